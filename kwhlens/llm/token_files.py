"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by doc_id.  Each partition is encoded
and written as three flat little-endian files: ``.bin`` (token ids, uint16 if the
vocabulary allows it, else uint32), ``.off`` (uint64, the first token of each document
in the part and the part's end) and ``.ids`` (int64 doc_ids).  The prefix sums of the
partitions' token counts are their bases, so a document's global start is base +
offset.  Reading maps the files into memory.

Encoding uses the tokenizers library.  White space never is part of a token of
a tokenizer that splits at it, so a text's ids are those of its ASCII-space-separated
words in order.  Each distinct word of a chunk (in small letters if the tokenizer makes
them so) is encoded once and kept in a bounded table of the Python worker; texts are put together
from it by NumPy.  With a tokenizer that isn't known to split so, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwhlens.llm.shared_files import AtomicFile, mapped, open_folder
from kwhlens.llm.words import slices, text_buffers, word_hashes

#: Words whose ids a worker keeps (about 30 bytes each); beyond it the table starts anew.
TABLE_WORDS = 3_000_000
#: Text bytes put together at once.
CHUNK_BYTES = 8 << 20
#: Marks that are tokens of their own after a word of letters.
_MARKS = ".,;:!?"
#: Fixed value: the split pattern by which words can be encoded one by one.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_at_space(spec: dict) -> bool:
    """Whether the file is a BPE whose words end in ``</w>``, split by ``_WORDS``, with known normalizers only."""
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = split[0]
    kinds = {x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {"type": "NFC"}])}
    return (spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>"
            and first.get("pattern") == {"Regex": _WORDS} and first.get("invert") is True
            and first.get("behavior") == "Removed" and kinds <= {"NFC", "Replace", "Lowercase"}
            and all(x.get("type") == "ByteLevel" and not x.get("use_regex") and not x.get("add_prefix_space") for x in split[1:]))


def _all_letters(word: str) -> bool:
    """True if the tokenizer sees letters only: also composed and in small letters, some of which end in a mark."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordEncoder:
    """Token ids of texts by way of their distinct words."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._reset()
        parsed = json.loads(spec)
        self.by_words = _splits_at_space(parsed)
        self.lower = "Lowercase" in json.dumps(parsed.get("normalizer"))
        if not self.by_words:
            return
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.mark = {m: self._each([m])[0] for m in _MARKS}

    def _reset(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _each(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in
                self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters: encoded together, parted after each word's last id."""
        out: list[np.ndarray] = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                out += np.split(ids, cuts[:-1])
            else:
                out += self._each(part)
        return out

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        core = [w[:-1] if w[-1] in self.mark else w for w in words]
        plain = [i for i, c in enumerate(core) if _all_letters(c)]
        rest = [i for i, c in enumerate(core) if not _all_letters(c)]
        out: list = [None] * len(words)
        stems = list(dict.fromkeys(core[i] for i in plain))
        ids = dict(zip(stems, self._letters(stems)))
        for i in plain:
            stem = ids[core[i]]
            out[i] = stem if len(core[i]) == len(words[i]) else np.concatenate([stem, self.mark[words[i][-1]]])
        for i, x in zip(rest, self._each([words[i] for i in rest])):
            out[i] = x
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        new = self._encode(words)
        count = np.array([len(x) for x in new], np.int64)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *new])
        every = np.concatenate([self.hash, hashes])
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, their count per document)."""
        if not self.by_words:
            text = raw[int(off[0]) : int(off[-1])].tobytes()
            at = (off - off[0]).tolist()
            own = self._each([text[a:b].decode("utf-8") for a, b in zip(at, at[1:])])
            return np.concatenate([np.zeros(0, np.uint32), *own]), np.array([len(x) for x in own], np.int64)
        parts = [word_hashes(raw, off[i : j + 1], spans=True, lower=self.lower) for i, j in slices(off)]
        bases = [int(off[i] - off[0]) for i, _ in slices(off)]
        words = np.concatenate([p[0] for p in parts])
        spans = np.concatenate([p[2] + b for p, b in zip(parts, bases)])
        n_words = np.concatenate([np.diff(p[1]) for p in parts])
        distinct, at, back = np.unique(words, return_index=True, return_inverse=True)
        if len(self.hash) + len(distinct) > TABLE_WORDS:
            self._reset()
        where = np.searchsorted(self.hash, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.hash):
            known = self.hash[np.minimum(where, len(self.hash) - 1)] == distinct
        if not known.all():
            text = raw[int(off[0]) : int(off[-1])].tobytes()
            missing = at[~known]
            self._learn(distinct[~known], [text[a:b].decode("utf-8") for a, b in spans[missing].tolist()])
            where = np.searchsorted(self.hash, distinct)
        count, first = self.count[where][back], self.first[where][back]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(first - (ends - count), count)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        return ids, np.diff(upto)


_encoders: dict[int, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]


def _write_map(shared, folder: str, end_id: int | None, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kwhlens.llm import token_files  # the worker's own module keeps the word table

        encoder = token_files._encoder(shared.value)
        system, path = open_folder(folder)
        part = TaskContext.get().partitionId()
        name = f"{path}/part-{part:06d}"
        n_docs, n_tokens, n_null = 0, 0, 0
        with (AtomicFile(system, f"{name}.bin") as out, AtomicFile(system, f"{name}.off") as offsets,
              AtomicFile(system, f"{name}.ids") as doc_ids):
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                raw, off = text_buffers(batch.column(1))
                n_null += batch.column(0).null_count  # they come first
                own = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                for i, j in slices(off, CHUNK_BYTES):
                    ids, count = encoder.encode(raw, off[i : j + 1])
                    if end_id is not None:
                        ids = np.insert(ids, np.cumsum(count), end_id)
                        count = count + 1
                    out.write(ids.astype(dtype).tobytes())
                    offsets.write((n_tokens + np.cumsum(count)).astype("<u8").tobytes())
                    doc_ids.write(own[i:j].tobytes())
                    n_tokens += int(count.sum())
                    n_docs += j - i
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()),
            "n_tokens": pa.array([n_tokens], pa.int64()), "n_null": pa.array([n_null], pa.int64())})

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Writes the token files into ``folder`` and returns their manifest (part, base, n_docs, n_tokens, n_null, dtype).

    Documents are in ascending doc_id order, those without doc_id first (``n_null`` of a
    part) and rows that repeat a doc_id in the order of their texts; each row is a
    document.  Null and empty texts have no ids but the end id.  Other columns are
    not read.  An empty table gives an empty manifest.  ``end_id`` (if any)
    follows each document.  Rows without doc_id, or of one doc_id, are dealt over tasks by the
    beginnings of their texts.  The manifest has a row per partition; its prefix
    sums are taken on the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer

    size = Tokenizer.from_str(spec).get_vocab_size()
    dtype = "<u2" if max(size, (end_id or 0) + 1) <= 1 << 16 else "<u4"
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), base.rdd.getNumPartitions())
    parts = (base.repartitionByRange(n, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
             .mapInArrow(_write_map(spark.sparkContext.broadcast(spec), folder, end_id, dtype),
                         "part long, n_docs long, n_tokens long, n_null long").collect())
    rows, start = [], 0
    for r in sorted(parts):
        rows.append((r.part, start, r.n_docs, r.n_tokens, r.n_null, dtype))
        start += r.n_tokens
    return spark.createDataFrame(rows, "part long, base long, n_docs long, n_tokens long, n_null long, dtype string")


def _read_map(folder: str, docs_at_once: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if not r["n_docs"]:
                    continue
                name = f"{path}/part-{r['part']:06d}"
                tokens = mapped(system, f"{name}.bin", r["dtype"])
                off, ids = mapped(system, f"{name}.off", "<u8"), mapped(system, f"{name}.ids", "<i8")
                for i in range(0, r["n_docs"], docs_at_once):
                    at = off[i : i + docs_at_once + 1].astype(np.int64)
                    wide = tokens[at[0] : at[-1]].astype("<u4").tobytes()
                    edge = ((at - at[0]) * 4).tolist()
                    own = [None if i + k < r["n_null"] else x for k, x in enumerate(ids[i : i + docs_at_once].tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, pa.int64()),
                        "start": pa.array(r["base"] + at[:-1]), "n_tokens": pa.array(np.diff(at)),
                        "tokens": pa.array([wide[a:b] for a, b in zip(edge, edge[1:])], pa.binary())})

    return run


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) per document; ``tokens`` holds its ids as little-endian uint32."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(
        _read_map(folder), "doc_id long, start long, n_tokens long, tokens binary")
