"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts over ``LONG`` characters are cut at boundaries that no match of the split
pattern can cross: after a letter or number, before a space or newline, or
before a mark that is neither space, letter nor number.  There every match ends,
whatever follows, and the next one starts as it would in the whole text; so the
pieces' ids, put together, are those of the whole text.  A run without such
a boundary stays whole.

Long runs of white space would exhaust the stack of the library's pattern matcher, so they don't reach it:
such a run is one match up to its last character (at the text's end, with it), and the
last one begins the following match.  Its bytes are encoded as one piece, without the pattern.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwhlens.llm.words import parts, tidy

#: Characters from which on a text is cut, and the least length of a piece.
LONG = 1 << 16
#: White-space characters in a row from which on a run is encoded without the pattern.
LONG_SPACE = 1 << 12
_BOUNDARY = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n]|[^\s\p{L}\p{N}])")


@functools.lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file's content, kept by the Python worker."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of at least ``long`` characters."""
    at = 0
    while len(text) - at > long:
        m = _BOUNDARY.search(text, at + long)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@functools.lru_cache(maxsize=4)
def _space_run(least: int) -> regex.Pattern:
    return regex.compile(rf"\p{{White_Space}}{{{least},}}")


def encode_text(enc: tiktoken.Encoding, text: str, long: int = LONG, long_space: int = LONG_SPACE) -> list[list[int]]:
    """The ids of a whole text, in lists to be put together."""
    out, at = [], 0
    for run in _space_run(max(2, long_space)).finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += [enc.encode_ordinary(piece) for piece in pieces(text[at : run.start()], long)]
        out.append(enc._encode_single_piece(text[run.start() : end].encode()))
        at = end
    return out + [enc.encode_ordinary(piece) for piece in pieces(text[at:], long)]


def _encode_map(shared, pattern: str, long: int, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in parts(batches, 128):
            held, ends, raw, n = [], [0], [], 0
            for text in pc.fill_null(batch.column(1), "").to_pylist():
                own = encode_text(enc, text, long)
                held += [np.array(x, dtype=np.int32) for x in own]
                n += sum(map(len, own))
                ends.append(n)
                if decoded:
                    raw.append(b"".join(map(enc.decode_bytes, own)))
            ids = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate(held) if held else np.zeros(0, np.int32)))
            cols = [batch.column(0), ids] + ([pa.array(raw, pa.binary())] if decoded else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)])

    return run


def _decode_map(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                raw = [None if x is None else enc.decode_bytes(x) for x in ids.slice(lo, 128).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           long: int = LONG, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): every whole text as token ids, without special tokens.

    With ``decoded`` also the raw bytes that the ids decode to, in the same pass (one
    Python worker and one table of ranks per task instead of two).

    Null texts are empty (no ids).  Each row gives a row, repeated or not, with or without
    a doc_id; other columns are not read.  The rank file (under 1 MB) is read
    on the driver and sent to the executors.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_encode_map(shared, pattern, long, decoded)),
                           "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``tokens`` (doc_id, ids) with the column ``decoded``: the raw bytes of the ids (null for null ids)."""
    with open(rank_file, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())
    return tokens.select("doc_id", "ids").mapInArrow(
        tidy(_decode_map(shared, pattern)), "doc_id long, ids array<int>, decoded binary")
