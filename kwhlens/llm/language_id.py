"""Language identification with language-bitmask n-gram filters.

Training keeps, for each language, the letter trigrams (lower case, with word
borders) that make up at least ``least_share`` of its trigrams.  They go into one
Bloom filter per language; the filters are bit-sliced: slot i of the table
holds bit i of all filters as one mask, so the AND of an n-gram's slots names all
languages that contain it.  A text's trigrams are looked up whole, the masks are
counted per language, and each count is corrected for the expected false
positives of that language's filter; the largest corrected share decides.

The classifier is fitted on a bounded sample of labelled rows: about
``rows_per_language`` of each language, chosen by a hash of the doc_id (a documented
parameter); prediction covers every row and its whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kwhlens.llm.words import mix, parts, tidy

#: Labelled rows of a language used for training, in expectation.
ROWS_PER_LANGUAGE = 4000
#: A trigram with a smaller share of its language's trigrams isn't kept; so at most 1 / LEAST_SHARE are.
LEAST_SHARE = 2e-5
HASHES = 2
MAX_LANGUAGES = 4096
UNKNOWN = "und"
#: Characters looked up at once (about 60 bytes of scratch each).
SLICE_CHARS = 1 << 17


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def letter_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of all texts, end of each text's trigrams).  A trigram is centred on each letter; 0 is a word border."""
    low = [t.lower() for t in texts]
    lengths = np.array([len(t) + 1 for t in low])
    cp = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    letter = table[np.minimum(cp, 0xFFFF)]
    for i in np.flatnonzero(cp > 0xFFFF):
        letter[i] = chr(cp[i]).isalpha()
    c = np.where(letter, cp, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    before = np.where(at > 0, c[at - 1], 0)
    grams = before | (c[at] << np.uint64(21)) | (c[at + 1] << np.uint64(42))
    return grams, np.searchsorted(at, np.cumsum(lengths))


def _parts(texts: list[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= SLICE_CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, c) summed per batch."""
    for batch in batches:
        langs, texts = (c.to_pylist() for c in batch.columns)
        for lang in sorted(set(langs)):
            for part in _parts([t for x, t in zip(langs, texts) if x == lang]):
                g, c = np.unique(letter_grams(part)[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g.view(np.int64)),
                    "c": pa.array(c.astype(np.int64))})


class MaskFilters:
    """Bloom filters of all languages, bit-sliced into one table of masks."""

    def __init__(self, grams: dict[str, np.ndarray], hashes: int = HASHES):
        self.languages = sorted(grams)
        self.hashes = hashes
        self.words = max(1, -(-len(self.languages) // 64))
        most = max([len(g) for g in grams.values()] + [64])
        self.slots = 1 << int(np.ceil(np.log2(8 * most)))
        self.table = np.zeros((self.words, self.slots), np.uint64)
        fill = []
        for i, lang in enumerate(self.languages):
            bit = np.uint64(1 << (i % 64))
            for at in self._at(grams[lang].astype(np.uint64)):
                self.table[i // 64][at] |= bit
            fill.append(np.count_nonzero(self.table[i // 64] & bit) / self.slots)
        #: Chance that a filter holds an n-gram that was not put in.
        self.false = np.array(fill) ** hashes

    def _at(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(grams)
        for i in range(self.hashes):
            yield ((h >> np.uint64(32 * (i % 2))) & np.uint64(self.slots - 1)).astype(np.int64)
            if i % 2:
                h = mix(h + np.uint64(i))

    def shares(self, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Corrected share of each text's trigrams that each language contains (texts x languages)."""
        n = np.diff(ends, prepend=0)
        out = np.zeros((len(n), len(self.languages)))
        for w in range(self.words):
            mask = None
            for at in self._at(grams):
                got = self.table[w][at]
                mask = got if mask is None else mask & got
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hit = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                count = np.diff(hit[ends], prepend=0)
                f = min(self.false[i], 0.999)
                out[:, i] = (count / np.maximum(n, 1) - f) / (1 - f)
        return np.clip(out, 0.0, 1.0)


def _predict_map(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: MaskFilters = shared.value
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            lang, score = [], []
            for part in _parts(texts):
                grams, ends = letter_grams(part)
                n = np.diff(ends, prepend=0)
                if filters.languages:
                    s = filters.shares(grams, ends)
                    best = s.argmax(1)
                    for i in range(len(part)):
                        lang.append(filters.languages[best[i]] if n[i] else UNKNOWN)
                        score.append(float(s[i, best[i]]) if n[i] else 0.0)
                else:
                    lang += [UNKNOWN] * len(part)
                    score += [0.0] * len(part)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """True for the rows that training must not see: crc32 of the doc_id's text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_language: int = ROWS_PER_LANGUAGE, least_share: float = LEAST_SHARE) -> MaskFilters:
    """Filters learned from the labelled rows that aren't held out.

    Rows without lang, text or doc_id teach nothing.  Repeated rows count each.  At most
    1 / least_share trigrams of a language reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
            & ~held_out(F.col("doc_id")))
    seen = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not seen:
        return MaskFilters({})
    keep = spark.createDataFrame(
        [(r.lang, int(min(1 << 30, (1 << 30) * rows_per_language / r.n))) for r in seen], "lang string, cut long")
    chosen = rows.join(F.broadcast(keep), "lang").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("cut")).select("lang", "text")
    counts = chosen.mapInArrow(tidy(_count_map), "lang string, gram long, c long").groupBy("lang", "gram").agg(
        F.sum("c").alias("c"))
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("c") >= F.lit(least_share) * F.col("total"))
    table = kept.select("lang", "gram").toArrow().to_pandas()
    grams = {r.lang: np.zeros(0, np.int64) for r in seen}
    grams |= {lang: part.to_numpy() for lang, part in table.groupby("lang")["gram"]}
    return MaskFilters(grams)


def predict(docs: DataFrame, filters: MaskFilters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1, the share of its trigrams that the language contains).

    Texts without a letter and null texts are ``und`` with score 0.  Of equally
    likely languages the first by name is taken.  Only the text decides; all
    columns pass through, and those named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])
    return rows.mapInArrow(tidy(_predict_map(shared, rows.columns.index(text_col))), schema)


def keep_known(docs: DataFrame, filters: MaskFilters, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` in a language the filters know: not ``und``, and with a score of at least ``least``."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever docs names its columns
    found = predict(plain, filters, f"c{docs.columns.index(text_col)}")
    known = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return known.select(*plain.columns).toDF(*docs.columns)
