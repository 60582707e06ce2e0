"""Threshold-scaled document fingerprints, in DataFrame functions only.

A text is the set of its word 5-grams (lower case A-Z).  Each is hashed to 48
bits (the first 12 hex digits of its MD5), and every hash below ``fraction`` of
the range is retained, so a sketch grows with its text, the sketch of a union is the
union of the sketches, and containment can be estimated between texts of very
unequal lengths.  A text of which none is below keeps its smallest hash as a mark, so that only
texts without words have an empty sketch.  A mark isn't retained: it counts for likeness only, is left out of
containment, and goes when sketches are merged and one has retained hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kwhlens.session import Scratch

FRACTION = 1 / 8
SHINGLE = 5
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sketch(text: Column, fraction: float = FRACTION, shingle: int = SHINGLE) -> Column:
    """Sorted distinct retained hashes (array of 12 hex digits each); empty for null and wordless texts."""
    limit = _limit(fraction)

    def of_words(words: Column) -> Column:
        last = F.greatest(F.size(words) - shingle + 1, F.least(F.size(words), F.lit(1)))
        hashes = F.transform(
            F.when(F.size(words) > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
            lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, shingle), " ").cast("binary")), 1, 12))
        return of_hashes(hashes)

    def of_hashes(hashes: Column) -> Column:
        return let(hashes, lambda h: let(
            F.filter(h, lambda x: x < limit),
            lambda low: F.when((F.size(low) > 0) | (F.size(h) == 0), F.array_sort(F.array_distinct(low)))
            .otherwise(F.array(F.array_min(h)))))

    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOW), r"[\x20\x09-\x0D]+"),
                     lambda w: w != "")
    return let(words, of_words)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketched texts; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _limit(fraction: float) -> Column:
    return F.lit(f"{int(fraction * (1 << 48)):012x}")


def retained(a: Column, fraction: float = FRACTION) -> Column:
    """The hashes of a sketch below the threshold."""
    return F.filter(a, lambda x: x < _limit(fraction))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty sketch, null if a has words but no retained hash."""
    own = retained(a, fraction)
    both = F.size(F.array_intersect(own, retained(b, fraction)))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(own) > 0, both / F.size(own))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together: all retained hashes, or the smallest mark if there are none."""
    every = F.array_sort(F.array_union(a, b))
    return let(every, lambda e: let(
        retained(e, fraction), lambda low: F.when(F.size(low) > 0, low).otherwise(F.slice(e, 1, 1))))


def as_text(sketch_col: Column) -> Column:
    return F.array_join(sketch_col, "")


def following_ids(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, next_id) in descending order of distinct ids; after the last comes the first.

    Ids are dealt by ranges; the next id is found within the range, and for a range's
    last one from the head of the following range (a table of one row per partition).
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.table(
        ids.repartitionByRange(n, F.desc("doc_id")).select("doc_id", F.spark_partition_id().alias("part")), "ids")
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))
    after = Window.partitionBy(F.lit(0)).orderBy("part")
    heads = heads.select("part", F.coalesce(
        F.lead("head").over(after), F.first("head").over(after.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    within = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    return dealt.select("doc_id", "part", F.lead("doc_id").over(within).alias("inner")).join(
        F.broadcast(heads), "part").select("doc_id", F.coalesce("inner", "head").alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, sketch) of every text; null texts are empty.  Repeated rows give repeated rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"),
                       sketch(text, fraction, shingle).alias("sketch"))


def edit_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of each document, of its edited text, and their likeness.

    In descending order of doc_id, the last third (floor of n_chars / 3 code points) of a
    text is replaced by as many first code points of the next document's text (or all of it);
    after the last document comes the first.  Returns (doc_id, n_chars, edited,
    sketch, edited_sketch, next_sketch).

    Null texts are empty.  Of rows that repeat a doc_id the smallest text counts.
    Rows without doc_id have no place in the order and are left out.  A single document follows
    itself.  Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    order = scratch.table(following_ids(base, scratch), "order")
    if base.select("doc_id").count() > order.count():  # repeated ids
        base = base.groupBy("doc_id").agg(F.min("text").alias("text"))
    # each text is sketched once, and the sketch goes with it
    base = base.select("doc_id", "text", sketch(F.col("text"), fraction, shingle).alias("sketch"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    # how much of each document its predecessor takes
    wanted = base.select("doc_id", third.alias("take")).join(order, "doc_id").select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), "take")
    lent = base.join(wanted, "doc_id").select(
        F.col("before").alias("doc_id"), F.expr("substring(text, 1, take)").alias("piece"),
        F.col("sketch").alias("next_sketch"))
    edited = base.join(lent, "doc_id").select(
        "doc_id", "text", "sketch", "next_sketch",
        F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"),
                 "piece").alias("edited"))
    return edited.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited", "sketch",
        sketch(F.col("edited"), fraction, shingle).alias("edited_sketch"), "next_sketch")
