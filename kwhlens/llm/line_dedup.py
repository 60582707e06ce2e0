"""Line deduplication by site-relative frequency, in DataFrame functions only.

For each host the pages that hold a line are counted; a line on more than
``ratio`` of the host's pages (and on at least ``min_pages``) is boilerplate there
and is dropped from all of the host's pages.  Lines are compared without
leading and trailing spaces, by their 64-bit hash; blank lines stay.

The counts are partial sums per task, so a hot host or line costs one row per
task.  A page of l lines adds at most l / ratio boilerplate lines to its host on
average, so the list per host is as small as a page.  The lists are sent to
all executors only if they have at most ``BROADCAST_LINES`` lines together;
otherwise they are joined by host, where Spark splits a hot host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhlens.session import Scratch

RATIO = 0.1
MIN_PAGES = 3
#: Boilerplate lines (8 bytes each) broadcast at most.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                      ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, pages, host_pages) of the lines to drop."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).where("host is not null")
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))).alias("line_hash"))
    counts = lines.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("pages")).where(f"pages >= {min_pages}")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return counts.join(totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def drop_site_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                    ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with a cleaned text column and the added columns n_lines and n_dropped.

    A row is a page: repeated rows count each.  Pages without host, and null
    texts (0 lines), are left as they are; an empty text has one blank line.  A page
    that loses all its lines keeps an empty text.  Columns of ``docs`` named
    n_lines or n_dropped are replaced; any other extra column is kept.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    bad = scratch.table(
        boilerplate_lines(docs, text_col, host_col, ratio, min_pages).select("host", "line_hash"), "boilerplate")
    lists = bad.groupBy("host").agg(F.collect_set("line_hash").alias("_bad")).withColumnRenamed("host", "_host")
    if bad.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    pages = docs.select(F.struct(*own).alias("page"), F.col(host_col).alias("host"),
                        F.split(text_col, "\n").alias("lines")).join(lists, F.col("host") == F.col("_host"), "left")
    kept = F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_bad", _key(x)))
    clean = pages.select("page", "lines", F.when(F.col("_bad").isNotNull(), kept).alias("kept"))
    return clean.select(
        *[F.when(F.col("kept").isNull(), F.col("page")[c]).otherwise(F.array_join("kept", "\n")).alias(c)
          if c == text_col else F.col("page")[c].alias(c) for c in own],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
