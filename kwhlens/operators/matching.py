"""Control-standardised k-nearest-neighbour matching.

Candidate pairs are treated × control units of the same cohort ``Ti``.  A
cohort is a hot key by nature (few cohorts, many units each), so the join
never runs on ``Ti`` alone:

* **salting** — a cohort's controls are dealt over as many salts as its
  measured size asks for (``rows_per_salt`` controls each); treated rows are
  replicated to their cohort's salts only.
* **blocking** (summary matching) — pairs in the admissible band
  ``|c − t| <= thr·|t|`` are a fixed share of all, so they aren't listed: each
  salt searches its controls by boxes (``band_knn``), exactly.
* **top-k** uses ``row_number() <= k``; Spark inserts a partial
  ``WindowGroupLimit`` before the shuffle, so at most k candidates per treated
  unit and map task cross the network.

Without blocking, cohorts of many pairs are matched by pivots (``pivot_knn``), exactly and
without listing the treated × control pairs.

Equal distances are ordered by control id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kwhlens.operators.band_knn import nearest_in_band
from kwhlens.operators.pivot_knn import nearest_controls
from kwhlens.session import Scratch

#: Without blocking, treated × control pairs of all cohorts up to which they are simply compared; beyond it by pivots.
PLAIN_PAIRS = 20_000_000
#: Controls of a cohort that one salt holds.
ROWS_PER_SALT = 20_000


def _split(profiles_z: DataFrame, cols: Sequence[str]):
    keep = ["Ti", "id", *cols]
    t = profiles_z.where(F.col("group") == "treated").select(*keep)
    c = profiles_z.where(F.col("group") == "control").select(*keep)
    return t, c


def _salt(t: DataFrame, c: DataFrame, rows_per_salt: int):
    # one row per cohort (adoption dates: bounded by the calendar)
    sizes = c.groupBy("Ti").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, int(rows_per_salt)))).cast("int").alias("_salts"))
    c = c.join(F.broadcast(sizes), "Ti").withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int"))
    t = t.join(F.broadcast(sizes), "Ti").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return t.drop("_salts"), c.drop("_salts")


def _prefix(df: DataFrame, p: str, keys: Sequence[str]) -> DataFrame:
    return df.selectExpr(*[f"`{x}`" if x in keys else f"`{x}` AS `{p}{x}`" for x in df.columns])


def candidate_pairs(
    profiles_z: DataFrame,
    feature_cols: Sequence[str],
    complete_case: bool,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Treated × control pairs of one cohort: ``Ti, t_id, c_id, t_<f>_z, c_<f>_z``."""
    zc = [f"{c}_z" for c in feature_cols]
    t, c = _split(profiles_z, zc)
    if complete_case:
        ok = F.lit(True)
        for z in zc:
            ok = ok & F.col(z).isNotNull()
        t, c = t.where(ok), c.where(ok)
    keys = ["Ti", "_salt"]
    t, c = _salt(t, c, rows_per_salt)
    tp, cp = _prefix(t, "t_", keys), _prefix(c, "c_", keys)
    return tp.join(cp, keys).where(F.col("t_id") != F.col("c_id"))


def _by_pivots(profiles_z: DataFrame, prune: bool | None) -> bool:
    """Whether to prune by pivots: as told, or by the measured number of pairs (both ways give the same result)."""
    if prune is not None:
        return prune
    sizes = profiles_z.groupBy("Ti").agg(*[
        F.count(F.when(F.col("group") == g, 1)).alias(g) for g in ("treated", "control")])
    return (sizes.agg(F.sum(F.col("treated") * F.col("control"))).first()[0] or 0) > PLAIN_PAIRS


def _written(profiles_z: DataFrame, feature_cols: Sequence[str], prune: bool | None) -> DataFrame:
    """The columns that matching reads as a table, unless only one plan reads them: counting, dealing and searching do."""
    if prune is False:
        return profiles_z
    return Scratch(profiles_z.sparkSession, "units").table(
        profiles_z.select("Ti", "id", "group", *[f"{c}_z" for c in feature_cols]), "z")


def _pivot_matches(profiles_z: DataFrame, feature_cols: Sequence[str], complete_case: bool, k: int, rows_per_salt: int,
                   **options) -> DataFrame:
    zc = [f"{c}_z" for c in feature_cols]
    t, c = _split(profiles_z.dropna(subset=zc) if complete_case else profiles_z, zc)
    matches, _ = nearest_controls(t, c, zc, k, rows_per_salt=rows_per_salt, **options)
    return matches.select(F.col("t_id").alias("treated_id"), F.col("c_id").alias("control_id"),
                          F.col("Ti").alias("adoption_month"), "distance", "valid_dim", "match_rank")


def _top_k(cand: DataFrame, k: int, extra: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy("Ti", "t_id").orderBy(F.col("distance").asc(), F.col("c_id").asc())
    return (
        cand.withColumn("match_rank", F.row_number().over(w))
        .where(F.col("match_rank") <= k)
        .select(
            F.col("t_id").alias("treated_id"),
            F.col("c_id").alias("control_id"),
            F.col("Ti").alias("adoption_month"),
            "distance",
            *extra,
            "match_rank",
        )
    )


def match_topk(
    profiles_z: DataFrame,
    feature_cols: Sequence[str],
    k_neighbors: int = 5,
    blocking_threshold: float = 0.3,
    use_peak_blocking: bool = True,
    peak_block_col: str = "peak_mean",
    rows_per_salt: int = ROWS_PER_SALT,
    prune: bool | None = None,
) -> DataFrame:
    """Complete-case Euclidean kNN, optional peak blocking on the raw feature.

    Without blocking, ``prune`` chooses the pivot join (None: by the measured number of pairs).
    """
    block = peak_block_col if (use_peak_blocking and peak_block_col in feature_cols) else None
    zc = [f"{c}_z" for c in feature_cols]
    if block is not None:
        cols = list(dict.fromkeys([*zc, block]))
        complete = " AND ".join(f"`{x}` IS NOT NULL" for x in ["id", *cols])
        t, c = (side.where(complete) for side in _split(profiles_z, cols))
        return _top_k(nearest_in_band(t, c, zc, block, k_neighbors, float(blocking_threshold), rows_per_salt), k_neighbors)
    profiles_z = _written(profiles_z, feature_cols, prune)
    if _by_pivots(profiles_z, prune):
        return _pivot_matches(profiles_z, feature_cols, True, k_neighbors, rows_per_salt).drop("valid_dim")
    cand = candidate_pairs(profiles_z, feature_cols, True, rows_per_salt)
    d2 = sum((F.pow(F.col(f"t_{c}_z") - F.col(f"c_{c}_z"), 2) for c in feature_cols), F.lit(0.0))
    return _top_k(cand.withColumn("distance", F.sqrt(d2)), k_neighbors)


def default_min_valid_dim(dim: int, share: float = 0.3) -> int:
    return max(2, int(dim * share))


def _missing_aware(cand: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    both = [f"`t_{c}_z` IS NOT NULL AND `c_{c}_z` IS NOT NULL" for c in feature_cols]
    sq = " + ".join(f"CASE WHEN {b} THEN pow(`t_{c}_z` - `c_{c}_z`, 2) ELSE 0.0 END"
                    for b, c in zip(both, feature_cols))
    cnt = " + ".join(f"CASE WHEN {b} THEN 1 ELSE 0 END" for b in both)
    return cand.selectExpr("*", f"{cnt} AS valid_dim", f"{sq} AS _sq")


def match_topk_allow_missing(
    profiles_z: DataFrame,
    feature_cols: Sequence[str],
    k_neighbors: int = 5,
    min_valid_dim: int | None = None,
    min_valid_share: float = 0.3,
    rows_per_salt: int = ROWS_PER_SALT,
    prune: bool | None = None,
) -> DataFrame:
    """Distance over dimensions present on both sides, ``sqrt(Σ d² / valid_dim)``;
    pairs with fewer than ``max(2, int(0.3·dim))`` shared dimensions are dropped.

    ``prune`` chooses the pivot join (None: by the measured number of pairs).
    """
    if min_valid_dim is None:
        min_valid_dim = default_min_valid_dim(len(feature_cols), min_valid_share)
    profiles_z = _written(profiles_z, feature_cols, prune)
    if _by_pivots(profiles_z, prune):
        return _pivot_matches(profiles_z, feature_cols, False, k_neighbors, rows_per_salt, min_valid=min_valid_dim,
                              per_feature=True)
    cand = _missing_aware(candidate_pairs(profiles_z, feature_cols, False, rows_per_salt), feature_cols)
    cand = cand.where(F.col("valid_dim") >= min_valid_dim).withColumn(
        "distance", F.sqrt(F.col("_sq") / F.col("valid_dim"))
    )
    return _top_k(cand, k_neighbors, extra=["valid_dim"])


def valid_dim_distribution(profiles_z: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Number of candidate pairs per count of shared dimensions.

    Only which features are present matters, so profiles are counted per
    (cohort, role, presence mask) and masks are paired instead of units; pairs of a unit with
    itself (one that is in both roles of a cohort) are taken off.
    """
    wide = len(feature_cols) > 63
    if wide:
        raise ValueError("at most 63 features")
    mask = " + ".join(f"CASE WHEN `{c}_z` IS NOT NULL THEN {1 << i}L ELSE 0L END" for i, c in enumerate(feature_cols))
    masked = profiles_z.selectExpr("Ti", "id", "`group`", f"{mask} AS mask").where("`group` IN ('treated', 'control')")
    t, c = masked.where("`group` = 'treated'"), masked.where("`group` = 'control'")

    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("Ti", F.col("mask").alias(f"{name}_mask")).agg(F.count(F.lit(1)).alias(f"{name}_n"))

    shared = F.bit_count(F.col("t_mask").bitwiseAND(F.col("c_mask"))).cast("int").alias("valid_dim")
    pairs = counted(t, "t").join(counted(c, "c"), "Ti").select(shared, (F.col("t_n") * F.col("c_n")).alias("n"))
    own = t.select("Ti", "id", F.col("mask").alias("t_mask")).join(
        c.select("Ti", "id", F.col("mask").alias("c_mask")), ["Ti", "id"]).select(shared, F.lit(-1).cast("long").alias("n"))
    return pairs.union(own).groupBy("valid_dim").agg(F.sum("n").alias("count")).where("count > 0").orderBy("valid_dim")


def matched_ids(matches: DataFrame) -> DataFrame:
    """Distinct treated and control units per cohort with their role."""
    tr = matches.select(F.col("treated_id").alias("id"), F.col("adoption_month").alias("Ti")).distinct()
    co = matches.select(F.col("control_id").alias("id"), F.col("adoption_month").alias("Ti")).distinct()
    return tr.withColumn("group", F.lit("treated")).unionByName(co.withColumn("group", F.lit("control")))


def build_matched_profiles(profiles_z: DataFrame, matches: DataFrame) -> DataFrame:
    """Profiles of matched units only, role taken from the matches."""
    ids = matched_ids(matches).withColumnRenamed("group", "_mgroup")
    out = profiles_z.join(ids, ["id", "Ti"], "inner").drop("group").withColumnRenamed("_mgroup", "group")
    return out.select(*[c if c != "_mgroup" else "group" for c in profiles_z.columns])
