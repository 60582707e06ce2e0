"""Weighted two-way fixed-effects DiD and event studies.

Model (per group — pooled, per cohort, per price …):
``y_it = α_i + λ_t + x_itᵀβ + e_it`` with weights w, entity i, month t.

**Residualisation in closed form.**  Instead of alternating weighted
demeaning sweeps, the time effects solve the small normal system

    M b = R,   M = diag(Σ_i S_it) − Σ_i S_i S_iᵀ / W_i,   R = Σ_i (Sx_i − S_i X_i / W_i)

(S_it = Σ w in cell (i,t), W_i = Σ_t S_it, Sx/X the same for w·x).  M is
T×T with T = months in the group, so the solve is bounded by the calendar,
not by the data.  Residual = (x − b_t) − weighted entity mean of (x − b_t).

Distribution:
1. panel rows are hash-partitioned by (group, entity) and sorted; a
   ``mapInPandas`` pass turns each complete entity into its contribution to
   M and R with numpy, folds them batch by batch into one group's running
   matrices, and emits only T² + T·p sums per partition and group;
2. partial sums are summed by Spark; one ``applyInPandas`` per group solves
   with a pseudo-inverse (group input ≤ T² rows) and counts the components of the
   entity–month graph and the ranks of both systems (``identification``);
3. b is broadcast back (≤ groups × T rows), entity means are a window over
   (group, entity) — bounded by months per entity;
4. WLS: the first pass also sums the within-entity cross products Q of [y, x], so the
   Gram matrix after both effects is Q − Rᵀb and β is solved per group without a
   table of residuals; a second pass over the same partitions makes the cluster
   scores ``Σ w·x̃·e``, whose products are summed to the meat.

Cluster-robust variance follows the public statsmodels defaults for
``WLS(...).fit(cov_type='cluster')``: V = c·G⁻¹ (Σ_g s_g s_gᵀ) G⁻¹ with
c = n_clusters/(n_clusters−1) · (N−1)/(N−K), normal p-values, ±1.96·se.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwhlens.functions.stats import normal_two_sided_p

CI_Z = 1.96
PINV_RCOND = 1e-10
#: Treated units that a cohort needs to be fitted on its own.
MIN_TREATED = 30
_SEP = "\x1f"


# --------------------------------------------------------------------------- D1
def weighted_group_mean(df: DataFrame, cols: Sequence[str], group_col: str, weight_col: str) -> DataFrame:
    """Σw·x / Σw per group for several columns."""
    w = F.col(weight_col).cast("double")
    return df.groupBy(group_col).agg(
        *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in cols]
    )


# --------------------------------------------------------------------------- D2
class _TimeSums:
    """Running M (T x T) and R (T x p) of one group; T grows to the group's months."""

    def __init__(self, group: str, p: int):
        self.group, self.at = group, {}
        self.M, self.R = np.zeros((0, 0)), np.zeros((0, p))

    def add(self, times: np.ndarray, M: np.ndarray, R: np.ndarray) -> None:
        idx = [self.at.setdefault(t, len(self.at)) for t in times]
        more = len(self.at) - len(self.M)
        if more:
            self.M, self.R = np.pad(self.M, ((0, more), (0, more))), np.pad(self.R, ((0, more), (0, 0)))
        self.M[np.ix_(idx, idx)] += M
        self.R[idx] += R

    def frame(self) -> pd.DataFrame:
        times = np.array(list(self.at))
        i, j = np.nonzero(self.M)
        t, c = np.indices(self.R.shape).reshape(2, -1)
        return pd.DataFrame({
            "_g": self.group, "kind": ["M"] * len(i) + ["R"] * len(t), "a": np.concatenate([times[i], times[t]]),
            "b": np.concatenate([times[j], c.astype(str)]), "v": np.concatenate([self.M[i, j], self.R[t, c]])})


def residualize_twfe(
    data: DataFrame,
    cols: Sequence[str],
    entity_col: str = "entity_id",
    time_col: str = "month_id",
    weight_col: str = "match_weight",
    group_key: str = "_g",
) -> DataFrame:
    """Weighted two-way demeaning of ``cols`` within each ``group_key``.

    Rows with a missing value in any column, entity, time or weight are
    dropped first (as in the reference).  Returns the input columns plus
    ``<c>__r`` residual columns.
    """
    cols = list(cols)
    work = data.dropna(subset=[entity_col, time_col, weight_col, *cols])
    rows = work.select(
        F.col(group_key).alias("_g"),
        F.col(entity_col).cast("string").alias("_e"),
        F.col(time_col).cast("string").alias("_t"),
        F.col(weight_col).cast("double").alias("_w"),
        *[F.col(c).cast("double").alias(f"_x{j - 1}" if j else "_y") for j, c in enumerate(cols)],
    ).repartition("_g", "_e").sortWithinPartitions("_g", "_e")
    solved = _solved(rows, len(cols) - 1, False)
    # time effects: one row per (group, month) — bounded by the calendar
    bt = solved.select(F.col("_g").alias(group_key), F.explode(F.arrays_zip("times", "effects")).alias("z")).select(
        group_key, F.col("z.times").alias("__t"), *[F.col("z.effects")[j].alias(f"_b{j}") for j in range(len(cols))])
    out = work.withColumn("__t", F.col(time_col).cast("string")).join(F.broadcast(bt), [group_key, "__t"], "inner")
    # wide expression lists are written as SQL strings: one call per projection
    win = f"OVER (PARTITION BY `{group_key}`, `{entity_col}`)"
    w = f"CAST(`{weight_col}` AS DOUBLE)"
    out = out.selectExpr("*", *[f"CAST(`{c}` AS DOUBLE) - `_b{j}` AS `{c}__d`" for j, c in enumerate(cols)])
    out = out.selectExpr(
        "*", *[f"`{c}__d` - sum({w} * `{c}__d`) {win} / sum({w}) {win} AS `{c}__r`" for c in cols]
    )
    return out.drop("__t", *[f"_b{j}" for j in range(len(cols))], *[f"{c}__d" for c in cols])


# --------------------------------------------------------------------------- WLS
def _upper_pairs(K: int) -> list[tuple[int, int]]:
    """(k, m) with m >= k in row-major order (numpy ``triu_indices`` order)."""
    return [(k, m) for k in range(K) for m in range(k, K)]


def _sym(v, K: int) -> np.ndarray:
    """K×K symmetric matrix from its row-major upper triangle."""
    A = np.zeros((K, K))
    A[np.triu_indices(K)] = np.asarray(v, dtype=float)
    return A + A.T - np.diag(np.diag(A))


def _cov_fn(K: int):
    def cov(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            n, g, k = float(r["n_obs"]), float(r["n_clusters"]), float(r["k_params"])
            Gi = np.linalg.pinv(_sym(r["gram"], K), rcond=PINV_RCOND)
            corr = (g / (g - 1.0)) * ((n - 1.0) / (n - k)) if g > 1 and n > k else float("nan")
            V = corr * (Gi @ _sym(r["meat"], K) @ Gi)
            se = np.sqrt(np.clip(np.diag(V), 0, None))
            rows.append({"_g": r["_g"], "se": se.tolist()})
        return pd.DataFrame(rows, columns=["_g", "se"])

    return cov


def _whole_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of complete entities from batches sorted by group and entity."""
    carry = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        if not t.num_rows:
            continue
        last = pc.and_(pc.equal(t["_g"], t["_g"][-1]), pc.equal(t["_e"], t["_e"][-1]))
        others = np.flatnonzero(~last.to_numpy())
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield t.slice(0, cut)
        carry = t.slice(cut)
    if carry is not None and carry.num_rows:
        yield carry


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Start of every run of equal values in all columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _design(t: pa.Table, K: int, one_hot: bool) -> np.ndarray:
    """Outcome and K regressors of each row; one-hot regressors come as the index of the one that is 1 (or -1)."""
    X = np.zeros((t.num_rows, K + 1))
    X[:, 0] = t["_y"].to_numpy()
    if one_hot:
        k = t["_k"].to_numpy()
        rows = np.flatnonzero(k >= 0)
        X[rows, 1 + k[rows]] = 1.0
    else:
        for j in range(K):
            X[:, 1 + j] = t[f"_x{j}"].to_numpy()
    return X


class _NormalSums(_TimeSums):
    """Also Q = within-entity cross products of [y, x], and the counts of rows, entities and non-zero regressors."""

    def __init__(self, group: str, p: int):
        super().__init__(group, p)
        self.Q, self.count = np.zeros((p, p)), np.zeros(p + 1)

    def frame(self) -> pd.DataFrame:
        i, j = np.indices(self.Q.shape).reshape(2, -1)
        more = pd.DataFrame({
            "_g": self.group, "kind": ["Q"] * len(i) + ["C"] * len(self.count),
            "a": np.concatenate([i, np.arange(len(self.count))]).astype(str),
            "b": np.concatenate([j, np.zeros(len(self.count), int)]).astype(str),
            "v": np.concatenate([self.Q[i, j], self.count])})
        return pd.concat([super().frame(), more], ignore_index=True)


def _normal_map(K: int, one_hot: bool):
    """Sums of the normal equations of [time effects, y, x] after taking out the entity effects."""

    def fn(batches):
        sums = None
        for table in _whole_entities(batches):
            g = table["_g"].to_numpy()
            edge = [*_runs(g).tolist(), len(g)]
            for a, b in zip(edge, edge[1:]):
                if sums is not None and sums.group != g[a]:
                    yield pa.RecordBatch.from_pandas(sums.frame(), preserve_index=False)
                    sums = None
                sums = sums or _NormalSums(g[a], K + 1)
                t = table.slice(a, b - a)
                w, X = t["_w"].to_numpy(), _design(t, K, one_hot)
                start = _runs(t["_e"].to_numpy())
                ent = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(w))))
                tim, at = np.unique(t["_t"].to_numpy().astype(str), return_inverse=True)
                S = np.zeros((len(start), len(tim)))
                np.add.at(S, (ent, at), w)
                W, WX = S.sum(1), np.add.reduceat(w[:, None] * X, start, axis=0)
                by_time = np.zeros((len(tim), K + 1))
                np.add.at(by_time, at, w[:, None] * X)
                A = S / np.sqrt(W)[:, None]
                sums.add(tim, np.diag(S.sum(0)) - A.T @ A, by_time - S.T @ (WX / W[:, None]))
                sums.Q += (w[:, None] * X).T @ X - WX.T @ (WX / W[:, None])
                sums.count += [len(w), *np.count_nonzero(X[:, 1:], axis=0), len(start)]
        if sums is not None:
            yield pa.RecordBatch.from_pandas(sums.frame(), preserve_index=False)

    return fn


def _normal_solve(K: int):
    """One group's time effects b (T x (K + 1)), coefficients, Gram matrix, counts and what is identified."""

    def rank(x: np.ndarray) -> int:
        s = np.linalg.svd(x, compute_uv=False) if x.size else np.zeros(0)
        return int((s > PINV_RCOND * s.max()).sum()) if len(s) and s.max() > 0 else 0

    def components(M: np.ndarray) -> int:
        """Parts of the graph of months that are linked by an entity."""
        left, n = set(range(len(M))), 0
        while left:
            n, stack = n + 1, [left.pop()]
            while stack:
                near = left & set(np.flatnonzero(M[stack.pop()]).tolist())
                left -= near
                stack += near
        return n

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: d for k, d in pdf.groupby("kind")}
        times = np.unique(part["R"]["a"].to_numpy().astype(str))
        at = {t: i for i, t in enumerate(times)}
        M, R, Q = np.zeros((len(times),) * 2), np.zeros((len(times), K + 1)), np.zeros((K + 1, K + 1))
        for x, rows, cols in ((M, at.get, at.get), (R, at.get, int), (Q, int, int)):
            d = part.get("M" if x is M else "R" if x is R else "Q", pdf[:0])
            x[[rows(a) for a in d["a"]], [cols(b) for b in d["b"]]] = d["v"].to_numpy()
        b = np.linalg.pinv(M, rcond=PINV_RCOND) @ R
        G = Q - R.T @ b
        G = (G + G.T) / 2
        beta = np.linalg.pinv(G[1:, 1:], rcond=PINV_RCOND) @ G[1:, 0]
        c = part["C"].set_index("a")["v"]
        n, ones = float(c["0"]), np.array([c[str(k + 1)] for k in range(K)])
        return pd.DataFrame([{
            "_g": pdf["_g"].iloc[0], "times": times.tolist(), "effects": b.tolist(), "beta": beta.tolist(),
            "gram": G[1:, 1:][np.triu_indices(K)].tolist(), "varies": ((ones > 0) & (ones < n)).tolist(),
            "n_obs": int(n), "n_entities": int(c[str(K + 1)]), "n_components": components(M), "rank_time": rank(M),
            "rank_gram": rank(G[1:, 1:])}])

    return solve


def _solved(rows: DataFrame, K: int, one_hot: bool) -> DataFrame:
    """One row per group of ``rows`` (partitioned and sorted by group and entity); its arrays are bounded by the calendar and the regressors."""
    sums = rows.mapInArrow(_normal_map(K, one_hot), "_g string, kind string, a string, b string, v double").groupBy(
        "_g", "kind", "a", "b").agg(F.sum("v").alias("v"))
    return sums.groupBy("_g").applyInPandas(
        _normal_solve(K), "_g string, times array<string>, effects array<array<double>>, beta array<double>, "
                          "gram array<double>, varies array<boolean>, n_obs long, n_entities long, n_components int, "
                          "rank_time int, rank_gram int")


def _score_map(K: int, one_hot: bool):
    """(group, cluster, score): sums of w * x~ * e over each entity's rows of a cluster."""

    def fn(batches):
        for t in _whole_entities(batches):
            g, e, c, w = (t[x].to_numpy() for x in ("_g", "_e", "_c", "_w"))
            flat = t.combine_chunks()
            X = _design(t, K, one_hot) - pc.list_flatten(flat["_b"]).to_numpy().reshape(-1, K + 1)
            beta = pc.list_flatten(flat["_beta"]).to_numpy().reshape(-1, K)
            start = _runs(g, e)
            size = np.diff(np.append(start, len(w)))
            mean = np.add.reduceat(w[:, None] * X, start, axis=0) / np.add.reduceat(w, start)[:, None]
            X = X - np.repeat(mean, size, axis=0)
            u = X[:, 0] - (X[:, 1:] * beta).sum(1)
            part = _runs(g, e, c)
            s = np.add.reduceat((w * u)[:, None] * X[:, 1:], part, axis=0)
            yield pa.RecordBatch.from_pydict({
                "_g": pa.array(g[part].tolist(), pa.string()), "_c": pa.array(c[part].tolist(), pa.string()),
                "_s": pa.array(s.tolist(), pa.list_(pa.float64()))})

    return fn


def twfe_wls(
    data: DataFrame,
    outcome_col: str,
    regressors: Sequence[str],
    group_key: str = "_g",
    entity_col: str = "entity_id",
    time_col: str = "month_id",
    weight_col: str = "match_weight",
    cluster_col: str = "aID",
    one_hot: str | None = None,
) -> DataFrame:
    """WLS of y on regressors with entity and time effects, cluster-robust standard errors; one lazy plan.

    The regressors are numeric columns or, with ``one_hot``, the 0/1 columns
    that this integer column stands for (their index, or -1 for none); terms that
    never or always are 1 in a group are then left out of the result and of K.
    Rows with a missing value are dropped.  Two passes over the rows (partitioned once by group and
    entity): the first sums the normal equations, the second the cluster scores; neither
    dummies nor residuals are stored.
    Output: ``group_key, term, coef, std_error, p_value, ci_lower, ci_upper,
    n_obs, n_entities``.
    """
    regs, K, hot = list(regressors), len(regressors), one_hot is not None
    xs = [F.col(one_hot).cast("int").alias("_k")] if hot else [
        F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(regs)]
    rows = data.select(
        F.col(group_key).alias("_g"), F.col(entity_col).cast("string").alias("_e"),
        F.col(time_col).cast("string").alias("_t"), F.col(weight_col).cast("double").alias("_w"),
        F.col(cluster_col).cast("string").alias("_c"), F.col(outcome_col).cast("double").alias("_y"), *xs,
    ).dropna().repartition("_g", "_e")
    order = ["_g", "_e", "_c"]
    solved = _solved(rows.sortWithinPartitions(*order), K, hot)
    effects = solved.select("_g", "beta", F.explode(F.arrays_zip("times", "effects")).alias("z")).select(
        "_g", F.col("z.times").alias("_t"), F.col("z.effects").alias("_b"), F.col("beta").alias("_beta"))
    # sorted behind the join: the optimizer drops a sort in front of one
    scored = rows.join(F.broadcast(effects), ["_g", "_t"]).sortWithinPartitions(*order).mapInArrow(
        _score_map(K, hot), "_g string, _c string, _s array<double>")
    pairs = _upper_pairs(K)
    scores = scored.groupBy("_g", "_c").agg(
        F.expr("array(" + ", ".join(f"sum(_s[{k}])" for k in range(K)) + ")").alias("_s"))
    meat = scores.groupBy("_g").agg(
        F.expr("array(" + ", ".join(f"sum(_s[{k}] * _s[{m}])" for k, m in pairs) + ")").alias("meat"),
        F.count(F.lit(1)).alias("n_clusters"))
    k_params = F.size(F.filter("varies", lambda v: v)).cast("long") if hot else F.lit(K).cast("long")
    out = solved.withColumn("k_params", k_params).join(meat, "_g")
    ses = out.select("_g", "gram", "meat", "n_obs", "n_clusters", "k_params").groupBy("_g").applyInPandas(
        _cov_fn(K), "_g string, se array<double>")
    zipped = F.explode(F.arrays_zip(
        F.array(*[F.lit(r) for r in regs]).alias("term"), F.col("beta").alias("coef"), F.col("se").alias("std_error"),
        F.col("varies").alias("varies"))).alias("_z")
    long = out.join(ses, "_g").select("_g", "n_obs", "n_entities", zipped).where(
        F.col("_z.varies") if hot else F.lit(True)).select(
        F.col("_g").alias(group_key), "_z.term", "_z.coef", "_z.std_error", "n_obs", "n_entities")
    se = F.col("std_error")
    return long.select(
        group_key, "term", "coef", "std_error",
        F.when(se > 0, normal_two_sided_p(F.col("coef") / se)).alias("p_value"),
        (F.col("coef") - CI_Z * se).alias("ci_lower"),
        (F.col("coef") + CI_Z * se).alias("ci_upper"),
        "n_obs", "n_entities",
    )


# --------------------------------------------------------------------------- D3/D4
def _group_key(df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    if not group_cols:
        return df.withColumn("_g", F.lit("pooled"))
    return df.withColumn("_g", F.concat_ws(_SEP, *[F.col(c).cast("string") for c in group_cols]))


def _attach_groups(res: DataFrame, keyed: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    if not group_cols:
        return res.drop("_g")
    groups = keyed.select("_g", *group_cols).distinct()
    # one row per group (cohorts / prices): broadcast
    return res.join(F.broadcast(groups), "_g").drop("_g")


def _of_cohorts(panel: DataFrame, cohorts: Sequence[str] | None) -> DataFrame:
    return panel if cohorts is None else panel.where(F.col("cohort_id").isin(list(cohorts)))


def _cohort_stats(df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return df.groupBy("_g").agg(
        F.count_distinct(F.when(F.col("treatment") == 1, F.col("aID"))).alias("n_treated"),
        F.count_distinct(F.when(F.col("D") == 1, F.col("month_id"))).alias("n_periods"),
    )


def fit_basic_did(
    panel: DataFrame,
    outcome_col: str = "top3_mean_consumption",
    group_cols: Sequence[str] = (),
    entity_col: str = "entity_id",
    time_col: str = "month_id",
    weight_col: str = "match_weight",
    cluster_col: str = "aID",
    min_treated: int | None = MIN_TREATED,
    persist: str = "table",
    cohorts: Sequence[str] | None = None,
) -> DataFrame:
    """D3 (pooled) / D4 (``group_cols`` with ``cohort_id``): ``Y = α_i + λ_t + βD``.

    By cohort, cohorts with fewer than ``min_treated`` treated units are left out
    (None keeps all); ``cohorts`` restricts the panel to some cohort ids.

    Output: ``[group cols,] outcome, coef, std_error, p_value, ci_lower,
    ci_upper, [n_treated, n_periods,] n_obs, n_entities``.
    """
    from kwhlens.session import materialize

    cols = list(dict.fromkeys([*group_cols, outcome_col, "D", "treatment", "aID", "month_id", entity_col, time_col,
                               weight_col, cluster_col]))
    least = min_treated if "cohort_id" in group_cols else None
    keyed = materialize(_group_key(_of_cohorts(panel, cohorts).select(*cols), group_cols), persist)
    extra: list[str] = []
    data = keyed
    if least is not None:
        cs = _cohort_stats(keyed, group_cols)
        keep = cs.where(F.col("n_treated") >= least)
        data = keyed.join(F.broadcast(keep.select("_g")), "_g", "left_semi")
        extra = ["n_treated", "n_periods"]
    res = twfe_wls(data, outcome_col, ["D"], "_g", entity_col, time_col, weight_col, cluster_col)
    if extra:
        res = res.join(F.broadcast(cs), "_g")
    res = _attach_groups(res, keyed, group_cols)
    return res.select(*group_cols, F.lit(outcome_col).alias("outcome"), "coef", "std_error", "p_value",
                      "ci_lower", "ci_upper", *extra, "n_obs", "n_entities")


# --------------------------------------------------------------------------- D5-D7
def event_terms(event_window=(-12, 12), reference: int = -1) -> list[int]:
    return [k for k in range(event_window[0], event_window[1] + 1) if k != reference]


def _with_event_index(data: DataFrame, ks: Sequence[int], event_window) -> DataFrame:
    """The rows inside the window with ``_event``, the number of the one dummy that is 1 (-1: none)."""
    index = F.create_map(*[F.lit(x) for i, k in enumerate(ks) for x in (k, i)])
    return data.where(F.col("event_time").between(*event_window)).withColumn("_event", F.when(
        F.col("treatment") == 1, F.coalesce(F.try_element_at(index, F.col("event_time").cast("int")), F.lit(-1)))
        .otherwise(-1))


def fit_event_study(
    panel: DataFrame,
    outcome_col: str = "top3_mean_consumption",
    event_window=(-12, 12),
    reference: int = -1,
    group_cols: Sequence[str] = (),
    entity_col: str = "entity_id",
    time_col: str = "month_id",
    weight_col: str = "match_weight",
    cluster_col: str = "aID",
    min_treated: int | None = MIN_TREATED,
    persist: str = "table",
    cohorts: Sequence[str] | None = None,
) -> DataFrame:
    """D6 (pooled) / D7 (``group_cols`` with ``cohort_id``): event-time coefficients.

    Dummies with zero sum or zero variance in a group are not reported (the
    reference drops them before fitting; an all-zero column does not change
    the other estimates).  Groups without any valid dummy produce no rows; a
    pooled fit without any raises ``ValueError``.  ``min_treated`` and ``cohorts`` as in the basic fit.
    Output: ``[group cols, n_treated,] outcome, event_time, coef, std_error,
    p_value, ci_lower, ci_upper``.
    """
    from kwhlens.session import materialize

    ks = event_terms(event_window, reference)
    cols = list(dict.fromkeys([*group_cols, outcome_col, "event_time", "treatment", "aID", "month_id", "D",
                               entity_col, time_col, weight_col, cluster_col]))
    least = min_treated if "cohort_id" in group_cols else None
    keyed = materialize(_group_key(_of_cohorts(panel, cohorts).select(*cols), group_cols), persist)
    data = keyed
    if least is not None:
        cs = _cohort_stats(keyed, group_cols)
        data = keyed.join(F.broadcast(cs.where(F.col("n_treated") >= least).select("_g")), "_g", "left_semi")
    lo, hi = event_window
    data = _with_event_index(data, ks, event_window)
    if not group_cols and data.where("_event >= 0").isEmpty():
        raise ValueError(f"no treated row has an event time in {lo}..{hi} other than {reference}")
    res = twfe_wls(data, outcome_col, [str(k) for k in ks], "_g", entity_col, time_col, weight_col, cluster_col,
                   one_hot="_event")
    res = res.withColumn("event_time", F.col("term").cast("int"))
    extra = []
    if least is not None:
        res = res.join(F.broadcast(cs.select("_g", "n_treated")), "_g")
        extra = ["n_treated"]
    res = _attach_groups(res, keyed, group_cols)
    return res.select(*group_cols, *extra, F.lit(outcome_col).alias("outcome"), "event_time", "coef",
                      "std_error", "p_value", "ci_lower", "ci_upper")


def identification(
    panel: DataFrame,
    outcome_col: str = "top3_mean_consumption",
    event_window=None,
    reference: int = -1,
    group_cols: Sequence[str] = (),
    entity_col: str = "entity_id",
    time_col: str = "month_id",
    weight_col: str = "match_weight",
) -> DataFrame:
    """What a fit can identify, per group: of the basic DiD, or with ``event_window`` of the event study.

    ``n_components`` counts the parts of the entity–month graph: across parts months can't be compared, and each
    part has a free month, so ``rank_time`` = ``n_periods`` − ``n_components`` unless weights degenerate.
    ``rank_gram`` below ``n_regressors`` means that some direction of the coefficients is not identified and is
    set to 0 by the pseudo-inverse (estimates of least norm); ``identified`` says whether none is.
    Output: ``[group cols,] n_obs, n_entities, n_periods, n_components, rank_time, n_regressors, rank_gram, identified``.
    """
    keyed = _group_key(panel, group_cols)
    hot = event_window is not None
    ks = event_terms(event_window, reference) if hot else []
    K = len(ks) if hot else 1
    x = F.col("_event").cast("int").alias("_k") if hot else F.col("D").cast("double").alias("_x0")
    rows = (_with_event_index(keyed, ks, event_window) if hot else keyed).select(
        "_g", F.col(entity_col).cast("string").alias("_e"), F.col(time_col).cast("string").alias("_t"),
        F.col(weight_col).cast("double").alias("_w"), F.col(outcome_col).cast("double").alias("_y"), x,
    ).dropna().repartition("_g", "_e").sortWithinPartitions("_g", "_e")
    used = F.size(F.filter("varies", lambda v: v)) if hot else F.lit(K)
    out = _solved(rows, K, hot).select(
        "_g", "n_obs", "n_entities", F.size("times").alias("n_periods"), "n_components", "rank_time",
        used.alias("n_regressors"), "rank_gram", (F.col("rank_gram") >= used).alias("identified"))
    return _attach_groups(out, keyed, group_cols).select(*group_cols, *[c for c in out.columns if c != "_g"])


# --------------------------------------------------------------------------- D8-D10
def round_results(df: DataFrame, digits: int = 4) -> DataFrame:
    """Report rounding of the estimate columns."""
    cols = {c: F.round(c, digits) for c in ("coef", "std_error", "p_value", "ci_lower", "ci_upper") if c in df.columns}
    return df.withColumns(cols)


def coefficient_chart_data(results: DataFrame, outcome_col: str, cohorts: Sequence[str] | None = None) -> DataFrame:
    """Coefficients ±1.96·se for one outcome (optionally some cohorts), by event time."""
    df = results.where(F.col("outcome") == outcome_col)
    if cohorts is not None and "cohort_id" in df.columns:
        df = df.where(F.col("cohort_id").isin(list(cohorts)))
    df = df.withColumn("err_low", F.col("coef") - CI_Z * F.col("std_error")).withColumn(
        "err_high", F.col("coef") + CI_Z * F.col("std_error")
    )
    order = (["cohort_id"] if "cohort_id" in df.columns else []) + ["event_time"]
    return df.orderBy(*order)


def price_panels(matches: DataFrame, month_result: DataFrame, prices: Sequence[str] = ("high", "low", "all"),
                 outcome_col: str = "top3_mean_consumption") -> DataFrame:
    """One weighted panel for several price periods (``price`` stays a column;
    pass ``group_cols=['price']`` / ``['price', 'cohort_id']`` to the fits)."""
    from kwhlens.operators.matched import weighted_panel
    from kwhlens.operators.readings import price_slice

    mr = price_slice(month_result, list(prices))
    return weighted_panel(matches, mr, outcome_col)

