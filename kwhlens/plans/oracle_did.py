"""DuckDB SQL of the weighted two-way fixed-effects fits.

Dense linear algebra in SQL: the normal equations of the time effects (after
taking out the entity effects) and of the regressors are summed as rows, laid
out as lists of lists, and solved by Gauss-Jordan elimination in a recursive
CTE; columns without a pivot are free and get 0.  If the regressors leave one
direction free, the estimates are projected onto the rest (minimum norm).
"""

from __future__ import annotations

from collections.abc import Sequence

_DONE = "1e-9"


def _eliminate(name: str, src: str, wide: str) -> str:
    """CTE ``name``(g, m): reduced rows of ``src``(g, n, m); ``wide`` is the number of columns."""
    new = (f"[CASE WHEN abs(m[k][k]) < {_DONE} THEN m[i] WHEN i = k THEN [x / m[k][k] FOR x IN m[k]]"
           f" ELSE [m[i][j] - m[i][k] / m[k][k] * m[k][j] FOR j IN range(1, {wide} + 1)] END FOR i IN range(1, n + 1)]")
    return f"""
{name}_s AS (
  SELECT g, n, CAST(1 AS BIGINT) AS k, m FROM {src}
  UNION ALL
  SELECT g, n, k + 1, {new} FROM {name}_s WHERE k <= n
),
{name} AS (SELECT g, n, m FROM {name}_s WHERE k = n + 1)"""


def normal_p(t: str) -> str:
    """Two-sided normal p as 1 - erf, by the series of positive terms of erf."""
    x = f"(abs({t}) / sqrt(2.0::DOUBLE))"
    terms = (f"list_sum([exp(2 * n * ln(2.0::DOUBLE) + (2 * n + 1) * ln({x}) + lgamma(n + 1) - lgamma(2 * n + 2))"
             " FOR n IN range(0, 150)])")
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN abs({t}) > 8 THEN 0.0::DOUBLE WHEN {t} = 0 THEN 1.0::DOUBLE"
            f" ELSE 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms} END")


def fit(src: str, group: str, outcome: str, regressors: Sequence[tuple[str, str]], drop_empty: bool) -> str:
    """CTEs ending in ``est``(g, term, coef, std_error, n_obs, n_entities).

    ``src`` has entity_id, month_id, match_weight, aID; ``regressors`` are (term, SQL).  With
    ``drop_empty`` a term that doesn't vary or sums to 0 in a group is left out.
    """
    xs = ", ".join([f"CAST({outcome} AS DOUBLE)", *[f"CAST({sql} AS DOUBLE)" for _, sql in regressors]])
    names = ", ".join(f"({j}, '{t}')" for j, (t, _) in enumerate(regressors, 1))
    keep = "sum(x) > 0 AND var_samp(x) > 0" if drop_empty else "true"
    return f"""
dat AS (SELECT row_number() OVER () AS rid, {group} AS g, entity_id AS e, month_id AS t, CAST(match_weight AS DOUBLE) AS w,
          aID AS cl, [{xs}] AS xl FROM {src} WHERE {outcome} IS NOT NULL AND match_weight IS NOT NULL),
allx AS (SELECT rid, g, e, t, w, cl, j, xl[j + 1] AS x FROM dat, unnest(range(0, {len(regressors) + 1})) r(j)),
terms(j, term) AS (VALUES {names}),
used AS (SELECT g, j, row_number() OVER (PARTITION BY g ORDER BY j) AS p FROM (
           SELECT g, j FROM allx WHERE j > 0 GROUP BY g, j HAVING {keep})),
x AS (SELECT allx.*, coalesce(p, 0) AS p FROM allx LEFT JOIN used USING (g, j) WHERE allx.j = 0 OR p IS NOT NULL),
size AS (SELECT g, max(p) AS kk FROM x GROUP BY g),
tim AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY t) AS ti FROM (SELECT DISTINCT g, t FROM dat)),
nt AS (SELECT g, max(ti) AS n FROM tim GROUP BY g),
cell AS (SELECT g, e, ti, sum(w) AS s FROM dat JOIN tim USING (g, t) GROUP BY ALL),
ent AS (SELECT g, e, sum(s) AS ws FROM cell GROUP BY ALL),
cx AS (SELECT g, e, ti, p, sum(w * x) AS sx FROM x JOIN tim USING (g, t) GROUP BY ALL),
esum AS (SELECT g, e, p, sum(sx) AS ex FROM cx GROUP BY ALL),
off AS (SELECT a.g, a.ti AS i, b.ti AS j, -sum(a.s * b.s / ws) AS v
        FROM cell a JOIN cell b USING (g, e) JOIN ent USING (g, e) GROUP BY ALL),
diag AS (SELECT g, ti AS i, ti AS j, sum(s) AS v FROM cell GROUP BY ALL),
rhs AS (SELECT g, i, n + 1 + p AS j, sum(v) AS v FROM (
          SELECT g, ti AS i, p, sx AS v FROM cx
          UNION ALL SELECT cell.g, cell.ti, p, -s * ex / ws FROM cell JOIN ent USING (g, e) JOIN esum USING (g, e))
        JOIN nt USING (g) GROUP BY ALL),
ent_m AS (SELECT g, i, j, sum(v) AS v FROM (
            SELECT * FROM off UNION ALL SELECT * FROM diag UNION ALL SELECT * FROM rhs) GROUP BY ALL),
full_m AS (SELECT nt.g, n, a.i, b.j, coalesce(v, 0) AS v
           FROM nt JOIN size USING (g), unnest(range(1, n + 1)) a(i), unnest(range(1, n + kk + 2)) b(j)
           LEFT JOIN ent_m ON ent_m.g = nt.g AND ent_m.i = a.i AND ent_m.j = b.j),
rows_m AS (SELECT g, n, i, list(v ORDER BY j) AS r FROM full_m GROUP BY ALL),
mat AS (SELECT g, n, list(r ORDER BY i) AS m FROM rows_m GROUP BY ALL),{_eliminate('fe', 'mat', 'len(m[1])')},
eff AS (SELECT g, ti, p, CASE WHEN abs(m[ti][ti] - 1) < 1e-6 THEN m[ti][n + 1 + p] ELSE 0 END AS b
        FROM fe JOIN size USING (g), unnest(range(1, n + 1)) a(ti), unnest(range(0, kk + 1)) c(p)),
dev AS (SELECT rid, x.g, e, cl, w, x.p, x - b AS d FROM x JOIN tim USING (g, t) JOIN eff ON eff.g = x.g
          AND eff.ti = tim.ti AND eff.p = x.p),
res AS (SELECT rid, g, e, cl, w, p, d - sum(w * d) OVER (PARTITION BY g, e, p) / sum(w) OVER (PARTITION BY g, e, p) AS r
        FROM dev),
gram AS (SELECT a.g, a.p AS i, b.p AS j, sum(a.w * a.r * b.r) AS v FROM res a JOIN res b USING (rid)
         WHERE a.p > 0 GROUP BY ALL),
aug AS (SELECT size.g, kk AS n, i, j, CASE WHEN j <= kk THEN (SELECT v FROM gram q WHERE q.g = size.g AND q.i = a.i AND q.j = b.j)
            WHEN j = 2 * kk + 1 THEN (SELECT v FROM gram q WHERE q.g = size.g AND q.i = a.i AND q.j = 0)
            WHEN j - kk = i THEN 1.0 ELSE 0.0 END AS v
        FROM size, unnest(range(1, kk + 1)) a(i), unnest(range(1, 2 * kk + 2)) b(j)),
rows_g AS (SELECT g, n, i, list(v ORDER BY j) AS r FROM aug GROUP BY ALL),
mat_g AS (SELECT g, n, list(r ORDER BY i) AS m FROM rows_g GROUP BY ALL),{_eliminate('sol', 'mat_g', '2 * n + 1')},
free AS (SELECT g, f FROM sol, unnest(range(1, n + 1)) a(f) WHERE abs(m[f][f] - 1) >= 1e-6),
nul AS (SELECT g, p, CASE WHEN p = f THEN 1.0::DOUBLE ELSE -m[p][f] END AS v FROM sol JOIN free USING (g), unnest(range(1, n + 1)) a(p)),
len AS (SELECT g, sum(v * v) AS vv FROM nul GROUP BY g),
proj AS (SELECT sol.g, i, j, CAST(i = j AS INT) - coalesce(x.v * y.v / vv, 0) AS v
         FROM sol CROSS JOIN unnest(range(1, n + 1)) a(i) CROSS JOIN unnest(range(1, n + 1)) b(j)
         LEFT JOIN nul x ON x.g = sol.g AND x.p = i LEFT JOIN nul y ON y.g = sol.g AND y.p = j LEFT JOIN len ON len.g = sol.g),
basic AS (SELECT g, i, j, CASE WHEN abs(m[i][i] - 1) < 1e-6 THEN CASE WHEN j <= n THEN m[i][n + j] ELSE m[i][2 * n + 1] END
            ELSE 0 END AS v FROM sol, unnest(range(1, n + 1)) a(i), unnest(range(1, n + 2)) b(j)),
half AS (SELECT q.g, q.i, basic.j, sum(q.v * basic.v) AS v FROM proj q JOIN basic ON basic.g = q.g AND basic.i = q.j GROUP BY ALL),
coef AS (SELECT half.g, i AS p, v AS b FROM half JOIN size ON size.g = half.g AND j = kk + 1),
inv AS (SELECT half.g, half.i, q.j, sum(half.v * q.v) AS v FROM half JOIN proj q ON q.g = half.g AND q.i = half.j GROUP BY ALL),
err AS (SELECT rid, res.g, sum(CASE WHEN res.p = 0 THEN r ELSE -r * b END) AS u FROM res
        LEFT JOIN coef ON coef.g = res.g AND coef.p = res.p GROUP BY ALL),
score AS (SELECT res.g, cl, p, sum(w * r * u) AS s FROM res JOIN err USING (rid) WHERE p > 0 GROUP BY ALL),
meat AS (SELECT a.g, a.p AS i, b.p AS j, sum(a.s * b.s) AS v FROM score a JOIN score b ON a.g = b.g AND a.cl = b.cl GROUP BY ALL),
num AS (SELECT g, count(*) AS n_obs, count(DISTINCT e) AS n_entities, count(DISTINCT cl) AS gg FROM dat GROUP BY g),
var AS (SELECT l.g, l.i AS p, sum(l.v * meat.v * q.v) AS v FROM inv l JOIN meat ON meat.g = l.g AND meat.i = l.j
        JOIN inv q ON q.g = l.g AND q.i = meat.j AND q.j = l.i GROUP BY ALL),
est AS (SELECT coef.g, term, b AS coef,
          sqrt(greatest(0, v * (CAST(gg AS DOUBLE) / (gg - 1)) * (CAST(n_obs - 1 AS DOUBLE) / (n_obs - kk)))) AS std_error,
          n_obs, n_entities
        FROM coef JOIN var USING (g, p) JOIN used USING (g, p) JOIN terms USING (j) JOIN num USING (g) JOIN size USING (g))"""


def estimates(extra: str = "") -> str:
    """Select list of the reported columns."""
    t = "(coef / std_error)"
    return (f"{extra}'top3_mean_consumption' AS outcome, coef, std_error, "
            f"CASE WHEN std_error > 0 THEN {normal_p(t)} END AS p_value, "
            "coef - 1.96::DOUBLE * std_error AS ci_lower, coef + 1.96::DOUBLE * std_error AS ci_upper")


def event_regressors(low: int, high: int, reference: int) -> list[tuple[str, str]]:
    return [(str(k), f"(event_time = {k} AND treatment = 1)::INT") for k in range(low, high + 1) if k != reference]
