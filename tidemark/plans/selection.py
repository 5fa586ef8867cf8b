"""MDL23, MDL24, MDL26, MDL29, EVL07, EVL19: penalties chosen by rank correlation, tuned anchors, paired series."""

from pyspark.sql import functions as F

from ..fixtures import BASELINE_FEATURES
from ..operators import evaluation as e
from ..operators import modelling as m
from ..operators import selection as s
from ..operators import windows as w
from ..session import cut_lineage
from . import query
from .evaluation import AVG_RANK, FLAT, bootstrap_sql, ic_sql
from .modelling import FEATURES, LABELS, NESTED, WIDE, labels, nested
from .windows import SIGNAL

# The penalties of the search, weakest first, three stronger ones that switch inputs off, and the two that are compared.
ELASTIC = [(l1, l2) for l1 in (0.0001, 0.001) for l2 in (0.001, 0.01, 0.1)]
GRID = [*ELASTIC, (0.002, 0.1), (0.004, 0.1), (0.006, 0.1)]
CURRENT, NEW = (0.0001, 0.01), (0.002, 0.1)
#: The target without most of what f2 explains, so that penalties matter.
NOISY = "(SELECT * REPLACE (target - 0.49 * f2 AS target) FROM examples)"
EIGHT = [*BASELINE_FEATURES, "momentum_x_market", "strength_x_market"]


def path_sql(source: str, features: list[str], grid: list[tuple[float, float]], keys: str = "", weight: str = "1.0", sweeps: int = 100) -> str:
    """Coordinate descent of every penalty as one recursive statement: a row (keys, l1, l2, x, ym, m, s) for each fit.

    A step moves one coordinate; ``n`` counts the steps.
    """
    lead, k = f"{keys}, " if keys else "", len(features)
    by, join = (f"GROUP BY {keys}", f"JOIN {{0}} USING ({keys})") if keys else ("", "CROSS JOIN {0}")
    listed = lambda name: "[" + ", ".join(f"{name}_{f}" for f in features) + "]"
    scale = lambda f: f"(CASE WHEN s_{f} > 1e-12 THEN s_{f} ELSE 1 END)"
    pair = lambda a, b: f"c_{a}_{b}" if features.index(a) <= features.index(b) else f"c_{b}_{a}"
    gram = "[" + ", ".join("[" + ", ".join(f"{pair(a, b)} / {scale(a)} / {scale(b)}" for b in features) + "]" for a in features) + "]"
    means = ", ".join(f"sum(w * {f}) / sum(w) AS m_{f}" for f in features)
    central = ", ".join(
        [f"any_value(m_{f}) AS m_{f}, sqrt(sum(w * pow({f} - m_{f}, 2)) / sum(w)) AS s_{f}, sum(w * ({f} - m_{f}) * (y - ym)) / sum(w) AS k_{f}" for f in features]
        + [f"sum(w * ({a} - m_{a}) * ({b} - m_{b})) / sum(w) AS c_{a}_{b}" for i, a in enumerate(features) for b in features[i:]])
    penalties = ", ".join(f"(CAST({l1} AS DOUBLE), CAST({l2} AS DOUBLE))" for l1, l2 in grid)
    partial = f"(cov[n % {k} + 1] - list_dot_product(gram[n % {k} + 1], x) + gram[n % {k} + 1][n % {k} + 1] * x[n % {k} + 1])"
    soft = f"(sign({partial}) * greatest(abs({partial}) - l1, 0) / (gram[n % {k} + 1][n % {k} + 1] + l2))"
    moved = f"list_value({', '.join(f'CASE WHEN n % {k} = {i} THEN {soft} ELSE x[{i + 1}] END' for i in range(k))})"
    names = ", ".join(f"b.{c.strip()}" for c in keys.split(",")) + ", " if keys else ""
    return f"""
    WITH RECURSIVE src AS MATERIALIZED (SELECT *, {weight} AS w, target AS y FROM {source}),
    mo AS MATERIALIZED (SELECT {lead} {means}, sum(w * y) / sum(w) AS ym FROM src {by}),
    ce AS MATERIALIZED (SELECT {lead} any_value(ym) AS ym, {central} FROM src {join.format('mo')} {by}),
    base AS MATERIALIZED (SELECT {lead} ym, {listed('m')} AS m, [{', '.join(scale(f) for f in features)}] AS s, {gram} AS gram, [{', '.join(f'k_{f} / {scale(f)}' for f in features)}] AS cov FROM ce),
    pen AS (SELECT * FROM (VALUES {penalties}) AS v(l1, l2)),
    it AS (SELECT {lead} l1, l2, 0 AS n, CAST([{', '.join('0' for _ in features)}] AS DOUBLE[]) AS x FROM base CROSS JOIN pen
           UNION ALL SELECT {names} it.l1, it.l2, it.n + 1, {moved} FROM it {join.format('base b')} WHERE it.n < {sweeps * k})
    SELECT {lead} l1, l2, x, ym, m, s FROM it {join.format('base')} WHERE n = {sweeps * k}"""


def line_sql(features: list[str]) -> str:
    return "ym + " + " + ".join(f"x[{i}] * ({f} - m[{i}]) / s[{i}]" for i, f in enumerate(features, 1))


INNER = f"""
    SELECT n.outer_fold, i.inner_fold, n.formation_date, n.outcome_date, CASE WHEN n.formation_date >= i.st THEN 'validation' WHEN n.outcome_date < i.st THEN 'train' ELSE 'purged' END AS role
    FROM (SELECT * FROM ({NESTED}) WHERE role = 'train') n JOIN (
      SELECT outer_fold, CAST(3 - (r - 1) // 3 AS INT) AS inner_fold, min(fm) AS st, max(fm) AS en FROM (
        SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY fm DESC) AS r FROM (SELECT DISTINCT outer_fold, formation_date AS fm FROM ({NESTED}) WHERE role = 'train')) WHERE r <= 9 GROUP BY 1, 2) i
    ON i.outer_fold = n.outer_fold AND n.formation_date <= i.en"""
ROLES = f"(SELECT outer_fold, 0 AS inner_fold, formation_date, role FROM ({NESTED}) UNION ALL SELECT outer_fold, inner_fold, formation_date, role FROM ({INNER}))"


def ranks_sql(roles: str, grid: list[tuple[float, float]], keys: str) -> str:
    """Validation rows of every penalty with their ranks by fold and date."""
    rows = f"(SELECT e.*, {', '.join(f'g.{k.strip()}' for k in keys.split(','))} FROM {NOISY} e JOIN (SELECT * FROM {roles} WHERE role = '{{0}}') g USING (formation_date))"
    part = f"{keys}, l1, l2, formation_date"
    return f"""
    SELECT *, {AVG_RANK('p', part)} AS pr, {AVG_RANK('target', part)} AS tr, count(*) OVER (PARTITION BY {part}) AS names FROM (
      SELECT {keys}, l1, l2, formation_date, outcome_date, security_id, target, round({line_sql(FEATURES)}, 10) AS p
      FROM {rows.format('validation')} JOIN ({path_sql(rows.format('train'), FEATURES, grid, keys)}) USING ({keys}))"""


def correlations_sql(roles: str, grid: list[tuple[float, float]], keys: str) -> str:
    return f"SELECT {keys}, l1, l2, formation_date, any_value(outcome_date) AS outcome_date, {FLAT('corr(pr, tr)')} AS rank_ic FROM ({ranks_sql(roles, grid, keys)}) GROUP BY {keys}, l1, l2, formation_date"


def months_sql(daily: str, keys: str) -> str:
    return f"""SELECT {keys}, l1, l2, avg(v) AS mean_rank_ic, count(*) AS months FROM (
      SELECT {keys}, l1, l2, date_trunc('month', formation_date) AS mo, avg(rank_ic) AS v FROM ({daily}) GROUP BY {keys}, l1, l2, mo) GROUP BY {keys}, l1, l2"""


def choice_sql(scores: str, keys: str) -> str:
    """Within 0.002 of the best, the greatest (l1, l2)."""
    return f"""SELECT {keys}, l1, l2, mean_rank_ic FROM (SELECT *, max(mean_rank_ic) OVER (PARTITION BY {keys}) AS best FROM ({scores}))
      WHERE round(mean_rank_ic, 9) >= round(best - 0.002, 9) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY l1 DESC, l2 DESC) = 1"""


INNER_SCORES = months_sql(correlations_sql(f"({INNER})", GRID, "outer_fold, inner_fold"), "outer_fold")


def noisy(r):
    return r.examples.withColumn("target", F.col("target") - 0.49 * F.col("f2"))


def inner_correlations(r):
    predicted = s.path_predictions(noisy(r), m.inner_folds(cut_lineage(nested(r))), FEATURES, GRID)  # roles: a row for each fold and date
    return s.rank_correlations(s.ranked_path(predicted, len(GRID)), len(GRID))


@query("MDL24_penalty_paths", f"""
    SELECT outer_fold, l1, l2, sqrt(avg(pow({line_sql(FEATURES)} - target, 2))) AS rmse
    FROM (SELECT e.*, outer_fold FROM examples e JOIN (SELECT * FROM ({NESTED}) WHERE role = 'validation') USING (formation_date))
    JOIN ({path_sql(f"(SELECT e.*, outer_fold FROM examples e JOIN (SELECT * FROM ({NESTED}) WHERE role = 'train') USING (formation_date))", FEATURES, ELASTIC, 'outer_fold')}) USING (outer_fold)
    GROUP BY 1, 2, 3""", digits="l1 l2 rmse")
def _(r):
    return m.grid_search(r.examples, nested(r), FEATURES, ELASTIC)


@query("MDL24_inner_rank_ic", INNER_SCORES, digits="l1 l2 mean_rank_ic")
def _(r):
    return s.with_penalties(s.month_balanced_mean(inner_correlations(r), ["outer_fold"]), GRID).select("outer_fold", "l1", "l2", "mean_rank_ic", "months")


@query("MDL24_rank_ic_choice", choice_sql(INNER_SCORES, "outer_fold"), digits="l1 l2 mean_rank_ic")
def _(r):
    scores = s.with_penalties(s.month_balanced_mean(inner_correlations(r), ["outer_fold"]), GRID)
    return s.strongest_near_best(scores, ["outer_fold"]).drop("penalty")


ANCHORS = f"""
    WITH ranked AS MATERIALIZED ({ranks_sql(ROLES, GRID, 'outer_fold, inner_fold')}),
    daily AS (SELECT outer_fold, l1, l2, formation_date, any_value(outcome_date) AS outcome_date, {FLAT('corr(pr, tr)')} AS rank_ic FROM ranked WHERE inner_fold > 0 GROUP BY outer_fold, inner_fold, l1, l2, formation_date),
    begun AS (SELECT outer_fold, inner_fold, min(formation_date) AS start FROM ranked GROUP BY 1, 2),
    asked AS (SELECT * FROM begun WHERE inner_fold = 0 OR (inner_fold > 1 AND outer_fold = (SELECT min(outer_fold) FROM begun WHERE inner_fold > 0))),
    known AS (SELECT a.outer_fold, a.inner_fold, l1, l2, formation_date, rank_ic FROM asked a JOIN daily d ON d.outer_fold = a.outer_fold AND d.outcome_date < a.start),
    chosen AS ({choice_sql(months_sql('SELECT * FROM known', 'outer_fold, inner_fold'), 'outer_fold, inner_fold')})
    SELECT outer_fold, inner_fold, formation_date, security_id, l1, l2, CASE WHEN names > 1 THEN (pr - 1) / (names - 1) * 2 - 1 END AS anchor_rank
    FROM ranked JOIN (SELECT outer_fold, inner_fold, l1, l2 FROM chosen) USING (outer_fold, inner_fold, l1, l2)"""


@query("MDL26_tuned_anchors", ANCHORS, digits="l1 l2 anchor_rank")
def _(r):
    outer = cut_lineage(nested(r))
    return s.tuned_anchors(noisy(r), outer.drop("outcome_date"), m.inner_folds(outer).drop("outcome_date"), FEATURES, GRID)


SWAP = f"""
    WITH ranked AS MATERIALIZED ({ranks_sql(f'(SELECT * FROM ({NESTED}))', [CURRENT, NEW], 'outer_fold')}),
    ic AS (SELECT outer_fold, formation_date, l1, {FLAT('corr(pr, tr)')} AS v FROM ranked GROUP BY 1, 2, 3),
    top AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY outer_fold, formation_date, l1 ORDER BY p DESC, security_id) <= 20),
    differ AS (SELECT a.outer_fold, a.formation_date, count(*) FILTER (b.security_id IS NULL) AS names_different FROM (SELECT * FROM top WHERE l1 = {NEW[0]}) a
      LEFT JOIN (SELECT * FROM top WHERE l1 = {CURRENT[0]}) b ON a.outer_fold = b.outer_fold AND a.formation_date = b.formation_date AND a.security_id = b.security_id GROUP BY 1, 2)
    SELECT outer_fold, formation_date, current_rank_ic, new_rank_ic, names_different, new_rank_ic - current_rank_ic AS delta FROM (
      SELECT outer_fold, formation_date, max(v) FILTER (l1 = {CURRENT[0]}) AS current_rank_ic, max(v) FILTER (l1 = {NEW[0]}) AS new_rank_ic FROM ic GROUP BY 1, 2) JOIN differ USING (outer_fold, formation_date)"""


def swap(r):
    return s.swap_series(noisy(r), cut_lineage(nested(r)).drop("outcome_date"), FEATURES, CURRENT, NEW)


@query("MDL29_swap_series", SWAP, digits="current_rank_ic new_rank_ic delta")
def _(r):
    return swap(r)


@query("MDL29_swap_bootstrap", bootstrap_sql(f"SELECT formation_date AS month, delta FROM ({SWAP})", 11, 2000), digits="bootstrap_mean probability_positive low high")
def _(r):
    return e.moving_block_bootstrap(swap(r).select(F.col("formation_date").alias("month"), "delta"), 11, 2000)


EIGHT_ROWS = f"""(
    SELECT *, 1.0 / count(*) OVER (PARTITION BY formation_date) AS fw FROM (
      SELECT formation_date, target, {', '.join(BASELINE_FEATURES)}, (momentum_12_1 - 0.5) * market_signal AS momentum_x_market, (relative_strength_6m - 0.5) * market_signal AS strength_x_market
      FROM (SELECT formation_date, security_id, {WIDE} FROM sector_ranks WHERE percentile IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT feature_key) = 6) JOIN ({LABELS}) USING (formation_date, security_id)
      JOIN (SELECT CAST(date_trunc('month', session_date) + INTERVAL 1 MONTH AS DATE) AS formation_date, max_by(market_signal, session_date) AS market_signal FROM ({SIGNAL}) GROUP BY 1) USING (formation_date)))"""


@query("MDL23_eight_inputs", f"""
    SELECT unnest([{', '.join(f"'{f}'" for f in EIGHT)}]) AS feature_key, unnest(x) AS coefficient, unnest(m) AS mean, unnest(s) AS scale, ym AS intercept
    FROM ({path_sql(EIGHT_ROWS, EIGHT, [(0.001, 0.02)], weight='fw', sweeps=150)})""", digits="coefficient mean scale intercept")
def _(r):
    wide = m.complete_wide(r.sector_ranks, list(BASELINE_FEATURES), labels(r))
    rows = s.eight_inputs(wide, w.market_trend_signal(r.benchmark_bars), list(BASELINE_FEATURES), "momentum_12_1", "relative_strength_6m")
    found = m.moments(rows, EIGHT, balance=["formation_date"])
    return m.coefficient_frame(r.spark, EIGHT, {k: (v, s.solve_path(v, [(0.001, 0.02)])[0]) for k, v in found.items()})


@query("EVL19_model_summary", f"""
    SELECT model_key, CAST(sum(n) AS BIGINT) AS paired_rows, count(*) AS months, avg(ic) AS mean_monthly_rank_ic, avg(top) AS top_gross, CAST(sum(short) AS BIGINT) AS short_formations FROM (
      SELECT model_key, date_trunc('month', formation_date) AS mo, avg(rank_ic) AS ic, avg(top) AS top, sum(pairs) AS n, count(*) FILTER (pairs < 20) AS short FROM ({ic_sql()})
      JOIN (SELECT model_key, formation_date, avg(actual) AS top FROM (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY model_key, formation_date ORDER BY prediction DESC, security_id) <= 20) GROUP BY 1, 2) USING (model_key, formation_date)
      GROUP BY 1, 2) GROUP BY 1""", digits="mean_monthly_rank_ic top_gross")
def _(r):
    return s.model_summary(r.predictions)


@query("EVL07_block_means", f"""
    SELECT model_key, outer_fold, count(*) AS months, avg(ic) AS mean_monthly_rank_ic, count(*) FILTER (ic > 0) * 1.0 / count(*) AS positive_share, sum(off) / sum(n) AS mae FROM (
      SELECT model_key, outer_fold, date_trunc('month', formation_date) AS mo, avg(rank_ic) AS ic, sum(off) AS off, sum(n) AS n FROM (
        SELECT model_key, outer_fold, formation_date, {FLAT('corr(l, r)')} AS rank_ic, sum(abs(prediction - actual)) AS off, count(*) AS n FROM (
          SELECT *, {AVG_RANK('prediction', 'model_key, outer_fold, formation_date')} AS l, {AVG_RANK('actual', 'model_key, outer_fold, formation_date')} AS r FROM predictions) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
       digits="mean_monthly_rank_ic positive_share mae")
def _(r):
    return s.block_means(r.predictions)
