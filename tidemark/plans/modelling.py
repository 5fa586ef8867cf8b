"""MDL: datasets, folds and fits."""

from pyspark.sql import functions as F

from ..fixtures import BASELINE_FEATURES
from ..functions import ranks
from ..operators import modelling as m
from ..operators import ranking as k
from ..operators import windows as w
from . import query
from . import fundamentals as fplans
from . import windows as wplans

FEATURES = ["f1", "f2", "f3"]
KEYS = ["formation_date", "security_id"]
#: Half-years from 1997 to 2001: every example from then on is validated once, and earlier ones train.
BLOCKS = ", ".join(
    f"({2 * (year - 1997) + half}, DATE '{year}-{'01-01' if half == 1 else '07-01'}', DATE '{year}-{'06-30' if half == 1 else '12-31'}')"
    for year in range(1997, 2002) for half in (1, 2))


def blocks(r):
    return r.spark.sql(f"SELECT * FROM VALUES {BLOCKS} AS t(outer_fold, valid_from, valid_to)")


def ridge_sql(source: str, l2: str, keys: str = "", weight: str = "1.0", target: str = "target") -> str:
    """Weighted standardised ridge with three features by Cramer's rule; one row per key."""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    join = f"JOIN mo USING ({keys})" if keys else ", mo"
    pairs = [("1", "2"), ("1", "3"), ("2", "3")]
    r = ", ".join(f"sum(w * (f{a} - m{a}) * (f{b} - m{b})) / sum(w) AS c{a}{b}" for a, b in pairs)
    v = ", ".join(f"any_value(m{i}) AS m{i}, sqrt(sum(w * pow(f{i} - m{i}, 2)) / sum(w)) AS s{i}, sum(w * (f{i} - m{i}) * (y - ym)) / sum(w) AS k{i}" for i in "123")
    return f"""
    SELECT {lead} (g1*(d*d-r23*r23) - r12*(g2*d-r23*g3) + r13*(g2*r23-d*g3)) / det AS b1, (d*(g2*d-r23*g3) - g1*(r12*d-r23*r13) + r13*(r12*g3-g2*r13)) / det AS b2,
           (d*(d*g3-g2*r23) - r12*(r12*g3-g2*r13) + g1*(r12*r23-d*r13)) / det AS b3, m1, m2, m3, s1, s2, s3, ym, sw, r12, r13, r23, g1, g2, g3 FROM (
      SELECT *, d*(d*d-r23*r23) - r12*(r12*d-r23*r13) + r13*(r12*r23-d*r13) AS det FROM (
        SELECT *, c12/(s1*s2) AS r12, c13/(s1*s3) AS r13, c23/(s2*s3) AS r23, k1/s1 AS g1, k2/s2 AS g2, k3/s3 AS g3, 1 + {l2} AS d FROM (
          SELECT {lead} sum(w) AS sw, any_value(ym) AS ym, {r}, {v} FROM (
            WITH src AS (SELECT *, {weight} AS w, {target} AS y FROM {source}), mo AS (SELECT {lead} sum(w*f1)/sum(w) AS m1, sum(w*f2)/sum(w) AS m2, sum(w*f3)/sum(w) AS m3, sum(w*y)/sum(w) AS ym FROM src {group})
            SELECT * FROM src {join}) {group})))"""


def long_coefficients(sql: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {lead} 'f{i}' AS feature_key, b{i} AS coefficient, m{i} AS mean, s{i} AS scale, ym AS intercept FROM ({sql})" for i in "123")


def enet_sql(source: str, l1: float, l2: float, steps: int = 60) -> str:
    """Coordinate descent as a recursive query over the three-feature gram."""
    soft = lambda x: f"(CASE WHEN {x} > {l1} THEN {x} - {l1} WHEN {x} < -{l1} THEN {x} + {l1} ELSE 0 END) / (1 + {l2})"
    u1 = soft("(g1 - r12*x2 - r13*x3)")
    u2 = soft(f"(g2 - r12*({u1}) - r23*x3)")
    u3 = soft(f"(g3 - r13*({u1}) - r23*({u2}))")
    return f"""
    WITH RECURSIVE base AS MATERIALIZED (SELECT * FROM ({ridge_sql(source, '0.1')})),
    it AS (SELECT 0 AS n, CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS x2, CAST(0 AS DOUBLE) AS x3
           UNION ALL SELECT n + 1, {u1}, {u2}, {u3} FROM it, base WHERE n < {steps})
    SELECT 'f1' AS feature_key, x1 AS coefficient, m1 AS mean, s1 AS scale, ym AS intercept FROM it, base WHERE n = {steps}
    UNION ALL SELECT 'f2', x2, m2, s2, ym FROM it, base WHERE n = {steps} UNION ALL SELECT 'f3', x3, m3, s3, ym FROM it, base WHERE n = {steps}"""


COEF = "coefficient mean scale intercept"
NESTED = f"""
    WITH b AS (SELECT * FROM (VALUES {BLOCKS}) AS v(outer_fold, vf, vt)), d AS (SELECT DISTINCT formation_date, outcome_date FROM examples),
    s AS (SELECT outer_fold, min(formation_date) AS st FROM d JOIN b ON formation_date BETWEEN vf AND vt GROUP BY 1)
    SELECT outer_fold, formation_date, outcome_date, CASE WHEN formation_date >= vf THEN 'validation' WHEN outcome_date < st THEN 'train' ELSE 'purged' END AS role
    FROM d JOIN b ON formation_date <= vt JOIN s USING (outer_fold)"""


def nested(r):
    dates = r.examples.select("formation_date", "outcome_date").distinct()
    return m.nested_folds(dates, blocks(r))


def labels(r):
    return r.examples.select(*KEYS, "target")


WIDE = ", ".join(f"max(CASE WHEN feature_key = '{f}' THEN percentile END) AS {f}" for f in BASELINE_FEATURES)
LABELS = "SELECT formation_date, security_id, target FROM examples"


@query("MDL01_wide_training_pivot", f"""SELECT * FROM (SELECT formation_date, security_id, {WIDE} FROM sector_ranks WHERE percentile IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT feature_key) = 6) JOIN ({LABELS}) USING (formation_date, security_id)""",
       digits=" ".join(BASELINE_FEATURES) + " target:9")
def _(r):
    return m.complete_wide(r.sector_ranks, list(BASELINE_FEATURES), labels(r))


@query("MDL02_long_training_rows", """
    SELECT count(*) AS examples, CAST(sum(n) AS BIGINT) AS rows_count, count(*) FILTER (n <> 6) AS incomplete_examples FROM (
      SELECT formation_date, security_id, count(*) AS n FROM sector_ranks WHERE percentile IS NOT NULL GROUP BY 1, 2)""")
def _(r):
    return m.feature_set_report(r.sector_ranks, labels(r), list(BASELINE_FEATURES))


@query("MDL03_partition_tag", """
    SELECT CASE WHEN formation_date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30' THEN 'holdout' ELSE 'development' END AS partition_name, count(*) AS rows_count FROM examples GROUP BY 1""")
def _(r):
    return r.examples.groupBy(m.partition_tag(F.col("formation_date"), "2000-07-01", "2001-06-30").alias("partition_name")).agg(F.count(F.lit(1)).alias("rows_count"))


@query("MDL04_clean_monthly_panel", f"""
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY formation_date ORDER BY round(normalized_score, 10) DESC, security_id) AS baseline_rank FROM composite WHERE eligible)
    SELECT formation_date, security_id, baseline_rank, {WIDE} FROM sector_ranks JOIN c USING (formation_date, security_id) GROUP BY 1, 2, 3""", digits=" ".join(BASELINE_FEATURES))
def _(r):
    scores = k.equal_weight_composite(r.sector_ranks).where("eligible").withColumn("s", F.round("normalized_score", 10))
    placed = ranks.with_position(scores, ["formation_date"], "s", "security_id", descending=True, position="baseline_rank").select(*KEYS, "baseline_rank")
    return k.feature_matrix(r.sector_ranks, list(BASELINE_FEATURES)).join(placed, KEYS)


PANEL_KEYS = ("asset_growth_yoy", "net_share_issuance_yoy", "accrual_quality_ttm")
MARKET_CELL = wplans.feature_sql("short_term_reversal_skip", "lag(close, 1) OVER o / lag(close, 21) OVER o - 1", 22, "SELECT security_id, session_date, close FROM bars")


@query("MDL05_monthly_feature_panel", f"""
    SELECT formation_date, security_id, feature_key, value, reason FROM ({fplans.FEATURES}) WHERE feature_key IN {PANEL_KEYS}
    UNION ALL SELECT session_date, security_id, 'short_term_reversal_skip', short_term_reversal_skip, short_term_reversal_skip_reason FROM ({MARKET_CELL}) WHERE session_date IN (SELECT formation_date FROM formations)""",
       digits="value:8")
def _(r):
    accounting = fplans.features(r).where(F.col("feature_key").isin(*PANEL_KEYS)).select(*KEYS, "feature_key", "value", "reason")
    cells = w.short_term_reversal(w.price_history(r.bars), skip_day=True).withColumnRenamed("session_date", "formation_date")
    market = cells.join(r.formations.select("formation_date"), "formation_date", "left_semi").select(
        *KEYS, F.lit("short_term_reversal_skip").alias("feature_key"), F.col("short_term_reversal_skip").alias("value"), F.col("short_term_reversal_skip_reason").alias("reason"))
    return accounting.unionByName(market)


TIE = lambda v, p: f"((rank() OVER (PARTITION BY {p} ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0) / nullif(count(*) OVER (PARTITION BY {p}) - 1, 0))"


@query("MDL06_monthly_model_dataset", f"""
    SELECT formation_date, security_id, coalesce({TIE('f1', 'formation_date')} - 0.5, 0) AS market_rank, coalesce({TIE('f1', 'formation_date, sector_code')}, 0.5) - 0.5 AS sector_rank, target,
           1.0 / count(*) OVER (PARTITION BY formation_date) AS weight FROM examples JOIN sectors USING (security_id)""", digits="market_rank sector_rank target:9 weight")
def _(r):
    rows = r.examples.join(r.sectors, "security_id")
    market = k.centered_percentiles(rows, ["formation_date"], "f1").withColumnRenamed("centered_percentile", "market_rank")
    both = k.centered_percentiles(market, ["formation_date", "sector_code"], "f1").withColumnRenamed("centered_percentile", "sector_rank")
    return m.formation_weights(both).select(*KEYS, "market_rank", "sector_rank", "target", "weight")


@query("MDL07_challenger_dataset", f"""
    WITH c AS (SELECT formation_date, security_id, 1 - {TIE('f2', 'formation_date, sector_code')} AS c1, {TIE('f3', 'formation_date, sector_code')} AS c2 FROM examples JOIN sectors USING (security_id)),
    b AS (SELECT formation_date, security_id, {WIDE} FROM sector_ranks WHERE percentile IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT feature_key) = 6)
    SELECT formation_date, security_id, momentum_12_1, c1, c2, target FROM b JOIN c USING (formation_date, security_id) JOIN ({LABELS}) USING (formation_date, security_id) WHERE c1 IS NOT NULL AND c2 IS NOT NULL""",
       digits="momentum_12_1 c1 c2 target:9")
def _(r):
    keys = ["formation_date", "sector_code"]
    rows = r.examples.join(r.sectors, "security_id")
    one = ranks.with_tie_ranks(rows, keys, "f2").select("security_id", *keys, "f3", "target", (1 - ranks.tie_percentile()).alias("c1"))
    two = ranks.with_tie_ranks(one, keys, "f3", source=rows).select(*KEYS, "target", "c1", ranks.tie_percentile().alias("c2")).where("c1 IS NOT NULL AND c2 IS NOT NULL")
    return m.complete_wide(r.sector_ranks, list(BASELINE_FEATURES), two).select(*KEYS, "momentum_12_1", "c1", "c2", "target")


@query("MDL08_regime_interaction_dataset", f"""
    WITH s AS ({wplans.SIGNAL}), f AS (SELECT formation_date, market_signal FROM s JOIN formations ON formation_date = session_date),
    p AS (SELECT formation_date, security_id, {TIE('close', 'formation_date')} AS p FROM bars JOIN formations ON formation_date = session_date)
    SELECT formation_date, count(*) AS rows_count, count(market_signal) * 1.0 / count(*) AS coverage, count(market_signal) * 1.0 / count(*) >= 0.9 AS covered, min((p - 0.5) * market_signal) AS lowest, max((p - 0.5) * market_signal) AS highest
    FROM p LEFT JOIN f USING (formation_date) GROUP BY 1""", digits="coverage lowest highest")
def _(r):
    rows = r.bars.withColumnRenamed("session_date", "formation_date").join(r.formations.select("formation_date"), "formation_date", "left_semi")
    p = ranks.with_tie_ranks(rows.select(*KEYS, "close"), ["formation_date"], "close").select(*KEYS, ranks.tie_percentile().alias("p"))
    joined = p.join(w.market_trend_signal(r.benchmark_bars).withColumnRenamed("session_date", "formation_date"), "formation_date", "left")
    x = (F.col("p") - 0.5) * F.col("market_signal")
    coverage = F.count("market_signal") / F.count(F.lit(1))
    return joined.groupBy("formation_date").agg(F.count(F.lit(1)).alias("rows_count"), coverage.alias("coverage"), (coverage >= 0.9).alias("covered"), F.min(x).alias("lowest"), F.max(x).alias("highest"))


@query("MDL09_weekly_label_dataset", f"""
    WITH j AS (SELECT formation_date, security_id, CASE WHEN (security_id + month(formation_date)) % 10 <> 3 OR month(formation_date) = 4 THEN target END AS target FROM examples),
    kf AS (SELECT formation_date, count(target) AS n FROM j GROUP BY 1 HAVING count(target) * 1.0 / count(*) >= 0.9)
    SELECT formation_date, security_id, target, {TIE('target', 'formation_date')} * 2 - 1 AS label_rank, 1.0 / n AS sample_weight FROM j JOIN kf USING (formation_date) WHERE target IS NOT NULL""",
       digits="target:9 label_rank sample_weight")
def _(r):
    kept = labels(r).where("(security_id + month(formation_date)) % 10 <> 3 OR month(formation_date) = 4")
    return m.covered_formations(r.examples.select(*KEYS), kept)


@query("MDL10_written_dataset_audit", """
    SELECT count(*) AS keys, count(*) FILTER (security_id % 10 = 1) AS missing_written, CAST(0 AS BIGINT) AS unexpected_written, count(*) FILTER (security_id % 10 = 2) AS hash_mismatches FROM examples""")
def _(r):
    hashed = r.examples.select(*KEYS, F.sha2(F.to_json(F.struct("f1", "f2", "f3", "target")), 256).alias("row_hash"))
    written = hashed.where("security_id % 10 <> 1").withColumn("row_hash", F.when(F.col("security_id") % 10 == 2, F.lit("x")).otherwise(F.col("row_hash")))
    return m.written_audit(hashed, written, KEYS, "row_hash")


RANKED_LABELS = f"SELECT formation_date, security_id, {TIE('target', 'formation_date')} * 2 - 1 AS label_rank, {TIE('f1', 'formation_date')} * 2 - 1 AS anchor_rank, f2, f3 FROM examples QUALIFY count(*) OVER (PARTITION BY formation_date) >= 2"


def residuals(r):
    label = k.label_ranks(r.examples, ["formation_date"], "target").select(*KEYS, "label_rank", "f2", "f3")
    anchor = k.label_ranks(r.examples, ["formation_date"], "f1").select(*KEYS, F.col("label_rank").alias("anchor_rank"))
    return m.residual_rows(label, anchor)


@query("MDL11_residual_dataset", f"SELECT *, label_rank - anchor_rank AS residual FROM ({RANKED_LABELS})", digits="label_rank anchor_rank f2:9 f3:9 residual")
def _(r):
    return residuals(r)


@query("MDL12_time_ordered_folds", """
    WITH d AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM sessions), k AS (SELECT unnest([1, 2, 3]) AS fold)
    SELECT fold, e.session_date AS training_end, a.session_date AS validation_start, b.session_date AS validation_end FROM k
    JOIN d a ON a.i = a.n - 3 * 40 + (fold - 1) * 40 JOIN d b ON b.i = a.i + 39 JOIN d e ON e.i = a.i - 21""")
def _(r):
    return m.time_ordered_folds(r.sessions.select(F.col("session_date").alias("formation_date")), 3, 40, 20)


@query("MDL13_expanding_folds", """
    WITH d AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM sessions)
    SELECT CAST((a.i - 100) / 30 + 1 AS INT) AS fold, a.i AS training_dates, a.session_date AS validation_start, t.session_date AS training_end, b.session_date AS validation_end
    FROM d a JOIN d t ON t.i = a.i - 1 JOIN d b ON b.i = a.i + 29 WHERE a.i >= 100 AND (a.i - 100) % 30 = 0""")
def _(r):
    return m.expanding_folds(r.sessions.select(F.col("session_date").alias("formation_date")), 100, 30)


@query("MDL14_nested_folds", NESTED)
def _(r):
    return nested(r)


@query("MDL14_inner_folds", f"""
    WITH n AS ({NESTED}), t AS (SELECT * FROM n WHERE role = 'train'),
    mo AS (SELECT outer_fold, formation_date AS fm, CAST(3 - (row_number() OVER (PARTITION BY outer_fold ORDER BY formation_date DESC) - 1) // 3 AS INT) AS inner_fold FROM (SELECT DISTINCT outer_fold, formation_date FROM t)
           QUALIFY row_number() OVER (PARTITION BY outer_fold ORDER BY formation_date DESC) <= 9),
    v AS (SELECT t.outer_fold, inner_fold, formation_date, outcome_date FROM t JOIN mo ON mo.outer_fold = t.outer_fold AND fm = formation_date), s AS (SELECT outer_fold, inner_fold, min(formation_date) AS st FROM v GROUP BY 1, 2)
    SELECT *, 'validation' AS role FROM v UNION ALL SELECT t.outer_fold, inner_fold, formation_date, outcome_date, CASE WHEN outcome_date < st THEN 'train' ELSE 'purged' END FROM t JOIN s USING (outer_fold) WHERE formation_date < st""")
def _(r):
    return m.inner_folds(nested(r))


@query("MDL15_ridge", long_coefficients(ridge_sql("examples", "0.1")), digits=COEF)
def _(r):
    return m.fit(r.examples, FEATURES, 0.0, 0.1)


@query("MDL15_elastic_net", enet_sql("examples", 0.002, 0.05), digits=COEF)
def _(r):
    return m.fit(r.examples, FEATURES, 0.002, 0.05)


WEIGHTED = "(SELECT *, 1.0 / count(*) OVER (PARTITION BY formation_date) AS fw FROM examples)"


@query("MDL16_weighted_monthly_fit", long_coefficients(ridge_sql(WEIGHTED, "0.1", weight="fw")), digits=COEF)
def _(r):
    return m.fit(m.formation_weights(r.examples), FEATURES, 0.0, 0.1, weight="weight")


def single(r, found):
    base, b = found
    return m.coefficient_frame(r.spark, FEATURES, {(): (base, b)})


@query("MDL16_robust_monthly_fit")
def _(r):
    return single(r, m.fit_huber(m.formation_weights(r.examples), FEATURES, 0.1, 1.5, weight="weight"))


@query("MDL17_huber_regression")
def _(r):
    return single(r, m.fit_huber(r.examples, FEATURES, 0.1, 1.5))


BIN = lambda f: f"least(9, greatest(0, CAST(floor({f} * 10) AS INT)))"
STUMP = " UNION ALL ".join(f"SELECT {i} AS i, 'f{i + 1}' AS feature, {BIN(f'f{i + 1}')} AS b, target - (SELECT avg(target) FROM examples) AS r FROM examples" for i in range(3))


@query("MDL18_boosted_stumps", f"""
    WITH c AS (SELECT i, feature, b, sum(r) AS s, count(*) AS n FROM ({STUMP}) GROUP BY 1, 2, 3),
    q AS (SELECT i, feature, k AS split, coalesce(sum(s) FILTER (b <= k), 0) AS ls, coalesce(sum(n) FILTER (b <= k), 0) AS ln, coalesce(sum(s) FILTER (b > k), 0) AS rs, coalesce(sum(n) FILTER (b > k), 0) AS rn FROM c, range(9) t(k) GROUP BY 1, 2, 3)
    SELECT 1 AS round, feature, CAST(split AS INT) AS split_bin, 0.1 * ls / ln AS left_value, 0.1 * rs / rn AS right_value FROM q WHERE ln > 0 AND rn > 0 ORDER BY ls * ls / ln + rs * rs / rn DESC, i, split LIMIT 1""", digits="left_value:9 right_value:9")
def _(r):
    found = m.fit_stumps(r.examples, FEATURES, 1, 0.1)
    return r.spark.createDataFrame([(1, *s) for s in found], "round int, feature string, split_bin int, left_value double, right_value double")


@query("MDL18_boosted_stumps_rounds")
def _(r):
    found = m.fit_stumps(r.examples, FEATURES, 24, 0.1)
    return r.spark.createDataFrame([(i, *s) for i, s in enumerate(found, 1)], "round int, feature string, split_bin int, left_value double, right_value double")


@query("MDL19_extreme_pairs", """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY formation_date ORDER BY target, security_id) AS p, count(*) OVER (PARTITION BY formation_date) AS n FROM examples), c AS (SELECT *, least(10, n // 2) AS c FROM p)
    SELECT l.formation_date, l.p AS pair, l.c AS pairs, h.f1 - l.f1 AS f1, h.f2 - l.f2 AS f2, h.f3 - l.f3 AS f3 FROM c l JOIN c h ON h.formation_date = l.formation_date AND h.n - h.p + 1 = l.p WHERE l.p <= l.c""", digits="f1 f2 f3")
def _(r):
    return m.extreme_pairs(r.examples, FEATURES, 10)


@query("MDL19_pairwise_ranker")
def _(r):
    found = m.fit_pairwise(r.examples, FEATURES, 0.01, mirrored=False)
    return single(r, m.recalibrate(r.examples, FEATURES, *found))


@query("MDL20_mirrored_pairs", """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY formation_date ORDER BY target, security_id) - 1 AS p, count(*) OVER (PARTITION BY formation_date) AS n FROM examples),
    d AS (SELECT DISTINCT formation_date, n, least(64, n // 2) AS c FROM p), s AS (SELECT formation_date, n, c, unnest(range(c)) AS i FROM d WHERE c > 0),
    q AS (SELECT *, least(n // 2 - 1, CAST(floor(i * (n // 2) / c) AS BIGINT)) AS lo FROM s)
    SELECT q.formation_date, i AS pair, c AS pairs, h.f1 - l.f1 AS f1, h.f2 - l.f2 AS f2, h.f3 - l.f3 AS f3 FROM q JOIN p l ON l.formation_date = q.formation_date AND l.p = lo JOIN p h ON h.formation_date = q.formation_date AND h.p = h.n - 1 - lo""",
       digits="f1 f2 f3")
def _(r):
    return m.extreme_pairs(r.examples, FEATURES, m.PAIRS_PER_FORMATION, mirrored=True)


@query("MDL20_pairwise_linear")
def _(r):
    return single(r, m.fit_pairwise(r.examples, FEATURES, 0.1, mirrored=True))


BALANCED = "(SELECT *, 1.0 / count(*) OVER (PARTITION BY date_trunc('month', formation_date)) AS mw FROM examples)"


@query("MDL21_month_balanced_ridge", long_coefficients(ridge_sql(BALANCED, "1.0 / sw", weight="mw")), digits=COEF)
def _(r):
    return m.fit(m.month_balanced(r.examples), FEATURES, 0.0, 1.0, weight="weight", per_row=False)


@query("MDL22_residual_ridge", f"""
    WITH x AS (SELECT *, label_rank - anchor_rank AS y FROM ({RANKED_LABELS})), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY formation_date) AS w FROM x),
    mo AS (SELECT sum(w * f2) / sum(w) AS m2, sum(w * f3) / sum(w) AS m3 FROM w),
    c AS (SELECT sqrt(sum(w * pow(f2 - m2, 2)) / sum(w)) AS s2, sqrt(sum(w * pow(f3 - m3, 2)) / sum(w)) AS s3, sum(w * (f2 - m2) * (f3 - m3)) / sum(w) AS c23,
                 sum(w * (f2 - m2) * y) / sum(w) AS k2, sum(w * (f3 - m3) * y) / sum(w) AS k3, any_value(m2) AS m2, any_value(m3) AS m3 FROM w, mo),
    z AS (SELECT *, c23 / s2 / s3 AS r, k2 / s2 AS a, k3 / s3 AS b FROM c)
    SELECT 'f2' AS feature_key, (a * 11 - r * b) / (121 - r * r) AS coefficient, m2 AS mean, s2 AS scale FROM z UNION ALL SELECT 'f3', (11 * b - r * a) / (121 - r * r), m3, s3 FROM z""", digits="coefficient mean scale")
def _(r):
    rows = m.month_balanced(residuals(r).withColumn("target", F.col("residual")))
    return m.fit(rows, ["f2", "f3"], 0.0, 10.0, weight="weight").drop("intercept")


@query("MDL23_interaction_elastic_net", enet_sql("(SELECT *  REPLACE (f1 * f2 AS f3) FROM examples)", 0.001, 0.02, 120), digits=COEF)
def _(r):
    return m.fit(r.examples.withColumn("f3", F.col("f1") * F.col("f2")), FEATURES, 0.001, 0.02)


TRAIN = f"(SELECT e.*, outer_fold FROM examples e JOIN ({NESTED}) USING (formation_date) WHERE role = 'train')"
OOF = f"""
    SELECT outer_fold, e.formation_date, e.security_id, ym + b1 * (f1 - m1) / s1 + b2 * (f2 - m2) / s2 + b3 * (f3 - m3) / s3 AS prediction, target
    FROM examples e JOIN (SELECT * FROM ({NESTED}) WHERE role = 'validation') n USING (formation_date) JOIN ({ridge_sql(TRAIN, '{l2}', 'outer_fold')}) c USING (outer_fold)"""
GRID = [(0.0, x) for x in (0.001, 0.01, 0.1, 1.0)]
GRID_SQL = " UNION ALL ".join(
    f"SELECT outer_fold, CAST(0 AS DOUBLE) AS l1, CAST({l2} AS DOUBLE) AS l2, sqrt(avg(pow(prediction - target, 2))) AS rmse FROM ({OOF.replace('{l2}', str(l2))}) GROUP BY 1" for _, l2 in GRID)


@query("MDL24_grid_search", GRID_SQL, digits="l1 l2 rmse")
def _(r):
    return m.grid_search(r.examples, nested(r), FEATURES, GRID)


@query("MDL24_selected_penalty", f"""
    WITH g AS ({GRID_SQL}), b AS (SELECT outer_fold, min(rmse) AS best FROM g GROUP BY 1)
    SELECT outer_fold, l1, l2, rmse FROM g JOIN b USING (outer_fold) WHERE rmse <= best + 0.0005 QUALIFY row_number() OVER (PARTITION BY outer_fold ORDER BY l2 DESC) = 1""", digits="l1 l2 rmse")
def _(r):
    return m.select_penalty(m.grid_search(r.examples, nested(r), FEATURES, GRID), tolerance=0.0005)


@query("MDL25_out_of_fold_predictions", OOF.replace("{l2}", "0.1"), digits="prediction target:9")
def _(r):
    return m.out_of_fold(r.examples, nested(r), FEATURES, 0.0, 0.1)


@query("MDL26_cross_fitted_anchors", f"""
    SELECT outer_fold, formation_date, security_id, {TIE('p', 'formation_date')} * 2 - 1 AS anchor_rank FROM (SELECT *, round(prediction, 10) AS p FROM ({OOF.replace('{l2}', '0.1')}))""", digits="anchor_rank")
def _(r):
    scored = m.out_of_fold(r.examples, nested(r), FEATURES, 0.0, 0.1).withColumn("p", F.round("prediction", 10))
    return k.label_ranks(scored, ["formation_date"], "p").select("outer_fold", *KEYS, F.col("label_rank").alias("anchor_rank"))


@query("MDL27_reference_training_cut", f"SELECT outer_fold, count(*) AS rows_count, max(outcome_date) AS latest_outcome FROM {TRAIN} GROUP BY 1")
def _(r):
    return m.fold_rows(r.examples, nested(r), "train").groupBy("outer_fold").agg(F.count(F.lit(1)).alias("rows_count"), F.max("outcome_date").alias("latest_outcome"))


@query("MDL28_full_universe_ranks", f"""
    SELECT * FROM (SELECT formation_date, security_id, {TIE('f2', 'formation_date')} AS universe_percentile FROM examples) WHERE security_id % 2 = 0""", digits="universe_percentile")
def _(r):
    ranked = ranks.with_tie_ranks(r.examples, ["formation_date"], "f2").select(*KEYS, ranks.tie_percentile().alias("universe_percentile"))
    return ranked.join(labels(r).where("security_id % 2 = 0").select(*KEYS), KEYS, "left_semi")


@query("MDL29_elastic_net_swap", f"""SELECT 'light' AS configuration, * FROM ({enet_sql('examples', 0.001, 0.05)}) UNION ALL SELECT 'heavy', * FROM ({enet_sql('examples', 0.004, 0.2)})""", digits=COEF)
def _(r):
    found = m.moments(r.examples, FEATURES)[()]
    fits = {(name,): (found, m.solve(found, l1, l2)) for name, l1, l2 in (("light", 0.001, 0.05), ("heavy", 0.004, 0.2))}
    return m.coefficient_frame(r.spark, FEATURES, fits, ["configuration"])


@query("MDL30_final_fit_drift_check", f"""
    SELECT a.feature_key, a.coefficient, b.coefficient AS frozen, abs(a.coefficient - b.coefficient) <= 0.00001 AS matches
    FROM ({long_coefficients(ridge_sql('examples', '0.1'))}) a JOIN ({long_coefficients(ridge_sql('(SELECT * FROM examples WHERE year(formation_date) < 2000)', '0.1'))}) b USING (feature_key)""", digits="coefficient frozen")
def _(r):
    frozen = m.fit(r.examples.where("year(formation_date) < 2000"), FEATURES, 0.0, 0.1)
    return m.drift_check(m.fit(r.examples, FEATURES, 0.0, 0.1), frozen, 0.00001)


@query("MDL31_calibration_context", """
    WITH b AS (SELECT formation_date, avg(prediction) AS p, avg(actual) AS a FROM (SELECT *, row_number() OVER (PARTITION BY formation_date ORDER BY prediction DESC, security_id) AS rn FROM predictions WHERE model_key = 'reference') WHERE rn <= 20 GROUP BY 1)
    SELECT count(*) AS baskets, regr_slope(a, p) AS slope, regr_intercept(a, p) AS intercept, avg(a - p) AS bias, quantile_cont(a - p, 0.1) AS low_residual, quantile_cont(a - p, 0.9) AS high_residual FROM b""",
       digits="slope intercept bias low_residual high_residual")
def _(r):
    return m.basket_calibration(r.predictions.where("model_key = 'reference'").withColumnRenamed("actual", "target"))
