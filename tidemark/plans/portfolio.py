"""PRT: portfolios."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import portfolio as p
from . import query

SIZE = 5
COMPLETE = "SELECT security_id FROM dense_bars GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM sessions)"
BRAND_SCORES = f"""
    SELECT session_date AS formation_date, security_id, score FROM (
      SELECT *, round(adjusted_open / lag(adjusted_open, 20) OVER (PARTITION BY security_id ORDER BY session_date) - 1, 10) AS score FROM dense_bars WHERE security_id IN ({COMPLETE}))
    WHERE score IS NOT NULL AND session_date IN (SELECT formation_date FROM formations)"""
TARGETS = f"SELECT *, row_number() OVER (PARTITION BY formation_date ORDER BY score DESC, security_id) AS target_rank FROM ({BRAND_SCORES}) QUALIFY target_rank <= {SIZE}"
PERIODS = "SELECT * FROM (SELECT formation_date, next_session AS execution_date, lead(next_session) OVER (ORDER BY formation_date) AS exit_date FROM formations JOIN sessions ON session_date = formation_date) WHERE exit_date IS NOT NULL"
BOOK = f"""
    WITH r AS (SELECT t.*, d.execution_date, d.exit_date, e.adjusted_open AS open, x.adjusted_open AS xo FROM ({TARGETS}) t JOIN ({PERIODS}) d USING (formation_date)
               JOIN dense_bars e ON e.security_id = t.security_id AND e.session_date = execution_date JOIN dense_bars x ON x.security_id = t.security_id AND x.session_date = exit_date),
    g AS (SELECT formation_date, sum(xo / open) / {SIZE} AS growth FROM r GROUP BY 1),
    n AS (SELECT formation_date, 100000 * coalesce(product(growth) OVER (ORDER BY formation_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS starting_nav FROM g)
    SELECT r.*, starting_nav, starting_nav / {SIZE} AS notional, starting_nav / {SIZE} / open AS quantity FROM r JOIN n USING (formation_date)"""
TRADES = f"""
    SELECT formation_date, execution_date, security_id, 'buy' AS side, quantity, open AS price, notional FROM ({BOOK})
    UNION ALL SELECT d.formation_date, b.exit_date, b.security_id, 'sell', b.quantity, b.xo, b.quantity * b.xo FROM ({BOOK}) b JOIN ({PERIODS}) d ON d.execution_date = b.exit_date"""


def brand_scores(r):
    whole = r.dense_bars.groupBy("security_id").agg(F.count(F.lit(1)).alias("n"))
    total = r.sessions.agg(F.count(F.lit(1)).alias("n"))
    bars = r.dense_bars.join(whole.join(total, "n", "left_semi"), "security_id", "left_semi")
    own = Window.partitionBy("security_id").orderBy("session_date")
    scored = bars.withColumn("score", F.round(F.col("adjusted_open") / F.lag("adjusted_open", 20).over(own) - 1, 10)).where("score IS NOT NULL")
    return scored.select(F.col("session_date").alias("formation_date"), "security_id", "score").join(r.formations.select("formation_date"), "formation_date", "left_semi")


def opens(r):
    return r.dense_bars.select("security_id", "session_date", F.col("adjusted_open").alias("open"))


def periods(r):
    return lb.execution_periods(r.formations, r.sessions)


def targets(r):
    return p.equal_weight_targets(brand_scores(r), "score", SIZE)


def book(r):
    return p.rebalance_chain(targets(r), periods(r), opens(r), 100000.0)


def trades(r):
    return p.ledger_trades(book(r), periods(r), opens(r))


@query("PRT01_equal_weight_targets", f"SELECT formation_date, security_id, target_rank, 1.0 / {SIZE} AS target_weight FROM ({TARGETS})", digits="target_weight")
def _(r):
    return targets(r)


@query("PRT02_rebalance_ledger", f"SELECT formation_date, execution_date, security_id, side, quantity, price, notional FROM ({TRADES})", digits="quantity price notional:4")
def _(r):
    return trades(r)


MONTHS = "SELECT score_date AS formation_date, score_date + 7 AS execution_date FROM (SELECT DISTINCT score_date FROM scores)"


@query("PRT03_publication_decisions", """
    WITH f AS (SELECT formation_date, next_session AS execution_date FROM formations JOIN sessions ON session_date = formation_date WHERE next_session IS NOT NULL),
    t AS (SELECT formation_date, security_id FROM bars JOIN formations ON formation_date = session_date QUALIFY row_number() OVER (PARTITION BY formation_date ORDER BY volume DESC, security_id) <= 20),
    n AS (SELECT f.formation_date, f.execution_date, count(t.security_id) AS targets, count(b.security_id) AS opens FROM f LEFT JOIN t USING (formation_date)
          LEFT JOIN bars b ON b.security_id = t.security_id AND b.session_date = f.execution_date GROUP BY 1, 2)
    SELECT *, CASE WHEN year(formation_date) = 1996 THEN 'already_published' WHEN month(formation_date) = 5 THEN 'not_one_model_version' WHEN targets <> 20 THEN 'fewer_than_required_ranks'
                   WHEN opens < targets THEN 'missing_next_open' ELSE 'publish' END AS decision FROM n""")
def _(r):
    formations = r.formations.join(r.sessions.select(F.col("session_date").alias("formation_date"), F.col("next_session").alias("execution_date")), "formation_date")
    formations = formations.where("execution_date IS NOT NULL").select("formation_date", "execution_date")
    dated = r.bars.withColumnRenamed("session_date", "formation_date").join(r.formations.select("formation_date"), "formation_date", "left_semi")
    chosen = p.top_rows(dated, ["formation_date"], [F.col("volume").desc(), F.col("security_id").asc()], 20).select("formation_date", "security_id")
    second = F.when(F.month("formation_date") == 5, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    models = formations.select("formation_date", F.explode(second).alias("model_version"))
    return p.publishable(formations, chosen, models, r.bars, formations.where("year(formation_date) = 1996"))


RANKED = "SELECT score_date AS formation_date, security_id, score_rank FROM scores WHERE score_rank <= 30"


def ranked(r):
    return r.scores.where("score_rank <= 30").select(F.lit("reference").alias("model_key"), F.col("score_date").alias("formation_date"), "security_id", F.col("score_rank").alias("rank"))


@query("PRT04_hysteresis_selection", f"""
    WITH RECURSIVE l AS (SELECT formation_date, list(security_id ORDER BY score_rank) AS ids, row_number() OVER (ORDER BY formation_date) AS n FROM ({RANKED}) GROUP BY 1),
    s AS (SELECT n, formation_date, ids[1:20] AS sel FROM l WHERE n = 1
          UNION ALL SELECT l.n, l.formation_date, (list_concat(list_filter(ids, lambda x: list_contains(sel, x)), list_filter(ids, lambda x: NOT list_contains(sel, x))))[1:20] FROM s JOIN l ON l.n = s.n + 1)
    SELECT 'reference' AS model_key, f.formation_date, f.security_id, k.score_rank AS rank FROM (SELECT formation_date, unnest(sel) AS security_id FROM s) f
    JOIN ({RANKED}) k USING (formation_date, security_id)""")
def _(r):
    return p.hysteresis(ranked(r))


TURNOVER = """
    WITH s AS (SELECT score_date AS formation_date, security_id FROM scores WHERE score_rank <= 20), d AS (SELECT formation_date, lag(formation_date) OVER (ORDER BY formation_date) AS pd FROM (SELECT DISTINCT formation_date FROM s)),
    c AS (SELECT s.formation_date, any_value(pd) AS pd, count(*) AS names, count(o.security_id) AS retained FROM s JOIN d USING (formation_date) LEFT JOIN s o ON o.formation_date = d.pd AND o.security_id = s.security_id GROUP BY 1)
    SELECT formation_date, names, retained, 20 - retained AS additions, CASE WHEN pd IS NULL THEN 0 ELSE 20 - retained END AS removals, CASE WHEN pd IS NULL THEN 1.0 ELSE 1.0 - retained / 20 END AS one_way_turnover FROM c"""


@query("PRT05_turnover_periods", TURNOVER, digits="one_way_turnover")
def _(r):
    return p.turnover_periods(ranked(r).where("rank <= 20").select("formation_date", "security_id"))


LABELS = """SELECT formation_date, security_id, CASE WHEN (security_id + year(formation_date)) % 97 NOT IN (3, 4) THEN target END AS security_return, month(formation_date) / 1000.0 AS benchmark_return,
    CASE WHEN (security_id + year(formation_date)) % 97 = 3 THEN 'short_window' END AS reason FROM examples WHERE (security_id + month(formation_date)) % 89 <> 5"""


@query("PRT05_labelled_periods", f"""
    WITH j AS (SELECT s.score_date AS formation_date, s.security_id, security_return, benchmark_return, CASE WHEN security_return IS NULL THEN coalesce(reason, 'missing_label') END AS reason
      FROM scores s LEFT JOIN ({LABELS}) l ON l.formation_date = s.score_date AND l.security_id = s.security_id WHERE s.score_rank <= 20),
    g AS (SELECT formation_date, count(*) AS names, count(security_return) AS labelled, avg(security_return) AS pr, min(benchmark_return) FILTER (security_return IS NOT NULL) AS br, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM j GROUP BY 1)
    SELECT formation_date, names, labelled, CASE WHEN names = labelled THEN pr END AS portfolio_return, CASE WHEN names = labelled THEN br END AS benchmark_return, CASE WHEN names = labelled THEN pr - br END AS relative_return,
           CASE WHEN names <> labelled THEN 'selected_outcome_unavailable:' || reasons END AS reason FROM g""", digits="portfolio_return:9 benchmark_return relative_return:9")
def _(r):
    place = F.col("security_id") + F.year("formation_date")
    outcomes = r.examples.where("(security_id + month(formation_date)) % 89 <> 5").select(
        "formation_date", "security_id", F.when(~(place % 97).isin(3, 4), F.col("target")).alias("security_return"), (F.month("formation_date") / 1000.0).alias("benchmark_return"),
        F.when(place % 97 == 3, "short_window").alias("reason"))
    return p.labelled_periods(ranked(r).where("rank <= 20").select("formation_date", "security_id"), outcomes)


BASKETS = f"""
    SELECT b.formation_date, b.gross_return, bx.open / be.open - 1 AS benchmark_return, t.one_way_turnover FROM (
      SELECT formation_date, any_value(execution_date) AS execution_date, any_value(exit_date) AS exit_date, avg(xo / open) - 1 AS gross_return FROM ({BOOK}) GROUP BY 1) b
    JOIN dense_benchmark be ON be.session_date = execution_date JOIN dense_benchmark bx ON bx.session_date = exit_date
    JOIN (WITH tg AS MATERIALIZED ({TARGETS}), td AS (SELECT formation_date, lag(formation_date) OVER (ORDER BY formation_date) AS pd FROM (SELECT DISTINCT formation_date FROM tg)),
               held AS (SELECT td.formation_date, td.pd, tg.security_id FROM td JOIN tg ON tg.formation_date = td.pd)
          SELECT c.formation_date, CASE WHEN count(td.pd) = 0 THEN 1.0 ELSE 1.0 - count(h.security_id) * 1.0 / {SIZE} END AS one_way_turnover FROM tg c JOIN td ON td.formation_date = c.formation_date
          LEFT JOIN held h ON h.formation_date = c.formation_date AND h.security_id = c.security_id GROUP BY 1) t USING (formation_date)"""


def basket_periods(r):
    chosen = targets(r)
    gross = lb.basket_returns(chosen, periods(r), opens(r), SIZE).where("complete")
    side = lambda name: r.dense_benchmark.select(F.col("session_date").alias(name), F.col("open").alias(f"_{name}"))
    rows = gross.join(side("execution_date"), "execution_date").join(side("exit_date"), "exit_date")
    rows = rows.withColumn("benchmark_return", F.col("_exit_date") / F.col("_execution_date") - 1)
    return rows.join(p.turnover_periods(chosen, SIZE).select("formation_date", "one_way_turnover"), "formation_date").select(
        "formation_date", "gross_return", "benchmark_return", "one_way_turnover")


@query("PRT06_period_summary", f"""
    WITH b AS ({BASKETS}), r AS (SELECT *, gross_return - benchmark_return AS rel, row_number() OVER (ORDER BY formation_date) = 1 AS f FROM b)
    SELECT count(*) AS formations, avg(rel) AS mean_gross_relative, product(1 + gross_return) - 1 AS cumulative_portfolio, product(1 + benchmark_return) - 1 AS cumulative_benchmark,
           avg(one_way_turnover) FILTER (NOT f) AS recurring_turnover, avg(rel - one_way_turnover * 5 / 10000) AS net_5bp, avg(rel - one_way_turnover * 10 / 10000) AS net_10bp,
           avg(rel - one_way_turnover * 25 / 10000) AS net_25bp, avg(rel - one_way_turnover * 50 / 10000) AS net_50bp, avg(rel) / avg(one_way_turnover) * 10000 AS break_even_bp FROM r""",
       digits="mean_gross_relative cumulative_portfolio cumulative_benchmark recurring_turnover net_5bp net_10bp net_25bp net_50bp break_even_bp")
def _(r):
    return p.period_summary(basket_periods(r))


@query("PRT07_rebalance_cost_report", f"""
    WITH t AS (SELECT formation_date, sum(notional) AS gross_notional, sum(notional) FILTER (side = 'buy') AS buys FROM ({TRADES}) GROUP BY 1),
    n AS (SELECT formation_date, any_value(starting_nav) AS nav FROM ({BOOK}) GROUP BY 1)
    SELECT formation_date, c AS cost_bps, gross_notional, buys / nav AS one_way_turnover, gross_notional * c / 10000 AS total_cost, nav - gross_notional * c / 10000 AS nav_after_cost
    FROM t JOIN n USING (formation_date), (VALUES (1), (5), (10), (20)) AS v(c)""", digits="gross_notional:4 one_way_turnover total_cost:4 nav_after_cost:4")
def _(r):
    held = book(r)
    return p.cost_report(p.ledger_trades(held, periods(r), opens(r)), held.groupBy("formation_date").agg(F.max("starting_nav").alias("starting_nav")))


@query("PRT08_cost_adjusted_return", f"""
    SELECT formation_date, c AS cost_bps, (1 + gross_return) * pow(1 - c / 10000.0, 2) - 1 AS net_return, (1 + gross_return) * pow(1 - c / 10000.0, 2) - 1 - benchmark_return AS relative_return
    FROM ({BASKETS}), (VALUES (5), (10), (25), (50)) AS v(c)""", digits="net_return relative_return")
def _(r):
    rows = basket_periods(r).withColumn("cost_bps", F.explode(F.array(*[F.lit(c) for c in p.COSTS])))
    net = p.cost_adjusted(F.col("gross_return"), F.col("cost_bps"))
    return rows.select("formation_date", "cost_bps", net.alias("net_return"), (net - F.col("benchmark_return")).alias("relative_return"))


@query("PRT09_liquidity_floor", """
    WITH t AS (SELECT score_date AS formation_date, security_id FROM scores WHERE score_rank <= 20),
    l AS (SELECT formation_date, security_id, value FROM outcomes WHERE feature_key = 'median_dollar_volume_20d' AND security_id % 9 <> 2)
    SELECT formation_date, count(*) AS targets, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value < 20000) AS illiquid,
           count(*) FILTER (value IS NULL) = 0 AND count(*) FILTER (value < 20000) = 0 AS passed FROM t LEFT JOIN l USING (formation_date, security_id) GROUP BY 1""")
def _(r):
    liquid = r.outcomes.where("feature_key = 'median_dollar_volume_20d' AND security_id % 9 <> 2").select("formation_date", "security_id", F.col("value").alias("median_dollar_volume"))
    return p.liquidity_gate(ranked(r).where("rank <= 20").select("formation_date", "security_id"), liquid, 20000.0)


@query("PRT10_performance_metrics", """
    WITH n AS (SELECT d.security_id, d.session_date, d.adjusted_open AS nav, b.open AS bnav FROM dense_bars d JOIN dense_benchmark b USING (session_date)),
    x AS (SELECT *, nav / lag(nav) OVER o - 1 AS r, nav / max(nav) OVER (PARTITION BY security_id ORDER BY session_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM n WINDOW o AS (PARTITION BY security_id ORDER BY session_date)),
    g AS (SELECT security_id, count(*) AS observations, arg_max(nav, session_date) / arg_min(nav, session_date) - 1 AS pr, arg_max(bnav, session_date) / arg_min(bnav, session_date) - 1 AS br,
                 count(r) AS n, avg(r) AS m, stddev_samp(r) AS sd, sqrt(avg(pow(least(r, 0), 2))) AS dn, min(dd) AS mdd FROM x GROUP BY 1 HAVING count(*) >= 2)
    SELECT security_id, observations, pr AS portfolio_return, br AS benchmark_return, pr - br AS relative_return, exp(ln(1 + pr) / (n / 252.0)) - 1 AS cagr, sd * sqrt(252) AS volatility,
           m / nullif(sd, 0) * sqrt(252) AS sharpe, m / nullif(dn, 0) * sqrt(252) AS sortino, mdd AS max_drawdown, (exp(ln(1 + pr) / (n / 252.0)) - 1) / nullif(abs(mdd), 0) AS calmar FROM g""",
       digits="portfolio_return benchmark_return relative_return cagr volatility sharpe sortino max_drawdown calmar")
def _(r):
    nav = r.dense_bars.select("security_id", "session_date", F.col("adjusted_open").alias("portfolio_nav")).join(
        r.dense_benchmark.select("session_date", F.col("open").alias("benchmark_nav")), "session_date")
    return p.performance(nav, ["security_id"])


@query("PRT11_portfolio_history", f"""
    WITH t AS (SELECT formation_date, security_id, 1.0 / {SIZE} AS w FROM ({TARGETS}) WHERE month(formation_date) <> 6),
    d AS (SELECT formation_date, lag(formation_date) OVER (ORDER BY formation_date) AS previous FROM (SELECT DISTINCT formation_date FROM t)),
    o AS (SELECT d.formation_date AS fd, t.security_id, t.w FROM d JOIN t ON t.formation_date = d.previous),
    c AS (SELECT coalesce(t.formation_date, o.fd) AS formation_date, sum(abs(coalesce(t.w, 0) - coalesce(o.w, 0))) / 2 AS turnover FROM t FULL JOIN o ON o.fd = t.formation_date AND o.security_id = t.security_id GROUP BY 1)
    SELECT * FROM (SELECT d.formation_date, 'official' AS state, previous, CASE WHEN previous IS NOT NULL THEN turnover END AS turnover FROM d JOIN c USING (formation_date)
                   UNION ALL SELECT formation_date, 'missed', NULL, NULL FROM formations WHERE month(formation_date) = 6) ORDER BY formation_date DESC LIMIT 40""", digits="turnover")
def _(r):
    weights = targets(r).where("month(formation_date) <> 6")
    return p.portfolio_history(weights.select("formation_date").distinct(), weights, r.formations.where("month(formation_date) = 6"), 40)


@query("PRT12_truthfulness_audit", f"""
    WITH b AS ({BOOK}), s AS (SELECT formation_date, security_id, row_number() OVER (PARTITION BY formation_date ORDER BY score DESC, security_id) AS rk FROM ({BRAND_SCORES})),
    h AS (SELECT * FROM b WHERE NOT (month(formation_date) = 3 AND target_rank = 1)),
    f AS (SELECT formation_date, any_value(execution_date) AS execution_date, any_value(starting_nav) AS nav FROM b GROUP BY 1),
    g AS (SELECT f.*, (SELECT count(*) FROM h WHERE h.formation_date = f.formation_date) AS np, (SELECT sum(notional) FROM h WHERE h.formation_date = f.formation_date) AS spent FROM f)
    SELECT formation_date, 'position_count' AS finding FROM g WHERE np <> {SIZE} UNION ALL SELECT formation_date, 'buy_count' FROM g WHERE np <> {SIZE}
    UNION ALL SELECT formation_date, 'positions_not_top_ranked' FROM g WHERE np <> {SIZE} UNION ALL SELECT formation_date, 'nav_does_not_tie' FROM g WHERE abs(spent - nav) > 0.01
    UNION ALL SELECT formation_date, 'execution_not_next_open' FROM g WHERE month(formation_date) = 8 UNION ALL SELECT formation_date, 'both_missed_and_official' FROM g WHERE month(formation_date) = 6""")
def _(r):
    held = book(r)
    late = F.when(F.month("formation_date") == 8, F.date_add("execution_date", 7)).otherwise(F.col("execution_date"))
    runs = held.groupBy("formation_date").agg(F.first("execution_date").alias("execution_date"), F.max("starting_nav").alias("starting_nav")).withColumn(
        "execution_date", late).withColumn("ending_cash", F.lit(0.0))
    kept = held.where("NOT (month(formation_date) = 3 AND target_rank = 1)")
    scores = p.top_rows(brand_scores(r), ["formation_date"], [F.col("score").desc(), F.col("security_id").asc()], SIZE, rank="score_rank").withColumn("model_version", F.lit("m"))
    buys = kept.select("formation_date", "security_id", F.lit("buy").alias("side"), "notional")
    return p.truthfulness_audit(runs, kept, buys, scores, r.sessions, r.formations.where("month(formation_date) = 6"), SIZE)


@query("PRT13_selection_manifest", """
    WITH l AS (SELECT max(formation_date) AS formation_date FROM predictions GROUP BY date_trunc('month', formation_date)),
    k AS (SELECT formation_date, security_id, prediction, actual FROM predictions JOIN l USING (formation_date) WHERE model_key = 'candidate')
    SELECT formation_date, 'baseline' AS book, row_number() OVER (PARTITION BY formation_date ORDER BY actual, security_id) AS place, security_id FROM k QUALIFY place <= 20
    UNION ALL SELECT formation_date, 'model', row_number() OVER (PARTITION BY formation_date ORDER BY prediction DESC, security_id) AS place, security_id FROM k QUALIFY place <= 20""")
def _(r):
    rows = r.predictions.where("model_key = 'candidate'").withColumn("baseline_rank", F.col("actual"))
    return p.selection_manifest(rows)


FOLDS = "(1, DATE '1995-01-01', DATE '1996-12-31'), (2, DATE '1997-01-01', DATE '1998-12-31'), (3, DATE '1998-06-01', DATE '2000-12-31')"


@query("PRT14_month_end_fold_scores", f"""
    WITH f AS (SELECT * FROM (VALUES {FOLDS}) AS v(outer_fold, a, b)), o AS (SELECT formation_date, feature_key, security_id, value FROM outcomes WHERE feature_key <> 'median_dollar_volume_20d'),
    m AS (SELECT formation_date, max(outer_fold) AS outer_fold FROM (SELECT DISTINCT formation_date FROM o) JOIN f ON formation_date BETWEEN a AND b GROUP BY 1 HAVING count(*) = 1)
    SELECT outer_fold, formation_date, security_id, sum(coefficient * outer_fold * (value - mean) / scale) AS prediction FROM o JOIN m USING (formation_date) JOIN model_inputs USING (feature_key)
    GROUP BY 1, 2, 3 HAVING count(value) = count(*)""", digits="prediction:9")
def _(r):
    folds = r.spark.sql(f"SELECT * FROM VALUES {FOLDS} AS t(outer_fold, valid_from, valid_to)")
    inputs = r.model_inputs.withColumn("outer_fold", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("coefficient", F.col("coefficient") * F.col("outer_fold"))
    return p.score_by_fold(r.outcomes.where("feature_key <> 'median_dollar_volume_20d'").select("formation_date", "security_id", "feature_key", "value"), folds, inputs.drop("ordinal"))
