"""LBL: labels and wealth accounting."""

from pyspark.sql import functions as F

from ..functions.calendar import forward_sessions, label_windows
from ..operators import labels as lb
from ..functions.ranks import top_rows
from . import query
from .joins import WINDOWS

SNAPS = "SELECT b.security_id, b.session_date AS score_date FROM bars b JOIN formations f ON f.formation_date = b.session_date"
FORWARD = f"""
    WITH w AS (SELECT s.session_date AS score_date, h AS horizon, a.session_date AS entry, b.session_date AS exit FROM sessions s, (VALUES (5), (20), (60)) AS v(h)
               JOIN sessions a ON a.idx = s.idx + 1 JOIN sessions b ON b.idx = s.idx + h)
    SELECT n.security_id, n.score_date, horizon, exit AS outcome_date,
           CASE WHEN se.close IS NULL OR sx.close IS NULL THEN 'withheld' ELSE 'completed' END AS status,
           CASE WHEN se.close IS NULL OR sx.close IS NULL THEN 'security price unavailable' END AS reason,
           sx.close / se.close - bx.close / be.close AS relative_return
    FROM ({SNAPS}) n JOIN w USING (score_date) JOIN benchmark_bars be ON be.session_date = entry JOIN benchmark_bars bx ON bx.session_date = exit
    LEFT JOIN bars se ON se.security_id = n.security_id AND se.session_date = entry LEFT JOIN bars sx ON sx.security_id = n.security_id AND sx.session_date = exit"""


def snapshots(r):
    return r.bars.select("security_id", F.col("session_date").alias("score_date")).join(
        r.formations.select(F.col("formation_date").alias("score_date")), "score_date", "left_semi")


def forward(r):
    return lb.forward_returns(snapshots(r), r.sessions, r.bars, r.benchmark_bars, [5, 20, 60]).drop("cutoff_at")


@query("LBL01_forward_return", FORWARD, digits="relative_return")
def _(r):
    return forward(r)


def wealth_sql(windows: str = WINDOWS, price: str = "unadjusted_open") -> str:
    return f"""
    WITH w AS ({windows}), j AS (SELECT security_id, session_date, {price} AS price,
         {price} * (CASE WHEN session_date = DATE '1998-06-08' THEN 2.0 ELSE 1.0 END) / lag({price}) OVER (PARTITION BY security_id ORDER BY session_date) - 1 AS jump FROM dense_bars),
    p AS (SELECT w.formation_date, j.security_id, any_value(w.entry_date) AS entry_date, any_value(w.outcome_date) AS outcome_date, count(*) AS marks,
                 max(CASE WHEN session_date = w.entry_date THEN price END) AS ep, max(CASE WHEN session_date = w.outcome_date THEN price END) AS xp,
                 min(CASE WHEN session_date > w.entry_date AND abs(jump) > 0.15 THEN session_date END) AS jd
          FROM w JOIN j ON j.session_date BETWEEN w.entry_date AND w.outcome_date GROUP BY 1, 2),
    q AS (SELECT p.formation_date, p.security_id, bool_or(action_type = 'spin_off') AS spun, coalesce(product(ratio_numerator / ratio_denominator), 1.0) AS quantity,
                 sum(cash_amount * (CASE WHEN effective_date > DATE '1998-06-08' AND p.entry_date < DATE '1998-06-08' AND p.outcome_date >= DATE '1998-06-08' THEN 2.0 ELSE 1.0 END)) AS cash
          FROM p JOIN actions a ON a.security_id = p.security_id AND effective_date > p.entry_date AND effective_date <= p.outcome_date GROUP BY 1, 2),
    z AS (SELECT *, coalesce(quantity, 1.0) AS qt, coalesce(cash, 0.0) AS cs, CASE WHEN marks < 21 THEN 'missing_complete_security_price_path' WHEN spun THEN 'unresolved complex corporate action: spin_off'
                         WHEN jd IS NOT NULL THEN 'unexplained structural price discontinuity on ' || jd END AS reason FROM p LEFT JOIN q USING (formation_date, security_id))
    SELECT formation_date, security_id, entry_date, outcome_date, reason, CASE WHEN reason IS NULL THEN qt END AS quantity, CASE WHEN reason IS NULL THEN cs END AS cash,
           CASE WHEN reason IS NULL THEN (qt * xp + cs) / ep - 1 END AS wealth_return FROM z"""


def brand_bars(r):
    return r.dense_bars.select("security_id", "session_date", F.col("unadjusted_open").alias("price"), "available_at")


def wealth(r, windows=None):
    return lb.wealth_returns(brand_bars(r), r.actions, r.sessions, label_windows(r.sessions, r.formations) if windows is None else windows)


WEALTH_COLUMNS = ["formation_date", "security_id", "entry_date", "outcome_date", "reason", "quantity", "cash", "wealth_return"]


@query("LBL02_wealth_return", wealth_sql(), digits="quantity cash wealth_return")
def _(r):
    return wealth(r).select(*WEALTH_COLUMNS)


def relative(r):
    series = r.dense_benchmark.select(F.lit(-1).cast("long").alias("security_id"), "session_date", F.col("open").alias("price"), "available_at")
    benchmark = lb.wealth_returns(series, r.actions.where("false"), r.sessions, label_windows(r.sessions, r.formations))
    return lb.relative_wealth(wealth(r), benchmark)


RELATIVE = f"""
    SELECT s.formation_date, s.security_id, s.wealth_return, CASE WHEN bj IS NULL THEN b.benchmark_return END AS benchmark_return,
           CASE WHEN s.reason IS NOT NULL OR bj IS NOT NULL THEN concat_ws('; ', s.reason, 'unexplained structural price discontinuity on ' || bj) END AS reason,
           CASE WHEN bj IS NULL THEN s.wealth_return - b.benchmark_return END AS relative_return
    FROM ({wealth_sql()}) s JOIN (
      SELECT w.formation_date, max(CASE WHEN j.session_date = w.outcome_date THEN open END) / max(CASE WHEN j.session_date = w.entry_date THEN open END) - 1 AS benchmark_return,
             min(CASE WHEN j.session_date > w.entry_date AND abs(jump) > 0.15 THEN j.session_date END) AS bj
      FROM ({WINDOWS}) w JOIN (SELECT session_date, open, open / lag(open) OVER (ORDER BY session_date) - 1 AS jump FROM dense_benchmark) j ON j.session_date BETWEEN w.entry_date AND w.outcome_date GROUP BY 1) b USING (formation_date)"""


@query("LBL03_relative_wealth", RELATIVE, digits="wealth_return benchmark_return relative_return")
def _(r):
    return relative(r).select("formation_date", "security_id", "wealth_return", "benchmark_return", "reason", "relative_return")


@query("LBL04_twenty_session_label", f"""
    SELECT formation_date, security_id, relative_return, reason, CASE WHEN reason IS NULL THEN 64 END AS hash_length FROM ({RELATIVE})""", digits="relative_return")
def _(r):
    out = lb.with_label_hash(relative(r))
    return out.select("formation_date", "security_id", "relative_return", "reason", F.length("label_sha256").alias("hash_length"))


@query("LBL05_exclusion_category", f"""
    SELECT CASE WHEN reason LIKE 'unexplained%' THEN 'unexplained_structural_price_discontinuity' WHEN reason LIKE 'unresolved%' THEN 'unresolved_complex_corporate_action:spin_off' ELSE reason END AS category, count(*) AS labels
    FROM ({wealth_sql()}) WHERE reason IS NOT NULL GROUP BY 1""")
def _(r):
    rows = wealth(r).where("reason IS NOT NULL")
    return rows.groupBy(lb.exclusion_category(F.col("reason")).alias("category")).agg(F.count(F.lit(1)).alias("labels"))


@query("LBL06_execution_periods", """
    SELECT formation_date, next_session AS execution_date, lead(next_session) OVER (ORDER BY formation_date) AS exit_date FROM formations JOIN sessions ON session_date = formation_date
    QUALIFY lead(next_session) OVER (ORDER BY formation_date) IS NOT NULL""")
def _(r):
    return lb.execution_periods(r.formations, r.sessions)


PERIODS = """SELECT formation_date, next_session AS execution_date, lead(next_session) OVER (ORDER BY formation_date) AS exit_date FROM formations JOIN sessions ON session_date = formation_date"""
PICKS = "SELECT formation_date, security_id FROM dense_bars JOIN formations ON formation_date = session_date QUALIFY row_number() OVER (PARTITION BY formation_date ORDER BY volume DESC, security_id) <= 10"


def picks(r, size=10):
    rows = r.dense_bars.withColumnRenamed("session_date", "formation_date").join(r.formations.select("formation_date"), "formation_date", "left_semi")
    return top_rows(rows, ["formation_date"], [F.col("volume").desc(), F.col("security_id").asc()], size).select("formation_date", "security_id")


def brand_opens(r):
    return r.dense_bars.select("security_id", "session_date", F.col("adjusted_open").alias("open"))


@query("LBL07_basket_return", f"""
    SELECT formation_date, execution_date, exit_date, count(*) AS names, count(*) = 10 AND count(x.adjusted_open / e.adjusted_open) = 10 AS complete,
           CASE WHEN count(*) = 10 AND count(x.adjusted_open / e.adjusted_open) = 10 THEN avg(x.adjusted_open / e.adjusted_open) - 1 END AS gross_return
    FROM ({PICKS}) p JOIN ({PERIODS}) d USING (formation_date) LEFT JOIN dense_bars e ON e.security_id = p.security_id AND e.session_date = execution_date
    LEFT JOIN dense_bars x ON x.security_id = p.security_id AND x.session_date = exit_date WHERE exit_date IS NOT NULL GROUP BY 1, 2, 3""", digits="gross_return")
def _(r):
    return lb.basket_returns(picks(r), lb.execution_periods(r.formations, r.sessions), brand_opens(r), 10)


EVERY = "SELECT f.session_date AS formation_date, a.session_date AS entry_date, b.session_date AS outcome_date FROM sessions f JOIN sessions a ON a.idx = f.idx + 1 JOIN sessions b ON b.idx = f.idx + 21"
DIFFERENCES = f"""SELECT s.formation_date, s.security_id, reason, abs(wealth_return - (x.adjusted_open / e.adjusted_open - 1)) AS difference FROM ({wealth_sql(EVERY)}) s
    LEFT JOIN dense_bars e ON e.security_id = s.security_id AND e.session_date = s.entry_date LEFT JOIN dense_bars x ON x.security_id = s.security_id AND x.session_date = s.outcome_date"""


def differences(r):
    windows = forward_sessions(r.sessions, {"entry_date": 1, "outcome_date": 21}).where("outcome_date IS NOT NULL")
    opens = lambda side: brand_opens(r).select("security_id", F.col("session_date").alias(side), F.col("open").alias(f"{side}_open"))
    rows = wealth(r, windows).join(opens("entry_date"), ["security_id", "entry_date"], "left").join(opens("outcome_date"), ["security_id", "outcome_date"], "left")
    return rows.withColumn("difference", F.abs(F.col("wealth_return") - (F.col("outcome_date_open") / F.col("entry_date_open") - 1)))


@query("LBL08_total_return_reconciliation", f"""
    WITH d AS ({DIFFERENCES}), o AS (SELECT difference, row_number() OVER (ORDER BY difference) - 1 AS i, count(*) OVER () AS n FROM d WHERE difference IS NOT NULL)
    SELECT (SELECT count(difference) FROM d) AS comparisons, (SELECT count(*) FROM d WHERE reason IS NOT NULL) AS withheld, (SELECT max(difference) FROM d) AS largest,
           p95, p95 <= 0.001 AND (SELECT max(difference) FROM d) <= 0.0025 AS passed FROM (SELECT max(difference) AS p95 FROM o WHERE i = floor((n - 1) * 0.95 + 0.5))""", digits="largest p95")
def _(r):
    return lb.reconciliation_report(differences(r))


@query("LBL08_reconciliation_outliers", f"SELECT formation_date, security_id, difference FROM ({DIFFERENCES}) WHERE difference IS NOT NULL ORDER BY round(difference, 9) DESC, formation_date, security_id LIMIT 10", digits="difference")
def _(r):
    rows = differences(r).where("difference IS NOT NULL")
    return rows.orderBy(F.round("difference", 9).desc(), "formation_date", "security_id").limit(10).select("formation_date", "security_id", "difference")


@query("LBL09_mark_to_market", f"""
    SELECT p.formation_date AS run_id, b.session_date, count(*) FILTER (d.adjusted_open IS NULL) AS missing,
           CASE WHEN count(*) FILTER (d.adjusted_open IS NULL) = 0 THEN (10.0 + sum(0.5 * d.adjusted_open)) / 1000 - 1 END AS portfolio_return
    FROM ({PICKS}) p JOIN ({PERIODS}) b0 USING (formation_date) JOIN sessions b ON b.session_date = b0.exit_date LEFT JOIN dense_bars d ON d.security_id = p.security_id AND d.session_date = b.session_date GROUP BY 1, 2""",
       digits="portfolio_return")
def _(r):
    periods = lb.execution_periods(r.formations, r.sessions)
    positions = picks(r).join(periods, "formation_date").select(
        F.col("formation_date").alias("run_id"), "security_id", F.col("exit_date").alias("session_date"), F.lit(0.5).alias("quantity"), F.lit(10.0).alias("ending_cash"), F.lit(1000.0).alias("starting_nav"))
    return lb.mark_to_market(positions, r.dense_bars.select("security_id", "session_date", F.col("adjusted_open").alias("close")))


@query("LBL10_portfolio_checkpoints", f"""
    SELECT p.formation_date, count(*) AS positions, max(CASE WHEN w.entry_date IS NULL THEN 'price path unavailable' ELSE reason END) AS reason,
           CASE WHEN max(CASE WHEN w.entry_date IS NULL THEN 'price path unavailable' ELSE reason END) IS NULL THEN avg(wealth_return) END AS portfolio_return
    FROM ({PICKS}) p LEFT JOIN ({wealth_sql()}) w USING (formation_date, security_id) GROUP BY 1""", digits="portfolio_return")
def _(r):
    return lb.checkpoint_outcomes(picks(r), wealth(r))


@query("LBL11_forward_readiness", f"""
    WITH o AS ({FORWARD}), t AS (SELECT count(*) AS total FROM ({SNAPS}))
    SELECT h AS horizon, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'withheld') AS withheld,
           count(DISTINCT score_date) FILTER (status = 'completed') AS completed_dates, max(outcome_date) AS latest_outcome, any_value(total) - count(status) AS pending
    FROM (VALUES (5), (20), (60), (90)) AS v(h) CROSS JOIN t LEFT JOIN o ON o.horizon = h GROUP BY 1""")
def _(r):
    return lb.forward_readiness(snapshots(r), forward(r), [5, 20, 60, 90])
