"""FND: fundamentals."""

from pyspark.sql import functions as F

from ..functions.scalars import filing_available_at
from ..operators import fundamentals as f
from ..session import cut_lineage
from . import query

CELL = f.CELL
KNOWN = "SELECT f.formation_date, x.* FROM formations f JOIN facts x ON x.available_at <= f.decision_at"
ANNUAL = f"""
    SELECT formation_date, security_id, value AS income, concept, period_start, period_end AS income_end FROM ({KNOWN})
    WHERE concept IN ('NetIncomeLoss', 'ProfitLoss') AND period_end - period_start BETWEEN 330 AND 370
    QUALIFY row_number() OVER (PARTITION BY formation_date, security_id ORDER BY concept, period_end DESC, available_at DESC, accession DESC) = 1"""


def newest(concept: str, name: str) -> str:
    return f"""SELECT formation_date, security_id, value AS {name}, period_end AS {name}_end FROM ({KNOWN}) WHERE concept = '{concept}'
    QUALIFY row_number() OVER (PARTITION BY formation_date, security_id ORDER BY period_end DESC, available_at DESC, accession DESC) = 1"""


CLOSES = "SELECT b.session_date AS formation_date, b.security_id, b.close FROM unadjusted_bars b JOIN formations f ON f.formation_date = b.session_date"


def closes(r, adjusted=False):
    """Closes of the formation sessions; trades of other sessions make no bar."""
    sessions = r.formations.select(F.col("formation_date").alias("session_date"))
    bars = r.bars_of(r.trades.join(sessions, "session_date", "left_semi"))
    return (bars if adjusted else r.unadjusted(bars)).select(F.col("session_date").alias("formation_date"), "security_id", "close")


@query("FND01_annual_net_income", ANNUAL, digits="income:4")
def _(r):
    return f.annual_income(r.facts, r.formations)


@query("FND02_earnings_yield_ttm", f"""
    SELECT c.formation_date, c.security_id, CASE WHEN income IS NULL THEN 'missing_annual_income' WHEN shares IS NULL THEN 'missing_shares' WHEN shares <= 0 THEN 'nonpositive_shares' END AS reason,
           income / (close * shares) AS earnings_yield_ttm
    FROM ({CLOSES}) c LEFT JOIN ({ANNUAL}) a USING (formation_date, security_id) LEFT JOIN ({newest(f.SHARES, 'shares')}) s USING (formation_date, security_id)""",
       digits="earnings_yield_ttm:9")
def _(r):
    return f.earnings_yield(f.annual_income(r.facts, r.formations), f.latest_facts(r.facts, r.formations, f.SHARES, "shares"), closes(r))


ROA = f"""
    WITH a AS ({ANNUAL}), k AS ({KNOWN}),
    b AS (SELECT a.formation_date, a.security_id, arg_max(k.value, row(k.period_end, k.available_at, k.accession)) AS begin_assets FROM a JOIN k ON k.formation_date = a.formation_date
            AND k.security_id = a.security_id AND k.concept = 'Assets' AND a.period_start - k.period_end BETWEEN 0 AND 7 GROUP BY 1, 2),
    e AS (SELECT a.formation_date, a.security_id, arg_max(k.value, row(k.available_at, k.accession)) AS end_assets FROM a JOIN k ON k.formation_date = a.formation_date
            AND k.security_id = a.security_id AND k.concept = 'Assets' AND k.period_end = a.income_end GROUP BY 1, 2)
    SELECT formation_date, security_id, income / ((begin_assets + end_assets) / 2) AS return_on_assets_ttm,
           CASE WHEN begin_assets IS NULL THEN 'missing_begin_assets' WHEN end_assets IS NULL THEN 'missing_end_assets' END AS reason
    FROM a LEFT JOIN b USING (formation_date, security_id) LEFT JOIN e USING (formation_date, security_id)"""


@query("FND03_return_on_assets_ttm", ROA, digits="return_on_assets_ttm")
def _(r):
    out = f.return_on_assets(f.annual_income(r.facts, r.formations), f.asset_history(r.facts, r.formations), r.formations)
    return out.select(*CELL, "return_on_assets_ttm", "reason")


HISTORY = """
    SELECT security_id, period_start, period_end, concept, value FROM facts
    WHERE concept IN ('NetIncomeLoss', 'ProfitLoss') AND period_end - period_start BETWEEN 330 AND 370
    QUALIFY row_number() OVER (PARTITION BY security_id, period_end ORDER BY concept, available_at DESC, accession DESC) = 1"""


@query("FND04_roa_change_yoy", f"""
    WITH h AS ({HISTORY}), a AS (SELECT security_id, period_end, value FROM facts WHERE concept = 'Assets'),
    roa AS (SELECT h.security_id, h.period_end AS income_end, h.value / ((b.value + e.value) / 2) AS roa FROM h
            JOIN a b ON b.security_id = h.security_id AND h.period_start - b.period_end BETWEEN 0 AND 7 JOIN a e ON e.security_id = h.security_id AND e.period_end = h.period_end)
    SELECT security_id, income_end, roa, roa - prior AS roa_change FROM (
      SELECT *, lag(roa) OVER o AS prior, income_end - lag(income_end) OVER o AS gap FROM roa WINDOW o AS (PARTITION BY security_id ORDER BY income_end)) WHERE gap BETWEEN 330 AND 400""", digits="roa roa_change")
def _(r):
    return f.roa_change(r.facts)


@query("FND05_annual_income_history", HISTORY, digits="value:4")
def _(r):
    return f.annual_history(r.facts).select("security_id", "period_start", "period_end", "concept", "value")


QUARTERS = """
    WITH s AS (SELECT * FROM {known} WHERE unit = 'USD' AND taxonomy = 'us-gaap' AND
                 ((fiscal_period = 'Q1' AND period_end - period_start BETWEEN 70 AND 120) OR (fiscal_period = 'Q2' AND period_end - period_start BETWEEN 150 AND 220)
                  OR (fiscal_period = 'Q3' AND period_end - period_start BETWEEN 230 AND 310) OR (fiscal_period = 'FY' AND period_end - period_start BETWEEN 320 AND 390))
               QUALIFY row_number() OVER (PARTITION BY {keys} security_id, concept, period_start, fiscal_year, fiscal_period ORDER BY available_at DESC, accepted_at DESC, is_amendment DESC, accession DESC) = 1)
    SELECT {keys} security_id, concept, 'Q1' AS quarter, period_start, period_end, value FROM s WHERE fiscal_period = 'Q1'
    UNION ALL SELECT {ckeys} c.security_id, c.concept, CASE c.fiscal_period WHEN 'FY' THEN 'Q4' ELSE c.fiscal_period END, p.period_end + 1, c.period_end, c.value - p.value
    FROM s c JOIN s p ON {same} c.security_id = p.security_id AND c.concept = p.concept AND c.period_start = p.period_start AND c.fiscal_year = p.fiscal_year
     AND (p.fiscal_period, c.fiscal_period) IN (('Q1', 'Q2'), ('Q2', 'Q3'), ('Q3', 'FY')) WHERE c.period_end - p.period_end - 1 BETWEEN 65 AND 120"""
ALL_QUARTERS = QUARTERS.format(known="facts", keys="", ckeys="", same="")
KNOWN_QUARTERS = QUARTERS.format(known=f"({KNOWN})", keys="formation_date,", ckeys="c.formation_date,", same="c.formation_date = p.formation_date AND ")


@query("FND06_standalone_quarters", ALL_QUARTERS, digits="value:2")
def _(r):
    return f.latest_quarters(f.standalone_quarters(r.facts)).select("security_id", "concept", "quarter", "period_start", "period_end", "value")


@query("FND07_latest_unambiguous", """
    SELECT security_id, concept, period_end, arg_max(value, lineage_key) AS value FROM (
      SELECT security_id, concept, period_end, round(value / 10, 0) AS value, date_trunc('day', observed_at) AS seen, lineage_key,
             max(date_trunc('day', observed_at)) OVER (PARTITION BY security_id, concept, period_end) AS latest FROM observations)
    WHERE seen = latest GROUP BY 1, 2, 3 HAVING min(value) = max(value)""", digits="value")
def _(r):
    rows = r.observations.select(
        "security_id", "concept", "period_end", F.round(F.col("value") / 10, 0).alias("value"), F.date_trunc("day", "observed_at").alias("available_at"),
        F.lit("2024-01-01").cast("timestamp").alias("accepted_at"), F.lit(False).alias("is_amendment"), F.col("lineage_key").alias("accession"))
    return f.latest_unambiguous(rows, ["security_id", "concept", "period_end"]).select("security_id", "concept", "period_end", "value")


def ttm_sql(concepts: str, name: str) -> str:
    return f"""
    SELECT formation_date, security_id, sum(value) AS {name}, max(period_end) AS {name}_end, concept AS {name}_concept FROM (
      SELECT *, coalesce(period_start - lag(period_end) OVER (PARTITION BY formation_date, security_id, concept ORDER BY period_end) - 1, 0) AS gap FROM (
        SELECT * FROM ({KNOWN_QUARTERS}) WHERE concept IN ({concepts}) AND period_end <= formation_date
        QUALIFY row_number() OVER (PARTITION BY formation_date, security_id, concept ORDER BY period_end DESC) <= 4))
    GROUP BY formation_date, security_id, concept HAVING count(*) = 4 AND bool_and(gap BETWEEN 0 AND 7)
    QUALIFY row_number() OVER (PARTITION BY formation_date, security_id ORDER BY concept) = 1"""


@query("FND08_true_ttm", ttm_sql("'NetIncomeLoss', 'ProfitLoss'", "income"), digits="income:2")
def _(r):
    return f.true_ttm(f.standalone_quarters(r.facts), r.formations, f.INCOME, "income")


ASSETS, SHARES, EQUITY = newest("Assets", "assets"), newest(f.SHARES, "shares"), newest("StockholdersEquity", "equity")


@query("FND09_latest_endpoint", f"SELECT *, 'StockholdersEquity' AS concept, CAST(NULL AS VARCHAR) AS equity_reason FROM ({EQUITY})", digits="equity:4")
def _(r):
    return f.latest_endpoint(r.facts, r.formations, f.EQUITY, "equity")


def prior_sql(current: str, concept: str, name: str) -> str:
    return f"""
    SELECT c.formation_date, c.security_id, max(k.period_end) AS prior_{name}_end, arg_max(k.value, k.period_end) AS prior_{name}
    FROM ({current}) c JOIN ({KNOWN}) k ON k.formation_date = c.formation_date AND k.security_id = c.security_id AND k.concept = '{concept}'
     AND c.{name}_end - k.period_end BETWEEN 330 AND 400 GROUP BY 1, 2"""


@query("FND10_comparable_prior", prior_sql(ASSETS, "Assets", "assets"), digits="prior_assets:2")
def _(r):
    return f.comparable_prior(r.facts, r.formations, "Assets", "assets")


def spans(r, shares=None, prior=None):
    shares = f.latest_endpoint(r.facts, r.formations, [f.SHARES], "shares", positive=True) if shares is None else shares
    prior = f.comparable_prior(r.facts, r.formations, f.SHARES, "shares") if prior is None else prior
    return shares.join(prior, CELL).join(r.formations, "formation_date").select(
        *CELL, F.col("prior_shares_end").alias("span_start"), F.col("shares_end").alias("span_end"), "decision_at")


FACTOR = f"""
    WITH s AS ({SHARES}), p AS ({prior_sql(SHARES, f.SHARES, 'shares')}),
    j AS (SELECT s.formation_date, s.security_id, a.action_type, a.ratio_numerator / a.ratio_denominator AS ratio FROM s JOIN p USING (formation_date, security_id) JOIN formations f USING (formation_date)
          LEFT JOIN actions a ON a.security_id = s.security_id AND a.effective_date > prior_shares_end AND a.effective_date <= shares_end AND a.available_at <= f.decision_at)
    SELECT formation_date, security_id, CASE WHEN count(*) FILTER (action_type = 'spin_off') > 0 THEN 'structural_corporate_action' END AS factor_reason,
           CASE WHEN count(*) FILTER (action_type = 'spin_off') = 0 THEN coalesce(product(ratio) FILTER (action_type = 'forward_split'), 1.0) END AS factor FROM j GROUP BY 1, 2"""


@query("FND11_split_adjustment_factor", FACTOR, digits="factor")
def _(r):
    return f.split_factor(r.actions, spans(r))


def stale(name: str, label: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '{label}:unavailable' WHEN formation_date - {name}_end > 450 THEN '{label}:stale_over_450d' END"


SNAPSHOT = f"""
    SELECT * FROM ({ASSETS}) FULL JOIN ({SHARES}) USING (formation_date, security_id) FULL JOIN ({EQUITY}) USING (formation_date, security_id)
    FULL JOIN ({ttm_sql("'NetIncomeLoss', 'ProfitLoss'", "income")}) USING (formation_date, security_id)
    FULL JOIN ({ttm_sql("'NetCashProvidedByUsedInOperatingActivities'", "cash")}) USING (formation_date, security_id)
    FULL JOIN ({prior_sql(ASSETS, "Assets", "assets")}) USING (formation_date, security_id) FULL JOIN ({prior_sql(SHARES, f.SHARES, "shares")}) USING (formation_date, security_id)"""
NO_CAP = stale("shares", "shares")
NO_ASSETS = f"coalesce({stale('assets', 'assets')}, CASE WHEN prior_assets IS NULL THEN 'prior_assets:unavailable' END)"
NO_INCOME, NO_CASH, NO_EQUITY = stale("income", "net_income_ttm"), stale("cash", "operating_cash_flow_ttm"), stale("equity", "equity")
AVG = "((assets + prior_assets) / 2)"
DEFS = [
    ("book_to_market", f"coalesce({NO_CAP}, {NO_EQUITY})", "equity / (close * shares)"),
    ("earnings_yield_ttm", f"coalesce({NO_CAP}, {NO_INCOME})", "income / (close * shares)"),
    ("operating_cash_flow_yield_ttm", f"coalesce({NO_CAP}, {NO_CASH})", "cash / (close * shares)"),
    ("return_on_assets_ttm", f"coalesce({NO_ASSETS}, {NO_INCOME})", f"income / {AVG}"),
    ("operating_cash_flow_profitability_ttm", f"coalesce({NO_ASSETS}, {NO_CASH})", f"cash / {AVG}"),
    ("accrual_quality_ttm", f"coalesce({NO_ASSETS}, {NO_INCOME}, {NO_CASH}, CASE WHEN abs(income_end - cash_end) > 7 THEN 'misaligned_ttm_periods' END)", f"(income - cash) / {AVG}"),
    ("asset_growth_yoy", NO_ASSETS, "assets / prior_assets - 1"),
    ("net_share_issuance_yoy", f"coalesce({NO_CAP}, CASE WHEN prior_shares IS NULL THEN 'prior_shares:unavailable' END, factor_reason)", "shares / (prior_shares * factor) - 1"),
]
FEATURES = f"WITH w AS MATERIALIZED (SELECT * FROM ({CLOSES}) LEFT JOIN ({SNAPSHOT}) USING (formation_date, security_id) LEFT JOIN ({FACTOR}) USING (formation_date, security_id)) " + " UNION ALL ".join(
    f"SELECT formation_date, security_id, '{key}' AS feature_key, CASE WHEN {reason} IS NULL THEN {value} END AS value, {reason} AS reason FROM w" for key, reason, value in DEFS)


def features(r):
    """Snapshots are written once; spans and features both read them."""
    snapshot = cut_lineage(f.accounting_snapshot(r.facts, r.formations))
    held = snapshot.where("shares IS NOT NULL AND prior_shares_end IS NOT NULL").join(r.formations, "formation_date").select(
        *CELL, F.col("prior_shares_end").alias("span_start"), F.col("shares_end").alias("span_end"), "decision_at")
    return f.accounting_features(snapshot, closes(r), f.split_factor(r.actions, held))


@query("FND12_accounting_features", FEATURES, digits="value:8")
def _(r):
    return features(r)


@query("FND13_accounting_snapshot", f"""SELECT formation_date, security_id, assets, prior_assets, equity, shares, prior_shares, income, cash FROM ({SNAPSHOT})""",
       digits="assets:2 prior_assets:2 equity:4 shares:2 prior_shares:2 income:2 cash:2")
def _(r):
    return f.accounting_snapshot(r.facts, r.formations).select(*CELL, "assets", "prior_assets", "equity", "shares", "prior_shares", "income", "cash")


def change_sql(concept: str, keep: str) -> str:
    return f"""
    WITH p AS (SELECT security_id, period_end, arg_max(value, row(available_at, is_amendment, accession)) AS value FROM facts WHERE concept = '{concept}' AND {keep} GROUP BY 1, 2),
    c AS (SELECT security_id, max(period_end) AS current_end, arg_max(value, period_end) AS current_value FROM p GROUP BY 1)
    SELECT c.*, p.period_end AS prior_end, p.value AS prior_value FROM c JOIN p USING (security_id) WHERE current_end - period_end BETWEEN 330 AND 400
    QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY abs(current_end - period_end - 365), period_end DESC) = 1"""


@query("FND14_asset_growth_monthly", f"SELECT security_id, current_end, prior_end, current_value / prior_value - 1 AS asset_growth FROM ({change_sql('Assets', 'true')})", digits="asset_growth:8")
def _(r):
    out = f.annual_prior_change(r.facts, "Assets")
    return out.select("security_id", "current_end", "prior_end", (F.col("current_value") / F.col("prior_value") - 1).alias("asset_growth"))


@query("FND15_net_share_issuance_monthly", f"""
    SELECT security_id, CASE WHEN structural THEN 'structural_corporate_action' END AS reason, CASE WHEN NOT structural THEN current_value / (prior_value * factor) - 1 END AS net_share_issuance FROM (
      SELECT s.security_id, current_value, prior_value, coalesce(bool_or(action_type = 'spin_off'), false) AS structural,
             coalesce(product(ratio_numerator / ratio_denominator) FILTER (action_type = 'forward_split'), 1.0) AS factor
      FROM ({change_sql(f.SHARES, 'true')}) s LEFT JOIN actions a ON a.security_id = s.security_id AND a.effective_date > prior_end AND a.effective_date <= current_end GROUP BY 1, 2, 3)""",
       digits="net_share_issuance:8")
def _(r):
    change = f.annual_prior_change(r.facts, f.SHARES)
    cells = change.select(F.lit("2099-12-31").cast("date").alias("formation_date"), "security_id", F.col("prior_end").alias("span_start"),
                          F.col("current_end").alias("span_end"), F.lit("2100-01-01").cast("timestamp").alias("decision_at"))
    joined = change.join(f.split_factor(r.actions, cells), "security_id")
    return joined.select("security_id", F.col("factor_reason").alias("reason"), (F.col("current_value") / (F.col("prior_value") * F.col("factor")) - 1).alias("net_share_issuance"))


@query("FND16_accrual_quality_monthly", """
    WITH b AS (SELECT security_id, concept, period_start, period_end, arg_max(value, row(available_at, is_amendment, accession)) AS value FROM facts
               WHERE period_end - period_start BETWEEN 330 AND 370 GROUP BY 1, 2, 3, 4),
    a AS (SELECT security_id, period_end, arg_max(value, row(available_at, accession)) AS value FROM facts WHERE concept = 'Assets' GROUP BY 1, 2)
    SELECT i.security_id, i.period_end, (i.value - c.value) / ((s.value + e.value) / 2) AS accrual_quality
    FROM b i JOIN b c ON c.security_id = i.security_id AND c.period_start = i.period_start AND c.period_end = i.period_end AND c.concept = 'NetCashProvidedByUsedInOperatingActivities'
    JOIN a s ON s.security_id = i.security_id AND abs(s.period_end - i.period_start) <= 7 JOIN a e ON e.security_id = i.security_id AND e.period_end = i.period_end
    WHERE i.concept IN ('NetIncomeLoss', 'ProfitLoss') QUALIFY row_number() OVER (PARTITION BY i.security_id ORDER BY i.period_end DESC) = 1""", digits="accrual_quality:8")
def _(r):
    return f.accrual_quality(r.facts)


CONSERVATIVE = KNOWN.replace("x.available_at", "x.available_at + INTERVAL 5 MINUTE")


@query("FND17_active_reference_fundamentals", f"""
    SELECT formation_date, security_id, return_on_assets_ttm, earnings_yield FROM ({ROA.replace(KNOWN, CONSERVATIVE)})
    LEFT JOIN (SELECT a.formation_date, a.security_id, income / (close * shares) AS earnings_yield FROM ({ANNUAL.replace(KNOWN, CONSERVATIVE)}) a
               JOIN ({newest(f.SHARES, 'shares').replace(KNOWN, CONSERVATIVE)}) s USING (formation_date, security_id)
               JOIN (SELECT session_date AS formation_date, security_id, close FROM bars) c USING (formation_date, security_id)) USING (formation_date, security_id)""",
       digits="return_on_assets_ttm earnings_yield:9")
def _(r):
    facts = r.facts.withColumn("available_at", filing_available_at(F.col("available_at")))
    income = f.annual_income(facts, r.formations)
    roa = f.return_on_assets(income, f.asset_history(facts, r.formations), r.formations)
    ey = f.earnings_yield(income, f.latest_facts(facts, r.formations, f.SHARES, "shares"), closes(r, adjusted=True))
    return roa.select(*CELL, "return_on_assets_ttm").join(ey.select(*CELL, F.col("earnings_yield_ttm").alias("earnings_yield")), CELL, "left")


@query("FND18_accounting_coverage_audit", f"""
    SELECT feature_key, sum(a) * 1.0 / sum(n) AS aggregate_coverage, min(a * 1.0 / n) AS minimum_coverage, count(*) AS formations FROM (
      SELECT feature_key, formation_date, count(value) AS a, count(*) AS n FROM ({FEATURES}) GROUP BY 1, 2) GROUP BY 1""", digits="aggregate_coverage minimum_coverage")
def _(r):
    return f.coverage_audit(features(r))
