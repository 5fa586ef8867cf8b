"""FND14-FND16 of every formation, as known at its decision."""

from pyspark.sql import functions as F

from ..operators import fundamentals as f
from ..operators import monthly_fundamentals as mf
from . import query
from .fundamentals import KNOWN

#: Facts in which every fifth company states weighted averages instead of shares on a date.
SHARE_FACTS = f"""
    SELECT * REPLACE (CASE WHEN weighted THEN '{mf.WEIGHTED_SHARES}' ELSE concept END AS concept, CASE WHEN weighted AND fiscal_period = 'FY' THEN make_date(fiscal_year, 1, 1) ELSE period_start END AS period_start)
    FROM (SELECT *, concept = '{f.SHARES}' AND security_id % 5 = 2 AS weighted FROM facts)"""


def share_facts(r):
    weighted = (F.col("concept") == f.SHARES) & (F.col("security_id") % 5 == 2)
    start = F.when(weighted & (F.col("fiscal_period") == "FY"), F.make_date("fiscal_year", F.lit(1), F.lit(1))).otherwise(F.col("period_start"))
    return r.facts.withColumn("period_start", start).withColumn("concept", F.when(weighted, F.lit(mf.WEIGHTED_SHARES)).otherwise(F.col("concept")))


def pairs_sql(facts: str, keep: str) -> str:
    return f"""
    WITH k AS MATERIALIZED (SELECT f.formation_date, x.security_id, x.concept, x.period_end, arg_max(x.value, row(x.available_at, x.is_amendment, x.accession)) AS value
           FROM formations f JOIN (SELECT * FROM ({facts}) WHERE {keep}) x ON x.available_at <= f.decision_at GROUP BY 1, 2, 3, 4),
    c AS (SELECT formation_date, security_id, concept, max(period_end) AS current_end, arg_max(value, period_end) AS current_value FROM k GROUP BY 1, 2, 3)
    SELECT c.*, k.period_end AS prior_end, k.value AS prior_value FROM c LEFT JOIN k ON k.formation_date = c.formation_date AND k.security_id = c.security_id AND k.concept = c.concept
      AND current_end - k.period_end BETWEEN 330 AND 400
    QUALIFY row_number() OVER (PARTITION BY c.formation_date, c.security_id, c.concept ORDER BY abs(current_end - k.period_end - 365) NULLS LAST, k.period_end DESC) = 1"""


@query("FND14_asset_growth_per_formation", f"""
    SELECT formation_date, security_id, current_end, prior_end, CASE WHEN prior_end IS NULL THEN 'missing_comparable_prior_assets' WHEN current_value <= 0 OR prior_value <= 0 THEN 'nonpositive_assets' END AS reason,
           CASE WHEN current_value > 0 AND prior_value > 0 THEN current_value / prior_value - 1 END AS asset_growth FROM ({pairs_sql('SELECT * FROM facts', "concept = 'Assets'")})""", digits="asset_growth:8")
def _(r):
    return mf.asset_growth(r.facts, r.formations)


@query("FND15_share_issuance_per_formation", f"""
    WITH p AS MATERIALIZED (SELECT * FROM ({pairs_sql(SHARE_FACTS, f"concept = '{f.SHARES}' OR concept = '{mf.WEIGHTED_SHARES}' AND period_end - period_start BETWEEN 330 AND 370")})
      QUALIFY row_number() OVER (PARTITION BY formation_date, security_id ORDER BY CASE WHEN prior_end IS NULL THEN 2 WHEN concept = '{f.SHARES}' THEN 0 ELSE 1 END, concept) = 1),
    x AS (SELECT p.formation_date, p.security_id, p.concept, current_value, prior_value, prior_end, coalesce(bool_or(action_type = 'spin_off'), false) AS structural,
                 coalesce(product(ratio_numerator / ratio_denominator) FILTER (action_type = 'forward_split'), 1.0) AS factor
          FROM p JOIN formations f USING (formation_date) LEFT JOIN actions a ON a.security_id = p.security_id AND a.effective_date > prior_end AND a.effective_date <= current_end AND a.available_at <= f.decision_at
          GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT formation_date, security_id, CASE WHEN prior_end IS NOT NULL THEN concept END AS concept,
           CASE WHEN prior_end IS NULL THEN 'missing_comparable_prior_shares' WHEN structural THEN 'structural_corporate_action' WHEN current_value <= 0 OR prior_value <= 0 THEN 'nonpositive_shares' END AS reason,
           CASE WHEN NOT structural AND current_value > 0 AND prior_value > 0 THEN current_value / (prior_value * factor) - 1 END AS net_share_issuance FROM x""", digits="net_share_issuance:8")
def _(r):
    return mf.net_share_issuance(share_facts(r), r.actions, r.formations)


@query("FND16_accrual_quality_per_formation", f"""
    WITH k AS MATERIALIZED ({KNOWN}),
    i AS (SELECT formation_date, security_id, period_start, period_end, value AS income FROM k WHERE concept IN ('NetIncomeLoss', 'ProfitLoss') AND period_end - period_start BETWEEN 330 AND 370
          QUALIFY row_number() OVER (PARTITION BY formation_date, security_id, period_start, period_end ORDER BY concept, available_at DESC, is_amendment DESC, accession DESC) = 1),
    c AS (SELECT formation_date, security_id, period_start, period_end, arg_max(value, row(available_at, is_amendment, accession)) AS cash FROM k
          WHERE concept = 'NetCashProvidedByUsedInOperatingActivities' AND period_end - period_start BETWEEN 330 AND 370 GROUP BY 1, 2, 3, 4),
    a AS (SELECT formation_date, security_id, period_end, arg_max(value, row(available_at, is_amendment, accession)) AS assets FROM k WHERE concept = 'Assets' GROUP BY 1, 2, 3)
    SELECT formation_date, security_id, i.period_end, CASE WHEN s.assets <= 0 OR e.assets <= 0 THEN 'nonpositive_assets' END AS reason,
           CASE WHEN s.assets > 0 AND e.assets > 0 THEN (income - cash) / ((s.assets + e.assets) / 2) END AS accrual_quality
    FROM i JOIN c USING (formation_date, security_id, period_start, period_end) JOIN a e USING (formation_date, security_id, period_end)
    JOIN a s ON s.formation_date = i.formation_date AND s.security_id = i.security_id AND abs(s.period_end - i.period_start) <= 7
    QUALIFY row_number() OVER (PARTITION BY formation_date, security_id ORDER BY i.period_end DESC, i.period_start DESC, abs(s.period_end - i.period_start), s.period_end) = 1""", digits="accrual_quality:8")
def _(r):
    return mf.accrual_quality(r.facts, r.formations)
