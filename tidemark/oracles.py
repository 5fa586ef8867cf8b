"""The fixture tables as DuckDB SQL, and the helper that prefixes a query with those it uses."""

from __future__ import annotations

import re

from .fixtures import FIRST_DAY, LISTING_BREAK, MODEL_INPUTS, MODEL_VERSION, SPLIT_DATE, TARGET_MEAN, BASELINE_FEATURES


def local(day: str, hour: int) -> str:
    return f"timezone('UTC', timezone('America/Toronto', CAST({day} AS TIMESTAMP) + INTERVAL {hour} HOUR))"


def sector_rank_sql(source: str) -> str:
    """Sector percentiles of a long value-or-reason source."""
    return f"""
        WITH o AS (SELECT x.*, sector_code, feature_version, direction FROM {source} x JOIN sectors USING (security_id) JOIN registry USING (feature_key)),
        k AS (SELECT *, count(value) OVER g AS peer_count,
                     (rank() OVER (PARTITION BY formation_date, feature_key, sector_code, value IS NULL ORDER BY value) - 1
                      + (count(*) OVER (PARTITION BY formation_date, feature_key, sector_code, value) - 1) / 2.0)
                     / nullif(count(value) OVER g - 1, 0) AS raw
              FROM o WINDOW g AS (PARTITION BY formation_date, feature_key, sector_code)),
        z AS (SELECT *, CASE WHEN value IS NULL THEN 'feature_unavailable:' || unavailable_reason WHEN peer_count < 2 THEN 'insufficient_sector_peers' END AS reason FROM k)
        SELECT security_id, formation_date, feature_key, sector_code, feature_version, peer_count, reason,
               CASE WHEN reason IS NULL THEN CASE WHEN direction > 0 THEN raw ELSE 1 - raw END END AS percentile FROM z"""


_INPUT_ROWS = ", ".join(f"('{k}', CAST({c} AS DOUBLE), CAST({m} AS DOUBLE), CAST({s} AS DOUBLE), {i})" for i, (k, c, m, s) in enumerate(MODEL_INPUTS))
_REGISTRY_ROWS = ", ".join(f"('{k}', 'v1', {d})" for k, d in BASELINE_FEATURES.items())

VIEWS: dict[str, str] = {
    "trades": """
        SELECT l_suppkey AS security_id, l_partkey, CAST(l_shipdate AS DATE) AS ship_day,
               CAST(date_trunc('week', l_shipdate) AS DATE) AS session_date,
               CAST(date_trunc('month', l_shipdate) AS DATE) AS "month",
               l_extendedprice / l_quantity AS price, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_discount * 100) AS BIGINT) AS discount,
               CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_returnflag = 'R' AS BIGINT) AS returned,
               row(l_shipdate, l_orderkey, l_linenumber) AS seq
        FROM lineitem""",
    "bars": f"""
        SELECT security_id, session_date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, seq) AS close, CAST(sum(quantity) AS BIGINT) AS volume,
               {local('session_date', 18)} AS available_at
        FROM trades GROUP BY security_id, session_date""",
    "unadjusted_bars": f"""
        SELECT security_id, session_date,
               close * (CASE WHEN session_date < DATE '{SPLIT_DATE}' THEN 2.0 ELSE 1.0 END) AS close,
               volume / (CASE WHEN session_date < DATE '{SPLIT_DATE}' THEN 2.0 ELSE 1.0 END) AS volume, available_at
        FROM bars""",
    "benchmark_bars": f"""
        SELECT session_date,
               coalesce(sum(cents) FILTER (isodow(ship_day) <= 3) / 100.0 / sum(quantity) FILTER (isodow(ship_day) <= 3),
                        sum(cents) / 100.0 / sum(quantity)) AS open,
               sum(cents) / 100.0 / sum(quantity) AS close, {local('session_date', 18)} AS available_at
        FROM trades GROUP BY session_date""",
    "sessions": """
        SELECT session_date, row_number() OVER (ORDER BY session_date) AS idx,
               lead(session_date) OVER (ORDER BY session_date) AS next_session
        FROM (SELECT DISTINCT session_date FROM trades)""",
    "formations": f"""
        SELECT formation_date, {local('formation_date', 20)} AS decision_at FROM (
          SELECT max(session_date) AS formation_date FROM (SELECT DISTINCT session_date FROM trades)
          GROUP BY date_trunc('month', session_date))""",
    "dense_bars": f"""
        SELECT security_id, session_date, volume, adjusted_open,
               adjusted_open * (CASE WHEN session_date < DATE '{SPLIT_DATE}' THEN 2.0 ELSE 1.0 END) AS unadjusted_open,
               {local('session_date', 18)} AS available_at
        FROM (SELECT security_id, session_date, volume, avg(vwap) OVER (PARTITION BY security_id ORDER BY session_date
                     ROWS UNBOUNDED PRECEDING) AS adjusted_open
              FROM (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS security_id, session_date,
                           sum(cents) / 100.0 / sum(quantity) AS vwap, CAST(sum(quantity) AS BIGINT) AS volume
                    FROM trades JOIN part ON p_partkey = l_partkey GROUP BY 1, 2))""",
    "dense_benchmark": f"""
        SELECT session_date, volume, {local('session_date', 18)} AS available_at,
               avg(vwap) OVER (ORDER BY session_date ROWS UNBOUNDED PRECEDING) AS open
        FROM (SELECT session_date, sum(cents) / 100.0 / sum(quantity) AS vwap, CAST(sum(quantity) AS BIGINT) AS volume
              FROM trades GROUP BY session_date)""",
    "actions": f"""
        SELECT security_id, security_id || '-' || strftime(session_date, '%Y%m%d') AS action_id, action_type,
               session_date AS effective_date, session_date + 1 AS process_date,
               CASE WHEN action_type = 'cash_dividend' THEN 12.5 END AS cash_amount,
               CASE WHEN action_type = 'forward_split' THEN 2.0 END AS ratio_numerator,
               CASE WHEN action_type = 'forward_split' THEN 1.0 END AS ratio_denominator,
               'USD' AS currency, {local('session_date', 18)} AS available_at
        FROM (SELECT b.security_id, b.session_date,
                     CASE WHEN b.session_date = DATE '{SPLIT_DATE}' THEN 'forward_split'
                          WHEN s.idx = 300 AND b.security_id % 17 = 0 THEN 'spin_off'
                          WHEN s.idx % 26 = 0 THEN 'cash_dividend' END AS action_type
              FROM dense_bars b JOIN sessions s USING (session_date))
        WHERE action_type IS NOT NULL""",
    "securities": "SELECT s_suppkey AS security_id, s_name AS issuer_name, s_nationkey AS nation_key FROM supplier",
    "sectors": """
        SELECT security_id, 'sector_' || n_regionkey AS sector_code
        FROM securities JOIN nation ON n_nationkey = nation_key""",
    "sector_claims": f"""
        SELECT *, CAST(as_of_date AS TIMESTAMP) + INTERVAL 1 DAY AS available_at FROM (
          SELECT security_id, 'sector_' || n_regionkey AS sector_code, DATE '{FIRST_DAY}' AS as_of_date
          FROM securities JOIN nation ON n_nationkey = nation_key
          UNION ALL
          SELECT security_id, 'sector_' || ((n_regionkey + 1) % 5), DATE '1998-01-01'
          FROM securities JOIN nation ON n_nationkey = nation_key WHERE security_id % 4 = 0)""",
    "listings": f"""
        SELECT security_id, 'OLD' || security_id AS ticker, 'XNYS' AS mic, DATE '{FIRST_DAY}' AS valid_from, DATE '{LISTING_BREAK}' AS valid_to FROM securities
        UNION ALL
        SELECT security_id, 'TKR' || security_id, 'XNYS', DATE '{LISTING_BREAK}', CAST(NULL AS DATE) FROM securities""",
    "quarters": """
        SELECT CAST(floor(o_custkey / 15) AS BIGINT) AS security_id, year(o_orderdate) AS fy, quarter(o_orderdate) AS qtr,
               sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS income,
               sum(CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) <= 3 THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS cash,
               count(*) AS orders
        FROM orders GROUP BY 1, 2, 3""",
    "facts": """
        WITH q AS (
          SELECT *, sum(income) OVER y AS income_ytd, sum(cash) OVER y AS cash_ytd,
                 sum(income) OVER e AS income_ever, sum(orders) OVER e AS orders_ever,
                 CAST(last_day(make_date(fy, qtr * 3, 1)) AS DATE) AS period_end, make_date(fy, 1, 1) AS year_start,
                 security_id || '-' || fy || '-' || qtr AS acc
          FROM quarters
          WINDOW y AS (PARTITION BY security_id, fy ORDER BY qtr ROWS UNBOUNDED PRECEDING),
                 e AS (PARTITION BY security_id ORDER BY fy, qtr ROWS UNBOUNDED PRECEDING)),
        rows5 AS (
          SELECT *, 'us-gaap' AS taxonomy, CASE WHEN security_id % 7 = 3 THEN 'ProfitLoss' ELSE 'NetIncomeLoss' END AS concept, 'USD' AS unit, year_start AS period_start, CAST(income_ytd / 100.0 AS DOUBLE) AS value FROM q
          UNION ALL SELECT *, 'us-gaap', 'NetCashProvidedByUsedInOperatingActivities', 'USD', year_start, CAST(cash_ytd / 100.0 AS DOUBLE) FROM q
          UNION ALL SELECT *, 'us-gaap', 'Assets', 'USD', NULL, CAST(income_ever / 100.0 + 1000000 AS DOUBLE) FROM q
          UNION ALL SELECT *, 'us-gaap', 'StockholdersEquity', 'USD', NULL, CAST(income_ever / 200.0 AS DOUBLE) FROM q
          UNION ALL SELECT *, 'dei', 'EntityCommonStockSharesOutstanding', 'shares', NULL, CAST(orders_ever * 1000.0 + 10000 AS DOUBLE) FROM q),
        orig AS (
          SELECT security_id, acc AS accession, CASE WHEN qtr = 4 THEN '10-K' ELSE '10-Q' END AS form, false AS is_amendment,
                 CAST(period_end + CAST(30 + security_id % 20 AS INT) AS TIMESTAMP) + INTERVAL 16 HOUR AS accepted_at,
                 taxonomy, concept, unit, period_start, period_end, fy AS fiscal_year,
                 CASE WHEN qtr = 4 THEN 'FY' ELSE 'Q' || qtr END AS fiscal_period, value FROM rows5)
        SELECT *, accepted_at + INTERVAL 5 MINUTE AS available_at FROM (
          SELECT * FROM orig
          UNION ALL
          SELECT security_id, accession || 'A', '10-K/A', true, accepted_at + INTERVAL 60 DAY, taxonomy, concept, unit,
                 period_start, period_end, fiscal_year, fiscal_period, value + 1000
          FROM orig WHERE security_id % 10 = 0 AND fiscal_period = 'FY' AND concept = 'NetIncomeLoss')""",
    "observations": """
        WITH base AS (
          SELECT event_id, user_id AS security_id, event_type AS concept, value, ts AS observed_at,
                 ts - to_minutes(CAST(event_id % 7 AS INT)) AS accepted_at, CAST(date_trunc('week', ts) AS DATE) AS period_end,
                 lpad(CAST(event_id AS VARCHAR), 20, '0') AS lineage_key FROM events)
        SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_id % 10 = 0""",
    "observation_decisions": """
        SELECT DISTINCT CAST(ts AS DATE) AS formation_date, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS decision_at FROM events""",
    "monthly": """
        SELECT security_id, "month" AS formation_date, count(*) AS n, sum(discount) AS d, sum(tax) AS t, sum(quantity) AS q,
               sum(returned) AS r, sum(cents) AS c, max(quantity) - min(quantity) AS spread
        FROM trades GROUP BY 1, 2""",
    "outcomes": """
        WITH cells AS (
          SELECT security_id, formation_date, 'momentum_12_1' AS feature_key, CAST(d AS DOUBLE) / n AS v, NULL AS unavailable_reason FROM monthly
          UNION ALL SELECT security_id, formation_date, 'relative_strength_6m', CAST(t AS DOUBLE) / n, NULL FROM monthly
          UNION ALL SELECT security_id, formation_date, 'earnings_yield_ttm', CAST(q AS DOUBLE) / n,
                 CASE WHEN (security_id + month(formation_date)) % 11 = 0 THEN 'missing annual income fact' END FROM monthly
          UNION ALL SELECT security_id, formation_date, 'return_on_assets_ttm', CAST(r AS DOUBLE) / n, NULL FROM monthly
          UNION ALL SELECT security_id, formation_date, 'trailing_volatility_60d', CAST(spread AS DOUBLE), CASE WHEN n < 3 THEN 'insufficient_history' END FROM monthly
          UNION ALL SELECT security_id, formation_date, 'median_dollar_volume_20d', CAST(c AS DOUBLE) / n / 100.0, NULL FROM monthly)
        SELECT security_id, formation_date, feature_key, CASE WHEN unavailable_reason IS NULL THEN v END AS value, unavailable_reason FROM cells""",
    "model_inputs": f"SELECT * FROM (VALUES {_INPUT_ROWS}) AS t(feature_key, coefficient, mean, scale, ordinal)",
    "registry": f"SELECT * FROM (VALUES {_REGISTRY_ROWS}) AS t(feature_key, feature_version, direction)",
    "scores": f"""
        WITH raw AS (
          SELECT security_id, formation_date AS score_date, n >= 3 AS eligible, CAST(d * 3 + t AS DOUBLE) / n AS raw_prediction FROM monthly),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY score_date ORDER BY raw_prediction DESC, security_id) AS score_rank,
                 count(*) OVER (PARTITION BY score_date) AS ranked FROM raw WHERE eligible)
        SELECT security_id, score_date, eligible, raw_prediction, score_rank,
               coalesce(100.0 * (ranked - score_rank) / nullif(ranked - 1, 0), 0.0) AS score,
               CAST(NULL AS VARCHAR) AS exclusion_reason, '{MODEL_VERSION}' AS model_version FROM placed
        UNION ALL SELECT security_id, score_date, eligible, raw_prediction, NULL, 0.0, 'insufficient price sessions', '{MODEL_VERSION}' FROM raw WHERE NOT eligible""",
    "predictions": """
        WITH w AS (SELECT security_id, session_date AS formation_date, CAST(date_trunc('month', session_date) AS DATE) AS "month",
                          year(session_date) AS outer_fold, count(*) AS n, CAST(sum(discount) AS DOUBLE) AS d, CAST(sum(tax) AS DOUBLE) AS t, CAST(sum(quantity) AS DOUBLE) AS q
                   FROM trades GROUP BY security_id, session_date)
        SELECT 'reference' AS model_key, d / n / 100.0 AS prediction, outer_fold, formation_date, "month", security_id, (t * 2 + q - n * 33) / n / 100.0 AS actual FROM w
        UNION ALL SELECT 'candidate', (d * 2 + t) / n / 300.0, outer_fold, formation_date, "month", security_id, (t * 2 + q - n * 33) / n / 100.0 FROM w""",
    "examples": """
        SELECT security_id, formation_date, CAST(formation_date + INTERVAL 1 MONTH AS DATE) AS outcome_date, CAST(d AS DOUBLE) / n / 10.0 AS f1, CAST(q AS DOUBLE) / n / 50.0 AS f2,
               CAST(r AS DOUBLE) / n AS f3, CAST(t * 2 + q - n * 33 AS DOUBLE) / n / 100.0 AS target FROM monthly""",
    "sector_ranks": sector_rank_sql("outcomes"),
    "linear_all": f"""
        WITH t AS (SELECT formation_date, security_id, sum(coefficient * (coalesce(percentile, mean) - mean) / scale) AS s, count(*) FILTER (percentile IS NULL) AS miss,
                          string_agg(feature_key || '@' || feature_version || ':' || reason, ',' ORDER BY feature_key) FILTER (percentile IS NULL) AS why
                   FROM sector_ranks JOIN model_inputs USING (feature_key) GROUP BY 1, 2)
        SELECT formation_date, security_id, miss = 0 AS eligible, CASE WHEN miss = 0 THEN {TARGET_MEAN} + s END AS prediction,
               'required_feature_rank_unavailable=' || why AS reason FROM t""",
    "linear_active": f"""
        WITH t AS (SELECT formation_date, security_id, sum(coefficient * (coalesce(percentile, mean) - mean) / scale) AS s, count(*) FILTER (percentile IS NULL AND coefficient <> 0) AS miss
                   FROM sector_ranks JOIN model_inputs USING (feature_key) GROUP BY 1, 2)
        SELECT formation_date, security_id, miss = 0 AS eligible, CASE WHEN miss = 0 THEN {TARGET_MEAN} + s END AS prediction FROM t""",
    "composite": """
        SELECT formation_date, security_id, count(*) FILTER (percentile IS NULL) = 0 AS eligible,
               CASE WHEN count(*) FILTER (percentile IS NULL) = 0 THEN avg(percentile) END AS normalized_score,
               'required_feature_rank_unavailable=' || string_agg(feature_key || '@' || feature_version || ':' || reason, ',' ORDER BY feature_key) FILTER (percentile IS NULL) AS reason
        FROM sector_ranks GROUP BY 1, 2""",
}


def _uses(sql: str) -> set[str]:
    words = set(re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "", sql)))
    return {name for name in VIEWS if name in words}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the CTEs a statement needs, in dependency order."""
    views = {**VIEWS, **(extra or {})}
    needed: set[str] = set()
    frontier = _uses(sql) | {n for n in (extra or {}) if re.search(rf"\b{n}\b", sql)}
    while frontier:
        name = frontier.pop()
        if name not in needed:
            needed.add(name)
            frontier |= {n for n in views if n != name and re.search(rf"\b{n}\b", re.sub(r"'[^']*'", "", views[name]))}
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in views if n in needed)
    return f"WITH {ctes}\nSELECT * FROM ({sql})" if ctes else sql


def rounded(sql: str, columns: dict[str, int]) -> str:
    if not columns:
        return sql
    parts = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in columns.items())
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"