"""Period-aware accounting features as of each formation.

Facts are cut to one best version per key and decision before they are spread over the
formations (:mod:`tidemark.functions.asof`), so no formations x history product is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import expand_versions, latest_per_key, version_intervals
from ..functions.scalars import first_reason, safe_divide

# Concepts in priority order, forms and day bands.
INCOME = ("NetIncomeLoss", "ProfitLoss")
CASH_FLOW = ("NetCashProvidedByUsedInOperatingActivities",)
EQUITY = ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest")
SHARES = "EntityCommonStockSharesOutstanding"
FLOW_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")
ANNUAL_DAYS = (330, 370)
PRIOR_DAYS = (330, 400)
ASSET_GAP_DAYS = 7
QUARTER_DAYS = (65, 120)
SLOT_DAYS = {"Q1": (70, 120), "Q2": (150, 220), "Q3": (230, 310), "FY": (320, 390)}
STALE_DAYS = 450
SPLITS = ("forward_split", "reverse_split", "unit_split")
STRUCTURAL = ("cash_merger", "spin_off", "stock_and_cash_merger", "stock_merger")
CELL = ["formation_date", "security_id"]
NEWEST = ["period_end", "available_at", "accession"]


def days(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(later, earlier)


def priority(concepts: Sequence[str]) -> Column:
    """Larger is better: first concept of the list wins."""
    chain = F.lit(0)
    for rank, concept in enumerate(reversed(concepts), start=1):
        chain = F.when(F.col("concept") == concept, rank).otherwise(chain)
    return chain


def annual_facts(facts: DataFrame, concepts: Sequence[str] = INCOME) -> DataFrame:
    span = days("period_end", "period_start")
    return facts.where(F.col("concept").isin(*concepts) & (F.col("unit") == "USD") & span.between(*ANNUAL_DAYS))


def annual_income(facts: DataFrame, formations: DataFrame) -> DataFrame:
    """Latest annual income fact per formation; concept priority beats recency (FND01)."""
    ranked = annual_facts(facts).withColumn("priority", priority(INCOME))
    versions = version_intervals(ranked, ["security_id"], formations, "available_at", ["priority", *NEWEST])
    return expand_versions(versions, formations).select(
        *CELL, F.col("value").alias("income"), "concept", "period_start", F.col("period_end").alias("income_end"))


def latest_facts(facts: DataFrame, formations: DataFrame, concept: str, name: str) -> DataFrame:
    """Latest instant fact of one concept per formation, plain recency (shares, assets)."""
    versions = version_intervals(facts.where(F.col("concept") == concept), ["security_id"], formations, "available_at", NEWEST)
    return expand_versions(versions, formations).select(*CELL, F.col("value").alias(name), F.col("period_end").alias(f"{name}_end"))


def earnings_yield(income: DataFrame, shares: DataFrame, closes: DataFrame) -> DataFrame:
    """Annual income over close x shares (FND02). ``closes`` has formation_date, security_id, close."""
    rows = closes.join(income.select(*CELL, "income"), CELL, "left").join(shares.select(*CELL, "shares"), CELL, "left")
    reason = first_reason(
        (F.col("income").isNull(), "missing_annual_income"), (F.col("shares").isNull(), "missing_shares"),
        (F.col("shares") <= 0, "nonpositive_shares"), (F.col("close") <= 0, "nonpositive_close"))
    return rows.select(*CELL, reason.alias("reason")
                       , F.when(reason.isNull(), F.col("income") / (F.col("close") * F.col("shares"))).alias("earnings_yield_ttm"))


def asset_history(facts: DataFrame, formations: DataFrame) -> DataFrame:
    """Asset fact versions with the decision range in which each period's value stands."""
    assets = facts.where((F.col("concept") == "Assets") & (F.col("unit") == "USD"))
    return version_intervals(assets, ["security_id", "period_end"], formations, "available_at", ["available_at", "accession"]).select(
        "security_id", F.col("period_end").alias("asset_end"), F.col("value").alias("assets"), "decision_ord", "until_ord")


def numbered(formations: DataFrame) -> DataFrame:
    return formations.select("formation_date", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("decision_at")).alias("ord"))


def return_on_assets(income: DataFrame, assets: DataFrame, formations: DataFrame, value: str = "return_on_assets_ttm") -> DataFrame:
    """Income over mean of begin and end assets; begin 0-7 days before the period, end on its last day (FND03).

    Both tolerance windows are equi-joined: each income row names its nine candidate days.
    """
    rows = income.join(numbered(formations), "formation_date")
    begin_days = F.sequence(F.date_sub("period_start", ASSET_GAP_DAYS), F.col("period_start"))
    wanted = rows.withColumn("asset_end", F.explode(F.array_union(begin_days, F.array("income_end"))))
    held = (F.col("decision_ord") <= F.col("ord")) & (F.col("ord") < F.col("until_ord"))
    found = wanted.join(assets, ["security_id", "asset_end"]).where(held)
    picked = found.groupBy(*CELL).agg(
        F.max_by(F.when(F.col("asset_end") <= F.col("period_start"), F.col("assets")),
                 F.when(F.col("asset_end") <= F.col("period_start"), F.col("asset_end"))).alias("begin_assets"),
        F.max(F.when(F.col("asset_end") == F.col("income_end"), F.col("assets"))).alias("end_assets"))
    out = income.join(picked, CELL, "left")
    reason = first_reason(
        (F.col("begin_assets").isNull(), "missing_begin_assets"), (F.col("end_assets").isNull(), "missing_end_assets"),
        ((F.col("begin_assets") <= 0) | (F.col("end_assets") <= 0), "nonpositive_assets"))
    return out.withColumn("reason", reason).withColumn(
        value, F.when(reason.isNull(), F.col("income") / ((F.col("begin_assets") + F.col("end_assets")) / 2)))


def annual_history(facts: DataFrame, keys: Sequence[str] = ("security_id",)) -> DataFrame:
    """Best annual income fact per period end by (concept priority, recency, filing) (FND05)."""
    ranked = annual_facts(facts).withColumn("priority", priority(INCOME))
    return latest_per_key(ranked, [*keys, "period_end"], ["priority", "available_at", "accession"])


def roa_change(facts: DataFrame) -> DataFrame:
    """Year-on-year change of ROA between consecutive annual periods (FND04), over resolved facts.

    One row per annual period with a predecessor 330-400 days earlier; a security has at most
    one annual row per fiscal year, which bounds the window.
    """
    history = annual_history(facts).select("security_id", "period_start", F.col("period_end").alias("income_end"), F.col("value").alias("income"))
    assets = latest_per_key(facts.where("concept = 'Assets'"), ["security_id", "period_end"], ["available_at", "accession"]).select(
        "security_id", F.col("period_end").alias("asset_end"), F.col("value").alias("assets"))
    begin_days = F.sequence(F.date_sub("period_start", ASSET_GAP_DAYS), F.col("period_start"))
    wanted = history.withColumn("asset_end", F.explode(F.array_union(begin_days, F.array("income_end"))))
    is_begin = F.col("asset_end") <= F.col("period_start")
    roa = wanted.join(assets, ["security_id", "asset_end"]).groupBy("security_id", "income_end").agg(
        F.max("income").alias("income"),
        F.max_by(F.when(is_begin, F.col("assets")), F.when(is_begin, F.col("asset_end"))).alias("begin_assets"),
        F.max(F.when(F.col("asset_end") == F.col("income_end"), F.col("assets"))).alias("end_assets"),
    ).where("begin_assets > 0 AND end_assets > 0")
    own = Window.partitionBy("security_id").orderBy("income_end")
    value = F.col("income") / ((F.col("begin_assets") + F.col("end_assets")) / 2)
    stepped = roa.withColumn("roa", value).withColumn("_prior", F.lag("roa").over(own)).withColumn("_gap", days("income_end", F.lag("income_end").over(own)))
    return stepped.where(F.col("_gap").between(*PRIOR_DAYS)).select("security_id", "income_end", "roa", (F.col("roa") - F.col("_prior")).alias("roa_change"))


# ---- quarters ----------------------------------------------------------------
def resolve_ties(facts: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """One row per key and (available_at, accepted_at); ``ambiguous`` when tied rows disagree (FND07)."""
    order = F.struct("is_amendment", "accession")
    return facts.groupBy(*keys, "available_at", "accepted_at").agg(
        F.max_by("value", order).alias("value"), (F.min("value") != F.max("value")).alias("ambiguous"),
        F.max("accession").alias("accession"), *[F.max_by(v, order).alias(v) for v in values])


def latest_unambiguous(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest fact per key, dropped where its ties disagree (FND07)."""
    return latest_per_key(resolve_ties(facts, keys), keys, ["available_at", "accepted_at"]).where("NOT ambiguous")


def flow_slots(facts: DataFrame) -> DataFrame:
    """Cumulative flow facts in their duration band, one version row per knowledge time."""
    span = days("period_end", "period_start")
    in_band = F.lit(False)
    for slot, (low, high) in SLOT_DAYS.items():
        in_band = in_band | ((F.col("fiscal_period") == slot) & span.between(low, high))
    flows = facts.where((F.col("taxonomy") == "us-gaap") & (F.col("unit") == "USD") & F.col("form").isin(*FLOW_FORMS) & in_band)
    keys = ["security_id", "concept", "period_start", "fiscal_year", "fiscal_period"]
    versions = resolve_ties(flows, keys, "period_end")
    own = Window.partitionBy(*keys).orderBy("available_at", "accepted_at")
    return versions.withColumn("until_at", F.lead("available_at").over(own)).withColumn(
        "value", F.when(~F.col("ambiguous"), F.col("value")))


def standalone_quarters(facts: DataFrame) -> DataFrame:
    """Versions of standalone quarters: Q1, Q2 = H1 - Q1, Q3 = 9M - H1, Q4 = FY - 9M (FND06).

    Each version carries the time from which it is known. Prior and current slots meet on an
    equi key, and only while both versions stand.
    """
    slots = flow_slots(facts)
    chain = F.create_map(*[F.lit(x) for x in ("Q1", "Q2", "Q2", "Q3", "Q3", "FY")])
    prior = slots.where("fiscal_period <> 'FY'").select(
        "security_id", "concept", "period_start", "fiscal_year", chain[F.col("fiscal_period")].alias("fiscal_period"),
        F.col("value").alias("p_value"), F.col("period_end").alias("p_end"),
        F.col("available_at").alias("p_at"), F.col("until_at").alias("p_until"))
    pairs = slots.join(prior, ["security_id", "concept", "period_start", "fiscal_year", "fiscal_period"])
    standing = (F.col("p_until").isNull() | (F.col("available_at") < F.col("p_until"))) & (
        F.col("until_at").isNull() | (F.col("p_at") < F.col("until_at")))
    label = F.when(F.col("fiscal_period") == "FY", "Q4").otherwise(F.col("fiscal_period"))
    later = pairs.where(standing).select(
        "security_id", "concept", label.alias("quarter"), F.date_add("p_end", 1).alias("period_start"), "period_end",
        (F.col("value") - F.col("p_value")).alias("value"), F.greatest("available_at", "p_at").alias("available_at"),
    ).where(days("period_end", "period_start").between(*QUARTER_DAYS))
    first = slots.where("fiscal_period = 'Q1' AND fiscal_year IS NOT NULL").select(
        "security_id", "concept", F.lit("Q1").alias("quarter"), "period_start", "period_end", "value", "available_at")
    return first.unionByName(later)


PERIOD = ["security_id", "concept", "period_start", "period_end"]


def latest_quarters(quarters: DataFrame) -> DataFrame:
    """Standing value per quarter with all facts known; tied versions that disagree are dropped."""
    tied = quarters.groupBy(*PERIOD, "available_at").agg(
        F.max("value").alias("value"), F.max("quarter").alias("quarter"),
        ((F.min("value") != F.max("value")) | (F.count("value") < F.count(F.lit(1)))).alias("ambiguous"))
    return latest_per_key(tied, PERIOD, ["available_at"]).where("NOT ambiguous")


def metric_of(groups: dict[str, Sequence[str]]) -> Column:
    """Name of the metric a concept belongs to."""
    pairs = [F.lit(x) for name, concepts in groups.items() for c in concepts for x in (c, name)]
    return F.create_map(*pairs)[F.col("concept")]


def wide_metrics(rows: DataFrame, names: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """One row per cell from rows keyed by metric; ``columns`` maps a source column to a name pattern."""
    pick = lambda name, source: F.max(F.when(F.col("metric") == name, F.col(source)))
    return rows.groupBy(*CELL).agg(*[
        pick(name, source).alias(pattern.format(name)) for name in names for source, pattern in columns.items()])


def stretches(rows: DataFrame, keys: Sequence[str], spans: str) -> DataFrame:
    """Each row over the decisions [decision_ord, until_ord) between two bounds of its ``spans``, which have ``lo`` and ``hi``.

    ``spans`` are then those that stand there, in their order; rows without any drop out.
    """
    bounds = F.array_sort(F.array_distinct(F.concat(F.transform(spans, lambda s: s["lo"]), F.transform(spans, lambda s: s["hi"]))))
    cut = rows.select(*keys, spans, bounds.alias("_bounds"))
    length = F.greatest(F.size("_bounds") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_bounds", 1, length), F.slice("_bounds", 2, length), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    at = cut.select(*keys, spans, F.explode(pairs).alias("_at"))
    stands = F.filter(spans, lambda s: (s["lo"] <= F.col("_at.lo")) & (F.col("_at.lo") < s["hi"]))
    return at.select(*keys, F.col("_at.lo").alias("decision_ord"), F.col("_at.hi").alias("until_ord"), stands.alias(spans))


def ttm_intervals(quarters: DataFrame, formations: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Latest four consecutive standalone quarters per metric, by concept priority, over the decisions at which they are the same.

    A quarter takes part from its period's end on. A security's quarters meet in one row per metric, where the
    four change only with a version, so they are not spread over the formations.
    """
    concepts = [c for group in groups.values() for c in group]
    wanted = quarters.where(F.col("concept").isin(*concepts))
    known = version_intervals(wanted, PERIOD, formations, "available_at", ["available_at", "value"]).where("value IS NOT NULL")
    calendar = formations.agg(F.array_sort(F.collect_list(F.struct("decision_at", "formation_date")))["formation_date"].alias("_dates"))  # one row
    ended = F.array_min(F.filter(F.sequence("decision_ord", F.col("until_ord") - 1), lambda o: F.col("period_end") <= F.get("_dates", (o - 1).cast("int"))))
    lo = F.when(F.col("period_end") <= F.col("formation_date"), F.col("decision_ord")).otherwise(ended)
    spans = known.crossJoin(F.broadcast(calendar)).select(
        "security_id", metric_of(groups).alias("metric"),
        F.struct(priority(concepts).alias("priority"), "period_end", "period_start", "value", "concept", lo.alias("lo"), F.col("until_ord").alias("hi")).alias("_span"))
    history = spans.where("_span.lo IS NOT NULL").groupBy("security_id", "metric").agg(F.collect_list("_span").alias("_spans"))
    newest = history.withColumn("_spans", F.reverse(F.array_sort("_spans")))
    standing = stretches(newest, ["security_id", "metric"], "_spans")
    of = lambda place: F.slice(F.filter("_spans", lambda s: s["priority"] == place), 1, 4)
    follows = lambda q, i: (days(q[i]["period_start"], q[i + 1]["period_end"]) - 1).between(0, ASSET_GAP_DAYS)
    whole = F.filter(F.array(*[of(place) for place in range(len(concepts), 0, -1)]), lambda q: (F.size(q) == 4) & follows(q, 0) & follows(q, 1) & follows(q, 2))
    first = standing.select("security_id", "metric", "decision_ord", "until_ord", F.explode(F.slice(whole, 1, 1)).alias("_q"))
    q = F.col("_q")
    return first.select(
        "security_id", "metric", "decision_ord", "until_ord", (q[3]["value"] + q[2]["value"] + q[1]["value"] + q[0]["value"]).alias("value"),
        q[0]["period_end"].alias("period_end"), q[0]["concept"].alias("concept"))


def true_ttm(quarters: DataFrame, formations: DataFrame, concepts: Sequence[str], name: str) -> DataFrame:
    """Sum of the latest four consecutive standalone quarters known at each formation (FND08)."""
    return expand_versions(ttm_intervals(quarters, formations, {name: concepts}), formations).select(
        *CELL, F.col("value").alias(name), F.col("period_end").alias(f"{name}_end"), F.col("concept").alias(f"{name}_concept"))


# ---- endpoints ---------------------------------------------------------------
def endpoint_versions(facts: DataFrame, concepts: Sequence[str]) -> DataFrame:
    instants = facts.where(F.col("concept").isin(*concepts) & F.col("period_start").isNull() & F.col("form").isin(*FLOW_FORMS))
    return resolve_ties(instants, ["security_id", "concept", "period_end"]).withColumn("priority", priority(concepts))


def endpoint_intervals(facts: DataFrame, formations: DataFrame, groups: dict[str, Sequence[str]], positive: Sequence[str]) -> DataFrame:
    """Latest instant fact per metric over the decisions at which it stands; ambiguous or non-positive ones carry a reason."""
    concepts = [c for group in groups.values() for c in group]
    versions = endpoint_versions(facts, concepts).withColumn("metric", metric_of(groups))
    order = ["priority", "period_end", "available_at", "accepted_at"]
    rows = version_intervals(versions, ["security_id", "metric"], formations, "available_at", order)
    must_be_positive = F.col("metric").isin(*positive) if positive else F.lit(False)
    reason = first_reason(
        (F.col("ambiguous"), "ambiguous_latest_endpoint_context"), (must_be_positive & (F.col("value") <= 0), "nonpositive_latest_endpoint"))
    return rows.select(
        "security_id", "metric", "decision_ord", "until_ord", F.when(reason.isNull(), F.col("value")).alias("value"), "period_end", "concept",
        reason.alias("reason"))


def latest_endpoint(facts: DataFrame, formations: DataFrame, concepts: Sequence[str], name: str, *, positive: bool = False) -> DataFrame:
    """Latest instant fact of the first concept with candidates (FND09)."""
    rows = expand_versions(endpoint_intervals(facts, formations, {name: concepts}, [name] if positive else []), formations)
    return rows.select(*CELL, F.col("value").alias(name), F.col("period_end").alias(f"{name}_end"), "concept", F.col("reason").alias(f"{name}_reason"))


def month_number(day: str | Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def prior_intervals(facts: DataFrame, formations: DataFrame, current: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Endpoint whose period ends 330-400 days before the current one, over the decisions at which both stand.

    ``current`` has security_id, metric, period_end and its decision_ord, until_ord. A security's periods meet
    it in one row per metric, which keeps those in the day band.
    """
    concepts = [c for group in groups.values() for c in group]
    versions = endpoint_versions(facts, concepts).withColumn("metric", metric_of(groups))
    periods = version_intervals(versions, ["security_id", "metric", "period_end"], formations, "available_at", ["available_at", "accepted_at"])
    span = F.struct("period_end", "value", "ambiguous", F.col("decision_ord").alias("lo"), F.col("until_ord").alias("hi"))
    history = periods.groupBy("security_id", "metric").agg(F.collect_list(span).alias("_all"))
    near = F.filter("_all", lambda s: days(F.col("period_end"), s["period_end"]).between(*PRIOR_DAYS) & (
        s["lo"] < F.col("until_ord")) & (F.col("decision_ord") < s["hi"]))
    clipped = F.transform("_near", lambda s: F.struct(
        s["period_end"].alias("period_end"), s["value"].alias("value"), s["ambiguous"].alias("ambiguous"),
        F.greatest(s["lo"], F.col("decision_ord")).alias("lo"), F.least(s["hi"], F.col("until_ord")).alias("hi")))
    met = current.join(history, ["security_id", "metric"]).select("security_id", "metric", "decision_ord", "until_ord", near.alias("_near"))
    standing = stretches(met.withColumn("_spans", clipped), ["security_id", "metric"], "_spans")
    # One version of a period stands at a time, so the largest span is that of the latest period.
    best = standing.select("security_id", "metric", "decision_ord", "until_ord", F.explode(F.slice(F.sort_array("_spans", asc=False), 1, 1)).alias("_s"))
    good = ~F.col("_s.ambiguous") & (F.col("_s.value") > 0)
    return best.select(
        "security_id", "metric", "decision_ord", "until_ord", F.when(good, F.col("_s.value")).alias("value"), F.col("_s.period_end").alias("period_end"))


def comparable_prior(facts: DataFrame, formations: DataFrame, concept: str, name: str) -> DataFrame:
    """Comparable prior of the latest positive endpoint of one metric (FND10)."""
    group = {name: [concept]}
    current = endpoint_intervals(facts, formations, group, [name]).where("value IS NOT NULL")
    rows = expand_versions(prior_intervals(facts, formations, current, group), formations)
    return rows.select(*CELL, F.col("period_end").alias(f"prior_{name}_end"), F.col("value").alias(f"prior_{name}"))


def split_factor(actions: DataFrame, spans: DataFrame) -> DataFrame:
    """Product of split ratios in (start, end] known by the decision; structural actions exclude (FND11).

    ``spans`` has formation_date, security_id, span_start, span_end, decision_at.
    """
    usable = (F.col("ratio_numerator") > 0) & (F.col("ratio_denominator") > 0)
    split = F.col("action_type").isin(*SPLITS)
    # A security's actions collapse to one row per date and knowledge time before they meet its spans.
    daily = actions.groupBy("security_id", "effective_date", "available_at").agg(
        F.coalesce(F.product(F.when(split & usable, F.col("ratio_numerator") / F.col("ratio_denominator"))), F.lit(1.0)).alias("_ratio"),
        F.max(F.col("action_type").isin(*STRUCTURAL)).alias("_is_structural"),
        F.max(split & ~F.coalesce(usable, F.lit(False))).alias("_is_bad"))
    # A span names its months, so it meets the actions of its own months and no others of its security. Formations that
    # share a span ask once; each then keeps what it knows.
    daily = daily.withColumn("_month", month_number("effective_date"))
    months = F.sequence(month_number(F.date_add("span_start", 1)), month_number("span_end"))
    span = ["security_id", "span_start", "span_end"]
    asked = spans.where("span_end > span_start").select(*span).distinct().select(*span, F.explode(months).alias("_month"))
    inside = (F.col("effective_date") > F.col("span_start")) & (F.col("effective_date") <= F.col("span_end"))
    met = asked.join(daily, ["security_id", "_month"]).where(inside).select(*span, "available_at", "_ratio", "_is_structural", "_is_bad")
    of = lambda name: F.when(F.col("available_at") <= F.col("decision_at"), F.col(name))
    grouped = spans.select(*CELL, "span_start", "span_end", "decision_at").join(met, span, "left").groupBy(*CELL).agg(
        F.product(of("_ratio")).alias("_factor"), F.max(of("_is_structural")).alias("_structural"), F.max(of("_is_bad")).alias("_bad"))
    no = F.lit(False)
    reason = first_reason((F.coalesce("_structural", no), "structural_corporate_action"), (F.coalesce("_bad", no), "invalid_split_ratio"))
    return grouped.select(*CELL, F.when(reason.isNull(), F.coalesce("_factor", F.lit(1.0))).alias("factor"), reason.alias("factor_reason"))


def accounting_snapshot(facts: DataFrame, formations: DataFrame) -> DataFrame:
    """TTM income and cash flow, assets, equity, shares and the comparable priors, one row per cell (FND13).

    Metrics of one kind share a pass. All are ranges of decisions until the last step, which spreads them over the
    formations and unfolds them within their security's task.
    """
    compared = {"assets": ["Assets"], "shares": [SHARES]}
    ends = endpoint_intervals(facts, formations, {**compared, "equity": EQUITY}, list(compared))
    priors = prior_intervals(facts, formations, ends.where(F.col("value").isNotNull() & F.col("metric").isin(*compared)), compared)
    flows = ttm_intervals(standalone_quarters(facts), formations, {"income": INCOME, "cash": CASH_FLOW})
    columns = ["security_id", "metric", "decision_ord", "until_ord", "value", "period_end"]
    prior = priors.withColumn("metric", F.concat(F.lit("prior_"), "metric"))
    held = ends.select(columns).unionByName(flows.select(columns)).unionByName(prior.select(columns)).repartition("security_id")
    names = ["assets", "shares", "equity", "income", "cash", *(f"prior_{name}" for name in compared)]
    return wide_metrics(expand_versions(held, formations), names, {"value": "{}", "period_end": "{}_end"})


def usable(name: str, label: str) -> Column:
    stale = days("formation_date", f"{name}_end") > STALE_DAYS
    return F.when(F.col(name).isNull(), f"{label}:unavailable").when(stale, f"{label}:stale_over_{STALE_DAYS}d")


def accounting_features(snapshot: DataFrame, closes: DataFrame, factors: DataFrame) -> DataFrame:
    """The eight accounting features, each a value or a reason (FND12). Long form."""
    rows = closes.join(snapshot, CELL, "left").join(factors, CELL, "left")
    cap = F.col("close") * F.col("shares")
    no_cap = F.when(F.coalesce(F.col("close"), F.lit(0.0)) <= 0, "missing_positive_unadjusted_formation_close").otherwise(usable("shares", "shares"))
    average = (F.col("assets") + F.col("prior_assets")) / 2
    no_assets = F.coalesce(
        usable("assets", "assets"), F.when(F.col("prior_assets").isNull(), "prior_assets:unavailable"),
        F.when(average <= 0, "nonpositive_average_assets"))
    no_income, no_cash, no_equity = usable("income", "net_income_ttm"), usable("cash", "operating_cash_flow_ttm"), usable("equity", "equity")
    misaligned = F.when(F.abs(days("income_end", "cash_end")) > ASSET_GAP_DAYS, "misaligned_ttm_periods")
    no_shares = F.coalesce(usable("shares", "shares"), F.when(F.col("prior_shares").isNull(), "prior_shares:unavailable"), F.col("factor_reason"))
    adjusted = F.col("prior_shares") * F.coalesce("factor", F.lit(1.0))
    definitions = {
        "book_to_market": (F.coalesce(no_cap, no_equity), safe_divide(F.col("equity"), cap)),
        "earnings_yield_ttm": (F.coalesce(no_cap, no_income), safe_divide(F.col("income"), cap)),
        "operating_cash_flow_yield_ttm": (F.coalesce(no_cap, no_cash), safe_divide(F.col("cash"), cap)),
        "return_on_assets_ttm": (F.coalesce(no_assets, no_income), safe_divide(F.col("income"), average)),
        "operating_cash_flow_profitability_ttm": (F.coalesce(no_assets, no_cash), safe_divide(F.col("cash"), average)),
        "accrual_quality_ttm": (F.coalesce(no_assets, no_income, no_cash, misaligned), safe_divide(F.col("income") - F.col("cash"), average)),
        "asset_growth_yoy": (no_assets, safe_divide(F.col("assets"), F.col("prior_assets")) - 1),
        "net_share_issuance_yoy": (no_shares, safe_divide(F.col("shares"), adjusted) - 1),
    }
    cells = F.array(*[
        F.struct(F.lit(key).alias("feature_key"), F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))
        for key, (reason, value) in definitions.items()
    ])
    return rows.select(*CELL, F.explode(cells).alias("x")).select(*CELL, "x.*")


# ---- monthly panel variants ---------------------------------------------------
def latest_per_period(facts: DataFrame, concept: str) -> DataFrame:
    return latest_per_key(facts.where(F.col("concept") == concept), ["security_id", "period_end"], ["available_at", "is_amendment", "accession"])


def annual_prior_change(facts: DataFrame, concept: str) -> DataFrame:
    """Latest period and the prior one nearest to 365 days within 330-400 (FND14, FND15), over resolved facts."""
    periods = latest_per_period(facts, concept).select("security_id", "period_end", "value")
    current = periods.groupBy("security_id").agg(F.max("period_end").alias("current_end"), F.max_by("value", "period_end").alias("current_value"))
    pairs = current.join(periods, "security_id").withColumn("_gap", days("current_end", "period_end")).where(F.col("_gap").between(*PRIOR_DAYS))
    best = F.struct(-F.abs(F.col("_gap") - 365), F.col("period_end"))
    return pairs.groupBy("security_id").agg(
        F.max("current_end").alias("current_end"), F.max("current_value").alias("current_value"),
        F.max_by("period_end", best).alias("prior_end"), F.max_by("value", best).alias("prior_value"))


def accrual_quality(facts: DataFrame) -> DataFrame:
    """(income - cash flow) / mean assets of the latest aligned annual period (FND16), over resolved facts."""
    annual = annual_facts(facts, [*INCOME, *CASH_FLOW])
    best = latest_per_key(annual, ["security_id", "concept", "period_start", "period_end"], ["available_at", "is_amendment", "accession"])
    of = lambda c: F.max(F.when(F.col("concept") == c, F.col("value")))
    periods = best.groupBy("security_id", "period_start", "period_end").agg(
        F.coalesce(of(INCOME[0]), of(INCOME[1])).alias("income"), of(CASH_FLOW[0]).alias("cash")).where("income IS NOT NULL AND cash IS NOT NULL")
    assets = latest_per_period(facts, "Assets").select("security_id", F.col("period_end").alias("asset_end"), F.col("value").alias("assets"))
    near = F.sequence(F.date_sub("period_start", ASSET_GAP_DAYS), F.date_add("period_start", ASSET_GAP_DAYS))
    wanted = periods.withColumn("asset_end", F.explode(F.array_union(near, F.array("period_end")))).join(assets, ["security_id", "asset_end"])
    distance = F.abs(days("asset_end", "period_start"))
    begins = distance <= ASSET_GAP_DAYS
    picked = wanted.groupBy("security_id", "period_start", "period_end").agg(
        F.max("income").alias("income"), F.max("cash").alias("cash"),
        F.min_by(F.when(begins, F.col("assets")), F.when(begins, distance)).alias("begin_assets"),
        F.max(F.when(F.col("asset_end") == F.col("period_end"), F.col("assets"))).alias("end_assets"),
    ).where("begin_assets > 0 AND end_assets > 0")
    latest = latest_per_key(picked, ["security_id"], ["period_end"])
    return latest.select("security_id", "period_end", ((F.col("income") - F.col("cash")) / ((F.col("begin_assets") + F.col("end_assets")) / 2)).alias("accrual_quality"))


def coverage_audit(cells: DataFrame) -> DataFrame:
    """Availability per formation and feature, with aggregate and minimum over formations (FND18, MON16)."""
    per_formation = cells.groupBy("feature_key", "formation_date").agg(
        F.count("value").alias("available"), F.count(F.lit(1)).alias("universe"))
    share = F.col("available") / F.col("universe")
    return per_formation.groupBy("feature_key").agg(
        (F.sum("available") / F.sum("universe")).alias("aggregate_coverage"), F.min(share).alias("minimum_coverage"),
        F.count(F.lit(1)).alias("formations"))
