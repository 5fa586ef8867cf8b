"""Four quarters and comparable priors as ranges of decisions: as a direct lookup finds them, and not spread over the formations."""

import datetime as dt
import random

from tidemark.functions.asof import expand_versions
from tidemark.operators import fundamentals as f

D = dt.date
FORMATIONS = [(D(2000 + m // 12, m % 12 + 1, 25), dt.datetime(2000 + m // 12, m % 12 + 1, 26)) for m in range(60)]
QUARTER = "security_id long, concept string, quarter string, period_start date, period_end date, value double, available_at timestamp"
FACT = ("security_id long, accession string, form string, is_amendment boolean, accepted_at timestamp, available_at timestamp, taxonomy string, "
        "concept string, unit string, period_start date, period_end date, fiscal_year int, fiscal_period string, value double")


def formations(spark):
    return spark.createDataFrame(FORMATIONS, "formation_date date, decision_at timestamp")


def quarter_days(i):
    start = D(2000 + i // 4, i % 4 * 3 + 1, 1)
    return start, D(2000 + (i + 1) // 4, (i + 1) % 4 * 3 + 1, 1) - dt.timedelta(days=1)


def random_quarters(seed):
    """Quarters with gaps, late and early filings, corrections, withdrawn values and a second concept."""
    draw, rows = random.Random(seed), []
    for security in range(1, 7):
        for concept in f.INCOME:
            for i in range(16):
                start, end = quarter_days(i)
                for _ in range(draw.choice([0, 1, 1, 1, 1, 1, 2, 3])):
                    at = dt.datetime.combine(end, dt.time()) + dt.timedelta(days=draw.choice([-50, 10, 35, 35, 40, 300]), minutes=draw.randrange(1000))
                    rows.append((security, concept, f"Q{i % 4 + 1}", start, end, None if draw.random() < 0.1 else float(draw.randrange(1000)), at))
    return rows


def looked_up(rows, formation, decision, security):
    for concept in f.INCOME:
        standing = {}
        for s, c, _, start, end, value, at in sorted(rows, key=lambda r: r[6]):
            if s == security and c == concept and at <= decision:
                standing[(end, start)] = value
        four = sorted((k, v) for k, v in standing.items() if v is not None and k[0] <= formation)[-4:]
        gaps = [(b[0][1] - a[0][0]).days - 1 for a, b in zip(four, four[1:])]
        if len(four) == 4 and all(0 <= g <= 7 for g in gaps):
            return sum(v for _, v in four), four[-1][0][0], concept
    return None


def test_four_quarters_equal_a_direct_lookup(spark):
    rows = random_quarters(5)
    held = f.ttm_intervals(spark.createDataFrame(rows, QUARTER), formations(spark), {"income": f.INCOME})
    got = {(r.formation_date, r.security_id): (r.value, r.period_end, r.concept) for r in expand_versions(held, formations(spark)).collect()}
    expected = {(d, s): found for d, at in FORMATIONS for s in range(1, 7) if (found := looked_up(rows, d, at, s))}
    assert len(expected) > 50 and got == expected


def test_quarters_are_not_spread_over_the_formations(spark):
    rows = [(1, "NetIncomeLoss", "Q", *quarter_days(i), float(i), dt.datetime.combine(quarter_days(i)[1], dt.time()) + dt.timedelta(days=20)) for i in range(8)]
    held = f.ttm_intervals(spark.createDataFrame(rows, QUARTER), formations(spark), {"income": f.INCOME})
    assert held.count() == 5 and expand_versions(held, formations(spark)).count() == 60 - 12


def test_priors_equal_a_direct_lookup(spark):
    draw, rows = random.Random(3), []
    for security in range(1, 6):
        for i in range(16):
            end = quarter_days(i)[1] - dt.timedelta(days=draw.choice([0, 0, 0, 20]))
            for n in range(draw.choice([0, 1, 1, 2])):
                at = dt.datetime.combine(end, dt.time()) + dt.timedelta(days=draw.choice([10, 35, 200, 500]), minutes=draw.randrange(1000))
                rows.append((security, f"{security}-{i}-{n}", "10-Q", False, at, at, "us-gaap", "Assets", "USD", None, end, end.year, "Q", float(draw.randrange(-20, 100))))
    facts = spark.createDataFrame(rows, FACT)
    got = {(r.formation_date, r.security_id): (r.prior_assets_end, r.prior_assets) for r in f.comparable_prior(facts, formations(spark), "Assets", "assets").collect()}
    expected = {}
    for day, decision in FORMATIONS:
        for security in range(1, 6):
            standing = {}
            for row in sorted(rows, key=lambda r: r[5]):
                if row[0] == security and row[5] <= decision:
                    standing[row[10]] = row[13]
            if standing and standing[max(standing)] > 0:
                near = [e for e in standing if 330 <= (max(standing) - e).days <= 400]
                if near:
                    expected[(day, security)] = (max(near), standing[max(near)] if standing[max(near)] > 0 else None)
    assert len(expected) > 50 and got == expected


def test_formations_of_one_span_keep_what_they_know(spark):
    at = lambda day: dt.datetime.combine(day, dt.time())
    start, end = D(2000, 1, 1), D(2001, 1, 1)
    spans = spark.createDataFrame([(d, s, start, end, at(d)) for d in (D(2001, 2, 1), D(2001, 3, 1)) for s in (1, 2)] + [(D(2001, 3, 1), 3, None, end, at(end))],
                                  "formation_date date, security_id long, span_start date, span_end date, decision_at timestamp")
    split = lambda s, day, known: (s, "forward_split", day, 2.0, 1.0, at(known))
    actions = spark.createDataFrame([split(1, D(2000, 6, 1), D(2000, 6, 2)), split(1, D(2000, 7, 1), D(2001, 2, 15)), split(1, start, start)],
                                    "security_id long, action_type string, effective_date date, ratio_numerator double, ratio_denominator double, available_at timestamp")
    got = {(r.formation_date.month, r.security_id): r.factor for r in f.split_factor(actions, spans).collect()}
    assert got == {(2, 1): 2.0, (3, 1): 4.0, (2, 2): 1.0, (3, 2): 1.0, (3, 3): 1.0}


def test_closes_aggregate_the_formation_sessions_only(spark):
    from tidemark.fixtures import Research
    from tidemark.plans import fundamentals as plans

    plan = plans.closes(Research(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [security_id") < plan.index("LeftSemi")
