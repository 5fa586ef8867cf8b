"""Mixing sources to target weights by entropy balancing.

Within a source the document rates r in (0, 2) stay as near to 1 as the token constraint sum(n r) = T
allows, in the entropy r ln r + (2 - r) ln(2 - r). The convex dual has one multiplier t per source and
exponentially tilted rates r = 2 e^(t z) / (e^(t z) + e^(-t z)), z being the document's size over the
source's mean. Newton iterations on the dual are distributed: each is one aggregation of the sums of
n r and of its derivative. Rates are then rounded into 0, 1 or 2 copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, few, free_names

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
_BINS = 1 << 12


def sized(docs: DataFrame) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def fill(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Targets by weight that sum to ``total``, none above ``most`` times its size; the excess is reshared by weight."""
    target = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    rest = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / weight
            break
        for i in over:
            target[i] = float(most * sizes[i])
        rest -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def _rate(t: Column, z: Column) -> Column:
    """2 / (1 + e^(-2 t z)); infinite t gives the ends for documents of any size."""
    return 2.0 / (1.0 + F.exp(F.least(F.greatest(-2.0 * t * z, F.lit(-700.0)), F.lit(700.0))))


def multipliers(sizes: DataFrame, sources: list[dict]) -> dict[int, float]:
    """The dual's solution per source, from ``sizes`` (place, n, docs): distinct sizes with their counts.

    ``sources``: dicts of place, docs, size and target. A Newton step that leaves the bracket known so far
    is replaced by its middle. Results are rounded to 9 digits, so the order of summation leaves no trace.
    """
    spark = sizes.sparkSession
    done: dict[int, float] = {}
    live = {}
    for s in sources:
        if s["size"] == 0 or s["target"] <= 0:
            done[s["place"]] = -math.inf
        elif s["target"] >= MOST * s["size"] * (1 - 1e-12):
            done[s["place"]] = math.inf
        else:
            live[s["place"]] = {"t": 0.0, "low": -math.inf, "high": math.inf, "mean": s["size"] / s["docs"], **s}
    for _ in range(200):
        if not live:
            return done
        now = spark.createDataFrame([(p, x["t"], x["mean"]) for p, x in live.items()], "place int, t double, mean double")
        z = F.col("n") / F.col("mean")
        r = _rate(F.col("t"), z)
        sums = sizes.join(now, "place").groupBy("place").agg(
            F.sum(F.col("docs") * F.col("n") * r).alias("taken"), F.sum(F.col("docs") * F.col("n") * z * r * (2.0 - r)).alias("slope")).collect()
        for row in sums:
            x = live[row["place"]]
            gap = x["target"] - row["taken"]
            x["low" if gap > 0 else "high"] = x["t"]
            step = gap / row["slope"] if row["slope"] > 0 else math.copysign(math.inf, gap)
            nxt = x["t"] + step
            if not x["low"] < nxt < x["high"]:
                if math.isinf(x["low"]) or math.isinf(x["high"]):
                    nxt = x["t"] + math.copysign(max(1.0, abs(x["t"])), gap)
                else:
                    nxt = (x["low"] + x["high"]) / 2
            if abs(gap) <= 1e-9 * x["size"] or abs(nxt - x["t"]) <= 1e-12 * max(1.0, abs(nxt)):
                done[row["place"]] = float(f"{x['t']:.9g}")
                del live[row["place"]]
            else:
                x["t"] = nxt
    raise RuntimeError("the dual did not converge in 200 steps")


def _copies(theta: Column) -> Column:
    """Copies at a shift of the source's rates: the whole part, one more where the draw falls under the rest."""
    return F.least(F.greatest(F.floor(F.col("rate") + theta + F.col("draw")), F.lit(0)), F.lit(MOST)).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``key``, ``mark`` (a hash of key and text), ``source``, ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` of every row of ``docs``.

    Sources stand in code-point order, null last (one source of its own), and take ``weights`` in turn;
    targets share ``share`` times all words and are capped at twice a source's words, the excess
    reshared. A document's draw is a hash of its key and text, so reruns agree and equal rows are taken
    alike; of each source one shift of all rates, found to within one document over exact sums, brings
    the words taken to the target. Empty documents get rate 1 and take nothing; an empty table gives an
    empty result; a null key is a key like any other. Totals per source are held by the driver: their
    number, not that of documents, bounds what it holds.
    """
    spark = docs.sparkSession
    light = cut(docs.select(key, "source", sized(docs).alias("size"), F.xxhash64(key, "text").alias("mark")))
    totals = light.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    order = sorted(totals, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    targets = fill([r["size"] for r in order], [float(weights[i % len(weights)]) for i in range(len(order))], share * sum(r["size"] for r in order))
    sources = [{"place": i, "source": r["source"], "size": r["size"], "docs": r["docs"], "target": t} for i, (r, t) in enumerate(zip(order, targets, strict=True))]
    names = spark.createDataFrame([(s["place"], s["source"], s["size"], float(s["size"]) / s["docs"], s["target"]) for s in sources],
                                  "place int, source string, source_size long, mean double, target double")
    placed = light.join(few(names.withColumnRenamed("source", "named"), len(sources)), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    solved = multipliers(cut(placed.groupBy("place", F.col("size").alias("n")).agg(F.count("*").alias("docs"))), sources)
    tilt = spark.createDataFrame([(p, t) for p, t in solved.items()], "place int, t double")
    tilted = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("t") == math.inf, F.lit(float(MOST))).when(F.col("t") == -math.inf, F.lit(0.0)).otherwise(
        _rate(F.col("t"), F.col("size") / F.col("mean")))
    # rates and draws on a grid of 2^-40: sums over it are exact
    grid = float(1 << 40)
    rated = cut(placed.join(few(tilt, len(sources)), "place").select(
        "place", key, "mark", "source", "size", "source_size", "target", (F.round(tilted * grid) / grid).alias("rate"),
        (F.pmod(F.xxhash64("mark", F.lit(5)), F.lit(1 << 40)) / grid).alias("draw")))
    shift = _shifts(rated, sources)
    theta = spark.createDataFrame(list(shift.items()), "place int, theta double")
    out = rated.join(few(theta, len(sources)), "place").withColumn("copies", _copies(F.col("theta")))
    return out.select(key, "mark", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _shifts(rated: DataFrame, sources: list[dict]) -> dict[int, float]:
    """Per source the shift of all rates whose rounding takes the words nearest to the target.

    The words taken only grow with the shift; each document steps where rate + draw + shift is whole. A
    range of shifts is cut into bins by the words that step in each; the bin that crosses the target is
    cut again until it is one grid step wide. Every pass is one aggregation to (source, bin).
    """
    spark = rated.sparkSession
    low = {s["place"]: -2.0 for s in sources}
    width = 4.0
    base = {s["place"]: 0 for s in sources}  # words taken at ``low``
    target = {s["place"]: s["target"] for s in sources}
    if not sources:
        return {}
    floor_ = F.least(F.greatest(F.floor(F.col("rate") + F.col("draw") + F.col("low")), F.lit(0)), F.lit(MOST))
    best = {}
    for step in range(4):
        now = spark.createDataFrame(list(low.items()), "place int, low double")
        rows = rated.filter("size > 0").join(few(now, len(low)), "place")
        if step == 0:
            for r in rows.groupBy("place").agg(F.sum(floor_ * F.col("size")).alias("n")).collect():
                base[r["place"]] = int(r["n"])
        # the shifts at which a document takes its first and its second copy
        at = F.explode(F.array(*[(F.lit(float(k)) - F.col("rate") - F.col("draw")) for k in range(1, MOST + 1)])).alias("at")
        inside = rows.select("place", "size", "low", at).filter((F.col("at") > F.col("low")) & (F.col("at") <= F.col("low") + width))
        bins = inside.groupBy("place", F.ceil((F.col("at") - F.col("low")) / (width / _BINS)).alias("bin")).agg(F.sum("size").alias("n")).collect()
        by_place: dict[int, list[tuple[int, int]]] = {}
        for r in bins:
            by_place.setdefault(r["place"], []).append((int(r["bin"]), int(r["n"])))
        for p in low:
            taken, begin = base[p], low[p]
            near = best.get(p)
            if near is None or abs(taken - target[p]) < near[0]:
                near = (abs(taken - target[p]), begin)
            for b, n in sorted(by_place.get(p, [])):
                if taken + n > target[p]:
                    low[p], base[p] = begin + (b - 1) * (width / _BINS), taken
                    over = (taken + n - target[p], begin + b * (width / _BINS))
                    near = min(near, (abs(taken - target[p]), low[p]), over)
                    break
                taken += n
                if abs(taken - target[p]) < near[0]:
                    near = (abs(taken - target[p]), begin + b * (width / _BINS))
            else:
                low[p], base[p] = begin + width, taken
            best[p] = near
        width /= _BINS
    return {p: t for p, (_, t) in best.items()}


def mixture(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; an empty document stays once. Columns stay as they are."""
    names = docs.columns
    other, mark, copies, copy = free_names(docs, "key_", "mark_", "copies_", "copy_")
    taken = mix(docs, key, weights, share).groupBy(F.col(key).alias(other), F.col("mark").alias(mark)).agg(
        F.max(F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))).cast("int").alias(copies))
    joined = docs.join(taken, F.col(key).eqNullSafe(F.col(other)) & (F.xxhash64(key, "text") == F.col(mark)))
    return joined.select(*names, F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(copy)).select(*names)
