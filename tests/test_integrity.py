"""Key integrity: counts on odd rows, and keys spread over many tasks."""

import math

from tidemark.operators import quality


def test_keys_are_counted_and_spread(spark):
    rows = [(1, 0.5), (1, 0.5), (2, None), (3, math.nan), (4, math.inf), (5, 1.0), (None, 1.0), (None, 2.0)]
    out = quality.key_integrity(spark.createDataFrame(rows, "k long, v double"), ["k"], ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    pieces = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {pieces})" in plan
    row = out.first()
    assert (row["keys"], row["duplicate_keys"], row["bad_v"]) == (6, 2, 3)
