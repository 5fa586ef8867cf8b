from pyspark.sql import functions as F

from tidemark.sources import datasets as ds


def test_rows_of_a_digest_tree_are_shuffled_once(spark):
    rows = spark.range(70000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 2).alias("v"))
    out = ds.tree_digest(rows, ["g"], ["id"], ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the rows by the root's children, then the children by group
    assert plan.count("Exchange hashpartitioning") == 2
    again = ds.tree_digest(rows.repartition(7, "v"), ["g"], ["id"], ["v"])
    assert sorted(out.collect()) == sorted(again.collect()) and {r.rows_count for r in out.collect()} == {35000}
