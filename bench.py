"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import load  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "WIN02_momentum_12_1", "WIN11_idiosyncratic_volatility_60d", "JN01_fact_as_of", "JN03_as_of_sweep", "JN23_bar_reconciliation",
    "RNK01_sector_percentile", "RNK07_equal_weight_composite", "RNK09_linear_model_scores", "LBL01_forward_return", "LBL02_wealth_return",
    "FND08_true_ttm", "FND11_split_adjustment_factor", "MDL15_ridge", "MDL25_out_of_fold_predictions", "EVL01_rank_ic", "MON05_feature_health",
    "PRT02_rebalance_ledger", "SRC01_daily_bar_payloads", "RNK16_score_run", "SRV01_dated_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 * 1024 * 1024))
    catalogue = load()
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
