"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meltframe.plans.catalog import QUERIES  # noqa: E402
from meltframe.session import local_session  # noqa: E402

HEADLINE = [
    "mixture_density", "weighted_means", "fractions", "empirical_params", "domain_means", "process_class",
    "process_class_documents", "process_histogram", "missing_profile", "observed_vs_imputed", "imputed_export",
    "composition_string", "composition_parse", "composition_bounds", "feasibility", "kfold", "r2_by_fold", "cv_summary",
    "dense_relu", "decode_candidates", "objective_matrix", "pareto_front", "pareto_rank", "crowding_distance",
    "rf_regress", "batch_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("meltframe-bench", cores=os.environ.get("BENCH_CPUS", "8"))
    # one small job first, so that starting the session is not charged to a query
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
