"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated subset. After BENCH_SECONDS the line lists what was timed until then, and
under ``unfinished`` the queries that were not.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from tabscale.plans import catalogue
from tabscale.session import local_session

HEADLINE = [
    "prof_summary", "prof_corr_reg", "prof_duplicates", "prof_categorical", "prof_distribution",
    "chart_hist", "chart_qq", "chart_corr_matrix", "chart_corr_matrix_wide",
    "imp_auto", "out_all", "out_remove",
    "prep_noise_mix", "prep_split", "prep_scale", "prep_label_encode",
    "met_bundle", "met_prf_weighted", "met_auc", "cmp_rep_stats",
    "rf_bootstrap", "rf_thresholds", "rf_fit",
    "ml_ridge", "ml_rf", "xai_shap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    run: dict[str, float] = {}

    def line() -> str:
        unfinished = [n for n in names if n not in run]
        return json.dumps({
            "metric": "headline_total_seconds", "value": round(sum(run.values()), 3), "unit": "sec", "queries": run,
            "sf": os.path.basename(sf_dir.rstrip("/"))} | ({"unfinished": unfinished} if unfinished else {}))

    def stop() -> None:
        print(line(), flush=True)
        os._exit(0)

    timer = threading.Timer(float(os.environ.get("BENCH_SECONDS", "1500")), stop)
    timer.daemon = True
    timer.start()
    for i, name in enumerate([names[0], *names]):  # the first run warms the JVM up
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        if i:
            run[name] = round(time.perf_counter() - start, 3)
            print(name, run[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    timer.cancel()
    print(line())


if __name__ == "__main__":
    main()
