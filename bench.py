"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the threads."""

from __future__ import annotations

import json
import os
import time

from scorelake.plans import bootstrap_queries, registry
from scorelake.session import get_session

HEADLINE = (
    "q_system_table", "q_roc_points", "q_threshold_metrics", "q_within_group_eer", "q_pooled_bonafide_eer", "q_short_clip_control", "q_quantile_strata_eer", "q_bootstrap_ci_clustered",
    "q_bootstrap_ci_trial", "q_paired_diff", "q_znorm", "q_equal_fusion", "q_spearman_matrix", "q_score_assembly_left", "q_stratified_subsample", "q_frame_quota", "q_dct2", "q_gmm_em_step",
)
#: Replicates of the bootstrap that is timed beside the queries, whose own intervals take 200.
REPLICATES = 2000


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["q_system_eer"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session and the code generator
    times = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    began = time.time()
    bootstrap_queries.replicates(spark, sf, n=REPLICATES).write.format("noop").mode("overwrite").save()
    times[f"bootstrap_{REPLICATES}"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
