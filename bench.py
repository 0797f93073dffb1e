"""Time registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query writes its whole result to the no-op sink.  BENCH_QUERIES (comma list) picks
some; BENCH_ALL=1 runs all registered queries instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = """
a1_good_copies a2_completeness a3_raw_size a6_directory_digest a13_log_totals
c4_drift_velocity c6_apply_correction c7_fit_polynomial e1_adler32 e3_sha e10_parse_upload_log e12_log_summary
e13_classify_errors e15_parse_replicas f11_is_transferred_to f12_site_attributes
j1_master_checksum j2_compare_checksums j3_here_there j4_range_lookup j5_interval_mean j6_find_strays
j8_verify_download j9_verify_upload j10_match_rules j13_product_backlog
m1_push_locations m2_set_location m3_pull_locations m8_add_checksum
p1_stalled_transfers p2_bad_checksum p3_buffer_purge p5_catalogue_purge p6_transfer_plan p10_processing_plan
p11_product_plan p13_rule_actions p15_restore_plan r3_rse_multiple r6_rse_refresh s1_read_runs s5_read_logs
t2_current_state t3_stall_alarms t3_stall_alarm_stream t4_bad_transitions u4_composed_pass
""".split()


def main() -> None:
    from runledger.session import local_session
    from runledger.workloads import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = chosen or (list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE)
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a1_good_copies"](spark, sf).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{times[name]:8.2f}  {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
