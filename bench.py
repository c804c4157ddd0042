"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (folder of the tables), BENCH_CPUS (threads of the local master).
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablemend import catalog  # noqa: E402
from tablemend.session import build_session  # noqa: E402

HEADLINES = [
    "missing_profile", "duplicate_rows", "numeric_stats", "iqr_outliers", "correlation_pairs",
    "spearman_with_target", "mutual_information_binned", "issue_list", "impute_mode", "impute_regression",
    "impute_knn", "winsorise", "cell_audit", "frequency_encode", "one_hot", "date_parts", "lag_rolling",
    "entity_frequency", "standardise", "near_duplicate_rows", "label_noise", "tomek_links", "isolation_outliers",
    "local_outlier_factor", "repair_readable", "model_versions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = list(queries) if names == ["all"] else names
    seconds = {}
    spark.read.parquet(f"{folder}/nation.parquet").count()
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
