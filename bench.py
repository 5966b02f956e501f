"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from verstore.plans import queries as core
from verstore.store import Database

HEADLINE = ("snapshot_view", "as_of_view", "point_get", "multi_get", "range_scan", "batch_last_wins", "wal_recovery", "write_conflicts", "read_conflicts", "phantom_conflicts", "compaction_merge", "gc_removable", "pitr_restore", "log_ship", "state_hash")


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return round(time.perf_counter() - start, 3)


def store(spark: SparkSession, rows: int = 10_000, puts: int = 100) -> dict[str, float]:
    """Seconds of writes to and reads from a fresh store: keys key-%08d."""
    pairs = [(b"key-%08d" % i, b"value-%08d" % i) for i in range(rows)]
    with tempfile.TemporaryDirectory() as at:
        single, batch = Database.open(spark, f"{at}/single"), Database.open(spark, f"{at}/batch")
        out = {f"put_{puts}": timed(lambda: [single.set(k, v) for k, v in pairs[:puts]])}
        out[f"write_batch_{rows}"] = timed(lambda: batch.write_batch(("put", k, v) for k, v in pairs))
        frame = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs], "key binary, value binary")
        out[f"write_frame_{rows}"] = timed(lambda: batch.write_df(frame))
        out["checkpoint"] = timed(batch.checkpoint)
        out["get"] = timed(lambda: batch.get(b"key-00005000"))
        out["get_range_1000"] = timed(lambda: batch.get_range(b"key-00005000", b"key-00006000"))
        out[f"multi_get_{rows}"] = timed(lambda: batch.multi_get(frame).write.format("noop").mode("overwrite").save())
        out["reopen"] = timed(lambda: Database.open(spark, f"{at}/batch").get(b"key-00000001"))
    return out


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first compiles
            start = time.perf_counter()
            core.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "store": store(spark), "sf": sf}))


if __name__ == "__main__":
    main()
