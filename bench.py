"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Every query runs once unmeasured, then three times; the median counts. The
result is written to a sink that keeps nothing, so all rows are computed.
Two generated matrices show how speed depends on the width; ``--sweep`` adds
more widths, and block sizes, schedules and split sizes.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import narrowmat as nm  # noqa: E402
from narrowmat.catalog import queries as q  # noqa: E402

HEADLINE = [
    "tsqr_lineitem", "tsqr_embeddings", "tsqr_scheduled", "gram_lineitem", "gram_embeddings",
    "cholesky_qr", "col_sums", "col_sums_embeddings", "svd_left_leverage", "svd_reconstruct",
    "least_squares", "pca_gram", "word_count", "duplicate_keys", "text_roundtrip",
    "fixed_records", "image_pca", "gen_matrix_r", "mix_rows", "profile_values",
]

# Published cells (rows x columns) per second and map slot of a 100,000,000 x 500
# factorisation in C++, and of its two Python versions.
PUBLISHED_CELLS_PER_SLOT = {"cxx": 703_000, "python_fast": 367_000, "python_slow": 227_000}


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("narrowmat-bench")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="narrowmat-bench-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(run, times: int = 3) -> float:
    run()
    taken = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        taken.append(time.perf_counter() - began)
    return round(statistics.median(taken), 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def generated(spark, cells: int, n: int):
    """A matrix of about ``cells`` numbers in Parquet; gives its path and rows."""
    path = q.scratch(spark, f"bench{n}")
    m = nm.gen_matrix(spark, cells // n, n, maprows=10 * n, parts=16)
    nm.save(m, path)
    return path, spark.read.parquet(path).count()


def reader(spark, path, n):
    return lambda: nm.as_matrix(spark.read.parquet(path), n=n)


def widths(spark, cells: int, sizes, cpus: int) -> dict:
    """TSQR and column sums over matrices of different shape and equal size."""
    found = {}
    for n in sizes:
        path, rows = generated(spark, cells, n)
        read = reader(spark, path, n)
        took = seconds(lambda: drain(nm.tsqr(read())))
        stages = {r.stage: r.rows for r in nm.tsqr(read(), stats=True).stats.collect()}
        found[f"{rows}x{n}"] = {
            "tsqr": took,
            "shuffled_of_read": round(stages.get(1, 0) / stages[0], 4),
            "col_sums": seconds(lambda: drain(nm.col_sums(read()))),
            "tsqr_cells_per_core_second": round(rows * n / took / cpus),
        }
    return found


def sweep(spark, cells: int) -> dict:
    """Seconds of TSQR over block sizes, schedules and split sizes."""
    found = {}
    for n in (50, 500):
        path, _ = generated(spark, cells, n)
        read = reader(spark, path, n)
        for size in (2, 3, 5, 10, 20, 50, None):
            took = seconds(lambda: drain(nm.tsqr(read(), blocksize=size)), 2)
            found[f"n{n} blocksize {size or 'auto'}"] = took
        for schedule in ("1", "8,1", "s16,8,1", None):
            took = seconds(lambda: drain(nm.tsqr(read(), schedule=schedule)), 2)
            found[f"n{n} schedule {schedule or 'auto'}"] = took
        for split in (4, 16, 64):
            read = reader(nm.split_session(spark, split << 20), path, n)
            found[f"n{n} split {split}m"] = seconds(lambda: drain(nm.tsqr(read())), 2)
    return found


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sweep", action="store_true")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    # The first queries of a JVM run uncompiled; let others have that time.
    for name in ("tsqr_lineitem", "svd_left_leverage", "col_sums") * 3:
        drain(q.QUERIES[name](spark, folder))
    times = {}
    for name in options.names or HEADLINE:
        times[name] = seconds(lambda: drain(q.QUERIES[name](spark, folder)))
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    rows = q.table(spark, folder, "lineitem").count()
    result = {
        "metric": "sum of headline query medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }
    if "tsqr_lineitem" in times:
        result["tsqr_rows_per_second"] = round(rows / times["tsqr_lineitem"])
    if not options.names:
        # As many numbers as sixteen columns of lineitem.
        result["widths"] = widths(spark, 16 * rows, (50, 500), int(cpus))
        result["widths"] |= widths(spark, 32 * rows, (1000,), int(cpus))
        result["published_cells_per_slot_second"] = PUBLISHED_CELLS_PER_SLOT
    if options.sweep:
        result.setdefault("widths", {}).update(widths(spark, 16 * rows, (100,), int(cpus)))
        result["widths"].update(widths(spark, 64 * rows, (2000,), int(cpus)))
        result["sweep"] = sweep(spark, 16 * rows)
    spark.stop()
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
