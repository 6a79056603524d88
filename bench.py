"""Time the headline queries and print one JSON line.

A table of the given folder is one file with one row group, which a single task reads. The queries
are timed twice: over a copy with a file for every core, written beforehand, and over the folder as
it is. ``value`` and ``queries`` are for the copy, as tables come on a cluster; ``value_as_given`` and
``queries_as_given`` for the folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from entry_queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "char_counts",
    "required_chars",
    "preprocess",
    "split_90_5_5",
    "split_exact",
    "with_row_idx",
    "epoch_shuffle",
    "sample_with_replacement",
    "pad_batch",
    "train_batch",
    "word_counts",
    "substring_seeds",
    "merge_vocab",
    "encode",
    "decode",
    "training_batches",
    "init_embeddings",
    "corpus_bleu",
    "corpus_chrf",
    "evaluate",
    "best_checkpoints",
    "macro_loss",
    "learn_vocab",
]


def spread(spark: SparkSession, folder: str, target: str) -> None:
    """Copy every table, with as many files as there are cores."""
    for path in sorted(Path(folder).glob("*.parquet")):
        rows = spark.read.parquet(str(path))
        rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{target}/{path.name}")


def timed(spark: SparkSession, names: list[str], folder: str) -> dict[str, float]:
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    return times


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CORES}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CORES if CORES.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    with tempfile.TemporaryDirectory(prefix="bench-") as copy:
        spread(spark, FOLDER, copy)
        QUERIES["corpus_size"](spark, copy).collect()
        times = timed(spark, names, copy)
        as_given = timed(spark, names, FOLDER)
    scale = re.search(r"sf([0-9.]+)", FOLDER)
    result = {
        "metric": "total_wall_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else FOLDER,
        "value_as_given": round(sum(as_given.values()), 3),
        "queries_as_given": as_given,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
