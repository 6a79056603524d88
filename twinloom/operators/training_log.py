"""Queries over training metrics and checkpoint records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: number of best checkpoints kept besides the last one.
SAVE_TOP_K = 3


def mean_loss_by_loader(metrics: DataFrame) -> DataFrame:
    """Row-weighted mean loss per epoch and loader; rows without a value carry no weight."""
    rows = F.when(F.col("value").isNotNull(), F.col("n_rows"))
    weighted = F.sum(F.col("value") * rows) / F.sum(rows)
    return metrics.groupBy("epoch", "loader").agg(weighted.alias("val_loss"))


def macro_loss(by_loader: DataFrame, n_loaders: int = 2) -> DataFrame:
    """Unweighted mean over loaders; null where a loader reported nothing."""
    complete = F.count("val_loss") == n_loaders
    return by_loader.groupBy("epoch").agg(F.when(complete, F.avg("val_loss")).alias("val_loss"))


def best_checkpoints(records: DataFrame, *run: str, k: int = SAVE_TOP_K) -> DataFrame:
    """The ``k`` lowest losses and the last step of each run, flagged ``best`` / ``last``.

    A record without a loss is never among the best.

    Spark turns the rank filter into a group limit ahead of the shuffle, so every task sends
    at most ``k`` rows of a run, however many the run has.
    """
    by_loss = Window.partitionBy(*run).orderBy("val_loss", "step")
    best = (
        records.where(F.col("val_loss").isNotNull())
        .withColumn("_rank", F.row_number().over(by_loss))
        .where(F.col("_rank") <= k)
        .select(*records.columns, F.lit("best").alias("kept_as"))
    )
    last = (
        records.groupBy(*run)
        .agg(F.max_by(F.struct(*records.columns), "step").alias("_row"))
        .select("_row.*", F.lit("last").alias("kept_as"))
    )
    return best.unionByName(last)


def checkpoint_name(epoch: Column, val_loss: Column) -> Column:
    return F.format_string("epoch=%02d-val_loss=%.5f.ckpt", epoch.cast("int"), val_loss)


def parse_checkpoint_name(name: Column) -> tuple[Column, Column]:
    """Epoch and loss of a checkpoint file name."""
    pattern = r"epoch=(\d+)-val_loss=([0-9.]+)\.ckpt$"
    epoch = F.regexp_extract(name, pattern, 1).cast("int")
    return epoch, F.regexp_extract(name, pattern, 2).cast("double")
