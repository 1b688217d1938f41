"""Stored layouts that save later shuffles: marts in buckets, and wide rows around a narrow window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators.velocity import feature_names, velocity


def bucketed(df: DataFrame, name: str, path: str, key: str, order: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Write ``df`` as table ``name`` in hash buckets of ``key``, sorted inside by key and ``order``, and read it.

    Windows, aggregates and joins on the key then need no exchange. One task writes one bucket, so there is one file for each.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, key).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(n, key).sortBy(key, *order).saveAsTable(name))
    return df.sparkSession.table(name)


def pivoted_block(lines: DataFrame, key: str, slot: Column, value: str, width: int, prefix: str = "v") -> DataFrame:
    """One row per ``key`` with ``width`` columns: the sum of ``value`` by slot 1..width, null where there is none."""
    return (lines.groupBy(key, slot.cast("int").alias("__slot")).agg(F.sum(value).alias("__v"))
            .groupBy(key).pivot("__slot", list(range(1, width + 1))).agg(F.first("__v"))
            .withColumnsRenamed({str(i): f"{prefix}{i}" for i in range(1, width + 1)}))


def with_late_features(wide: DataFrame, row_id: str = "transaction_id", key: str = "account_id", ts: str = "transaction_dt",
                       amt: str = "transaction_amt") -> DataFrame:
    """`wide` with the look-back block; the window never sees the wide columns.

    The window runs on four columns of the table, and its result is joined back by the row id. Where ``wide`` is stored in
    buckets of the row id, only the narrow rows are shuffled: once by account and once by row id. A few columns of a wide table
    look small to the planner, which takes their share of the compressed bytes; the hint keeps it from broadcasting all their rows.
    """
    looked_back = velocity(wide.select(row_id, key, ts, amt), key, ts, amt).select(row_id, *feature_names())
    return wide.join(looked_back.hint("merge"), row_id)
