"""Readers, writers and typed projections of the raw, staging and mart layers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.scalars import day_of

# Types pinned by name.
PINNED_TYPES = {"transaction_id": "bigint", "is_fraud": "int", "transaction_dt": "bigint",
                "transaction_amt": "decimal(18,3)", "txn_day": "bigint"}
PINNED_COUNTS = {"transaction_id", "transaction_dt", "txn_day", "is_fraud"}


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Without a schema one type per column is inferred over the whole input:
    mixed numbers widen, any text makes the column a string."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Idempotent full replace."""
    packed(df, partition_by).write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def packed(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Gather each output partition into files of the advisory size, splitting oversized ones."""
    return df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df


def csv_to_parquet(spark: SparkSession, csv_path: str, out_path: str, seconds: str | None = None,
                   schema: T.StructType | None = None) -> DataFrame:
    """Raw CSV to Parquet; with ``seconds`` the day index is derived and kept as ``txn_day``."""
    df = read_csv(spark, csv_path, schema)
    if seconds:
        df = df.withColumn("txn_day", day_of(seconds))
    write_parquet(df, out_path)
    return spark.read.parquet(out_path)


def prepare(spark: SparkSession, transactions_csv: str, identity_csv: str, out_dir: str) -> dict[str, DataFrame]:
    """Both raw tables. Only transactions have a clock, so only they get a day."""
    return {"transactions": csv_to_parquet(spark, transactions_csv, f"{out_dir}/transactions", "TransactionDT"),
            "identity": csv_to_parquet(spark, identity_csv, f"{out_dir}/identity")}


def snake(name: str) -> str:
    """Lower case, with an underscore between a lower and an upper letter."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


def _staged_type(name: str, dtype: T.DataType) -> str:
    if name in PINNED_TYPES:
        return PINNED_TYPES[name]
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "bigint"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "string"


def staged(df: DataFrame) -> DataFrame:
    """Snake-case, typed view of a raw table from its own schema, in one projection.

    Pinned names come first, then the type rule, then string. Whole-number targets round a
    fractional source instead of truncating it, and text that is no number becomes null.
    """
    cols = []
    for f in df.schema.fields:
        name = snake(f.name)
        target = _staged_type(name, f.dataType)
        col = F.col(f"`{f.name}`")
        if name in PINNED_COUNTS and not isinstance(f.dataType, (T.LongType, T.IntegerType)):
            col = col.try_cast("decimal(38,0)")
        cols.append(col.try_cast(target).alias(name))
    return df.select(*cols)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Bulk load of several files by column name, ignoring case; columns a file lacks become null."""
    lowered = [df.toDF(*[c.lower() for c in df.columns]) for df in frames]
    out = lowered[0]
    for df in lowered[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def completeness(df: DataFrame, name: str, rows: int, columns: int) -> DataFrame:
    """One row per failed size expectation; empty when the load is complete."""
    return df.agg(F.count("*").alias("actual_rows")).select(
        F.lit(name).alias("table"), "actual_rows", F.lit(rows).cast("long").alias("expected_rows"),
        F.lit(len(df.columns)).alias("actual_columns"), F.lit(columns).alias("expected_columns")).where(
        "actual_rows <> expected_rows or actual_columns <> expected_columns")


def require_complete(df: DataFrame, name: str, rows: int, columns: int) -> None:
    bad = completeness(df, name, rows, columns).collect()  # at most one row
    if bad:
        raise ValueError(f"{name} is incomplete: {bad[0].asDict()}")


def narrowed(df: DataFrame) -> DataFrame:
    """Lower-case names and smaller types for extracts: double to float, scale-0 decimal to long,
    other decimals to double."""
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            col = col.cast("float")
        elif isinstance(f.dataType, T.DecimalType):
            col = col.cast("long" if f.dataType.scale == 0 else "double")
        cols.append(col.alias(f.name.lower()))
    return df.select(*cols)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None only where nothing stands at the path. Any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as failed:
        if failed.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                 columns: Sequence[str] | None = None) -> DataFrame:
    """The table at ``path``, building and writing it on first use."""
    df = read_if_there(spark, path)
    if df is None:
        write_parquet(narrowed(build()), path)
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_result_csv(df: DataFrame, path: str) -> None:
    """Result-sized frames only: one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def publish(df: DataFrame, name: str, materialise: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Staging layers become views, marts become tables."""
    if materialise:
        df.write.mode("overwrite").format("parquet").partitionBy(*partition_by).saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)


def aligned(df: DataFrame, ids: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows of ``df`` for exactly the ids given; raises when an id is missing or repeated. One pass checks both."""
    marked = df.select(key, F.lit(1).alias("__row"), F.lit(0).alias("__id")).unionByName(
        ids.select(key, F.lit(0).alias("__row"), F.lit(1).alias("__id")))
    sides = marked.groupBy(key).agg(F.sum("__row").alias("rows"), F.sum("__id").alias("ids")).where("ids > 0")
    seen = sides.agg(F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), F.count_if((F.col("rows") == 0) | F.col(key).isNull()).alias("missing"),
                     F.count_if((F.col("rows") > 1) | (F.col("ids") > 1)).alias("repeated")).first()
    if seen["missing"] or seen["repeated"]:
        raise ValueError(f"alignment on {key}: of {seen['ids']} ids {seen['missing']} are missing, {seen['repeated']} repeated")
    return df.join(ids.select(key), key)
