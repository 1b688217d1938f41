"""Bootstrap weights made many at a time."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tollgate.functions import hashing as H
from tollgate.operators import bootstrap


def test_weights_equal_single_digests(spark):
    tails = [b"", b":None", b":" + b"x" * 60, ":\u00e9\u4e2d".encode(), *[f":{i * i}".encode() for i in range(300)]]
    for replicates in (1, 45, 1000):
        digests = b"".join(hashlib.md5(f"7:{block}".encode() + t).digest() for t in tails for block in range(-(-replicates // 4)))
        draws = np.frombuffer(digests, ">u4").reshape(len(tails), -1)[:, :replicates]
        assert (H.weights_of("7", tails, replicates) == np.searchsorted(np.array(H.poisson_cuts()), draws, side="right")).all()
    lanes = spark.range(20).select("id", *H.poisson_weights("7", F.lit(3), F.col("id"))).orderBy("id").collect()
    assert [tuple(r)[1:] for r in lanes] == [tuple(w[12:]) for w in H.weights_of("7", [f":{i}".encode() for i in range(20)], 16)]


def test_replicate_sums_are_exact_for_wide_decimals_nulls_and_groups(spark):
    rows = [("a", 1, "999999999999.999999", 1), ("a", 2, "-999999999999.999999", None), ("a", None, "0.000001", 2), (None, 3, None, None), (None, 3, None, 5)]
    df = spark.createDataFrame(rows, "g string, k long, t string, n long").withColumn("v", F.col("t").cast("decimal(18,6)"))
    got = bootstrap.replicate_sums(df, {"s": F.col("v"), "c": F.col("n")}, "k", 6, "7", ["g"])
    weighted = df.crossJoin(spark.range(2).withColumnRenamed("id", "b"))
    weighted = weighted.select("*", F.posexplode(F.array(*H.poisson_weights("7", F.col("b"), F.col("k")))).alias("lane", "w"))
    want = weighted.groupBy("g", (F.col("b") * 4 + F.col("lane")).alias("rep")).agg(
        F.sum(F.col("v") * F.col("w")).alias("s"), F.sum(F.col("n") * F.col("w")).alias("c")).where("rep < 6")
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert got.schema["s"].dataType == want.schema["s"].dataType
