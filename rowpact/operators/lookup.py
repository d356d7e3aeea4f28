"""Left lookup joins that stay balanced when one key holds a large share of the left rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HOT_KEYS = 256  # upper bound on the rows of the table that is broadcast here
TRACKED_KEYS = 4096  # sketch size: a key with more than about a thousandth of the rows is found
SKETCH_GROUPS = 256


def hot_keys(df: DataFrame, key: str, limit: int = HOT_KEYS) -> DataFrame:
    """At most `limit` of the most frequent keys, from sketches (the keys are not shuffled).

    Every task sends one small sketch; they are merged in groups first, so the last merge
    sees `SKETCH_GROUPS` sketches however many tasks there were.
    """
    accumulate = F.expr(f"approx_top_k_accumulate(`{key}`, {TRACKED_KEYS})")
    combine = F.expr(f"approx_top_k_combine(_sketch, {TRACKED_KEYS})")
    estimate = F.expr(f"approx_top_k_estimate(_merged, {int(limit)})")
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_group"))
        .agg(accumulate.alias("_sketch"))
        .groupBy(F.lit("all"))  # grouped, because merging nothing at all is an error
        .agg(combine.alias("_merged"))
        .select(F.explode(estimate["item"]).alias("_hot_key"))
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    payload: Sequence[str],
    row: str = "row",
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """`left` with the payload of `right`, which has one row per text key; NULL without a match.

    Rows of a frequent key are spread over the shuffle partitions by a salt from their row
    number, and the one right row of that key is copied once per salt. At most `HOT_KEYS` keys
    are treated so; middling keys are left to adaptive skew splitting, which both plain sides
    of the join allow. Rows without a key get one of their own. The frequent keys are found once, when the
    join is built, and both sides get that same list (`HOT_KEYS` values at most), so the result is exact
    whatever the sketch finds. `keys_from` is a cheaper table with the same keys as `left`.
    """
    spark = left.sparkSession
    salts = max(16, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = hot_keys(left if keys_from is None else keys_from, key).collect()
    hot = F.broadcast(spark.createDataFrame([(r["_hot_key"],) for r in found], "_hot_key string"))
    is_hot = F.col("_hot_key").isNotNull()
    salted_left = left.join(hot, F.col(key) == F.col("_hot_key"), "left").select(
        *[F.col(f"`{c}`") for c in left.columns],
        F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.col(row).cast("string"))).alias("_probe"),
        F.when(is_hot, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).otherwise(F.lit(0))
        .alias("_salt"),
    )
    copies = F.sequence(F.lit(0), F.when(is_hot, F.lit(salts - 1)).otherwise(F.lit(0)))
    salted_right = right.join(hot, F.col(key) == F.col("_hot_key"), "left").select(
        F.col(key).alias("_right_key"),
        *[F.col(p).alias(f"_right_{p}") for p in payload],
        F.explode(copies).alias("_right_salt"),
    )
    joined = salted_left.join(
        salted_right,
        (F.col("_probe") == F.col("_right_key")) & (F.col("_salt") == F.col("_right_salt")),
        "left",
    )
    return joined.select(
        *[F.col(f"`{c}`") for c in left.columns],
        *[F.col(f"_right_{p}").alias(p) for p in payload],
    )


HOT_ROWS = 100_000


def counted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    payload: Sequence[str],
    count: str,
    row: str = "row",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`left` with the payload of `right`, whose `count` says how many left rows each of its keys has.

    Nothing has to be guessed: keys of more than `hot_rows` rows, at most one for each `hot_rows` rows of `left`, are
    broadcast, and their rows go where their row number sends them. All others are joined by shuffle.
    """
    def renamed(frame: DataFrame, prefix: str) -> DataFrame:
        return frame.select(F.col(key).alias(f"{prefix}key"), *[F.col(p).alias(prefix + p) for p in payload])

    hot = renamed(right.filter(F.col(count) > hot_rows), "_hot_")
    rest = renamed(right.filter(F.col(count) <= hot_rows), "_rest_")
    is_hot = F.col("_hot_key").isNotNull()
    probe = F.when(is_hot | F.col(key).isNull(), F.concat(F.lit("\x00"), F.col(row).cast("string"))).otherwise(F.col(key))
    probed = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn("_probe", probe)
    joined = probed.join(rest, F.col("_probe") == F.col("_rest_key"), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in left.columns],
        *[F.when(is_hot, F.col(f"_hot_{p}")).otherwise(F.col(f"_rest_{p}")).alias(p) for p in payload],
    )
