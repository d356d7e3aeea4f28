"""First-row-wins uniqueness that no hot value can pile up in one task.

Which row owns a value is a `min(row)` per value, combined map-side before the shuffle.
The owners then go back to the rows by *row number*, which is unique, so a value shared
by a third of the table still spreads evenly. All keys of a contract ride in one
aggregate and one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_BYTES = 64 << 20  # above this, contested values are not broadcast
KEYS_PER_JOIN = 60  # owned keys travel as the bits of one long
_ROW_OVERHEAD = 64  # bytes per hash-table entry besides the text

Key = tuple[str, ...]


def key_text(key: Key) -> Column:
    """One text per key value; '' where the key takes no part.

    Composite keys carry the length of each part, so ('a','bc') and ('ab','c') differ.
    """
    if len(key) == 1:
        return F.col(f"`{key[0]}`")
    parts = [F.col(f"`{name}`") for name in key]
    complete = parts[0] != ""
    for part in parts[1:]:
        complete &= part != ""
    coded = [F.concat(F.octet_length(part).cast("string"), F.lit(":"), part) for part in parts]
    return F.when(complete, F.concat(*coded)).otherwise(F.lit(""))


def candidates(df: DataFrame, keys: Sequence[Key], eligible: Column, row: str) -> DataFrame:
    """(key number, value, row) of every eligible row; empty values never leave the map side."""
    if len(keys) == 1:
        narrow = df.filter(eligible).select(
            F.lit(0).alias("_key"), key_text(keys[0]).alias("_value"), F.col(row).alias("_row"))
    else:
        pairs = [c for i, key in enumerate(keys) for c in (F.lit(i), key_text(key))]
        narrow = df.filter(eligible).select(
            F.stack(F.lit(len(keys)), *pairs).alias("_key", "_value"), F.col(row).alias("_row"))
    return narrow.filter(F.col("_value") != "")


def owned_keys(df: DataFrame, keys: Sequence[Key], eligible: Column, row: str) -> DataFrame:
    """(_owner_row, _owned): for each row that owns a value, the bit set of owned keys."""
    return owned_bits(value_owners(df, keys, eligible, row))


def value_owners(df: DataFrame, keys: Sequence[Key], eligible: Column, row: str) -> DataFrame:
    """(_key, _value, _owner_row): the first eligible row of each value."""
    return (
        candidates(df, keys, eligible, row)
        .groupBy("_key", "_value")
        .agg(F.min("_row").alias("_owner_row"))
    )


def owned_bits(owners: DataFrame) -> DataFrame:
    bits = F.bit_or(F.expr("shiftleft(1L, _key)"))
    return owners.groupBy("_owner_row").agg(bits.alias("_owned"))


def flag_duplicates(
    df: DataFrame,
    keys: Sequence[Key],
    eligible: Column,
    row: str,
    names: Sequence[str],
    owned: DataFrame | None = None,
) -> DataFrame:
    """Add one boolean per key: the row is eligible, has a value, and another row owns it."""
    if owned is None and len(keys) > KEYS_PER_JOIN:
        some = flag_duplicates(df, keys[:KEYS_PER_JOIN], eligible, row, names[:KEYS_PER_JOIN])
        return flag_duplicates(some, keys[KEYS_PER_JOIN:], eligible, row, names[KEYS_PER_JOIN:])
    if owned is None:
        owned = owned_keys(df, keys, eligible, row)
    joined = df.join(owned, F.col(row) == F.col("_owner_row"), "left")
    mine = F.coalesce("_owned", F.lit(0).cast("bigint"))
    flags = [
        (eligible & (key_text(key) != "") & (F.getbit(mine, F.lit(i)) == 0)).alias(name)
        for i, (key, name) in enumerate(zip(keys, names))
    ]
    return joined.select("*", *flags).drop("_owner_row", "_owned")


#: Words of 64 bits in which `contested_bits` marks values: no table of them has more rows than this.
WORDS = 1 << 17


def _place(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(64 * WORDS).cast("bigint"))


def contested_bits(df: DataFrame, keys: Sequence[Key], eligible: Column, row: str) -> DataFrame:
    """(_word, _bits): one bit for each value that more than one row claims.

    Only hashes of values are shuffled, counted map-side first. Values that share a hash or a bit add rows to the exact
    comparison and change no result. The table has at most `WORDS` rows of two longs, whatever the input.
    """
    hashed = candidates(df, keys, eligible, row).select(F.xxhash64("_key", "_value").alias("_hash"))
    twice = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_claims")).filter("_claims > 1")
    placed = twice.select(_place(F.col("_hash")).alias("_place"))
    return placed.groupBy(F.shiftright("_place", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 as int))")).alias("_bits"))


def mark_suspects(df: DataFrame, keys: Sequence[Key], eligible: Column, bits: DataFrame, name: str) -> DataFrame:
    """Add a boolean: the row is eligible and one of its values has its bit set. No row is moved."""
    out, found = df, F.lit(False)
    for i, key in enumerate(keys):
        hashed = F.xxhash64(F.lit(i), key_text(key))
        place = _place(hashed)
        out = out.join(
            F.broadcast(bits.select(F.col("_word").alias(f"_word{i}"), F.col("_bits").alias(f"_bits{i}"))),
            F.shiftright(place, 6) == F.col(f"_word{i}"), "left")
        mine = F.getbit(F.coalesce(f"_bits{i}", F.lit(0).cast("bigint")), place.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
        found |= (key_text(key) != "") & (mine == 1)
    return out.select(*[f"`{c}`" for c in df.columns], F.coalesce(eligible & found, F.lit(False)).alias(name))


def flag_in_place(df: DataFrame, keys: Sequence[Key], eligible: Column, row: str, names: Sequence[str]) -> DataFrame:
    """The flags of `flag_duplicates`, for tables whose values are nearly unique.

    Rows whose values nobody else claims stay where they are. The others, which include every claim of every contested
    value, are compared exactly among themselves, distributed by row number so that a hot value spreads.
    `df` is computed three times, once of them for its keys only. A null value takes no part.
    """
    marked = mark_suspects(df, keys, eligible, contested_bits(df, keys, eligible, row), "_suspect")
    alone = marked.filter(~F.col("_suspect")).drop("_suspect").select("*", *[F.lit(False).alias(n) for n in names])
    several = marked.filter("_suspect").drop("_suspect").repartition(F.col(f"`{row}`"))
    flagged = flag_duplicates(several, keys, eligible, row, names)
    return alone.unionByName(flagged).withColumns({n: F.coalesce(n, F.lit(False)) for n in names})


def stage_contested(
    df: DataFrame, keys: Sequence[Key], eligible: Column, row: str, path: str
) -> DataFrame:
    """Write the values that more than one row claims: (_key, _value, _owner_row).

    A written table survives lost executors and is shared by every later sink. Most
    contracts are nearly unique, so it is far smaller than the input.
    """
    contested = (
        candidates(df, keys, eligible, row)
        .groupBy("_key", "_value")
        .agg(F.min("_row").alias("_owner_row"), F.count(F.lit(1)).alias("_claims"))
        .filter(F.col("_claims") > 1)
        .drop("_claims")
    )
    contested.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def fits_broadcast(contested: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the contested values, as measured, are small enough to send to every executor."""
    size = F.sum(F.octet_length("_value") + F.lit(_ROW_OVERHEAD))
    return contested.agg(F.coalesce(size, F.lit(0)).alias("n")).first()["n"] <= limit


def flag_from_contested(
    df: DataFrame,
    keys: Sequence[Key],
    eligible: Column,
    row: str,
    names: Sequence[str],
    contested: DataFrame,
) -> DataFrame:
    """Flag duplicates without moving the rows. Only for contested values that `fits_broadcast`."""
    out = df
    for i, key in enumerate(keys):
        mine = contested.filter(F.col("_key") == i).select(
            F.col("_value").alias(f"_value{i}"), F.col("_owner_row").alias(f"_owner{i}"))
        out = out.join(F.broadcast(mine), key_text(key) == F.col(f"_value{i}"), "left")
    flags = [
        (eligible & F.coalesce(F.col(row) > F.col(f"_owner{i}"), F.lit(False))).alias(name)
        for i, name in enumerate(names)
    ]
    return out.select(*[f"`{c}`" for c in df.columns], *flags)
