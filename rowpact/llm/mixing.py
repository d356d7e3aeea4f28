"""Mixing sources to target weights: hash-random keys, range sort, distributed prefix sums, exact cut.

A document's size is its number of words (runs of anything but ASCII white space). Sources in code point order, null
last, weigh WEIGHTS in turn and share the sum of all sizes; a target stops at MAX_EPOCHS times its source's size, and the
excess goes to the others by weight until none is above.

Only (document id, source, size, key) moves. These rows are sorted by range on (source, key), so a source of a third of all
rows spreads over as many partitions as its rows need; each partition adds up sizes as it streams by, and the partitions'
totals (one row per partition and source) give the offsets. Each source's budget is cut at that prefix sum: whole
epochs first, then the documents in key order, the last one in part, so that a source's taken words equal its rounded
target.

Defined cases: null texts have size 0 and are taken 0 words; a source of size 0 has target 0; a null source is a source of
its own; rows that are equal in id, source and size are interchangeable; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rowpact.llm.common import Scratch, fresh, lookup

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from rows of source and size.

    Sorted by the share at which a source is full, the full ones come first: level k is what a unit of weight gets when
    the first k are full; it is the greatest level at which the next one is not full. Windows without partition run over
    one row per source only.
    """
    by_source = Window.orderBy(F.col("source").isNull(), "source")
    per = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_source) - 1) % len(weights) + 1).cast("double"))
        .withColumn("most", (F.col("source_size") * max_epochs).cast("double"))
    )
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / (F.sum("weight").over(every) - F.col("gone")))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(every))
        .select("source", "source_size", F.least(F.col("most"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))
    )


def _running(batches):
    """Adds the partition and, within it and a source, the sum of the sizes before a row. Rows come sorted by source."""
    part = TaskContext.get().partitionId()
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("rank").to_numpy()
        size = batch.column("size").to_numpy()
        before = np.cumsum(size) - size
        new = np.flatnonzero(np.diff(ids)) + 1
        base = np.zeros(len(ids), np.int64)
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(ids)], strict=True):
            base[a:b] = -before[a] + (total if ids[a] == last else 0)
            last, total = ids[a], int(before[b - 1] + size[b - 1] + base[a])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int64)), pa.array(before + base)],
                                         [*batch.schema.names, "part", "inner"])


def mix(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted): one row per document."""
    narrow = scratch.stage(docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "sizes")
    aims = scratch.stage(targets(narrow, weights, max_epochs).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))), "targets")
    ranked = lookup(narrow, aims.select("source", "rank"), ["source"])
    keyed = ranked.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "source"))
    order = ["rank", "key", "doc_id", "size"]
    sums = T.StructType([*keyed.schema.fields, T.StructField("part", T.LongType()), T.StructField("inner", T.LongType())])
    sorted_ = scratch.stage(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, sums), "sorted")
    offsets = (
        sorted_.groupBy("rank", "part").agg(F.sum("size").alias("own"))
        .withColumn("offset", F.sum("own").over(Window.partitionBy("rank").orderBy("part")) - F.col("own"))
        .select("rank", "part", "offset").join(aims.select("rank", "source_size", "target"), "rank")
    )
    place = F.col("offset") + F.col("inner")
    budget = F.round("target").cast("long")
    whole = F.floor(budget / F.greatest("source_size", F.lit(1))).cast("long")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.least(F.greatest(rest - place, F.lit(0)), F.col("size"))
    return sorted_.join(offsets, ["rank", "part"]).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, with what stands between the words."""
    parts = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(parts, 1, n.cast("int")), "")


def mixed_documents(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text: str = "text", source: str = "source",
                    **options) -> DataFrame:
    """The mix itself: a row of docs for each time that it is taken; the one at its source's cut has its first words only.

    A document that is equal to another in id, source and size is taken as often as their mean says, rounded up, so that
    equal rows need no order.
    """
    plan = mix(docs, scratch, id_column, text, source, **options)
    plan = plan.groupBy("doc_id", "source", "size").agg(F.ceil(F.avg("taken")).cast("long").alias("taken")).filter("taken > 0")
    size, taken, words = fresh(docs, "size", "taken", "words")
    left = docs.withColumn(size, n_words(F.col(text)))
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("taken").alias(taken))
    times = F.ceil(F.col(taken) / F.col(size)).cast("int")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = left.join(plan, left[id_column].eqNullSafe(plan["p_id"]) & left[source].eqNullSafe(plan["p_source"]) & (left[size] == plan["p_size"]))
    rows = rows.withColumn(words, F.explode(F.transform(
        F.sequence(F.lit(1), times), lambda k: F.when(k < times, F.col(size)).otherwise(F.col(taken) - (k - 1) * F.col(size)))))
    cut = F.when(F.col(words) < F.col(size), first_words(F.col(text), F.col(words))).otherwise(F.col(text)).alias(text)
    return rows.select(*[cut if c == text else own[k] for k, c in enumerate(docs.columns)])
