"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct shingles of SHINGLE lower-cased words; two documents link at a similarity of THRESHOLD per cent.
Shingles are put in a global order by a 64-bit hash. The order is cut into fragments, and sets are compared fragment by fragment:

1. Documents with equal sets are one class (128 bits of the set); from here on there are classes only.
2. Linked sets differ in at most d = n/9 shingles, where n is the smaller's size (at 90 per cent). Each class gives signatures, of which
   two linked classes have one in common; it gives them for each level (of sizes) at which a linked set could be. Sets from SMALL
   shingles: more fragments than d, so that some fragment is the same in both; each level has spare fragments (SPARE), since an
   empty one says nothing, and that all in question are empty has a chance below 1e-12 a pair. Smaller sets: the order is cut into
   d/3 + 1 groups of GROUP fragments, so some group has at most two differing shingles; a signature for each choice of GROUP - 2 of its
   fragments, empty or not, and one choice is without difference.
3. Classes that share a signature meet, which a line that many texts have in common is enough for. Each class has a sketch: a bit for each
   remainder of its hashes that comes up an odd number of times. A shingle that only one of two sets has turns one bit, so sketches of
   linked sets differ in no more bits than the sets do in shingles. Classes of a signature whose sizes and sketches allow a link are
   tied, by as many rows as the signature has members at most; families are the components of these ties. A signature of
   more than MEETING classes is cut into blocks as families are. Signatures are taken in PASSES shares, one after the other.
4. Families are compared block by block: a family of more than BLOCK classes (or BLOCK_SHINGLES shingles) is cut into blocks by hash, and
   each pair of blocks is a task's work. The order is cut into PARTS equal ranges; overlaps of all pairs are counted in each range
   separately, as a product of incidence matrices of that range's shared shingles, and summed per pair. Only one link per class and
   block that ties it to its component is written, never all pairs.
5. Components of these links, over all blocks, are the components of all links.

Every document then has its class, the number of its shingles and the least document id of its component.

Defined cases: null and blank texts have an empty set, are linked with nothing and are their own component; a null document id
takes no part in the minimum (a component of nulls only has the id null); rows that repeat are a class; empty tables
give none; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rowpact.llm.common import (BLANK, BROADCAST_ROWS, LOWER, Scratch, flat, fresh, mix, steps, window_hashes, word_hashes, words)
from rowpact.llm.components import components

SHINGLE = 3
THRESHOLD = 90
PARTS = 8
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Columns of an incidence matrix that is held at once.
COLUMNS = 4096
PASSES = 2
#: Bits of a sketch, and of those of sets from LARGE shingles; the wide ones fold to the others.
NARROW, WIDE = 256, 1024
LARGE = 448
MEETING = 8192
#: Up to so many members of a signature are compared each with each, all signatures of a batch at once.
FEW = 8
SPARE = 5
SPARE_SHARE = 0.15
SMALL = 64
GROUP = 5
MISS = 1e-13
#: Sizes of the levels from SMALL on grow by this; linked sets are of the same level or of neighbours.
LEVEL = 1.25


class Cuts:
    """Which signatures a set of a size gives."""

    def __init__(self, threshold: int):
        self.share = threshold / 100
        #: The most differing shingles for each shingle of the smaller set.
        self.differ = (1 - self.share) / self.share
        if not 0.8 <= self.share < 1:
            raise ValueError("levels are made for thresholds from 80 to 99")
        self._fragments_of: dict[int, int] = {}
        self.choices = {k: np.array(list(itertools.combinations(range(GROUP), GROUP - k))) for k in (1, 2)}

    def most(self, n: int) -> int:
        """Differing shingles at most, if n is the size of the smaller."""
        return math.floor(n * self.differ + 1e-9)

    def level(self, n: int) -> int:
        return math.floor(math.log(n / SMALL) / math.log(LEVEL) + 1e-9)

    def fragments(self, level: int) -> int:
        """With a fragment more than there are differing shingles, and spare ones for those that are empty, one is shared in any case. Large
        sets need fewer, as differing shingles fall on fragments at random: so many that all are hit with a chance below MISS."""
        if level not in self._fragments_of:
            differ = self.most(math.ceil(SMALL * LEVEL ** (level + 1)))
            same = math.floor(SMALL * LEVEL ** level * self.share)
            sure = differ + 1 + max(SPARE, math.ceil(SPARE_SHARE * (differ + 1)))

            def miss(n: int) -> float:
                beside = 1 - 1 / n
                return (1 - beside ** differ * (1 - beside ** same)) ** n

            self._fragments_of[level] = next((n for n in range(2, sure) if miss(n) < MISS), sure)
        return self._fragments_of[level]

    def signatures(self, found: np.ndarray) -> np.ndarray:
        n = len(found)
        partner = math.ceil(n * self.share - 1e-9)
        out = []
        if n >= SMALL:
            own, low = self.level(n), self.level(max(partner, SMALL))
            out += [self._fragments(found, level) for level in range(low, own + 1)]
        for d in range(max(1, self.most(min(partner, SMALL))), self.most(min(n, SMALL - 1)) + 1):
            out.append(self._choices(found, d))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _fragments(self, found: np.ndarray, level: int) -> np.ndarray:
        part = ((found >> np.uint64(32)) * np.uint64(self.fragments(level))) >> np.uint64(32)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
        total = np.add.reduceat(mix(found), cut)
        return mix(total + part[cut] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1000 + level))

    def _choices(self, found: np.ndarray, d: int) -> np.ndarray:
        groups = d // 3 + 1
        chosen = self.choices[min(2, d)]
        part = ((found >> np.uint64(32)) * np.uint64(groups * GROUP)) >> np.uint64(32)
        total = np.zeros(groups * GROUP, np.uint64)
        np.add.at(total, part.astype(np.int64), mix(found))
        kept = total.reshape(groups, GROUP)[:, chosen].sum(2, dtype=np.uint64)
        return mix(kept.ravel() + np.arange(kept.size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The hashes of each text's distinct shingles in order."""
    data = LOWER[data]
    start, end, first = words(data, at, ~BLANK)
    hashes = word_hashes(data, start, end)
    full = window_hashes(hashes, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            # Fewer words: the whole sequence is one, and is no shingle of a longer text.
            out.append(window_hashes(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _key(found: np.ndarray) -> bytes:
    one, two = mix(found ^ np.uint64(0x5851F42D4C957F2D)), mix(found + np.uint64(0x14057B7EF767814F))
    return np.array([np.add.reduce(one), np.add.reduce(two) + np.uint64(len(found))], np.uint64).tobytes()


def sketch(found: np.ndarray) -> bytes:
    bits = NARROW if len(found) < LARGE else WIDE
    times = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((times & 1).astype(np.uint8)).tobytes()


class Sketches:
    """Sizes and sketches of some classes."""

    def __init__(self, n: np.ndarray, values: list[bytes], threshold: int):
        self.n, self.threshold = n, threshold
        self.large = n >= LARGE
        self.at = np.cumsum(self.large) - 1
        self.wide = np.frombuffer(b"".join(v for v in values if len(v) > NARROW // 8), np.uint64).reshape(-1, WIDE // 64)
        self.narrow = np.empty((len(n), NARROW // 64), np.uint64)
        self.narrow[~self.large] = np.frombuffer(b"".join(v for v in values if len(v) == NARROW // 8), np.uint64).reshape(-1, NARROW // 64)
        self.narrow[self.large] = np.bitwise_xor.reduce(self.wide.reshape(-1, WIDE // NARROW, NARROW // 64), 1)

    def may_link(self, a, b: np.ndarray) -> np.ndarray:
        """For each place of b, and that of a beside it: false where sizes or sketches rule a link out."""
        n, m = self.n[a], self.n[b]
        # Of x and y shingles as many are in one set only.
        most = (n + m) * (100 - self.threshold) // (100 + self.threshold)
        ok = 100 * np.minimum(n, m) >= self.threshold * np.maximum(n, m)
        ok &= np.bitwise_count(self.narrow[a] ^ self.narrow[b]).sum(-1, dtype=np.int64) <= most
        again = np.flatnonzero(ok & self.large[a] & self.large[b])
        if len(again):
            x, y = a if np.ndim(a) == 0 else a[again], b[again]
            ok[again] = np.bitwise_count(self.wide[self.at[x]] ^ self.wide[self.at[y]]).sum(-1, dtype=np.int64) <= most[again]
        return ok


def meetings(group: np.ndarray, of: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that tie all classes of a group which may be linked; group: numbers that never fall."""
    cut = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    few = np.repeat(np.diff(cut) <= FEW, np.diff(cut))
    left, right = [], []
    for d in range(1, FEW):
        a = np.flatnonzero((group[d:] == group[:-d]) & few[d:])
        a = a[of.may_link(a, a + d)]
        left.append(a)
        right.append(a + d)
    for k in np.flatnonzero(np.diff(cut) > FEW):
        rest = np.arange(cut[k], cut[k + 1])
        while len(rest):
            head, rest = rest[0], rest[1:]
            reached = [head]
            while reached and len(rest):
                ok = of.may_link(reached.pop(), rest)
                new, rest = rest[ok], rest[~ok]
                left.append(np.full(len(new), head))
                right.append(new)
                reached += new.tolist()
    return np.concatenate(left), np.concatenate(right)


def _meet(threshold: int):
    """Rows (s, x, y, m, n, sketch) come sorted by the first three: a group is a signature, or a pair of its blocks."""
    def pairs(table: pa.Table) -> pa.RecordBatch:
        s, x, y, m, n = (table.column(c).to_numpy() for c in ("s", "x", "y", "m", "n"))
        group = np.cumsum(np.concatenate([[False], (s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        a, b = meetings(group, Sketches(n, table.column("sketch").to_pylist(), threshold))
        a, b = np.minimum(m[a], m[b]), np.maximum(m[a], m[b])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)] & (a != b)
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group of a batch may go on in the next one.
            last = np.ones(batch.num_rows, bool)
            for c in ("s", "x", "y"):
                value = batch.column(c).to_numpy()
                last &= value == value[-1]
            at = int(np.argmax(last))
            if held and (at or any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("s", "x", "y"))):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            elif at:
                yield pairs(pa.Table.from_batches([batch.slice(0, at)]))
            held.append(batch.slice(at))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


_SETS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("sketch", T.BinaryType()),
    *[T.StructField(f"signatures_{k}", T.ArrayType(T.LongType())) for k in range(PASSES)]])


def sets(docs: DataFrame, id_column: str, text: str, shingle: int, threshold: int) -> DataFrame:
    """doc_id, same (tells texts apart), n (shingles), cls (class), its sketch, signatures of its fragments in PASSES shares."""
    cuts = Cuts(threshold)
    source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text)).alias("same"), F.col(text).alias("text"))

    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text"):
                found = shingle_sets(*flat(batch.column("text")), shingle)
                signatures = [cuts.signatures(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("same"), pa.array([len(x) for x in found], pa.int64()),
                     pa.array([_key(x) for x in found], pa.binary()), pa.array([sketch(x) for x in found], pa.binary()),
                     *[_lists([x[x % np.uint64(PASSES) == k] for x in signatures]) for k in range(PASSES)]],
                    ["doc_id", "same", *_SETS.names])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:2], *_SETS.fields]))


def sets_of(docs: DataFrame, wanted: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    """cls, hashes for each class that is wanted (by cls and the doc_id of one of its documents).

    The wanted are counted, and sent to the documents if they are few; else the documents are joined by shuffle.
    """
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).join(
        wanted.select(F.col("doc_id").alias("w_id"), F.col("cls").alias("w_cls")), F.col("doc_id").eqNullSafe(F.col("w_id"))).select("w_cls", "text")

    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text"):
                pairs = zip(batch.column("w_cls").to_pylist(), shingle_sets(*flat(batch.column("text")), shingle), strict=True)
                own = [(cls, found) for cls, found in pairs if _key(found) == cls]  # not another text of the same id
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.binary()), _lists([x for _, x in own])], ["cls", "hashes"])

    return source.mapInArrow(run, "cls binary, hashes array<bigint>").dropDuplicates(["cls"])


def overlaps(sets_: list[np.ndarray]) -> np.ndarray:
    """For each pair of sets, the shingles that both have: counted part by part of the order, and summed."""
    total = np.zeros((len(sets_), len(sets_)), np.int64)
    every = np.concatenate(sets_)
    owner = np.repeat(np.arange(len(sets_)), [len(x) for x in sets_])
    part = (every >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)
    for p in range(PARTS):
        here = part == p
        values, place, times = np.unique(every[here], return_inverse=True, return_counts=True)
        column = (np.cumsum(times > 1) - 1)[place]
        both = (times > 1)[place]
        column, row = column[both], owner[here][both]
        for low in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
            some = (column >= low) & (column < low + COLUMNS)
            # Counts below 2 ** 24 are whole numbers in this type.
            matrix = np.zeros((len(sets_), min(COLUMNS, int(column.max()) + 1 - low)), np.float32)
            matrix[row[some], column[some] - low] = 1
            total += (matrix @ matrix.T).astype(np.int64)
    return total


def ties(sets_: list[np.ndarray], threshold: int) -> np.ndarray:
    """For each set the least place of a set of its component, by links between these sets."""
    n = np.array([len(x) for x in sets_])
    shared = overlaps(sets_)
    linked = 100 * shared >= threshold * (n[:, None] + n[None, :] - shared)
    root = np.arange(len(n))
    while True:
        least = np.where(linked, root[None, :], len(n)).min(1)
        least = np.minimum(root, least)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _compare(threshold: int):
    """Rows (root, x, y, cls, hashes) come sorted by the first three: a group is a block, or a pair of blocks, of a family."""
    def run(batches):
        at, keys, values = None, [], []

        def done():
            found = ties(values, threshold)
            own = np.flatnonzero(found != np.arange(len(found)))
            return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in found[own]], pa.binary()), pa.array([keys[k] for k in own], pa.binary())], ["a", "b"])

        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y")), strict=True))
            lists, cls = batch.column("hashes"), batch.column("cls").to_pylist()
            ends, flat_ = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for k, group in enumerate(groups):
                if group != at:
                    if len(keys) > 1:
                        yield done()
                    at, keys, values = group, [], []
                keys.append(cls[k])
                values.append(flat_[ends[k] : ends[k + 1]].copy())
        if len(keys) > 1:
            yield done()

    return run


def _met(found: DataFrame, classes: DataFrame, k: int, threshold: int, scratch: Scratch) -> DataFrame:
    """a, b: pairs of ids that tie the classes which share a signature of the k-th share and may be linked."""
    own = found.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.any_value(f"signatures_{k}").alias("signatures"))
    here = Window.partitionBy("s")
    shared = own.select(F.explode("signatures").alias("s"), F.coalesce("doc_id", F.xxhash64("cls")).alias("m")).select(
        "s", "m", F.min("m").over(here).alias("least"), F.max("m").over(here).alias("most"), F.count("*").over(here).alias("times"))
    shared = scratch.stage(shared.filter("least <> most").select("s", "m", F.ceil(F.col("times") / MEETING).cast("int").alias("blocks")), f"shared-{k}")
    scratch.tidy()
    place = F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int")
    rows = shared.join(classes.select("m", "n", "sketch"), "m").select(
        "s", "m", "n", "sketch", place.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("s", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "m", "n", "sketch")
    ordered = rows.repartition("s", "x", "y").sortWithinPartitions("s", "x", "y")
    met = scratch.stage(ordered.mapInArrow(_meet(threshold), "a bigint, b bigint").distinct(), f"met-{k}")
    scratch.tidy(f"shared-{k}")
    return met


def join(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
         threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, same, n_shingles, cls, component_id and first (whether the class has the component's least class): one row
    per document."""
    found = scratch.stage(sets(docs, id_column, text, shingle, threshold), "sets")
    # Two numbers a signature: an id that two classes share only brings both up as candidates.
    member = F.coalesce("doc_id", F.xxhash64("cls"))
    classes = found.filter("n > 0").groupBy("cls").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch"))
    classes = scratch.stage(classes.withColumn("m", member), "classes")
    met = [_met(found, classes, k, threshold, scratch) for k in range(PASSES)]
    found = scratch.stage(found.select("doc_id", "same", "n", "cls"), "texts")
    scratch.tidy("sets")
    families = scratch.stage(components(functools.reduce(DataFrame.unionAll, met), scratch, "families"), "family-of")
    members = scratch.stage(classes.join(families, classes["m"] == families["node"]).select("cls", "n", "doc_id", "root"), "members")
    hashes = scratch.stage(sets_of(docs, members, id_column, text, shingle), "hashes")
    scratch.tidy()
    blocks = members.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    pairs = members.join(blocks, "root").select("root", "cls", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "cls").join(hashes, "cls")
    ordered = pairs.select("root", "x", "y", "cls", "hashes").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "cls")
    links = scratch.stage(ordered.mapInArrow(_compare(threshold), "a binary, b binary"), "links")
    roots = scratch.stage(components(links, scratch), "all-roots")
    scratch.tidy("hashes")
    # Each class's component, then each document's.
    ids = classes.select("cls", "doc_id")
    of = ids.join(roots, ids["cls"] == roots["node"]).select("cls", "doc_id", "root")
    named = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("least"))
    grouped = scratch.stage(of.join(named, "root").select("cls", F.col("least.doc_id").alias("component"), F.col("least.cls").alias("head")), "grouped")
    alone = found.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies"))
    alone = scratch.stage(alone.filter("copies > 1").join(grouped, "cls", "full").select(
        "cls", F.when(F.col("head").isNotNull(), F.col("component")).otherwise(F.col("own")).alias("component"), F.coalesce("head", "cls").alias("head")), "named")
    # Spark splits the partition of a class of very many copies.
    out = found.join(alone, "cls", "left")
    grouped_ = F.col("head").isNotNull() & (F.col("n") > 0)
    return out.select(
        "doc_id", "same", F.col("n").alias("n_shingles"), "cls",
        F.when(grouped_, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        (~grouped_ | (F.col("head") == F.col("cls"))).alias("first"))


def keep_one(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group: of the group's least class that with the least id; of rows equal in id and text, one.

    Documents with an empty set all stay.
    """
    joined = join(docs, scratch, id_column, text, **options)
    stays = joined.filter("first").groupBy("doc_id", "same", "component_id").agg(F.min("n_shingles").alias("n"))
    stays = stays.filter((F.col("n") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id")))
    none, key, same, empty, number = fresh(docs, "none", "key", "same", "empty", "number")
    # Plain equal keys for the join and for the numbers of equal rows, so that documents are shuffled once.
    keys = lambda c: (c.isNull().alias(none), F.coalesce(c, F.lit(0)).alias(key))
    stays = scratch.stage(stays.select(*keys(F.col("doc_id")), F.col("same").alias(same), (F.col("n") == 0).alias(empty)), "stays")
    scratch.tidy()
    rows = docs.select("*", *keys(F.col(f"`{id_column}`")), F.xxhash64(F.col(f"`{text}`")).alias(same)).join(stays, [none, key, same])
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(none, key, same).orderBy(F.lit(0))))
    rows = rows.filter((F.col(number) == 1) | F.col(empty))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
