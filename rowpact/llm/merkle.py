"""Merkle manifest of a dataset, and proofs of all rows by octopus multiproofs.

A row's leaf is the SHA-256 of its fields, each `-` if null, else byte count, `:` and value. The leaves of a group, in order of their key,
form a tree: while more than one node remains, every FAN consecutive ones become the hash of their digests (lower-case hex, concatenated; the
last run may be shorter). What remains is the group's subroot, and the subroots in order of their group give the root in the same way. A
leaf's proof is the other nodes of its run, level by level up to the root.

1. Leaves are hashed by Spark's own functions and written; texts are not moved. They are sorted by range on (group, key, leaf), so a group of a
   third of all rows spreads over as many partitions as it needs; one row per partition gives each leaf its place in its group.
2. Leaves are dealt to leaf partitions: FAN ** LEVELS consecutive leaves of a large group, or the whole of small groups that begin within as
   many ranks of each other. So a partition holds whole subtrees and at most 2 * FAN ** LEVELS leaves. It hashes these, and only their tops are
   written; the levels above, FAN ** LEVELS times fewer rows, are grouped by Spark.
3. Octopus multiproof: from the tops that a leaf partition knows, the least set of node coordinates is told that it lacks to reach the root: at each
   level the runs' other nodes that it can't derive. These coordinates are joined to the nodes once per partition, not once per leaf; the partition
   derives shared interior nodes from them once and expands the proofs of its own leaves.

Leaves may be claimed to differ (`claim`): proofs are of the true leaves, and what a claimed leaf folds up to is compared with the root.

Defined cases: null groups are one group and come first; null keys come first in their group; rows equal in key are ordered by their leaf, and equal
leaves are interchangeable; a group of one row has that leaf as its subroot, a single subroot is the root; an empty text is `0:`; an
empty table gives no rows and no root; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowpact.llm.common import Scratch, lookup

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
LEVELS = 3
#: The tree over the groups' subroots.
TOP = -1


def leaf(*fields: Column) -> Column:
    """Digest (32 bytes) of the fields in order."""
    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, fields)), 256))


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


# Places of the leaves


def _numbered(batches):
    """Adds the partition, the place in it, the number of the group in it, and the place in the group in it. Rows come sorted by group."""
    part, at, group, since, last = TaskContext.get().partitionId(), 0, -1, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = batch.column("g")
        before = pa.concat_arrays([last if last is not None else names.slice(0, 1), names.slice(0, n - 1)])
        same = pc.or_(pc.fill_null(pc.equal(names, before), False), pc.and_(pc.is_null(names), pc.is_null(before))).to_numpy(zero_copy_only=False)
        new = ~same
        new[0] |= last is None
        place = np.arange(at, at + n)
        begin = np.maximum.accumulate(np.where(new, place, since))
        number = group + np.cumsum(new)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(place), pa.array(number), pa.array(place - begin)],
            [*batch.schema.names, "part", "at", "g_at", "k_at"])
        at, group, since, last = at + n, int(number[-1]), int(begin[-1]), names.slice(n - 1, 1)


def _offsets(sorted_: DataFrame) -> DataFrame:
    """part, base (rank of its first leaf), g_base (number of its first group), k_base (leaves of that group in earlier parts)."""
    per = sorted_.groupBy("part").agg(
        F.count("*").alias("n"), F.min(F.struct("at", "g"))["g"].alias("first"), F.max(F.struct("at", "g", "g_at", "k_at")).alias("last"))
    rows, base, groups, held, before = [], 0, 0, 0, None
    for part, n, first, last in per.orderBy("part").collect():  # one row for each partition
        goes_on = before is not None and before[0] == first
        start, k_base = (groups - 1, held) if goes_on else (groups, 0)
        rows.append((part, base, start, k_base))
        base, groups, before = base + n, start + last["g_at"] + 1, (last["g"],)
        held = last["k_at"] + 1 + (k_base if last["g_at"] == 0 else 0)
    return sorted_.sparkSession.createDataFrame(rows, "part long, base long, g_base long, k_base long")


def places(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """g_no (number of the group), pos (place in it), rank (in all), k, leaf, claim from rows of g, k, leaf, claim, tie."""
    schema = T.StructType([*leaves.schema.fields, *[T.StructField(x, T.LongType()) for x in ("part", "at", "g_at", "k_at")]])
    order = ["g", "k", "leaf", "tie"]
    sorted_ = scratch.stage(leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, schema), "sorted")
    # One row for each partition of the sort.
    offsets = F.broadcast(_offsets(sorted_))
    pos = F.col("k_at") + F.when(F.col("g_at") == 0, F.col("k_base")).otherwise(0)
    return sorted_.join(offsets, "part").select(
        (F.col("g_base") + F.col("g_at")).alias("g_no"), pos.alias("pos"), (F.col("base") + F.col("at")).alias("rank"), "k", "leaf", "claim")


# Trees


def climb(known: dict[int, bytes], n: int, fetch: Callable[[int, int], bytes], fan: int = FAN) -> tuple[list[dict[int, tuple[bytes, bytes]]], bytes]:
    """For each level of a tree of n nodes, what stands before and after each known node in its run; and the digest of the top.

    Interior nodes above known ones are derived once; fetch(level, place) gives the others.
    """
    steps = []
    while n > 1:
        around, up = {}, {}
        for g in sorted({i // fan for i in known}):
            at = range(fan * g, min(fan * (g + 1), n))
            run = [known[i] if i in known else fetch(len(steps), i) for i in at]
            for j, i in enumerate(at):
                if i in known:
                    around[i] = b"".join(run[:j]), b"".join(run[j + 1 :])
            up[g] = _digest(b"".join(run))
        steps.append(around)
        known, n = up, -(-n // fan)
    return steps, known[0]


def missing(known: set[int], n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The least set of (level, place) that must be known beside these nodes of a tree of n to derive its top."""
    out, level = [], 0
    while n > 1:
        up = {i // fan for i in known}
        out += [(level, i) for g in sorted(up) for i in range(fan * g, min(fan * (g + 1), n)) if i not in known]
        known, n, level = up, -(-n // fan), level + 1
    return out


def fold(digest: bytes, paths: list[list[tuple[bytes, bytes]]]) -> bytes:
    for path in paths:
        for before, after in path:
            digest = _digest(before + digest + after)
    return digest


def _leaves(table: pa.Table) -> dict[int, tuple[int, dict[int, int]]]:
    """group -> (its size, place -> row) of a leaf partition."""
    out: dict = {}
    for row, (g, pos, n) in enumerate(zip(*(table.column(x).to_pylist() for x in ("g_no", "pos", "n")), strict=True)):
        out.setdefault(g, (n, {}))[1][pos] = row
    return out


def _tops(groups: int, fan: int, levels: int):
    """Of a leaf partition: the node above each block of a large group, the subroot of each small group."""
    def run(table: pa.Table) -> pa.Table:
        rows = []
        own = [x.hex().encode() for x in table.column("leaf").to_pylist()]
        b1, b2 = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
        for g, (n, at) in sorted(_leaves(table).items()):
            known = {pos: own[row] for pos, row in at.items()}
            if b1 == TOP:
                rows.append((b1, b2, g, groups, climb(known, n, None, fan)[1].decode()))
                continue
            for _ in range(levels):
                known = {x: _digest(b"".join(known[i] for i in range(fan * x, fan * (x + 1)) if i in known)) for x in {i // fan for i in known}}
            rows.append((b1, b2, b2, -(-n // fan ** levels), known[b2].decode()))
        return pa.table([pa.array(x) for x in zip(*rows, strict=True)], ["tree", "b2", "idx", "n", "hex"])

    return run


def _levels(nodes: DataFrame, most: int, first: int, scratch: Scratch, fan: int) -> list[DataFrame]:
    """tree, level, idx, n, hex of all levels from the given one, the largest tree of which has most nodes; each level is a written table."""
    out = [nodes.select("tree", F.lit(first).alias("level"), "idx", "n", "hex")]
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("idx", "hex")))["hex"]
        up = out[-1].filter("n > 1").groupBy("tree", F.floor(F.col("idx") / fan).alias("idx"), F.ceil(F.col("n") / fan).alias("n")).agg(run.alias("run"))
        first, most = first + 1, -(-most // fan)
        up = up.select("tree", F.lit(first).alias("level"), "idx", "n", F.sha2(F.array_join("run", ""), 256).alias("hex"))
        out.append(scratch.stage(up, f"level{first}"))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


class Manifest:
    """The trees of a dataset, written: the root's digest, the nodes above the leaf partitions, and the leaves with their places."""

    def __init__(self, docs: DataFrame, scratch: Scratch, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id",
                 claim: Column | None = None, fan: int = FAN, levels: int = LEVELS):
        """claim: digest that a row is claimed to have, null where that is its own."""
        self.scratch, self.fan, self.levels, block = scratch, fan, levels, fan ** levels
        own = [F.col(f"`{x}`") for x in fields]
        claimed = F.lit(None).cast("binary") if claim is None else claim
        leaves = docs.select(F.col(f"`{group}`").alias("g"), F.col(f"`{key}`").alias("k"), leaf(*own).alias("leaf"), claimed.alias("claim"),
                             F.monotonically_increasing_id().alias("tie"))
        placed = places(scratch.stage(leaves, "leaves"), scratch)
        sizes = scratch.stage(placed.groupBy("g_no").agg((F.max("pos") + 1).alias("n"), F.min("rank").alias("first")), "sizes")
        self.groups, most = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
        large = F.col("n") > block
        self.leaves = lookup(placed, sizes, ["g_no"]).select(
            F.when(large, F.col("g_no")).otherwise(TOP).alias("b1"), F.floor(F.when(large, F.col("pos")).otherwise(F.col("first")) / block).alias("b2"),
            "g_no", "pos", "n", "k", "leaf", "claim")
        tops = self.leaves.groupBy("b1", "b2").applyInArrow(_tops(self.groups, fan, levels), "tree long, b2 long, idx long, n long, hex string")
        self.tops = scratch.stage(tops, "tops")
        upper = _levels(self.tops.filter(F.col("tree") != TOP), -(-most // block), levels, scratch, fan)
        subroots = [x.filter("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(self.groups).cast("long").alias("n"), "hex") for x in upper]
        subroots.append(self.tops.filter(F.col("tree") == TOP).select("tree", "idx", "n", "hex"))
        top = _levels(scratch.stage(_union(subroots), "subroots"), self.groups, 0, scratch, fan)
        self.nodes = scratch.stage(_union([*upper, *top]).select("tree", "level", "idx", "hex"), "nodes")
        found = top[-1].filter("n = 1").first()
        self.root: str | None = found["hex"] if found else None

    def lacking(self) -> DataFrame:
        """b1, b2, tree, level, idx: the coordinates that each leaf partition can't derive."""
        groups, fan, levels = self.groups, self.fan, self.levels

        def run(batches):
            for batch in batches:
                out = []
                for b1, b2, n, idx in zip(*(batch.column(x).to_pylist() for x in ("b1", "b2", "n", "idx")), strict=True):
                    if b1 != TOP:
                        out += [(b1, b2, b1, levels + level, i) for level, i in missing({b2}, n, fan)]
                    out += [(b1, b2, TOP, level, i) for level, i in missing(set(idx) if b1 == TOP else {b1}, groups, fan)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int32() if k == 3 else pa.int64()) for k in range(5)], ["b1", "b2", "tree", "level", "idx"])

        known = self.tops.groupBy(F.col("tree").alias("b1"), "b2").agg(F.max("n").alias("n"), F.collect_list("idx").alias("idx"))
        return known.mapInArrow(run, "b1 long, b2 long, tree long, level int, idx long")

    def proofs(self) -> DataFrame:
        """k, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each leaf; digests in hex."""
        root, groups, fan = self.root, self.groups, self.fan
        names = ["k", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        fetched = lookup(self.lacking(), self.nodes, ["tree", "level", "idx"])

        def expand(leaves: pa.Table, others: pa.Table) -> pa.Table:
            got = {(t, level, i): x.encode() for t, level, i, x in zip(*(others.column(c).to_pylist() for c in ("tree", "level", "idx", "hex")), strict=True)}
            own = [x.hex().encode() for x in leaves.column("leaf").to_pylist()]
            claims = [x if x is None else x.hex().encode() for x in leaves.column("claim").to_pylist()]
            trees = {g: (at, *climb({pos: own[row] for pos, row in at.items()}, n, lambda level, i, g=g: got[g, level, i], fan)) for g, (n, at) in _leaves(leaves).items()}
            above, top = climb({g: x[2] for g, x in trees.items()}, groups, lambda level, i: got[TOP, level, i], fan)
            if top.decode() != root:
                raise ValueError("the nodes do not give the manifest's root")

            def path(steps: list, i: int) -> list[tuple[bytes, bytes]]:
                out = []
                for around in steps:
                    out.append(around[i])
                    i //= fan
                return out

            result: list = [None] * leaves.num_rows
            for g, (at, steps, subroot) in trees.items():
                upper = path(above, g)
                rest = b"".join(a + b for a, b in upper)
                for pos, row in at.items():
                    lower = path(steps, pos)
                    proof = hashlib.sha256(b"".join(a + b for a, b in lower))
                    proof.update(rest)
                    folded = fold(claims[row] or own[row], [lower, upper]).decode()
                    result[row] = own[row].decode(), subroot.decode(), root, proof.hexdigest(), folded, folded == root
            columns = zip(*result, strict=True) if result else [[]] * 6
            return pa.table([leaves.column("k"), *[pa.array(x, pa.bool_() if name == "verified" else pa.string()) for name, x in zip(names[1:], columns, strict=True)]], names)

        schema = self.leaves.select("k", *[F.lit("").cast("string").alias(x) for x in names[1:-1]], F.lit(True).alias("verified")).schema
        for field in schema.fields:
            field.nullable = True
        return self.leaves.groupBy("b1", "b2").cogroup(fetched.groupBy("b1", "b2")).applyInArrow(expand, schema)
