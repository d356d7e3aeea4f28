"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts anywhere else are removed.

Sorting every suffix of a large corpus would rank strings of which nearly all are unique, so places that can't repeat are told
first, without loss, and the suffixes that are left are ranked by merged Burrows-Wheeler transforms.

1. Anchors. A string of LENGTH bytes has as its anchor the place in it of the GRAM-byte gram with the least hash (the leftmost of
   equals). Equal strings have their anchors at the same place, so strings are classed by the anchor's gram; neighbouring starts
   with one anchor are a block. A row for each block goes on: gram, content hash, place (about one per 80 bytes).
2. A gram that comes once has no repeat. Where all blocks of a gram are equal, all their strings are repeats; of other grams, blocks
   that come twice or more are. What is left are blocks that come once beside others of their gram: the ends of repeats.
3. These are cut by the distance of start and anchor into groups of STARTS starts. The strings of a group share a core, and equal
   strings have equal cores, so the core is what they are dealt by. Groups of equal content are counted first, and one of each goes on.
   A passage that many documents have with different text round it has at each end one core with as many groups: those of a core
   with more than BATCH groups are dealt string by string instead, by 128 bits of the string's bytes, and counted, summed before
   they are shuffled, so that no task receives such a core.
4. In a task, strings are packed into shards of SHARD strings. Each shard gets the Burrows-Wheeler transform of the suffixes at
   its starts, SYMBOL bytes a symbol: for each depth, the symbols before its suffixes in their order. Shards are merged by
   refining the interleave: which shard each place of the merged order comes from, refined by a stable distribution
   of the merged transform's symbols, depth by depth; suffixes are not sorted again. Two neighbours of the last order with no boundary
   between them have a common prefix of LENGTH bytes or more: a repeated interval.

Every table is keyed by (document id, hash of the text); rows that are equal in both count as places each. Joins are by shuffle
at every size, and partitions of skewed keys are split by Spark.

Defined cases: null texts are empty, and keep nothing; texts shorter than LENGTH have no string; texts of any length pass in
segments of SEGMENT bytes that end between blocks; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowpact.llm.common import Scratch, flat, mix, steps

LENGTH = 200
GRAM = 32
STARTS = 16
SYMBOL = 8
SHARD = 512
BATCH = 4096
SEGMENT = 4 << 20

_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        seed = np.full(max(n, 1 << 20), base, np.uint64)
        seed[0] = 1
        _powers[base] = np.multiply.accumulate(seed)
    return _powers[base][:n]


def blocks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts end to end (text k is data[at[k]:at[k + 1]]): gram, content hash, anchor, first and last start of each block."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none, none
    up, down = _power(_BASE, n + 1), _power(_UNBASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    # The least of each window of grams, by prefix and suffix minima of pieces of a window's length; low bits say where.
    width = LENGTH - GRAM + 1
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(packed) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(packed)] = packed
    pieces = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(pieces, 1).ravel()
    behind = np.minimum.accumulate(pieces[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - LENGTH + 1
    anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(at, np.arange(starts), "right") - 1 if len(at) > 2 else np.zeros(starts, np.int64)
    inside = np.arange(starts) + LENGTH <= at[text + 1]
    cut = np.ones(starts, bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    low = np.flatnonzero(cut & inside)
    ends = np.flatnonzero(np.concatenate([cut[1:] | ~inside[1:], [True]]) & inside)
    a = anchor[low]
    content = mix((total[ends + LENGTH] - total[low]) * down[low] + mix((a - low).astype(np.uint64) * np.uint64(1024) + (ends - low).astype(np.uint64)))
    return grams[a].view(np.int64), content.view(np.int64), a, low, ends


def _blocks_of_batch(batch: pa.RecordBatch):
    for part in steps(batch, "text", SEGMENT // 4):
        data, at = flat(part.column("text"))
        if part.num_rows > 1 or len(data) <= SEGMENT:
            yield part, blocks(data, at)
            continue
        begin = 0
        while True:
            stop = min(begin + SEGMENT, len(data))
            found = blocks(data[begin:stop], np.array([0, stop - begin]))
            if stop < len(data):
                # The last block may go on: it is the first of the next segment.
                next_ = begin + int(found[3][-1])
                found = tuple(x[:-1] for x in found)
            yield part, (*found[:2], *(x + begin for x in found[2:]))
            if stop == len(data):
                break
            begin = next_


def _rows(batches):
    # place: the anchor, then how far the first start lies before it and how many starts follow that, both below 2 ** 8.
    for whole in batches:
        for part, (gram, content, anchor, low, high) in _blocks_of_batch(whole):
            text = np.searchsorted(at := flat(part.column("text"))[1], low, "right") - 1
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("same").take(take), pa.array(gram), pa.array(content),
                 pa.array(((anchor - at[text]) << 16) + ((anchor - low) << 8) + high - low)],
                ["doc_id", "same", "gram", "content", "place"])


def _anchor(place: str = "place"):
    return F.call_function("shiftright", F.col(place), F.lit(16))


def _low(place: str = "place"):
    return _anchor(place) - F.call_function("shiftright", F.col(place), F.lit(8)).bitwiseAND(F.lit(255))


def _high(place: str = "place"):
    return _low(place) + F.col(place).bitwiseAND(F.lit(255))


_FRAME = STARTS - 1 + LENGTH


def _groups(batches):
    """Of blocks with their texts: a row for each group of STARTS starts by their distance to the anchor."""
    import xxhash

    names = ["core", "whole", "first", "last", "place", "n", "doc_id", "same"]
    for batch in batches:
        out: list[tuple] = []
        for doc, same, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "same", "text", "spans")), strict=True):
            data = (text or "").encode()
            for x in spans:
                low, high, anchor = x["low"], x["high"], x["anchor"]
                for c in range((anchor - high) // STARTS, (anchor - low) // STARTS + 1):
                    begin = anchor - STARTS * c - STARTS + 1  # the start that is furthest from the anchor
                    first, last = max(low, begin) - begin, min(high, anchor - STARTS * c) - begin
                    frame = _frame(data, begin)
                    core = xxhash.xxh3_64_intdigest(data[begin + STARTS - 1 : begin + LENGTH], seed=c) ^ (x["gram"] & (1 << 64) - 1)
                    key = xxhash.xxh3_64_intdigest(frame, seed=first * STARTS + last)
                    out.append((_signed(core), _signed(key), first, last, begin, x["n"], doc, same))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _frame(data: bytes, begin: int) -> bytes:
    """The bytes of a group's strings; zeros stand for what lies outside the text, where no string of the group reaches."""
    return data[max(0, begin) : begin + _FRAME].rjust(_FRAME - max(0, begin + _FRAME - len(data)), b"\0").ljust(_FRAME, b"\0")


def _frames(batches):
    """Of groups with their texts: core, frame, first, last, place, n, doc_id, same."""
    names = ["core", "frame", "first", "last", "place", "n", "doc_id", "same"]
    for batch in batches:
        out: list[tuple] = []
        for doc, same, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "same", "text", "spans")), strict=True):
            data = (text or "").encode()
            out += [(x["core"], _frame(data, x["place"]), x["first"], x["last"], x["place"], x["n"], doc, same) for x in spans]
        if out:
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _strings(batches):
    """Of groups with their texts: string (128 bits of its LENGTH bytes), n, start, doc_id, same; a row for each string."""
    import xxhash

    names = ["string", "n", "start", "doc_id", "same"]
    for batch in batches:
        for doc, same, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "same", "text", "spans")), strict=True):
            data = (text or "").encode()
            for some in range(0, len(spans), SHARD):
                out = [(xxhash.xxh3_128_digest(data[k : k + LENGTH]), x["n"], k, doc, same)
                       for x in spans[some : some + SHARD] for k in range(x["place"] + x["first"], x["place"] + x["last"] + 1)]
                kinds = (pa.binary(), pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Transform:
    """The Burrows-Wheeler transform of a shard: for each depth, the symbols that stand before its suffixes, in the order of
    the suffixes by what follows; order is that of the starts by LENGTH bytes."""

    def __init__(self, frames: np.ndarray):
        self.order = np.arange(len(frames) * STARTS)
        self.before: list[np.ndarray] = []
        for depth in range(LENGTH // SYMBOL):
            low = LENGTH - SYMBOL * (depth + 1)
            piece = np.ascontiguousarray(frames[:, low : low + STARTS - 1 + SYMBOL])
            symbols = np.lib.stride_tricks.sliding_window_view(piece, SYMBOL, 1)
            symbols = np.ascontiguousarray(symbols).view(">u8").reshape(-1).astype(np.uint64)[self.order]
            self.before.append(symbols)
            self.order = self.order[np.argsort(symbols, kind="stable")]


def merged(shards: list[Transform]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of all shards' suffixes (which shard each is of), and for each place the number of its interval: places of
    one interval have LENGTH bytes in common."""
    source = np.repeat(np.arange(len(shards)), [len(x.order) for x in shards])
    interval = np.zeros(len(source), np.int64)
    for depth in range(LENGTH // SYMBOL):
        symbols = np.empty(len(source), np.uint64)
        for k, shard in enumerate(shards):
            symbols[source == k] = shard.before[depth]
        order = np.argsort(symbols, kind="stable")
        source, symbols, interval = source[order], symbols[order], interval[order]
        new = (symbols[1:] != symbols[:-1]) | (interval[1:] != interval[:-1])
        interval = np.concatenate([[0], np.cumsum(new)])
    return source, interval


def repeated(frames: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each frame and each of its starts from first to last, whether LENGTH bytes from there are in another frame too."""
    n = len(frames)
    cuts = range(0, n, SHARD)
    shards = [Transform(frames[a : a + SHARD]) for a in cuts]
    source, interval = merged(shards)
    suffix = np.empty(len(source), np.int64)
    for k, shard in enumerate(shards):
        suffix[source == k] = shard.order + cuts[k] * STARTS
    start = suffix % STARTS
    valid = (start >= first[suffix // STARTS]) & (start <= last[suffix // STARTS])
    often = np.bincount(interval[valid], minlength=int(interval[-1]) + 1 if len(interval) else 0) > 1
    out = np.zeros(n * STARTS, bool)
    out[suffix] = valid & often[interval]
    return out.reshape(n, STARTS)


def _merge(batches):
    """Rows come sorted by core: whole cores are merged together, BATCH frames or more at a time."""
    held: list[pa.RecordBatch] = []
    count = 0

    def flush(rows: pa.Table):
        rows = rows.combine_chunks().to_batches()
        for batch in rows[:1]:
            frames = flat(batch.column("frame"))[0].reshape(-1, _FRAME)
            found = repeated(frames, batch.column("first").to_numpy(), batch.column("last").to_numpy())
            found &= (batch.column("n").to_numpy() == 1)[:, None]
            row, start = np.nonzero(found)
            place = batch.column("place").to_numpy()[row] + start
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("same").take(take), pa.array(place), pa.array(place + LENGTH)],
                                             ["doc_id", "same", "start", "end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= BATCH:
            table = pa.Table.from_batches(held)
            cores = table.column("core").to_numpy()
            whole = int(np.searchsorted(cores, cores[-1]))
            if whole:
                yield from flush(table.slice(0, whole))
                held, count = table.slice(whole).combine_chunks().to_batches(), count - whole
    if held:
        yield from flush(pa.Table.from_batches(held))


def ranges(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, same, spans (start and end in bytes of what repeats; they may overlap): a row per document with any."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text)).alias("same"), F.col(text).alias("text"))
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:2])
    found = scratch.stage(source.mapInArrow(_rows, f"{key}, gram long, content long, place long"), "blocks")
    shared = found.groupBy("gram").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("mixed")).filter("n > 1").drop("n")
    shared = scratch.stage(shared, "shared")
    scratch.tidy()
    met = scratch.stage(found.join(shared, "gram").withColumns({"anchor": _anchor(), "low": _low(), "high": _high()}).drop("place"), "met")
    scratch.tidy("blocks")
    full = met.filter(~F.col("mixed"))
    # Of mixed grams: blocks that come twice or more, and one place of each.
    mixed = met.filter("mixed")
    variants = scratch.stage(mixed.groupBy("gram", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "same", "anchor", "low", "high")).alias("x")).select("gram", "content", "n", "x.*"), "variants")
    often = variants.filter("n > 1").select("gram", "content")
    again = mixed.join(often, ["gram", "content"])
    span = lambda frame: frame.select("doc_id", "same", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end"))
    by_doc = variants.groupBy("doc_id", "same").agg(F.collect_list(F.struct("gram", "n", "anchor", "low", "high")).alias("spans"))
    by_doc = scratch.stage(by_doc.withColumnsRenamed({"doc_id": "v_id", "same": "v_same"}), "by-doc")
    scratch.tidy()
    texts = source.join(by_doc, F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("same") == F.col("v_same")))
    groups = scratch.stage(texts.select("doc_id", "same", "text", "spans").mapInArrow(
        _groups, f"core long, whole long, first int, last int, place long, n long, {key}"), "groups")
    # Equal groups are counted; those met once go on, with one of each other beside them, where a core has several.
    scratch.tidy("by-doc")
    totals = scratch.stage(groups.groupBy("core", "whole").agg(F.sum("n").alias("total")), "totals")
    twice = totals.filter("total > 1").select("core", "whole")
    equal = groups.filter("n = 1").join(twice, ["core", "whole"]).select(
        "doc_id", "same", (F.col("place") + F.col("first")).alias("start"), (F.col("place") + F.col("last") + LENGTH).alias("end"))
    open_ = totals.groupBy("core").agg(F.count("*").alias("k"), F.min("total").alias("least")).filter("k > 1 AND least = 1").select(
        "core", (F.col("k") > BATCH).alias("hot"))
    one = groups.join(open_, "core").join(totals, ["core", "whole"]).withColumn("n", F.col("total")).drop("total").dropDuplicates(["core", "whole"])
    # Only these need their bytes.
    one = one.groupBy("doc_id", "same").agg(F.collect_list(F.struct("core", "first", "last", "place", "n", "hot")).alias("spans"))
    one = scratch.stage(one.withColumnsRenamed({"doc_id": "v_id", "same": "v_same"}), "ends-by-doc")
    scratch.tidy()

    def texts_of(hot: bool) -> DataFrame:
        own = one.withColumn("spans", F.filter("spans", lambda x: x["hot"] == hot)).filter(F.size("spans") > 0)
        texts = source.join(own, F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("same") == F.col("v_same")))
        return texts.select("doc_id", "same", "text", "spans")

    # Rows of a string that very many groups have are joined last, so that Spark can split them.
    strings = scratch.stage(texts_of(True).mapInArrow(_strings, f"string binary, n long, start long, {key}"), "strings")
    often = strings.groupBy("string").agg(F.count("*").alias("k")).filter("k > 1").select("string")
    dealt = scratch.stage(strings.filter("n = 1").join(often, "string").select("doc_id", "same", "start", (F.col("start") + LENGTH).alias("end")), "dealt")
    scratch.tidy("strings")
    frames = texts_of(False).mapInArrow(
        _frames, f"core long, frame binary, first int, last int, place long, n long, {key}")
    ends = scratch.stage(frames.repartition("core").sortWithinPartitions("core").mapInArrow(_merge, f"{key}, start long, end long"), "ends")
    scratch.tidy("ends-by-doc")
    every = span(full).unionByName(span(again)).unionByName(equal).unionByName(dealt).unionByName(ends)
    spans = scratch.stage(every.groupBy("doc_id", "same").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    scratch.tidy("shared", "met", "variants", "groups", "totals")
    return spans


def cut(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes): a row per document."""
    spans = ranges(docs, scratch, id_column, text).withColumnsRenamed({"doc_id": "s_id", "same": "s_same"})
    source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text)).alias("same"), F.col(text).alias("text"))
    joined = source.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("same") == F.col("s_same")), "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            out = []
            for value, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, at, kept, removed, n = (value or "").encode(), 0, [], 0, 0
                end = -1
                for x in sorted((x["start"], x["end"]) for x in found or ()):
                    if x[0] > end:
                        kept.append(data[at : x[0]])
                        n, removed = n + 1, removed + x[1] - x[0]
                    elif x[1] > end:
                        removed += x[1] - end
                    end = at = max(end, x[1])
                kept.append(data[at:])
                out.append((len(data), removed, n, b"".join(kept)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
