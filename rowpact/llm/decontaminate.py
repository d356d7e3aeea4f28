"""Benchmark decontamination: hash set of normalised benchmark n-grams, scanned over token windows, hits verified.

Words are the runs of digits, letters a-z and non-ASCII characters after A-Z were lower-cased. Each 13 consecutive
words of an item are a window; an item of fewer words, but not none, is one window of its own length. A document word
inside any occurrence of a window is hit.

The items go to the executors in blocks of at most BLOCK_BYTES of text (measured before anything is sent). Each block is
one pass over the documents; with one block, the usual case, nothing is written in between. Within a pass no row is
shuffled: a document's windows are hashed, looked up in the block's sorted hash set, and each find is compared word for
word before it counts.

Defined cases: a null text has no words and is never hit; an item without words, or null, has no window; a null item_id
counts as the id ''; rows that repeat are judged one by one; items that share an id count once; an empty table of items
hits nothing; extra columns of the documents stay, and result columns are named so that they don't clash.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from rowpact.llm.common import LOWER, Scratch, flat, fresh, steps, window_hashes, word_hashes, words

WINDOW = 13
BLOCK_BYTES = 8 << 20

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Windows:
    """The windows of a block of items, by length: hashes to search, and words to verify."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.owners: dict[bytes, set[str]] = defaultdict(set)
        found = defaultdict(set)
        for item, text in items:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            start, end, _ = words(data, np.array([0, len(data)]), WORD)
            if not len(start):
                continue
            length = min(window, len(start))
            hashes = window_hashes(word_hashes(data, start, end), length)
            listed = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
            for k, h in enumerate(hashes.tolist()):
                self.owners[b" ".join(listed[k : k + length])].add(item)
                found[length].add(h)
        self.hashes = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in found.items()}
        self.sieve = {}
        for n, x in self.hashes.items():
            self.sieve[n] = np.zeros(1 << 20, bool)
            self.sieve[n][x >> np.uint64(44)] = True

    def find(self, data: np.ndarray, at: np.ndarray):
        """Per text: number of words, hit runs of words, the same runs in bytes, items."""
        data = LOWER[data]
        start, end, first = words(data, at, WORD)
        counts, docs = np.diff(first), len(at) - 1
        hits: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
        items: list[set[str]] = [set() for _ in range(docs)]
        if self.hashes and len(start):
            hashes, doc = word_hashes(data, start, end), np.repeat(np.arange(docs), counts)
            for n, known in self.hashes.items():
                if n > len(hashes):
                    continue
                seen = window_hashes(hashes, n)
                maybe = np.flatnonzero(self.sieve[n][seen >> np.uint64(44)])
                maybe = maybe[(doc[maybe] == doc[maybe + n - 1]) & np.isin(seen[maybe], known)]
                for k in maybe.tolist():
                    text = b" ".join(data[a:b].tobytes() for a, b in zip(start[k : k + n], end[k : k + n], strict=True))
                    if text in self.owners:
                        hits[doc[k]].append((k, k + n))
                        items[doc[k]] |= self.owners[text]
        runs, spans = [], []
        for d in range(docs):
            joined: list[list[int]] = []
            for a, b in sorted(hits[d]):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            runs.append([(a - int(first[d]), b - int(first[d])) for a, b in joined])
            spans.append([(int(start[a] - at[d]), int(end[b - 1] - at[d])) for a, b in joined])
        return counts, runs, spans, items


def scan(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """The documents with one more column, and its name: a struct of n_words, runs (hit runs of words, from, to),
    spans (the same in bytes of the text) and items (ids found, in order)."""
    (found,) = fresh(docs, "found")
    schema = T.StructType([*docs.schema.fields, T.StructField(found, T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("runs", SPAN), T.StructField("spans", SPAN),
        T.StructField("items", T.ArrayType(T.StringType()))]))])
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col(item_text), F.lit("")).alias("words"))
    total = items.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 64)).first()[0] or 0
    blocks = 1 + total // block_bytes
    frame = docs.withColumn(found, F.lit(None).cast(schema[-1].dataType))
    for k in range(blocks):
        of = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in of.collect()])
        frame = frame.mapInArrow(_pass(sent, window, text, found), schema)
        if blocks > 1:
            frame = scratch.stage(frame, f"hits-{k}")
    return frame, found


def _pass(sent: Broadcast, window: int, text: str, found: str):
    def run(batches):
        known = Windows(sent.value, window)
        for whole in batches:
            for batch in steps(whole, text):
                yield _judged(batch, known, text, found)

    return run


def _judged(batch: pa.RecordBatch, known: Windows, text: str, found: str) -> pa.RecordBatch:
    counts, runs, spans, items = known.find(*flat(batch.column(text)))
    before = batch.column(found)
    if before.null_count < len(before):
        for k, old in enumerate(before.to_pylist()):
            if old:
                runs[k] = _union(runs[k], [(x["start"], x["end"]) for x in old["runs"]])
                spans[k] = _union(spans[k], [(x["start"], x["end"]) for x in old["spans"]])
                items[k] |= set(old["items"])
    span = lambda xs: pa.array([[{"start": a, "end": b} for a, b in x] for x in xs], _SPANS)
    column = pa.StructArray.from_arrays(
        [pa.array(counts.astype(np.int64)), span(runs), span(spans), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
        ["n_words", "runs", "spans", "items"])
    return pa.RecordBatch.from_arrays(
        [column if n == found else batch.column(n) for n in batch.schema.names], batch.schema.names)


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def n_hit(found: str):
    """Number of words hit."""
    return F.aggregate(F.col(f"{found}.runs"), F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])


def contaminated(found: str):
    """A word is hit, and at least one in twenty is."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(f"{found}.n_words"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents that aren't contaminated."""
    frame, found = scan(docs, benchmark, scratch, **options)
    return frame.filter(~contaminated(found)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_spans(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text: str = "text", **options) -> DataFrame:
    """All documents, without the hit runs of words (what stands between two words of a run goes with it)."""
    frame, found = scan(docs, benchmark, scratch, text=text, **options)

    def run(batches):
        for batch in batches:
            out = []
            for value, info in zip(batch.column(text).to_pylist(), batch.column(found).to_pylist(), strict=True):
                if info["spans"]:
                    data, at, left = value.encode(), 0, []
                    for x in info["spans"]:
                        left.append(data[at : x["start"]])
                        at = x["end"]
                    value = b"".join([*left, data[at:]]).decode()
                out.append(value)
            keep = [n for n in batch.schema.names if n != found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, batch.schema.field(text).type) if n == text else batch.column(n) for n in keep], keep)

    return frame.mapInArrow(run, docs.schema)
