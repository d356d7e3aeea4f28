"""Token-ID output with Re-Pair grammar compression.

Documents are dealt by range of their id and sorted within it; each task encodes its texts, appends END to each and packs the ids
into shards of about SHARD_IDS. A shard is compressed on its own: pairs of neighbours within documents become new symbols, the most
frequent first, until no pair has MIN_COUNT occurrences that don't overlap. A file holds the ids that occur in it (symbols number these, then the
rules), the rules, the length that each symbol expands to, and where each document's symbols begin, so any document is decoded
from its own byte range.

Pairs are replaced in rounds. A round takes all pairs with at least a floor of occurrences; the floor falls by STEP from round
to round, to MIN_COUNT. Where two such pairs overlap the more frequent one wins, so the most frequent pair of a round is replaced
wherever it stands, and rounds go on as long as there is one. Once the floor is MIN_COUNT, counts of pairs without a new symbol
can only fall, so only places beside new symbols, and those of pairs that were often enough before, are counted again.

A task attempt writes files under names of its own and returns a row for each; that table of files is written by Spark, which keeps
one attempt per task, and readers open only files in it. Files of lost attempts are never read.

Encoding: the tokenizer splits at white space and drops it, so what stands between two ASCII white spaces is encoded alone. Texts are
taken a few megabytes at a time; Arrow finds the different strings in them, numpy cuts these into words where the tokenizer's file says
that it does the same, and the tokenizer is asked for words whose ids a worker doesn't know yet (it keeps up to CACHE). Ids of texts are
gathered from those of words. For a tokenizer that doesn't split at white space, pass whole=True.

Defined cases: a null text is empty and has END only; null ids come first; rows that are equal in id are ordered by text, null
first; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import io
import itertools
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rowpact.llm.common import Scratch, filesystem, flat, read_range, steps

TOKENIZER = "word_bpe_49k.json"
END = 2
SHARD_IDS = 1 << 20
STEP = 4
MIN_COUNT = 8
BIN_BITS = 18
CACHE = 700_000
#: Bytes of texts that are encoded at once (a longer text alone), and strings of them whose ids are gathered at once.
TEXT_BYTES = 4 << 20
STRINGS = 1 << 20
MAGIC = b"RPIDS002"
#: magic, different ids, rules, documents, ids, bytes of a symbol
_HEAD = struct.Struct("<8sQQQQQ")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _trimmed(known: dict, most: int) -> dict:
    """What came first comes often; of the rest the most is rare."""
    return known if len(known) < most else dict(itertools.islice(known.items(), most // 2))


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, length numbers long, end to end."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    #: What the tokenizer matches as a word once it has lower-cased.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Of bytes of plain strings, which are in UTF-8 !-~ without the apostrophe, \u00C0-\u00D6, \u00D8-\u00F6 and \u00F8-\u00FF:
    #: 1 in letters, 2 digits, 3 others; 0 no byte of such. And what they are in lower case.
    _KIND, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    _KIND[0x21:0x7F] = 3
    _KIND[0x30:0x3A] = 2
    _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:0xC0] = _KIND[0xC3] = 1
    _KIND[[0x27, 0x97, 0xB7]] = 0
    _LOWER[0x41:0x5B] += 32
    _LOWER[0x80:0x9F] += 32

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        #: Ids of words, and of strings between white spaces that aren't cut into words.
        self.known: dict[str, bytes] = {}
        self.last = self._ends()

    def _ends(self) -> np.ndarray | None:
        """Which ids end a word, if the tokenizer lower-cases, cuts by WORDS and marks word ends."""
        about = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (about["normalizer"] or {}).get("normalizers", [])]
        cut = ((about["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        end = about["model"].get("end_of_word_suffix")
        if steps != ["NFC", "Replace", "Lowercase"] or cut.get("type") != "Split" or not cut.get("invert") or not end:
            return None
        if cut["pattern"] != {"Regex": self.WORDS} or any(not x["content"].startswith("<|") for x in about["added_tokens"]):
            return None
        last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        last[[k for x, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if x.endswith(end)]] = True
        return last

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        """Of words, each as the pattern cuts it: encoded as one text and told apart by the ids that end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(texts) or len(ids) != (ends[-1] if len(ends) else 0):
            return self._encode(texts)
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _cut(self, strings: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What strings without white space are cut into, end to end: plain ones into words in lower case, others stay whole. Where each
        string's begin (one more than strings), and which are of strings that aren't plain."""
        data, at = flat(strings)
        length, kind = np.diff(at), self._KIND[data]
        if self.last is None:
            odd = np.ones(len(length), bool)
        else:
            strange = kind == 0
            # An added token begins so.
            strange[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
            total = np.concatenate([[0], np.cumsum(strange)])
            odd = total[at[1:]] > total[at[:-1]]
        begin = kind == 2
        begin[1:] |= kind[1:] != kind[:-1]
        within = np.repeat(odd, length)
        begin[within] = False
        begin[at[:-1][length > 0]] = True
        start = np.flatnonzero(begin)
        offsets = np.concatenate([start, at[-1:]]).astype(np.int32)
        lower = np.where(within, data, self._LOWER[data])
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(lower)), np.searchsorted(start, at), within[start]

    def _ids(self, pieces: list[str], odd: np.ndarray) -> list[bytes]:
        """Of words and strings; the tokenizer is asked for those not known."""
        found = list(map(self.known.get, pieces))
        for encode, of in ((self._encode_words, ~odd), (self._encode, odd)):
            new = [k for k in np.flatnonzero(of).tolist() if found[k] is None]
            if new:
                names = [pieces[k] for k in new]
                for k, name, ids in zip(new, names, encode(names), strict=True):
                    found[k] = self.known[name] = ids
        self.known = _trimmed(self.known, CACHE)
        return found

    def __call__(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        if self.whole:
            return self._encode(texts.to_pylist())
        strings = pc.ascii_split_whitespace(texts)
        coded = strings.values.dictionary_encode()
        cut, first, odd = self._cut(coded.dictionary)
        cut = cut.dictionary_encode()
        which = cut.indices.to_numpy(zero_copy_only=False)
        other = np.zeros(len(cut.dictionary), bool)
        other[which[odd]] = True
        found = self._ids(cut.dictionary.to_numpy(zero_copy_only=False).tolist(), other)
        # Ids of words to those of different strings, then to those of all.
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, length = np.frombuffer(b"".join(found), "<u4")[_runs((np.cumsum(length) - length)[which], length[which])], length[which]
        start = np.concatenate([[0], np.cumsum(length)])[first]
        length, which = np.diff(start), coded.indices.to_numpy(zero_copy_only=False)
        data = b"".join(pool[_runs(start[part], length[part])].tobytes() for part in (which[a : a + STRINGS] for a in range(0, len(which), STRINGS)))
        ends = (4 * np.concatenate([[0], np.cumsum(length[which])]))[strings.offsets.to_numpy()].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, whole: bool = False) -> Encoder:
    """One for each worker: it lasts from task to task."""
    if (path, whole) not in _encoders:
        _encoders[path, whole] = Encoder(path, whole)
    return _encoders[path, whole]


def _pairs(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (symbols[at].astype(np.uint64) << np.uint64(32)) | symbols[at + 1]


def _full(symbols: np.ndarray, last: np.ndarray, floor: int | None, least: int) -> tuple[np.ndarray, int]:
    """The places whose pair may come floor times or more, told by counts of bins, and the floor (a first one from the fullest bin).
    Pairs across the end of a document go to a bin of their own, which is not looked at."""
    pair = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
    bins = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.int32)
    bins[last[:-1]] = 1 << BIN_BITS
    counts = np.bincount(bins, minlength=(1 << BIN_BITS) + 1)
    counts[-1] = 0
    floor = floor or max(least, int(counts.max()) // STEP)
    return np.flatnonzero((counts >= floor)[bins]), floor


def _without_overlap(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which places are replaced: of neighbours the one of the better rank, then, beside places that lost to none of these, again."""
    chosen, free = np.zeros(len(at), bool), np.arange(len(at))
    for _ in range(2):
        order, touch = rank[free], np.diff(at[free]) == 1
        win, lose = np.ones(len(free), bool), np.zeros(len(free), bool)
        win[1:] &= ~(touch & (order[1:] > order[:-1]))
        win[:-1] &= ~(touch & (order[:-1] > order[1:]))
        lose[1:] |= touch & win[:-1]
        lose[:-1] |= touch & win[1:]
        chosen[free[win]] = True
        free = free[~win & ~lose]
    return chosen


def compress(ids: np.ndarray, lengths: np.ndarray, base: int, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, symbols of each document, rules (left, right) of the symbols from base on."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    top, floor, live = base, None, None
    while len(symbols) > 1:
        if live is None:
            at, floor = _full(symbols, last, floor, least)
        else:
            at = np.flatnonzero(live[:-1] & ~last[:-1])
        names, which = np.unique(_pairs(symbols, at), return_inverse=True)
        # A pair of equal symbols overlaps itself: of a run every other place counts, from the left.
        same = np.zeros(len(at), bool)
        same[1:] = (np.diff(at) == 1) & (which[1:] == which[:-1])
        begin = np.flatnonzero(~same)
        counted = (np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))) % 2 == 0
        counts = np.bincount(which[counted], minlength=len(names))
        frequent = (counts >= floor)[which]
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(names))
        pick = np.flatnonzero(frequent & counted)
        pick = pick[_without_overlap(at[pick], rank[which[pick]])]
        made = np.bincount(which[pick], minlength=len(names)) >= least
        if not made.any():
            if floor == least:
                break
            floor = max(least, floor // STEP)
            continue
        pick = pick[made[which[pick]]]
        put = at[pick]
        if floor == least:
            live = np.zeros(len(symbols), bool)
            live[at[frequent]] = True
        symbols[put] = (np.cumsum(made) - 1)[which[pick]] + top
        last[put] = last[put + 1]
        keep = np.ones(len(symbols), bool)
        keep[put + 1] = False
        symbols, last = symbols[keep], last[keep]
        if live is not None:
            live, now = live[keep], put - np.arange(len(put))
            live[now] = live[np.maximum(now - 1, 0)] = True
        rules.append(np.stack([names[made] >> np.uint64(32), names[made] & np.uint64(0xFFFFFFFF)], 1))
        top += int(made.sum())
        floor = max(least, floor // STEP)
    own = np.zeros(len(lengths), np.int64)
    own[lengths > 0] = np.diff(np.concatenate([[-1], np.flatnonzero(last)]))
    return symbols, own, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint64)


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule's symbol stands for. A rule only has symbols of earlier rounds."""
    n = np.ones(base + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        n[base + k] = n[a] + n[b]
    return n


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.int64)
    while True:
        at = np.flatnonzero(symbols >= base)
        if not len(at):
            return symbols
        wide = np.ones(len(symbols), np.int64)
        wide[at] = 2
        place = np.cumsum(wide) - wide
        out = np.empty(len(symbols) + len(at), np.int64)
        pair = rules[symbols[at] - base].astype(np.int64)
        out[place] = symbols
        out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


class Expansion:
    """All rules written out, so that decoding is one gather."""

    def __init__(self, rules: np.ndarray, base: int):
        self.base, n = base, expansions(rules, base)
        self.length = n[base:]
        self.start = np.cumsum(self.length) - self.length
        self.ids = expand(np.arange(base, base + len(rules)), rules, base)

    def __call__(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        at = np.flatnonzero(symbols >= self.base)
        rule = symbols[at] - self.base
        length = np.ones(len(symbols), np.int64)
        length[at] = self.length[rule]
        out = np.repeat(symbols, length)
        begin = (np.cumsum(length) - length)[at]
        length = length[at]
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(begin, length) + within] = self.ids[np.repeat(self.start[rule], length) + within]
        return out


def write_shard(uri: str, doc_ids: list, ids: list[bytes]) -> tuple[int, int]:
    """Writes a file; its number of ids and of bytes.

    Layout: head, different ids, rules, expansion lengths, document ids (8 bytes, 1 byte for null), first symbol and first id of each document (one
    more than documents), symbols.
    """
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    every = np.frombuffer(b"".join(ids), "<u4")
    seen = np.bincount(every) > 0
    alphabet = np.flatnonzero(seen)
    base = len(alphabet)
    symbols, own, rules = compress((np.cumsum(seen) - 1)[every], lengths, base)
    kind = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    out = io.BytesIO()
    out.write(_HEAD.pack(MAGIC, base, len(rules), len(ids), int(lengths.sum()), np.dtype(kind).itemsize))
    out.write(alphabet.astype("<u4").tobytes())
    out.write(rules.astype("<u4").tobytes())
    out.write(expansions(rules, base)[base:].astype("<u4").tobytes())
    out.write(np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes())
    out.write(np.array([x is None for x in doc_ids], np.uint8).tobytes())
    for starts in (own, lengths):
        out.write(np.concatenate([[0], np.cumsum(starts)]).astype("<u8").tobytes())
    out.write(symbols.astype(kind).tobytes())
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(out.getvalue())
    return int(lengths.sum()), out.tell()


class Shard:
    """A file that write_shard made; documents are read by their place in it."""

    def __init__(self, uri: str):
        self.uri = uri
        magic, self.base, rules, self.docs, self.ids, self.width = _HEAD.unpack(read_range(uri, 0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a file of token ids")
        size = 4 * self.base + 12 * rules + 9 * self.docs + 16 * (self.docs + 1)
        table = read_range(uri, _HEAD.size, size)
        if len(table) != size:
            raise ValueError(f"{uri} is cut short")
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            at += np.dtype(kind).itemsize * n
            return np.frombuffer(table, kind, n, at - np.dtype(kind).itemsize * n)

        self.alphabet = take("<u4", self.base)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.expansions = take("<u4", rules)
        self.doc_ids, self.null = take("<i8", self.docs), take("u1", self.docs)
        self.first_symbol, self.first_id = take("<u8", self.docs + 1).astype(np.int64), take("<u8", self.docs + 1).astype(np.int64)
        self.body = _HEAD.size + size
        self.expand = Expansion(self.rules, self.base)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids of the documents start, ..., stop - 1, from their own bytes."""
        a, b = self.first_symbol[start], self.first_symbol[stop]
        data = read_range(self.uri, int(self.body + a * self.width), int((b - a) * self.width))
        ids = self.alphabet[self.expand(np.frombuffer(data, f"<u{self.width}"))]
        if len(ids) != self.first_id[stop] - self.first_id[start]:
            raise ValueError(f"{self.uri} does not expand to what it says")
        return ids


def write(docs: DataFrame, scratch: Scratch, tokenizer: str | None = None, id_column: str = "doc_id", text: str = "text",
          end: int = END, whole: bool = False, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes all documents; the table of files: uri, part, seq, n_docs, n_ids, n_bytes, first (ids in the files before)."""
    path, folder = tokenizer or tokenizer_path(), f"{scratch.path}/ids"
    stop = np.array([end], "<u4").tobytes()
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches):
        encode, part, seq = encoder(path, whole), TaskContext.get().partitionId(), 0
        held: tuple[list, list] = ([], [])
        n = 0

        def flush():
            nonlocal held, n, seq
            uri = f"{folder}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.ids"
            ids, size = write_shard(uri, *held)
            row = pa.RecordBatch.from_pydict({"uri": [uri], "part": [part], "seq": [seq], "n_docs": [len(held[0])], "n_ids": [ids], "n_bytes": [size]})
            held, n, seq = ([], []), 0, seq + 1
            return row

        for batch in batches:
            for step in steps(batch, "text", TEXT_BYTES):
                for key, ids in zip(step.column("id").to_pylist(), encode(step.column("text")), strict=True):
                    held[0].append(key), held[1].append(ids + stop)
                    n += len(ids) // 4 + 1
                    if n >= shard_ids:
                        yield flush()
        if held[0]:
            yield flush()

    files = rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(
        run, "uri string, part long, seq long, n_docs long, n_ids long, n_bytes long")
    files = scratch.stage(files, "files")
    # One row per file here.
    return files.withColumn("first", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read(files: DataFrame, block: int = 512) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist(), strict=True):
                shard = Shard(uri)
                for a in range(0, shard.docs, block):
                    b = min(a + block, shard.docs)
                    ids, at = shard.read(a, b).astype("<u4"), shard.first_id[a : b + 1]
                    data = memoryview(ids.tobytes())
                    cut = (4 * (at - at[0])).tolist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.doc_ids[a:b], mask=shard.null[a:b].astype(bool)), pa.array(at[:-1] + first), pa.array(np.diff(at)),
                        pa.array([zlib.crc32(data[x:y]) for x, y in zip(cut, cut[1:], strict=False)], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // 4))
    return files.select("uri", "first").repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
