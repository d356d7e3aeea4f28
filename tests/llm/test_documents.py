"""Operators on documents against brute force, on small tables with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rowpact.llm import decontaminate, jaccard, linededup, mixing, oracles, quality, repair, suffixes
from tests.llm.conftest import EDGES

BENCHMARK = "item_id long, text string"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKS = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng, n, words=3000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture
def rows():
    rng = random.Random(5)
    made = list(EDGES)
    base = [prose(rng, rng.randrange(5, 120)) for _ in range(30)]
    for k in range(90):
        text = base[k % 30].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(99)}"
        made.append((100 + k, " ".join(text), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c"])))
    return made


# --- 1

def brute_contamination(docs, items, window=13):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add("" if item is None else str(item))
    out = []
    for r in docs:
        w, hit, found = WORD.findall(lower(r[1] or "")), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((r[0], len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_contamination(llm, scratch, documents, rows, block_bytes):
    taken = rows[20][1].split(" ")
    items = [(1, " ".join(taken[:20]).upper()), (2, "one"), (10, "ONE."), (3, None), (4, ""), (None, "cödé wörds"), (5, "words that nobody has"), (1, "one")]
    benchmark = llm.createDataFrame(items, BENCHMARK)
    found, at = decontaminate.scan(documents(rows), benchmark, scratch, block_bytes=block_bytes)
    got = found.select("doc_id", f"{at}.n_words", decontaminate.n_hit(at), f"{at}.items", decontaminate.contaminated(at)).collect()
    assert sorted([(r[0], r[1], r[2], tuple(r[3]), r[4]) for r in got], key=repr) == brute_contamination(rows, items)


def test_contamination_is_removed(llm, scratch, documents):
    benchmark = llm.createDataFrame([(1, "alpha beta gamma")], BENCHMARK)
    docs = documents([(1, "Ünder ALPHA, beta: gamma! rest", "en", "a"), (2, "alpha beta", "en", "a"), (3, None, "en", "a")])
    assert sorted(r["doc_id"] for r in decontaminate.drop_documents(docs, benchmark, scratch).collect()) == [2, 3]
    cut = decontaminate.drop_spans(docs, benchmark, scratch)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Ünder ! rest", 2: "alpha beta", 3: None}


def test_contamination_of_empty_tables(llm, scratch, documents):
    none = llm.createDataFrame([], BENCHMARK)
    found, at = decontaminate.scan(documents(EDGES), none, scratch)
    assert found.filter(decontaminate.contaminated(at)).count() == 0 and found.count() == len(EDGES)
    assert decontaminate.drop_documents(documents([]), none, scratch).count() == 0


# --- 2

def brute_lines(docs, run=3, words=50):
    places = {}
    order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in docs if r[1] is not None}, key=lambda x: x[:2])
    gone = collections.defaultdict(set)
    for known, doc, text in order:
        lines = [x.strip(" \t\x0b\x0c\r") for x in text.split("\n")]
        full = [x for x in lines if x]
        for n in range(1, run + 1):
            for k in range(len(full) - n + 1):
                g = tuple(full[k : k + n])
                if n < run and len(BLANKS.findall(" ".join(g))) <= words:
                    continue
                if g in places:
                    gone[known, doc, text] |= set(range(k, k + n))
                else:
                    places[g] = True
    out = []
    for r in docs:
        key = (r[0] is not None, r[0] or 0, r[1])
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        kept, p, n = [], 0, 0
        for line in r[1].split("\n"):
            if line.strip(" \t\x0b\x0c\r"):
                n += 1
                if p not in gone[key]:
                    kept.append(line)
                p += 1
            else:
                kept.append(line)
        out.append((r[0], "\n".join(kept), n, len(gone[key])))
    return sorted(out, key=repr)


def test_lines(scratch, documents):
    rng = random.Random(3)
    blocks = [[f"line {rng.randrange(6)}" for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    rows = [r for r in EDGES if r[0] != 8]
    for k in range(60):
        lines = [x for _ in range(rng.randrange(1, 5)) for x in [*rng.choice(blocks), f"own {k} {rng.random()}"]]
        if k % 3 == 0:
            lines.insert(2, " \t")
        rows.append((100 + k, "\n".join(f" {x}" if rng.random() < 0.1 else x for x in lines), "en", "a"))
    rows += rows[-2:]
    docs = documents(rows)
    found, at = linededup.cut(docs, scratch)
    assert found.columns == [*docs.columns, at]
    got = sorted([(r["doc_id"], r["text"], r[at]["n_lines"], r[at]["n_removed"]) for r in found.collect()], key=repr)
    assert got == brute_lines(rows) and any(r[3] for r in got)
    empty, _ = linededup.cut(documents([]), scratch)
    assert empty.count() == 0


def test_long_passages_in_few_lines(scratch, documents):
    """More than fifty words in one or two lines are a run; fifty are not. Equal rows are one place, in the SQL too."""
    def words(mark, n):
        return " ".join(f"{mark}{k}" for k in range(n))

    one, two, half, short = words("a", 51), f"{words('b', 30)}\n{words('c', 21)}", words("d", 50), words("e", 20)
    texts = [f"x1\n{one}\ny1", f"x2\n{two}\ny2", f"x3\n{half}\ny3", f"x4\n \n{one} \n{short}\ny4", f"x5\n{two}\n{half}\ny5",
             f"{half}\nx6\n{one}\n{short}\n", one, f"{one}\n{one}"]
    rows = [(k, x, "en", "a") for k, x in enumerate([*texts, None, "", texts[1]])]
    rows += [rows[3], rows[3], (None, f"{two}\nz", "en", "a")]
    docs = documents(rows)
    found, at = linededup.cut(docs, scratch)
    got = sorted([(r["doc_id"], r["text"], r[at]["n_lines"], r[at]["n_removed"]) for r in found.collect()], key=repr)
    assert got == brute_lines(rows)
    removed = {r[0]: r[3] for r in got}
    assert removed == {None: 0, 0: 0, 1: 2, 2: 0, 3: 1, 4: 2, 5: 2, 6: 1, 7: 2, 8: 0, 9: 0, 10: 4}
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    sql = sorted([tuple(r) for r in con.execute(oracles.OP2).fetchall()], key=repr)
    assert sql == sorted([(r["doc_id"], *r[at], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in found.collect()], key=repr)


# --- 3

def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above three times a source's size goes to the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("skew", [False, True])
def test_mix(scratch, documents, rows, skew):
    if skew:
        rows = [(r[0], r[1], r[2], "big" if k % 9 else f"s{k}") for k, r in enumerate(rows)] + [(1000, "", "en", "none"), (1001, None, "en", "none")]
    docs = documents(rows)
    plan = mixing.mix(docs, scratch).collect()
    assert sorted(plan, key=repr) == sorted(mixing.mix(docs, scratch).collect(), key=repr)
    assert len(plan) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(BLANKS.findall(r[1] or ""))
    expected = brute_targets(dict(sizes))
    taken = collections.Counter()
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], expected[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(t + 0.5) for s, t in expected.items())
    mixed = mixing.mixed_documents(docs, scratch)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r["source"]] += len(BLANKS.findall(r["text"]))
    assert all(abs(words[s] - taken[s]) <= 4 for s in sizes)  # equal rows round up
    assert mixing.mix(documents([]), scratch).count() == 0 and mixing.mixed_documents(documents([]), scratch).count() == 0


# --- 6

def brute_counts(text):
    w = BLANKS.findall(text or "")
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    lines = [x for x in (text or "").split("\n") if BLANKS.search(x)]
    repeated = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


def test_quality(scratch, documents, rows):
    rows = [*rows, (50, "a b c d e f g h i j a b c d e f g h i j x", "en", "a"), (51, "l1 x\nl1 x\n\n l1 x\nl1 x\r\n" + "q w e r t y u i o p" * 3, "en", "a"),
            (52, " ".join(f"w{k}###" for k in range(200)), "en", "a"), (53, "a a a a a a", "en", "a")]
    judged, at = quality.judge(documents(rows), scratch)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted([(r["doc_id"], *(r[at][n] for n in names), r[at]["base_failed"]) for r in judged.collect()], key=repr)
    expected = [(r[0], *(c := brute_counts(r[1])), c[0] < 10 or 100 * c[4] > 20 * c[0]) for r in rows]
    assert got == sorted(expected, key=repr)
    verdict = {r["doc_id"]: r[at]["kept"] for r in judged.collect()}
    assert not verdict[52] and not verdict[50] and all(verdict[100 + k] for k in range(90) if len(BLANKS.findall(rows[12 + k][1])) > 9)
    kept = quality.keep_good(documents(rows), scratch)
    assert kept.columns == documents(rows).columns and kept.count() == sum(r[at]["kept"] for r in judged.collect())
    assert quality.keep_good(documents([]), scratch).count() == 0


# --- 7

def brute_repeats(texts, n=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[k : k + n] for x in data for k in range(len(x) - n + 1))
    out = []
    for x in data:
        cover = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                cover[k : k + n] = b"\1" * n
        runs = sum(1 for k in range(len(x)) if cover[k] and (not k or not cover[k - 1]))
        out.append((len(x), sum(cover), runs, bytes(b for b, c in zip(x, cover) if not c)))
    return out


def repeating(seed):
    rng = random.Random(seed)
    parts = [prose(rng, rng.randrange(10, 200)) for _ in range(12)]
    made = []
    for k in range(40):
        text = "".join(rng.choice(parts)[rng.randrange(30):][: rng.randrange(150, 900)] + prose(rng, rng.randrange(0, 60)) for _ in range(rng.randrange(1, 4)))
        made.append((100 + k, text, "en", "a"))
    made += [(300, "a" * 1000, "en", "a"), (301, "ab" * 300, "en", "a"), (302, "a" * 200, "en", "a"), (303, "é" * 150, "en", "a"), (304, made[0][1], "en", "a"), (304, made[0][1], "en", "a")]
    return made


def test_suffixes(scratch, documents):
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 9999 else r[1][:3000], *r[2:]) for r in EDGES] + repeating(1)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.cut(documents(rows), scratch).collect()]
    expected = [(r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows]), strict=True)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert suffixes.cut(documents([]), scratch).count() == 0


def test_no_task_merges_a_hot_core(scratch, documents, monkeypatch):
    """A passage that many documents have with different text round it: its ends share a core."""
    rng, real = random.Random(9), suffixes._merge
    passage = prose(rng, 100)
    rows = [(k, f"{prose(rng, 60)} {passage} {prose(rng, 60)}", "en", "a") for k in range(60)]
    rows += [(100 + k, f"{prose(rng, 60)} the same before {passage} the same after {k}{prose(rng, 60)}", "en", "a") for k in range(20)]
    rows += [(200, passage, "en", "a"), (200, passage, "en", "a"), (201, passage[:250], "en", "a"), *repeating(2)]

    def bounded(batches):
        held = list(batches)
        cores = [c for batch in held for c in batch.column("core").to_pylist()]
        if cores and max(cores.count(c) for c in set(cores)) > 8:
            raise ValueError("a task receives a hot core")
        yield from real(iter(held))

    monkeypatch.setattr(suffixes, "BATCH", 8)
    monkeypatch.setattr(suffixes, "_merge", bounded)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.cut(documents(rows), scratch).collect()]
    expected = [(r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows]), strict=True)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_transforms_merge_to_the_order_of_all(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(suffixes, "SHARD", 7)
    frames = rng.integers(97, 99, (40, suffixes._FRAME)).astype(np.uint8)
    for k in range(20):
        a, b = rng.integers(0, 40, 2)
        frames[a] = frames[b]
        frames[a, : rng.integers(0, 16)] ^= 1
        frames[a, suffixes._FRAME - rng.integers(1, 16):] ^= 1
    first, last = np.zeros(40, int), np.full(40, 15)
    first[3], last[5] = 4, 9
    got = suffixes.repeated(frames, first, last)
    seen = collections.Counter(frames[k, s : s + 200].tobytes() for k in range(40) for s in range(first[k], last[k] + 1))
    for k in range(40):
        for s in range(16):
            assert got[k, s] == (first[k] <= s <= last[k] and seen[frames[k, s : s + 200].tobytes()] > 1)


def test_long_texts_are_cut_between_blocks(monkeypatch):
    """Blocks don't depend on where a long text is cut."""
    import pyarrow as pa

    text = prose(random.Random(2), 4000)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "same": [2], "text": [text]})
    whole = pa.Table.from_batches(suffixes._rows([batch])).to_pydict()
    monkeypatch.setattr(suffixes, "SEGMENT", 3000)
    assert pa.Table.from_batches(suffixes._rows([batch])).to_pydict() == whole


# --- 9

def brute_components(rows, threshold=90, size=3):
    found, classes = [], collections.defaultdict(list)
    for r in rows:
        w = BLANKS.findall(lower(r[1] or ""))
        s = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
        found.append(s)
        if s:
            classes[s].append(r[0])
    keys = list(classes)
    root = list(range(len(keys)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            shared = len(keys[a] & keys[b])
            if 100 * shared >= threshold * (len(keys[a]) + len(keys[b]) - shared):
                root[top(a)] = top(b)
    least = collections.defaultdict(list)
    for k, s in enumerate(keys):
        least[top(k)] += [x for x in classes[s] if x is not None]
    of = {s: min(least[top(k)], default=None) for k, s in enumerate(keys)}
    return sorted([(r[0], len(s), of[s] if s else r[0]) for r, s in zip(rows, found, strict=True)], key=repr)


def near(rng):
    made = []
    for k in range(25):
        text = prose(rng, rng.choice([3, 8, 12, 20, 30, 50, 66, 72, 90, 150, 400])).split(" ")
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(text) // 40 + 2)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [f"n{rng.randrange(9999)}"] if rng.random() < 0.7 else []
                copy = copy or ["x"]
            made.append((1000 + len(made), " ".join(copy), "en", "a"))
    return made


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard(scratch, documents, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [*EDGES, *near(random.Random(block))]
    docs = documents(rows)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, scratch).collect()]
    assert sorted(got, key=repr) == brute_components(rows)
    kept = jaccard.keep_one(docs, scratch)
    assert kept.columns == docs.columns
    empty = [r for r in rows if not BLANKS.search(r[1] or "")]
    groups = {(c if c is not None else "none") for d, n, c in got if n}
    ids = [r["doc_id"] for r in kept.collect()]
    # Two texts that share an id but aren't alike are two groups.
    assert len(ids) == len(empty) + len(groups) + 1 and set(x for x in groups if x != "none") <= set(ids)


def test_a_line_in_common_makes_no_family(scratch, documents):
    """Texts that share a line only meet by its signatures; one pair of near copies is all that is compared."""
    rng = random.Random(11)
    rows = [(k, f"this line of twelve words stands at the head of every text\n{prose(rng, 60 + k % 40)}", "en", "a") for k in range(200)]
    rows.append((200, rows[0][1] + " added", "en", "a"))
    got = jaccard.join(documents(rows), scratch, shingle=5, threshold=80)
    assert sorted(r["component_id"] for r in got.collect()) == [0, *range(200)]
    assert sorted(r["doc_id"] for r in scratch.spark.read.parquet(scratch._written["members"]).collect()) == [0, 200]


def test_large_signatures_meet_in_blocks(scratch, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "MEETING", 3)
    rows = [*EDGES, *near(random.Random(7))]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(rows), scratch, shingle=5, threshold=80).collect()]
    assert sorted(got, key=repr) == brute_components(rows, 80, 5)


def random_sets(rng, n, many):
    base = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
    for _ in range(many):
        out, added = rng.integers(0, n // 8 + 2, 2)
        yield np.unique(np.concatenate([base[:1], rng.permutation(base)[out:], rng.integers(0, 1 << 64, added, np.uint64, endpoint=False)]))


@pytest.mark.parametrize("threshold", [80, 90])
def test_sketches_allow_every_link(threshold):
    """On both sides of the size from which sketches are wide."""
    rng = np.random.default_rng(6)
    for n in [1, 2, 9, 63, 64, 130, 300, jaccard.LARGE - 1, jaccard.LARGE, 500, 2000]:
        made = list(random_sets(rng, n, 20))
        sketches = jaccard.Sketches(np.array([len(x) for x in made]), [jaccard.sketch(x) for x in made], threshold)
        for a, x in enumerate(made):
            may = sketches.may_link(a, np.arange(len(made)))
            assert (may == sketches.may_link(np.full(len(made), a), np.arange(len(made)))).all()
            for b, y in enumerate(made):
                shared = len(np.intersect1d(x, y))
                assert may[b] or 100 * shared < threshold * (len(x) + len(y) - shared)
    # Sets with nothing in common are told apart where a link allows few bits.
    apart = [np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)) for n in [80, 200, 300, 500, 1000] for _ in range(2)]
    sketches = jaccard.Sketches(np.array([len(x) for x in apart]), [jaccard.sketch(x) for x in apart], threshold)
    assert not sketches.may_link(np.arange(0, 10, 2), np.arange(1, 10, 2)).any()


@pytest.mark.parametrize("size", [1, 3, 50, 4000])
def test_members_of_a_signature_are_tied(size):
    """Ties make the components of all pairs that may be linked, in batches of any size."""
    rng = np.random.default_rng(8)
    rows = []
    for s, many in enumerate([1, 2, 5, jaccard.FEW, jaccard.FEW + 1, 40, 3, 90, 1]):
        for n in (70, 500):
            made = [x for _ in range(1 + many // 8) for x in random_sets(rng, n, 8)][:many]
            rows += [(s, 0, n, 1000 * s + n + k, len(x), jaccard.sketch(x)) for k, x in enumerate(made)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    table = pa.table(columns, ["s", "x", "y", "m", "n", "sketch"])
    pairs = {(a, b) for batch in jaccard._meet(80)(iter(table.to_batches(max_chunksize=size))) for a, b in zip(*batch.to_pydict().values(), strict=True)}
    sketches = jaccard.Sketches(np.array([r[4] for r in rows]), [r[5] for r in rows], 80)
    every = {(rows[a][3], rows[b][3]) for a in range(len(rows)) for b in range(a + 1, len(rows))
             if rows[a][:3] == rows[b][:3] and sketches.may_link(a, np.array([b]))[0]}

    def roots(links):
        root = {r[3]: r[3] for r in rows}
        for _ in rows:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots(sorted(pairs)) == roots(sorted(every)) and len(pairs) < len(every)


def test_jaccard_of_empty_tables(scratch, documents):
    assert jaccard.join(documents([]), scratch).count() == 0
    assert jaccard.keep_one(documents([]), scratch).count() == 0


def test_signatures_meet():
    """Linked sets of every size share a signature."""
    rng, cuts = np.random.default_rng(4), jaccard.Cuts(90)
    for n in [*range(9, 90), 127, 128, 300, 1000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            most = int(n / 9)
            out = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 63, most - out, np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 90 * (len(a) + len(b) - shared):
                assert len(np.intersect1d(cuts.signatures(a), cuts.signatures(b)))


@pytest.mark.parametrize("threshold", [80, 90])
def test_signatures_meet_at_the_bound(threshold):
    """Sets that are just linked, of every size up to long documents; of these one differs as much as it may."""
    rng, cuts = np.random.default_rng(5), jaccard.Cuts(threshold)
    share = threshold / 100
    for n in [*range(9, 80, 3), 127, 128, 300, 1000, 4000, 16000]:
        for out in (0, 1, 2):  # left out of the first set: none, half of what may differ, or all
            for _ in range(4):
                a = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
                gone = int((n - math.ceil(share * n)) * out / 2)
                kept = rng.permutation(a)[gone:]
                added = int(len(kept) / share - len(a) + 1e-9)
                b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, max(0, added), np.uint64, endpoint=False)]))
                shared = len(np.intersect1d(a, b))
                assert 100 * shared >= threshold * (len(a) + len(b) - shared)
                assert len(np.intersect1d(cuts.signatures(a), cuts.signatures(b)))
    # Fewer fragments than differing shingles where sets are large.
    level = cuts.level(16000)
    assert cuts.fragments(level) < cuts.most(16000)


# --- 10

def test_ids(scratch, documents, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(repair.tokenizer_path())
    rows = [*rows, (77, "It's <|endoftext|> a <|startoftext|>x can't WE'LL 123 ½ ÇA İI ﬁ ΣΑΣ é", "en", "a"), (78, " x\x1cy\x85z\xa0w ́a", "en", "a")]
    files = repair.write(documents(rows), scratch, shard_ids=2000)
    assert files.count() > 3
    got = sorted([(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in repair.read(files).collect()], key=lambda r: r[0])
    expected, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, repair.END]
        expected.append((start, r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    first = files.orderBy("first").first()
    shard = repair.Shard(first["uri"])
    whole = shard.read(0, shard.docs)
    for k in range(shard.docs):  # any document on its own
        assert (shard.read(k, k + 1) == whole[shard.first_id[k] : shard.first_id[k + 1]]).all()
    assert repair.read(repair.write(documents([]), scratch)).count() == 0


@pytest.mark.parametrize("blocks", [None, 3])
def test_ids_of_texts_are_those_of_the_tokenizer(monkeypatch, blocks):
    from tokenizers import Tokenizer

    if blocks:
        monkeypatch.setattr(repair, "STRINGS", blocks)
        monkeypatch.setattr(repair, "CACHE", blocks)
    tokenizer, encode = Tokenizer.from_file(repair.tokenizer_path()), repair.Encoder(repair.tokenizer_path())
    texts = ["left out", None, "", " \n\t ", "Don't WE'LL ''s x're, 'realm", "ÀÖ×ØÞß÷ÿ ªº² A×B", "a<|endoftext|>B <|EndOfText|> < | <| |>", "AB12c3--d.E", "É É  ́a",
             "x\x00y\x1cz\x7f \x85\xa0w", "ΑΣ İI ﬁ 汉字 😀", "a<", "|b", "\u0117\u4dd7 ė", "don't a<|endoftext|>b", "ab" * 500]
    rng = np.random.default_rng(4)
    letters = np.array(list("abAB1.<|>' \nÉé×ñß\u0301汉"))
    texts += ["".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 300)]
    expected = [np.array(tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for kind in (pa.string(), pa.large_string()):
        assert encode(pa.array(texts, kind)[1:]) == expected[1:]
        for k in range(6):
            assert encode(pa.array(texts, kind)[k : k + 1]) == [expected[k]] and encode(pa.array(texts, kind)[k:k]) == []


def test_ids_are_looked_up_once_for_each_word():
    """Not once for each time that a word comes: that, not the tokenizer, took most of the time."""
    class Counting(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    encode, rng = repair.Encoder(repair.tokenizer_path()), np.random.default_rng(2)
    encode.known = known = Counting()
    words = ["the", "house", "Stands", "by", "a", "river,", "no", "42", "don't"]
    encode(pa.array([" ".join(rng.choice(words, 200)) for _ in range(100)]))
    assert 0 < known.asked <= 20


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 40, 60) if seed else np.array([5000])
    ids = rng.integers(0, [3, 1, 50, 2, 9, 400][seed], int(lengths.sum()))
    symbols, own, rules = repair.compress(ids.astype("<u4"), lengths, 1000)
    assert (repair.expand(symbols, rules, 1000) == ids).all()
    assert (own > 0).tolist() == (lengths > 0).tolist() and own.sum() == len(symbols)
    n = repair.expansions(rules, 1000)
    ends = np.cumsum(own)
    assert [int(n[symbols[e - o : e].astype(int)].sum()) for o, e in zip(own, ends)] == lengths.tolist()
    if seed in (0, 1, 3):
        assert len(symbols) < len(ids) / 2
    assert not frequent_pairs(symbols, own, repair.MIN_COUNT)
    # Every rule is used, and made of symbols before it.
    assert set(range(1000, 1000 + len(rules))) <= set(symbols.tolist()) | set(rules.ravel().tolist())
    assert (rules.max(1) < np.arange(len(rules)) + 1000).all()


def frequent_pairs(symbols, own, least):
    """Pairs of neighbours within documents with so many occurrences that don't overlap, counted one by one."""
    counts, ends = collections.Counter(), np.cumsum(own)
    for a, b in zip(ends - own, ends, strict=True):
        before = None
        for pair in zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist(), strict=True):
            if pair[0] == pair[1] and pair == before:
                before = None
                continue
            counts[pair] += 1
            before = pair
    return {p: n for p, n in counts.items() if n >= least}


def test_grammar_goes_on_to_its_end():
    """Words from few letters, in many documents of equal passages: rules of rules, overlapping pairs, runs of one id."""
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 30, rng.integers(1, 7)) for _ in range(400)]
    words += [np.full(k, 7) for k in range(2, 30)]
    passages = [np.concatenate([words[k] for k in rng.integers(0, len(words), 40)]) for _ in range(60)]
    docs = [np.concatenate([passages[k] for k in rng.integers(0, 60, rng.integers(1, 4))] + [words[k] for k in rng.zipf(1.3, 30) % 400]) for _ in range(500)]
    docs[3:3] = [np.zeros(0, int)]
    lengths, ids = np.array([len(x) for x in docs]), np.concatenate(docs)
    symbols, own, rules = repair.compress(ids, lengths, 30)
    assert (repair.expand(symbols, rules, 30) == ids).all() and not frequent_pairs(symbols, own, repair.MIN_COUNT)
    assert len(symbols) < len(ids) / 8
