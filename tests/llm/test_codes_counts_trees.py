"""Operators 11 to 13 against plain versions, edge cases, and their registered queries."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rowpact.llm import merkle, tokencounts, vectorcode
from tests.llm.conftest import CLASH, CLASHING, EDGES

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# 11


def brute_codes(data, parts=16, entries=64, rounds=2, scale=256):
    """data: (vec_id, vector, label); rows of vec_id, code, error, label_error, and the digest."""
    data = [(i, v, y) for i, v, y in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in data), default=0)
    width = -(-dim // parts)
    whole = [[math.floor(scale * x) if abs(x) < 2 ** 50 else int(x) * scale for x in v] + [0] * (width * parts - len(v)) for _, v, _ in data]
    order = sorted(range(len(data)), key=lambda k: (data[k][0] is None, data[k][0] or 0, data[k][1]))[:entries]
    books = [[whole[k][p * width : (p + 1) * width] for k in order] for p in range(parts)]

    def nearest(v, p):
        part = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            found = {}
            for v in whole:
                found.setdefault(nearest(v, p)[1], []).append(v[p * width : (p + 1) * width])
            for e, members in found.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = []
    for (i, _, y), v in zip(data, whole, strict=True):
        near = [nearest(v, p) for p in range(parts)]
        out.append((i, y, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near)))
    sums = {}
    for _, y, _, d in out:
        sums[y] = sums.get(y, 0) + d
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, d, sums[y]) for i, y, c, d in out), key=repr), digest


def codes(llm, scratch, data, kind="float"):
    frame = llm.createDataFrame([(*r, *CLASHING) for r in data], f"vec_id long, embedding array<{kind}>, label int, {CLASH}").repartition(3)
    found, books = vectorcode.encode(frame, scratch)
    return rows(found.select("vec_id", "code", "error", "label_error")), books.digest()


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 8])
def test_transform_multiplies_squared_distances_by_the_padded_width(width):
    rng = np.random.default_rng(width)
    entries, part = rng.integers(-300, 300, (1, 20, width)), rng.integers(-300, 300, (50, width))
    books = vectorcode.Codebooks(entries)
    found, error = books.assign(np.tile(part, 1))
    plain = ((part[:, None] - entries[0]) ** 2).sum(2)
    assert (found[:, 0] == plain.argmin(1)).all() and (error[:, 0] == plain.min(1)).all()
    signs = vectorcode.hadamard(np.eye(books.padded, dtype=np.int64))[:, books.order]
    assert ((np.diff(signs, axis=0) != 0).sum(0) == np.arange(books.padded)).all()


def test_entries_are_dropped_early():
    rng = np.random.default_rng(5)
    books = vectorcode.Codebooks(rng.integers(-1000, 1000, (1, 64, 16)))
    asked = []
    bound = vectorcode.np.nonzero
    try:
        vectorcode.np.nonzero = lambda x: asked.append(x.mean()) or bound(x)
        books.assign(books.entries[0][rng.integers(0, 64, 200)] + rng.integers(-9, 9, (200, 16)))
    finally:
        vectorcode.np.nonzero = bound
    assert asked[0] < 0.5  # of all entries, after the first coefficient


def test_codes_equal_plain_ones(llm, scratch):
    rng = np.random.default_rng(1)
    data = [(int(k) * 3, [float(np.float32(x)) for x in rng.normal(0, 0.2, 48)], int(k) % 3 if k % 7 else None) for k in rng.permutation(150)]
    found, digest = codes(llm, scratch, data)
    assert (found, digest) == brute_codes(data)


def test_codes_of_odd_vectors(llm, scratch):
    same = [0.5] * 20
    data = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 20, 1), (4, [float("inf"), 0.0], 1), (None, same, None), (5, same, None), (5, same, 2),
            (6, [], 2), (7, [-0.001, 0.001], 2), (8, [0.25] * 37, 3), *[(k, same, 4) for k in range(9, 90)], (90, [3e5, -3e5], 5)]
    found, digest = codes(llm, scratch, data)
    assert (found, digest) == brute_codes(data)


def test_codes_beyond_64_bits(llm, scratch):
    data = [(1, [1e300, -1e300, 2.0 ** 70], 1), (2, [1e300, 5.0, 0.0], 1), *[(k, [float(k)] * 3, 2) for k in range(3, 70)]]
    found, digest = codes(llm, scratch, data, "double")
    expected, expected_digest = brute_codes(data)
    fits = lambda x: x if x < 1 << 63 else None
    assert digest == expected_digest
    assert [r[:3] for r in found] == [(i, c, fits(d)) for i, c, d, _ in expected]


def test_codes_of_no_vectors(llm, scratch):
    assert codes(llm, scratch, [])[0] == []
    assert codes(llm, scratch, [(1, None, 1)])[0] == []


def test_codes_decode_to_entries_at_the_stated_error(llm, scratch):
    rng = np.random.default_rng(2)
    data = {k: rng.normal(0, 0.2, 32).tolist() for k in range(100)}
    frame = llm.createDataFrame([(k, v, 1) for k, v in data.items()], "vec_id long, embedding array<double>, label int")
    found, books = vectorcode.encode(frame, scratch)
    for r in found.collect():
        whole = [math.floor(256 * x) for x in data[r.vec_id]]
        assert r.error == sum((a - b) ** 2 for a, b in zip(whole, vectorcode.decode(r.code, books), strict=True))


# 12


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokencounts.model_path())


ODD_TEXTS = [
    "", " ", "   ", "\n", " \n a\n\n  b ", "a", " a", "a ", "▁", "▁▁a ▁b", "<s> </s> <unk> <0x0A>", "\x00\x01", "日本語です 漢字かな交じり文", "ünïcödé—“quotes”… №5", "x0x1 12345 3.14 e-mail",
    "don't_stop();//code\tx", "\U0001F600\U0001F468‍\U0001F469", "A" * 3000, "ab" * 5000, "....,,,,!!!!", " 　 wide", "Привет, мир! Ещё", "áë",
]


def test_counts_equal_encoding_whole_texts(llm, scratch, processor):
    docs = [r.text for r in llm.read.parquet(f"{SF}/documents.parquet").collect()] + ODD_TEXTS
    frame = llm.createDataFrame([(k, x, *CLASHING) for k, x in enumerate(docs)], f"doc_id long, text string, {CLASH}").repartition(3)
    found = rows(tokencounts.count(frame, scratch, limit=100))
    expected = []
    for k, x in enumerate(docs):
        n = len(processor.encode(x or ""))
        expected.append((k, len((x or "").encode()), n, n > 100))
    assert found == sorted(expected, key=repr)


def test_rare_and_long_pretokens_take_the_shuffled_way(llm, scratch, processor):
    data = [(1, "rare words of this text"), (2, "words " * 50), (3, "z" * 500 + " " + "words of"), (4, "z" * 500)]
    found = rows(tokencounts.count(llm.createDataFrame(data, "doc_id long, text string"), scratch, hot=2))
    assert [(r[0], r[2]) for r in found] == [(k, len(processor.encode(x))) for k, x in data]


def test_long_texts_are_cut_alike(processor, monkeypatch):
    cut = tokencounts.PreTokens(tokencounts.model_path())
    text = " ".join(ODD_TEXTS)
    short = cut.frequencies(text)
    monkeypatch.setattr(tokencounts, "LONG", 10)
    assert cut.frequencies(text) == short
    monkeypatch.setattr(tokencounts, "CUTS", 3)
    assert cut.frequencies(text) == short and cut.frequencies("x") and len(cut._cuts) <= 3
    assert sum(n * p for n, p in zip(short.values(), cut.pieces(list(short)), strict=True)) == len(processor.encode(text))


def test_counts_of_edge_cases(llm, scratch, documents, processor):
    found = rows(tokencounts.count(documents(EDGES), scratch).select("doc_id", "n_bytes", "n_tokens"))
    assert found == sorted(((i, len((x or "").encode()), len(processor.encode(x or ""))) for i, x, *_ in EDGES), key=repr)
    assert rows(tokencounts.count(documents([]), scratch)) == []


# 13


def brute_manifest(data, fan=16):
    """data: (doc_id, source, lang, n_chars, text); rows of the query op13."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def tree(level):
        """Top, and for each first node the runs above it: (before, after)."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, i in enumerate(at):
                a = i // fan * fan
                paths[k].append((level[a:i], level[i + 1 : a + fan]))
            level = [h(*level[a : a + fan]) for a in range(0, len(level), fan)]
            at = [i // fan for i in at]
        return level[0], paths

    groups = {}
    for r in data:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, above = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, upper in zip(names, above, strict=True):
        for (_, _, own, r), lower in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                changed = (*r[:4], "".join(x.lower() if "A" <= x <= "Z" else x for x in r[4]))
            folded = leaf(changed)
            for before, after in lower + upper:
                folded = h(*before, folded, *after)
            proof = h(*(x for before, after in lower + upper for x in before + after))
            out.append((r[0], own, trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def manifest(llm, scratch, data, **options):
    kinds = f"doc_id long, source string, lang string, n_chars long, text string, {CLASH}, k int, g int, leaf int"
    frame = llm.createDataFrame([(*r, *CLASHING, 1, 2, 3) for r in data], kinds)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf(*[lower if x == "text" else F.col(x) for x in merkle.FIELDS]))
    made = merkle.Manifest(frame.repartition(4), scratch, claim=claim, **options)
    return rows(made.proofs()), made


def sample(sizes, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for s, n in sizes.items():
        out += [(int(rng.integers(0, 10 * n)), s, "en", k, f"Text {k} OF {s}") for k in range(n)]
    return [out[k] for k in rng.permutation(len(out))]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17}, {None: 3, "a": 300, "b": 1, "é": 33, "z": 16}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_manifest_equals_plain_one(llm, scratch, sizes):
    data = sample(sizes)
    assert manifest(llm, scratch, data)[0] == brute_manifest(data)


def test_manifest_of_many_leaf_partitions(llm, scratch):
    """Partitions of nine leaves: trees reach well above them, small groups share one."""
    data = sample({"big": 700, None: 9, "c": 10, "d": 1, "e": 90, **{f"s{k}": 1 + k % 4 for k in range(30)}}, 3)
    found, made = manifest(llm, scratch, data, fan=3, levels=2)
    assert found == brute_manifest(data, 3)
    # Each partition asks for the others of its runs above what it holds, not for leaves.
    assert made.lacking().filter("tree <> -1 and level < 2").count() == 0
    per = made.lacking().groupBy("b1", "b2").count().agg(F.max("count")).first()[0]
    assert per <= 2 * 8 + 9 * 2 * 4


def test_missing_coordinates_are_the_least(llm):
    n, fan = 1000, 4
    known = {5, 6, 7, 400, 999}
    asked = merkle.missing(known, n, fan)
    tree = {}
    level, digests = 0, [str(k).encode() for k in range(n)]
    while True:
        tree |= {(level, i): x for i, x in enumerate(digests)}
        if len(digests) == 1:
            break
        digests = [merkle._digest(b"".join(digests[a : a + fan])) for a in range(0, len(digests), fan)]
        level += 1
    used = set()
    _, top = merkle.climb({k: tree[0, k] for k in known}, n, lambda lv, i: used.add((lv, i)) or tree[lv, i], fan)
    assert top == tree[level, 0] and used == set(asked) and len(asked) == len(set(asked))
    assert not any((lv, i) in used for k in known for lv in range(level) for i in [k // fan ** lv])


def test_manifest_of_edge_cases(llm, scratch):
    data = [(i, s, g, None if x is None else len(x), x) for i, x, g, s in EDGES] + [(9, "", "en", 0, "")] * 20 + [(None, None, None, None, None)] * 3
    assert manifest(llm, scratch, data)[0] == brute_manifest(data)


def test_manifest_of_no_rows(llm, scratch):
    found, made = manifest(llm, scratch, [])
    assert found == [] and made.root is None


def test_one_changed_row_changes_the_root(llm, scratch):
    data = sample({"a": 40, "b": 5}, 4)
    changed = [data[0][:4] + (data[0][4] + "!",), *data[1:]]
    assert manifest(llm, scratch, data)[1].root != manifest(llm, scratch, changed)[1].root
    assert manifest(llm, scratch, data)[1].root == manifest(llm, scratch, data[::-1])[1].root


# The registered queries


def test_query_op11(llm):
    data = [(r.vec_id, r.embedding, r.label) for r in llm.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expected, digest = brute_codes(data)
    found = entry.queries()["op11_vector_codes"](llm, SF)
    assert rows(found.select("vec_id", "code", "error", "label_error")) == expected
    assert {r[0] for r in found.select("codebooks_sha256").collect()} == {digest}


def test_query_op12(llm, processor):
    found = rows(entry.queries()["op12_token_counts"](llm, SF))
    expected = []
    for r in llm.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(processor.encode(r.text or ""))
        expected.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert found == sorted(expected, key=repr)


def test_query_op13(llm):
    data = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in llm.read.parquet(f"{SF}/documents.parquet").collect()]
    found = entry.queries()["op13_merkle_manifest"](llm, SF)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows(found.select(*names)) == brute_manifest(data)
    assert not all(r.verified for r in found.collect())
