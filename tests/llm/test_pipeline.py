"""The five stages, each against what brute force makes of its own input."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from rowpact.llm import repair
from tests.llm.test_documents import BLANKS, brute_components, brute_contamination, brute_counts, brute_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(llm):
    from rowpact.llm.common import Scratch

    written, docs, found = Scratch(llm), llm.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows, columns = docs.collect(), docs.columns
        docs = written.stage(stage(llm, docs, SF), str(k))
        found.append((rows, docs.collect(), columns, docs.columns))
    yield found
    written.drop()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "decontamination", "mixing", "token ids"]


def test_columns_stay(stages):
    assert all(before == after for _, _, before, after in stages[:-1])


def test_quality_keeps_clean_documents(stages):
    before, after, *_ = stages[0]
    labels = duckdb.connect().execute(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1").fetchall()
    kept = {r["doc_id"] for r in after}
    for r in before:
        n = brute_counts(r["text"])
        if n[0] < 10 or 100 * n[4] > 20 * n[0]:
            assert r["doc_id"] not in kept
        elif (r["doc_id"],) in labels:
            assert r["doc_id"] in kept


def test_one_of_each_group_stays(stages):
    before, after, *_ = stages[1]
    groups = {c for _, n, c in brute_components([(r["doc_id"], r["text"]) for r in before], 80, 5)}
    assert sorted(r["doc_id"] for r in after) == sorted(groups)


def test_near_copies_between_80_and_90_of_100_go(llm, documents):
    """Sets of five-word shingles with a known share in common, on either side of the bound."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    rows, expected = [], []
    for k, appended in enumerate([0, 5, 11, 18, 24, 25, 26, 40]):
        base = [words[x] for x in rng.permutation(4000)[:104]]  # 100 shingles
        rows += [(10 * k, " ".join(base), "en", "a"), (10 * k + 1, " ".join([*base, *(f"x{k}y{j}" for j in range(appended))]), "en", "a")]
        expected += [10 * k] if 100 * 100 >= 80 * (100 + appended) else [10 * k, 10 * k + 1]
    kept = corpus_pipeline.one_of_each(llm, documents(rows), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


def test_contaminated_documents_go(stages):
    before, after, *_ = stages[2]
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    clean = [d for d, *_, bad in brute_contamination([(r["doc_id"], r["text"]) for r in before], items) if not bad]
    assert sorted(clean) == sorted(r["doc_id"] for r in after) and len(after) < len(before)


def test_sources_meet_their_targets(stages):
    before, after, *_ = stages[3]
    sizes, words = {}, {}
    for table, of in ((before, sizes), (after, words)):
        for r in table:
            of[r["source"]] = of.get(r["source"], 0) + len(BLANKS.findall(r["text"] or ""))
    expected = brute_targets(sizes)
    assert all(abs(words.get(s, 0) - t) <= 1 for s, t in expected.items())


def test_ids_are_the_tokenizer_s(stages):
    from tokenizers import Tokenizer

    before, after, *_ = stages[4]
    tokenizer, start, expected = Tokenizer.from_file(repair.tokenizer_path()), 0, []
    for r in sorted(before, key=lambda r: (r["doc_id"], r["text"].encode())):
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, repair.END]
        expected.append((start, r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after) == expected
