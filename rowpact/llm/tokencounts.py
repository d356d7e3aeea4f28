"""Token counts without token ids: pieces are counted once for each distinct pre-token.

The tokenizer merges neighbouring pieces only where the merged piece is in its vocabulary. So nothing is merged between two characters that no
piece has side by side. Texts are cut there into pre-tokens (between words, and within them, as before most punctuation), and the
tokens of a text are the sum over its pre-tokens. Which characters stand together is read from the vocabulary itself.

1. Each text becomes the frequencies of its distinct pre-tokens, written once, with a number for the row.
2. Distinct pre-tokens of all texts, with frequencies summed before they are shuffled, are encoded, each once, and their number of pieces is kept.
3. These numbers are joined to the rows' frequencies and summed per row. The HOT most frequent pre-tokens, which hold nearly all occurrences, are
   broadcast (at most HOT rows of KEY_BYTES + 1 bytes and a number); the others are joined by shuffle, and as each of them is rarer than HOT others, no
   key is hot there. Sums are made per row before they are shuffled. Pre-tokens longer than KEY_BYTES are joined by their SHA-256.

Defined cases: a null text is empty, has 0 bytes and 0 tokens; rows that repeat are rows of their own; null ids stay; very long texts are cut as
they are read, whole; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from rowpact.llm.common import Scratch

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
HOT = 200_000
KEY_BYTES = 64
#: Characters of a text from which its pre-tokens are counted one by one, not as a list.
LONG = 1 << 20
#: Words whose cuts a worker remembers; then it forgets them all.
CUTS = 400_000
#: Characters of a batch's texts that are taken to an Arrow batch at once.
STEP_CHARS = 4 << 20
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokens:
    """Cuts texts where the vocabulary allows no merge, and counts pieces of what lies between."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2 as model

        about = model.ModelProto()
        with open(path, "rb") as f:
            about.ParseFromString(f.read())
        spec = about.normalizer_spec
        if about.trainer_spec.model_type != model.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError(f"{path}: only BPE models that leave texts as they are can be cut")
        kinds = model.ModelProto.SentencePiece
        if any(x.type == kinds.USER_DEFINED for x in about.pieces):
            raise ValueError(f"{path}: pieces of the user's own can't be cut")
        pieces = [x.piece for x in about.pieces if x.type == kinds.NORMAL and len(x.piece) > 1]
        if any(SPACE in x.lstrip(SPACE) for x in pieces):
            raise ValueError(f"{path}: pieces with white space inside can't be cut")
        self._pairs = {x[k : k + 2] for x in pieces for k in range(len(x) - 1)}
        self._cuts: dict[str, tuple[str, ...]] = {}
        joined = "".join(re.escape(x) for x in sorted(set("".join(pieces)) - {SPACE}))
        self._pattern = re.compile(f"{SPACE}*[{joined}]+|{SPACE}+|[^{joined}{SPACE}]" if joined else f"{SPACE}+|[^{SPACE}]")
        self._prefix = SPACE if spec.add_dummy_prefix else ""
        spec.add_dummy_prefix = False
        self._processor = SentencePieceProcessor(model_proto=about.SerializeToString())

    def _cut(self, word: str) -> tuple[str, ...]:
        at = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self._pairs), len(word)]
        return tuple(word[a:b] for a, b in zip(at, at[1:], strict=False))

    def frequencies(self, text: str) -> dict[str, int]:
        """Pre-tokens of a text: cut beside characters that stand in no piece, then, each word once, between those that never stand together."""
        if not text:
            return {}
        text = self._prefix + text.replace(" ", SPACE)
        words = Counter(self._pattern.findall(text) if len(text) < LONG else (x[0] for x in self._pattern.finditer(text)))
        cuts, out = self._cuts, {}
        if len(cuts) > CUTS:
            cuts.clear()
        for word, n in words.items():
            parts = cuts.get(word)
            if parts is None:
                parts = self._cut(word)
                if len(word) <= KEY_BYTES:
                    cuts[word] = parts
            for part in parts:
                out[part] = out.get(part, 0) + n
        return out

    def pieces(self, tokens: list[str]) -> list[int]:
        return list(map(len, self._processor.encode(tokens, num_threads=1)))


_known: dict[str, PreTokens] = {}


def pretokens(path: str) -> PreTokens:
    """One for each worker: it lasts from task to task."""
    if path not in _known:
        _known[path] = PreTokens(path)
    return _known[path]


def frequencies(docs: DataFrame, path: str, id_column: str, text: str) -> DataFrame:
    """row (a number of its own), doc_id, n_bytes, f (array of pre-token t and how often it comes, n)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batches):
        cut, number = pretokens(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            start, held, size, texts = 0, [], 0, batch.column("text").to_pylist()
            for k, text in enumerate(texts):
                held.append(cut.frequencies(text))
                size += len(text)
                if size < STEP_CHARS and k + 1 < len(texts):
                    continue
                offsets = np.cumsum([0, *map(len, held)])
                flat = pa.StructArray.from_arrays(
                    [pa.array([t for x in held for t in x], pa.string()), pa.array([n for x in held for n in x.values()], pa.int64())], ["t", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + len(held))), batch.column("doc_id").slice(start, len(held)),
                     batch.column("n_bytes").slice(start, len(held)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                    ["row", "doc_id", "n_bytes", "f"])
                start, number, held, size = k + 1, number + len(held), [], 0

    schema = rows.select(F.lit(0).cast("long").alias("row"), "doc_id", "n_bytes", F.array(F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("n"))).alias("f")).schema
    return rows.mapInArrow(run, schema)


def _key(token: Column) -> Column:
    """The token itself, or its hash after a line feed where it is long; no token of that length is its own key."""
    return F.when(F.octet_length(token) > KEY_BYTES, F.concat(F.lit("\n"), F.sha2(token, 256))).otherwise(token)


def distinct_pieces(found: DataFrame, path: str) -> DataFrame:
    """key, n (occurrences), pieces of each distinct pre-token."""
    tokens = found.select(F.explode("f").alias("x")).groupBy(F.col("x.t").alias("t")).agg(F.sum("x.n").alias("n"))

    def run(batches):
        for batch in batches:
            pieces = pretokens(path).pieces(batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pieces, pa.int64())], ["key", "n", "pieces"])

    return tokens.select("t", _key(F.col("t")).alias("key"), "n").mapInArrow(run, "key string, n long, pieces long")


def count(docs: DataFrame, scratch: Scratch, model: str | None = None, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT,
          hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document."""
    path = model or model_path()
    found = scratch.stage(frequencies(docs, path, id_column, text), "frequencies", compression="zstd")
    pieces = scratch.stage(distinct_pieces(found, path), "pieces")
    often = scratch.stage(pieces.orderBy(F.col("n").desc(), "key").limit(hot).select("key", "pieces"), "hot")
    rare = pieces.join(F.broadcast(often.select("key")), "key", "left_anti").select("key", "pieces")
    each = found.select("row", F.explode("f").alias("x")).select("row", _key(F.col("x.t")).alias("key"), F.col("x.n").alias("n"))
    tokens = F.sum(F.col("n") * F.col("pieces")).alias("n_tokens")
    parts = [
        each.join(F.broadcast(often), "key").groupBy("row").agg(tokens),
        each.join(F.broadcast(often.select("key")), "key", "left_anti").join(rare, "key").groupBy("row").agg(tokens)]
    sums = parts[0].unionByName(parts[1]).select("row", F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), "n_tokens")
    every = found.select("row", "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).unionByName(sums)
    whole = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
