"""A corpus made ready for training, stage by stage; each stage's output is written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowpact.llm import decontaminate, jaccard, mixing, quality, repair
from rowpact.llm.common import Scratch

#: Near copies of the pipeline: shingles of five words, 80 of 100 in common.
SHINGLE, THRESHOLD = 5, 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Operator 6: documents that the quality rules reject go."""
    return quality.keep_good(docs, scratch or Scratch(spark))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Operator 9: of copies and near copies one document stays."""
    return jaccard.keep_one(docs, scratch or Scratch(spark), shingle=SHINGLE, threshold=THRESHOLD)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Operator 1: contaminated documents go."""
    return decontaminate.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch or Scratch(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Operator 3: sources repeated or cut to their targets."""
    return mixing.mixed_documents(docs, scratch or Scratch(spark))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Operator 10: written as token ids and read back."""
    return repair.read(repair.write(docs, scratch or Scratch(spark)))


#: Functions of (spark, docs, sf_dir), and of the scratch folder to use, which is the caller's to drop once the output is written.
STAGES: list[tuple[str, Callable[..., DataFrame]]] = [
    ("quality rules", good),
    ("n-gram Jaccard join", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", token_ids),
]

#: Stages with tokenizers, hashes and iteration: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written for itself goes when its output is written; the result reads the last one's files."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        own = Scratch(spark)
        out = stage(spark, docs, sf_dir, own)
        if k == len(STAGES) - 1:
            return out
        written = Scratch(spark)
        docs = written.stage(out, f"{k}-{name}")
        own.drop()
        if before is not None:
            before.drop()
        before = written
    return docs
