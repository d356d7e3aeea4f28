"""Line dedup by winnowing over line hashes; functions of the JVM only.

Lines are what stands between line feeds, compared without outer white space; blank lines take no part and stay. A run of RUN lines
or more, or of fewer lines with more than WORDS words in all, that stands somewhere earlier (by document id, then place) is deleted
where it comes again, in the same document too.

1. Windows are RUN neighbouring lines, and fewer of them where these have more than WORDS words. Of each the least line hash is
   selected: equal windows select the same one, so every repeat has a selected fingerprint in common. Fingerprints are counted,
   summed before they are shuffled.
2. Places whose fingerprint comes twice or more are joined to these (Spark splits the partition of a fingerprint of very many places).
3. From there a match is extended both ways: each window round the fingerprint is compared as a whole, and of
   each the first place in the corpus is found. Windows that come later are deleted; those that overlap are one run. As every run
   that counts is the union of its windows, none is lost. Windows are equal if their fingerprint and a hash over the
   hashes and checksums of all their lines are (128 bits).

Only hashes and places move until the documents are cut, which takes one join by document.

Defined cases: a null text stays null and has no lines; null ids come first; rows of one id and different texts are ordered by a
hash of the text; rows that are equal in id and text are one place and are cut alike; an empty table gives none; extra columns stay,
and result columns are named so that they don't clash.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from rowpact.llm.common import Scratch, fresh, lookup

RUN = 3
WORDS = 50
_TRIM = "\x20\x09\x0b\x0c\x0d"
_BLANKS = "[\x20\x09\x0b\x0c\x0d]+"


def _lines(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc_id, same (tells texts of an id apart), and of the lines that aren't blank h (hashes), c (checksums), w (words)."""
    trimmed = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_TRIM)))
    frame = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text)).alias("same"), F.array_remove(trimmed, "").alias("lines"))
    return frame.select(
        "doc_id", "same", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("lines", lambda x: (F.crc32(x) - F.lit(1 << 31)).cast("int")).alias("c"),
        F.transform("lines", lambda x: F.size(F.split(x, _BLANKS))).alias("w")).dropDuplicates(["doc_id", "same"])


def _windows(lines: int, run: int, words: int) -> Column:
    """All windows of so many lines that count: i (place), k (lines), least (h, p of the line selected), whole."""
    places = F.when(F.size("h") >= lines, F.sequence(F.lit(0), F.size("h") - lines)).otherwise(F.array().cast("array<int>"))
    if lines < run:
        places = F.filter(places, lambda i: functools.reduce(operator.add, [F.get("w", i + j) for j in range(lines)]) > words)
    return F.transform(places, lambda i: F.struct(
        i.alias("i"), F.lit(lines).alias("k"),
        F.array_min(F.array(*[F.struct(F.get("h", i + j).alias("h"), (i + j).alias("p")) for j in range(lines)])).alias("least"),
        F.xxhash64(*[F.get(x, i + j) for j in range(lines) for x in ("h", "c")]).alias("whole")))


def repeats(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """doc_id, same, gone: for each document with later repeated runs, the places (from 0, blank lines not counted) of their lines."""
    lines = scratch.stage(_lines(docs, id_column, text), "lines")
    groups = lines.select("doc_id", "same", F.concat(*[_windows(k, run, words) for k in range(1, run + 1)]).alias("g"))
    # Places selected by several windows of a document count once.
    prints = groups.select(F.explode(F.array_distinct(F.transform("g", lambda x: x["least"]))).alias("x"))
    shared = prints.groupBy(F.col("x.h").alias("print")).agg(F.count("*").alias("n")).filter("n > 1").select("print", F.lit(True).alias("shared"))
    shared = scratch.stage(shared, "shared")
    places = groups.select("doc_id", "same", F.explode("g").alias("g")).select(
        "doc_id", "same", "g.i", "g.k", F.col("g.least.h").alias("print"), "g.whole")
    near = scratch.stage(lookup(places, shared, ["print"]).filter("shared").drop("shared"), "near")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "same", "i")
    firsts = near.groupBy("print", "whole").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("print", "whole", "first")
    firsts = scratch.stage(firsts, "firsts")
    later = lookup(near, firsts, ["print", "whole"]).filter(F.col("first").isNotNull() & (place > F.col("first")))
    covered = later.select("doc_id", "same", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("k") - 1)).alias("p"))
    return covered.groupBy("doc_id", "same").agg(F.sort_array(F.collect_set("p")).alias("gone"))


def cut(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text: str = "text", run: int = RUN,
        words: int = WORDS) -> tuple[DataFrame, str]:
    """The documents without their later repeated runs, with one more column, and its name: a struct of n_lines (not blank),
    n_removed, n_runs."""
    gone = repeats(docs, scratch, id_column, text, run, words).select(F.col("doc_id").alias("g_id"), F.col("same").alias("g_same"), "gone")
    same, places, lines, kept, out = fresh(docs, "same", "places", "lines", "kept", "line_counts")
    gone = gone.withColumnRenamed("gone", places)
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(same, F.xxhash64(F.col(text)))
    rows = keyed.join(gone, keyed[id_column].eqNullSafe(gone["g_id"]) & (keyed[same] == gone["g_same"]), "left").select(*own, places)
    rows = rows.withColumn(lines, F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    # The lines' places, blank ones left out, to find those that go; numbers are told apart by hashing, however many there are.
    full = F.filter(F.transform(lines, lambda x, j: F.when(F.btrim(x, F.lit(_TRIM)) != "", j).otherwise(F.lit(-1))), lambda j: j >= 0)
    rows = rows.withColumn(kept, full)
    went = F.transform(places, lambda p: F.get(kept, p))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), went)
    new = F.when(F.col(places).isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda j: F.get(lines, j)), "\n"))
    gaps = F.filter(places, lambda p, k: (k == 0) | (p - F.get(places, k - 1) > 1))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    counts = F.struct(size(F.col(kept)).alias("n_lines"), F.when(F.col(places).isNull(), 0).otherwise(size(F.col(places))).cast("long").alias("n_removed"),
                      F.when(F.col(places).isNull(), 0).otherwise(size(gaps)).cast("long").alias("n_runs"))
    return rows.select(*[new.alias(text) if c == text else own[k] for k, c in enumerate(docs.columns)], counts.alias(out)), out
