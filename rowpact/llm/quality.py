"""Quality rules: thresholds that adapt to language and source, from mergeable quantile sketches; functions of the JVM only.

Base rules fail a text of fewer than MIN_WORDS words, or of which over REPEAT_PERCENT per cent of the words lie in five-word windows
that the text has twice or more. What is left is judged by METRICS. Each metric is a whole number; a sketch of it counts log-linear
buckets (SUB_BITS leading bits, so a value is known to 1/64), and two sketches merge by adding counts. So the sketches
of all (language, source) groups are one grouped count that is summed before it is shuffled, whatever a group's share,
and rereads agree to the row. A group's threshold is its upper quartile plus FENCE times its quartile range, or times the
metric's least range where the group hardly varies; a text above any threshold of its group goes.

Defined cases: a null text has no words and fails; null languages and sources are groups; a group with one text keeps it
if the base rules do; rows that repeat are counted and judged one by one; an empty table gives none; extra columns stay, and
the column of results is named so that it doesn't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowpact.llm.common import Scratch, fresh, lookup

MIN_WORDS = 10
REPEAT_WORDS = 5
REPEAT_PERCENT = 20
FENCE = 3
SUB_BITS = 7
BLANKS = r"[\x20\x09-\x0D]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"

#: Least quartile range of each metric: per thousand characters, per thousand lines, hundredths of a character a word.
METRICS = {"symbol_share": 20, "dup_line_share": 150, "word_length": 200}


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with one more column, and its name: a struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, all long.

    The columns in between are used more than once each, so that they are computed once, before what uses them.
    """
    t, w, h, p, out = fresh(docs, "text_", "words_", "windows_", "places_", "counts")
    own = [F.col(f"`{c}`") for c in docs.columns]
    frame = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias(t))
    frame = frame.select("*", F.array_remove(F.split(t, f"{BLANKS}+"), "").alias(w))
    last = F.size(w) - REPEAT_WORDS
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(REPEAT_WORDS)]))
    frame = frame.select("*", F.when(last > 0, hashed).otherwise(F.array().cast("array<bigint>")).alias(h))
    # Only a text in which some window repeats needs places: windows in order of their hash stand beside their like.
    placed = F.array_sort(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    frame = frame.select("*", F.when(F.size(F.array_distinct(h)) < F.size(h), placed).alias(p))
    at = F.col(p)
    repeated = F.filter(at, lambda x, i: (x["h"] == F.get(at, i - 1)["h"]) | (x["h"] == F.get(at, i + 1)["h"]))
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-REPEAT_WORDS).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(REPEAT_WORDS), x - a["last"])).alias("n")), lambda a: a["n"])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return frame.select(*own, F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, f"{BLANKS}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).alias(out)), out


def base_failed(counts: str) -> Column:
    n = F.col(f"{counts}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{counts}.n_repeat_words") > REPEAT_PERCENT * n)


def metric(name: str, counts: str) -> Column:
    at = lambda c: F.col(f"{counts}.{c}")
    share = lambda n, a, b: F.floor(n * at(a) / F.greatest(at(b), F.lit(1))).cast("long")
    return {"symbol_share": share(1000, "n_symbols", "word_chars"), "dup_line_share": share(1000, "n_dup_lines", "n_lines"),
            "word_length": share(100, "word_chars", "n_words")}[name]


def bucket(value: Column) -> Column:
    """The least value with the same leading SUB_BITS bits."""
    cut = F.greatest(F.length(F.bin(value)) - SUB_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(frame: DataFrame, counts: str, groups: list[str]) -> DataFrame:
    """Groups as g0, g1 ..., metric, bucket, n. Sketches of several tables merge by summing n."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(metric(m, counts)).alias("bucket")) for m in METRICS])
    return (
        frame.filter(~base_failed(counts)).select(*[F.col(f"`{g}`").alias(f"g{k}") for k, g in enumerate(groups)], F.explode(pairs).alias("x"))
        .groupBy(*[f"g{k}" for k in range(len(groups))], "x.metric", "x.bucket").agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame, groups: int) -> DataFrame:
    """Most of each metric, by group."""
    keys = [f"g{k}" for k in range(groups)]
    own = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("all", F.sum("n").over(own))
    quantile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket")))
    q = ranked.groupBy(*keys, "metric").agg(quantile(1).alias("q1"), quantile(3).alias("q3"))
    least = F.element_at(F.create_map(*[F.lit(x) for m, n in METRICS.items() for x in (m, n)]), F.col("metric"))
    most = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, most)).alias(f"most_{m}") for m in METRICS])


def judge(docs: DataFrame, scratch: Scratch, text: str = "text", groups: tuple[str, ...] = ("lang", "source"),
          carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """The documents (the columns carry, or all) with one more column, and its name: the struct of with_counts, base_failed, kept.

    Texts are read once: what is carried is written with its counts, and sketches and verdicts come from there.
    """
    counted, counts = with_counts(docs, text)
    kept_columns = [*dict.fromkeys([*(carry if carry is not None else docs.columns), *groups])]
    counted = scratch.stage(counted.select(*[F.col(f"`{c}`") for c in kept_columns], counts), "counts")
    most = scratch.stage(thresholds(sketches(counted, counts, list(groups)), len(groups)), "thresholds")
    names = {f"g{k}": g for k, g in enumerate(groups)}
    limits = fresh(counted, *[f"most_{m}" for m in METRICS])
    most = most.select(*[F.col(k).alias(g) for k, g in names.items()], *[F.col(f"most_{m}").alias(x) for m, x in zip(METRICS, limits, strict=True)])
    judged = lookup(counted, most, list(groups))
    above = F.lit(False)
    for m, limit in zip(METRICS, limits, strict=True):
        above = above | (metric(m, counts) > F.coalesce(F.col(limit), F.lit(0)))
    failed = base_failed(counts)
    verdict = F.col(counts).withField("base_failed", failed).withField("kept", ~failed & ~above)
    return judged.withColumn(counts, verdict).drop(*limits), counts


def keep_good(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents that are kept."""
    judged, counts = judge(docs, scratch, **options)
    return judged.filter(F.col(f"{counts}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
