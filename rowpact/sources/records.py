"""CSV records out of blocks of lines, so that one large file with quoted line breaks is read by all cores.

Spark's text source splits files into blocks of whole lines. Whether a line begins a record depends on the quotes before it in the file:
it does if their number is even. A block can't know that alone, but it can say how many quotes it has, odd or even, and how many
records begin in it in either case. Running totals of these over the blocks of a file, one row per block, then pick the case and
number the records. Lines that are a record of their own, nearly all, stay where they are; only the lines of records
that span lines are brought together, by record.

The lines are written once, with what is known of them inside their block, so that later settings, or another number of executors,
can't deal them out anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

QUOTE = '"'
#: Rows of the table of blocks up to which it is broadcast: a path, two numbers and a flag each.
BROADCAST_BLOCKS = 1_000_000
#: Batches of a file that a task takes although it needs the first record only: a task that stops early loses its worker.
DRAINED = 64
#: What a line without anything else holds does not count as a record.
_BLANKS = "".join(map(chr, range(0x21)))
_FACTS = "_line string, _file string, _block long, _id long, _odd boolean, _open boolean, _even_start long, _odd_start long"
#: Records that span lines: line breaks stand inside quoted fields only. No part of the pattern is tried twice.
_FIELD = r'(?:[ \t]*+"(?:[^"]++|"")*+"[^,"\r\n]*+|[^,"\r\n][^,\r\n]*+|)'
SPANNING = rf"\A{_FIELD}(?:,{_FIELD})*+\z"


class MalformedCsv(ValueError):
    """A quote that is never closed, or a line with quotes that can't be told apart from one."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """_line, _file, _block: lines end at a line feed; a carriage return before it stays."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def line_facts(batches):
    """Adds what a block knows of its lines, in order: place, odd number of quotes, whether the quotes before it in the block leave one open, and
    how many records have begun up to it if the block begins outside quotes, or inside."""
    now, at, opened, starts = None, 0, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        line, file, block = batch.column(0), batch.column(1), batch.column(2)
        quotes = pc.count_substring(line, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64) & 1
        blank = pc.equal(pc.binary_length(pc.ascii_trim(line, characters=_BLANKS)), 0).to_numpy(zero_copy_only=False)
        ends = pc.run_end_encode(pc.binary_join_element_wise(file, block.cast(pa.string()), "\n")).run_ends.to_pylist()
        opens, places = np.empty(len(quotes), np.int64), np.empty(len(quotes), np.int64)
        counts = [np.empty(len(quotes), np.int64), np.empty(len(quotes), np.int64)]
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            key = file[a].as_py(), block[a].as_py()
            if key != now:
                now, at, opened, starts = key, 0, 0, [0, 0]
            total = np.cumsum(quotes[a:b]) + opened
            opens[a:b] = (total - quotes[a:b]) & 1
            places[a:b] = np.arange(at, at + b - a)
            for case in (0, 1):
                counts[case][a:b] = starts[case] + np.cumsum((opens[a:b] == case) & ~blank[a:b])
                starts[case] = int(counts[case][b - 1])
            at, opened = at + b - a, int(total[-1]) & 1
        yield pa.RecordBatch.from_arrays(
            [line, file, block, pa.array(places), pa.array(quotes.astype(bool)), pa.array(opens.astype(bool)), pa.array(counts[0]), pa.array(counts[1])],
            ["_line", "_file", "_block", "_id", "_odd", "_open", "_even_start", "_odd_start"])


def with_facts(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).mapInArrow(line_facts, _FACTS)


def blocks_of(facts: DataFrame) -> DataFrame:
    """One row for each block: whether it begins inside quotes (_inside), the records that begin before it in its file (_before) and in it (_begun),
    whether its own quotes are odd (_parity), and whether a line's are (_spans)."""
    per = facts.groupBy("_file", "_block").agg(
        F.bit_xor(F.col("_odd").cast("int")).alias("_parity"), F.bool_or("_odd").alias("_spans"), F.max("_even_start").alias("_even"), F.max("_odd_start").alias("_odds"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = per.withColumn("_inside", F.coalesce(F.sum("_parity").over(before), F.lit(0)) % 2 == 1)
    begun = inside.withColumn("_begun", F.when(F.col("_inside"), F.col("_odds")).otherwise(F.col("_even")))
    return begun.select("_file", "_block", "_inside", F.coalesce(F.sum("_begun").over(before), F.lit(0)).alias("_before"), "_begun", "_parity", "_spans")


def files_of(blocks: DataFrame) -> DataFrame:
    """_file, _records (the header is one), _parity."""
    return blocks.groupBy("_file").agg(F.sum("_begun").alias("_records"), F.bit_xor("_parity").alias("_parity"))


def known_of(blocks: DataFrame) -> tuple[int, bool]:
    """How many blocks there are, and whether a record may span lines. A file that ends inside quotes is an error."""
    last = F.max_by(F.col("_inside") != (F.col("_parity") == 1), "_block")
    files = blocks.groupBy("_file").agg(last.alias("_open"), F.count("*").alias("_n"), F.bool_or("_spans").alias("_spans"))
    known = files.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.bool_or("_spans"), F.lit(False)).alias("spans"),
                      F.min(F.when(F.col("_open"), F.col("_file"))).alias("wrong")).first()
    if known["wrong"]:
        raise MalformedCsv(f"{known['wrong']} has a quote that is never closed")
    return known["n"], known["spans"]


def records(staged: DataFrame, blocks: DataFrame) -> DataFrame:
    """_file, _record (its number in the file, from 1; the header is the first), _text (without the line end)."""
    n, spans = known_of(blocks)
    known = blocks.select("_file", "_block", "_inside", "_before")
    placed = staged.join(F.broadcast(known) if n <= BROADCAST_BLOCKS else known, ["_file", "_block"], "left")
    begun = F.when(F.col("_inside"), F.col("_odd_start")).otherwise(F.col("_even_start"))
    number = F.coalesce("_before", F.raise_error(F.lit("a block of the input was not counted")).cast("long")) + begun
    placed = placed.select("_file", "_block", "_id", "_line", "_odd", number.alias("_record"), (F.col("_open") != F.col("_inside")).alias("_goes_on"))
    alone = ~F.col("_goes_on") & ~F.col("_odd")
    single = placed.filter(alone & (F.btrim("_line", F.lit(_BLANKS)) != "")).select("_file", "_record", _line_end(F.col("_line")).alias("_text"))
    if not spans:
        return single
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("_block", "_id", "_line")))["_line"], "\n")
    spanning = placed.filter(~alone).groupBy("_file", "_record").agg(_line_end(joined).alias("_text"))
    checked = F.when(F.col("_text").rlike(SPANNING), F.col("_text")).otherwise(F.raise_error(F.concat(
        F.lit("[MALFORMED_CSV_RECORD] a quote inside a field that has none around it, in "), F.col("_file"), F.lit(", record "), F.col("_record").cast("string"))))
    return single.unionByName(spanning.select("_file", "_record", checked.alias("_text")))


def _line_end(text: Column) -> Column:
    """Without the carriage return of its end."""
    return F.when(text.endswith("\r"), text.substr(F.lit(1), F.length(text) - 1)).otherwise(text)


def first_records(spark: SparkSession, path: str) -> DataFrame:
    """_file, _text: the first record of every file, in one job of one task per file; of a long file only the beginning is read."""
    apart = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name in ("maxPartitionBytes", "openCostInBytes"):
        apart.conf.set(f"spark.sql.files.{name}", str(1 << 50))

    def first(batches):
        held, file, quotes, done = [], None, 0, False
        for number, batch in enumerate(batches):
            if done and number > DRAINED:
                break
            for line, name in zip(*(batch.column(c).to_pylist() if not done else () for c in (0, 1)), strict=True):
                if not held and not line.strip(_BLANKS):
                    continue
                file = name
                held.append(line)
                quotes += line.count(QUOTE)
                if done := quotes % 2 == 0:
                    break
        if held:
            text = "\n".join(held)
            yield pa.RecordBatch.from_pydict({"_file": [file], "_text": [text.removesuffix("\r")]})

    return lines(apart, path).mapInArrow(first, "_file string, _text string")
