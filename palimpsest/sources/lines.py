"""Line-aligned and beam files as tables, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.sources.shared import cut


def read_lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(line_no, column): the lines of a text file, or of a folder's files in the order of their names, numbered from 0.

    Spark reads files in an order of its own and long ones in parts, so a line is placed by its file's name and its
    part's start, both of which the scan gives, and by its place in the part. The parts' line counts, a row for each
    part, are summed up and sent to the lines; no line is shuffled.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias(column), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"),
    )
    # Spark's own parts are in the order of their numbers, which outgrow their five digits.
    number = F.regexp_extract("_file", r"/part-([0-9]+)[^/]*$", 1)
    order = Window.orderBy(F.when(number != "", number.cast("long")), "_file", "_start")
    parts = raw.groupBy("_file", "_start").agg(F.count("*").alias("_lines"), F.min("_row").alias("_first"))
    parts = parts.withColumn("_before", F.sum("_lines").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.select("_file", "_start", "_first", F.coalesce("_before", F.lit(0)).alias("_before"))
    return raw.join(F.broadcast(parts), ["_file", "_start"]).select((F.col("_before") + F.col("_row") - F.col("_first")).alias("line_no"), column)


def _all_there(joined: DataFrame, marks: list[str], key: str, say: str) -> DataFrame:
    """A full outer join's rows; one that has no partner on a side is an error that names it. The check is part of the
    result, so no job of its own counts anything."""
    whole = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in marks])
    alone = F.raise_error(F.concat(F.lit(f"{say}, such as {key} "), F.col(key).cast("string")))
    return joined.where(whole | alone.cast("boolean")).drop(*marks)


def read_parallel_lines(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(line_no, one column for each file); a line that only some of the files have is an error of the query that meets it."""
    parts = [read_lines(spark, path, column).withColumn(f"_has_{k}", F.lit(True)) for k, (column, path) in enumerate(paths.items())]
    joined = reduce(lambda a, b: a.join(b, "line_no", "full_outer"), parts)
    return _all_there(joined, [f"_has_{k}" for k in range(len(parts))], "line_no", "files of different lengths")


def align_eval(spark: SparkSession, paths: dict[str, str], preds: str, nbest: int = 1) -> DataFrame:
    """(example_id, beam_rank, pred, one column for each of paths): nbest lines of preds for each line of the others;
    any other relation of their lengths is an error, by one count of a file of lines and one of the candidates."""
    column, path = next(iter(paths.items()))
    if (lines := read_lines(spark, path, column).count()) * nbest != (candidates := read_lines(spark, preds, "pred").count()):
        raise ValueError(f"{candidates} candidates are not {nbest} for each of {lines} lines")
    return read_parallel_lines(spark, paths).withColumnRenamed("line_no", "example_id").join(_beams(spark, preds, nbest), "example_id")


def write_parallel_lines(rows: DataFrame, paths: dict[str, str]) -> None:
    """A text folder for each column, in the order of line_no; line breaks inside a value become spaces. The rows are
    dealt into ranges of line_no and sorted once, and kept while the columns are written."""
    line = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\r\n]+", " ").alias(c)
    placed = rows.select("line_no", *[line(c) for c in paths]).orderBy("line_no").persist()
    for column, path in paths.items():
        placed.select(F.col(column).alias("value")).write.text(path)
    placed.unpersist()


def read_beam_lines(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(example_id, beam_rank, pred): k lines belong to an example; other counts are an error."""
    if (n := read_lines(spark, path, "pred").count()) % k:
        raise ValueError(f"{n} lines are no multiple of {k}")
    return _beams(spark, path, k)


def _beams(spark: SparkSession, path: str, k: int) -> DataFrame:
    return read_lines(spark, path, "pred").select(F.expr(f"line_no div {k}").alias("example_id"), (F.col("line_no") % k).cast("int").alias("beam_rank"), "pred")


def write_beam_lines(beams: DataFrame, path: str) -> None:
    beams.orderBy("example_id", "beam_rank").select(F.regexp_replace(F.coalesce("pred", F.lit("")), "[\r\n]+", " ").alias("value")).write.text(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """One record of a one-row table."""
    summary.coalesce(1).write.json(path)


def merge_gap_check(shards: DataFrame) -> DataFrame:
    """One row: ids, and whether they are 0 to n-1 without a gap."""
    ids = shards.select("id").distinct()
    return ids.agg(F.count("*").alias("ids"), F.coalesce((F.min("id") == 0) & (F.max("id") + 1 == F.count("*")), F.lit(True)).alias("gapless"))


#: Counts of range parts that are sent to all rows; beyond, rows and counts are joined by part.
SMALL_PARTS = 1_000_000


def number_rows(rows: DataFrame, order: list[str], within: list[str], out: str = "line_no") -> DataFrame:
    """Adds ``out``, counted from 0 inside each value of the columns ``within`` in the given order.

    Rows are dealt into ranges of (within, order) and sorted there, so a group of any size is spread over many tasks. A
    row's number is its place in its range and group, and the rows of the group in the ranges before: these counts, a row
    for each range and group, are summed up. The order should be total; rows that tie in it are numbered in any order, but
    once. Null is a value like others. A column named as ``out`` is replaced, others stay, whatever their names.
    """
    keys = [F.col(f"row.`{c}`").alias(f"key{k}") for k, c in enumerate([*within, *order])]
    groups = [f"key{k}" for k in range(len(within))]
    sort = [f"key{k}" for k in range(len(keys))]
    dealt = rows.drop(out).select(F.struct("*").alias("row")).select("row", *keys)
    placed = dealt.repartitionByRange(*sort).sortWithinPartitions(*sort).select("row", *groups, F.monotonically_increasing_id().alias("at"))
    placed = cut(placed).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part", *groups).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    held = cut(counts.select("part", *[F.col(g).alias(f"{g}_") for g in groups], (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")))
    if held.count() <= SMALL_PARTS:
        held = F.broadcast(held)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in groups], placed["part"] == held["part"])
    return placed.join(held, same).select("row.*", (F.col("at") + F.col("shift")).alias(out))
