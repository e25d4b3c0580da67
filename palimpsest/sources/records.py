"""Nested result records: k-best results, per-example scores, texts for outside scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import dataset_text
from palimpsest.sources.lines import number_rows, write_parallel_lines

#: A record on disk: a candidate is a list of its text, the text to score, and the base score.
BEAM_JSON = "id long, src string, ref string, `full-src` string, `full-ref` string, `full-beam-pred` array<array<string>>, `pred-edits` string, rerank_pred string"
_FLAT = {"full-src": "full_src", "full-ref": "full_ref", "pred-edits": "pred_edits"}


def read_beam_json(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """(example_id, src, ref, full_src, full_ref, pred_edits, rerank_pred, beam_rank, pred, seq_to_score, base_score):
    a row for each candidate. Records stand a line each, or with one_array all in one list, which one task then reads."""
    raw = spark.read.schema(BEAM_JSON).json(path, multiLine=one_array)
    long = raw.select(F.col("id").alias("example_id"), "src", "ref", *[F.col(f"`{a}`").alias(b) for a, b in _FLAT.items()], "rerank_pred", F.posexplode("full-beam-pred").alias("beam_rank", "x"))
    return long.select(*[c for c in long.columns if c != "x"], F.col("x")[0].alias("pred"), F.col("x")[1].alias("seq_to_score"), F.col("x")[2].cast("double").alias("base_score"))


def beam_records(beams: DataFrame) -> DataFrame:
    """A record for each example, its k candidates in rank order. beams: the table that read_beam_json gives."""
    one = {c: F.first(c) for c in ("src", "ref", "full_src", "full_ref", "pred_edits", "rerank_pred")}
    back = {b: a for a, b in _FLAT.items()}
    found = F.array_sort(F.collect_list(F.struct("beam_rank", "pred", "seq_to_score", "base_score")))
    rows = F.transform(found, lambda b: F.array(b["pred"], b["seq_to_score"], b["base_score"].cast("string")))
    return beams.groupBy(F.col("example_id").alias("id")).agg(*[v.alias(back.get(k, k)) for k, v in one.items()], rows.alias("full-beam-pred"))


def write_beam_json(beams: DataFrame, path: str) -> None:
    beam_records(beams).write.json(path)


def write_scores_json(long: DataFrame, path: str) -> None:
    """A folder for each metric, in it a record for each example, in order: scores grow with the corpus, so no record
    holds all of them. long: example_id, metric, value."""
    long.select("metric", "example_id", "value").repartitionByRange("metric", "example_id").sortWithinPartitions("metric", "example_id").write.partitionBy("metric").json(path)


def write_eval_text(rows: DataFrame, paths: dict[str, str]) -> None:
    """src, ref and pred as line files, comments by their sub-tokens. rows: dataset, line_no and the columns of paths."""
    write_parallel_lines(rows.select("line_no", *[dataset_text(F.col("dataset"), F.col(c)).alias(c) for c in paths]), paths)


def write_edit_dataset(rows: DataFrame, path: str) -> None:
    """Parquet by dataset and split, rows numbered inside each. rows: dataset, split, example_id and any others."""
    number_rows(rows, ["example_id"], ["dataset", "split"]).write.partitionBy("dataset", "split").parquet(path)
