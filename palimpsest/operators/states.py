"""States of corpus metrics: what is known of the examples so far, small, kept in files, and mergeable.

A state is the sums that a corpus metric's formula takes. States of different examples are merged by adding them; the
order does not count. A folder of states is kept up by batches, or by a stream whose batches are given to it: every batch
leaves its state and its examples' ids, an id that another batch has brought is not counted again, however late it
comes, and a batch that is repeated after a failure replaces what it left the first time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import metrics
from palimpsest.sources.shared import cut

#: The sums of a state, in order; all are counts.
FIELDS = [*(f"{kind}{n}" for kind in ("num", "den", "gnum", "gden") for n in metrics.N), "hlen", "rlen", "examples"]
_KIND = ", ".join(f"{f} long" for f in FIELDS)


def corpus_state(stats: DataFrame) -> DataFrame:
    """One row: state, a string, of the examples of overlap_stats; that of an empty table has zeros."""
    sums = metrics.corpus_sums(stats)
    return sums.select(F.to_json(F.struct(*[F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f) for f in FIELDS])).alias("state"))


def _opened(state: Column) -> Column:
    return F.from_json(state, _KIND, {"mode": "FAILFAST"})


def merge_states(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., state): the sums of all states, null ones left out; a string that is no state is an error. Adding is done
    by an aggregate, so any number of states is merged where they are before they meet."""
    opened = states.where(F.col("state").isNotNull()).select(*by, _opened(F.col("state")).alias("s"))
    total = F.struct(*[F.coalesce(F.sum(f"s.{f}"), F.lit(0)).alias(f) for f in FIELDS])
    return opened.groupBy(*by).agg(F.to_json(total).alias("state"))


def state_scores(states: DataFrame, method: str = "method1") -> DataFrame:
    """(examples, corpus_bleu, corpus_gleu) of each row's state; a state without examples has no scores."""
    sums = states.select(_opened(F.col("state")).alias("s")).select("s.*").where("examples > 0")
    gleu = metrics._gleu(metrics._cols("gnum"), metrics._cols("gden"), F.col("hlen"), F.col("rlen"), False)
    return metrics.bleu_of_sums(sums.withColumn("corpus_gleu", F.round(gleu, 6)), method, ("corpus_gleu",))


def _ids(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The ids of all batches so far with the batch that brought them; none for a new folder."""
    empty = spark.createDataFrame([], f"example_id {kind}, batch long")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ids")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty
    return spark.read.schema(empty.schema).parquet(f"{folder}/ids")


def add_batch(folder: str, rows: DataFrame, batch: int) -> None:
    """Adds the rows' state to a folder under a batch's number. rows: example_id, src, ref, pred.

    Of rows with one id the least by (ref, pred, src) counts, and none if another batch had the id. Null ids do not count.
    The ids are written before the state, and a state counts only with them, so a batch that failed between the two can be
    given again."""
    spark = rows.sparkSession
    kind = rows.schema["example_id"].dataType.simpleString()
    once = rows.where(F.col("example_id").isNotNull()).groupBy("example_id").agg(F.min(F.struct("ref", "pred", "src")).alias("r")).select("example_id", "r.*")
    others = _ids(spark, folder, kind).where(F.col("batch") != batch).select("example_id")
    new = cut(once.join(others, "example_id", "left_anti"))
    new.select("example_id").write.mode("overwrite").parquet(f"{folder}/ids/batch={batch}")
    corpus_state(metrics.overlap_stats(new)).write.mode("overwrite").parquet(f"{folder}/states/batch={batch}")


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """(state, batch) of a folder."""
    return spark.read.schema("state string, batch long").parquet(f"{folder}/states")


def keep_up(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream of (example_id, src, ref, pred) into a folder of states; the trigger's words go to Spark."""
    query = stream.writeStream.foreachBatch(lambda rows, batch: add_batch(folder, rows, batch)).option("checkpointLocation", checkpoint)
    return query.trigger(**trigger).start() if trigger else query.start()
