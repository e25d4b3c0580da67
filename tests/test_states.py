"""States of corpus metrics: merged, from files and from streams with late and repeated examples."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import metrics, states

ROWS = "example_id long, src string, ref string, pred string"


def _rows(n):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choices("abcde", k=rnd.randint(0, 12)))
    return [(k, text(), text(), text()) for k in range(n)]


def _scores(df):
    stats = metrics.overlap_stats(df)
    return (df.count(), metrics.corpus_bleu(stats).first().corpus_bleu, metrics.corpus_gleu(stats).first().corpus_gleu)


def test_states_of_parts_give_the_whole(spark):
    df = spark.createDataFrame(_rows(90), ROWS)
    want = _scores(df)
    parts = [states.corpus_state(metrics.overlap_stats(df.where(F.col("example_id") % 3 == k))) for k in range(3)]
    none = states.corpus_state(metrics.overlap_stats(df.limit(0)))
    every = parts[2].unionAll(parts[0]).unionAll(none).unionAll(parts[1]).unionAll(spark.createDataFrame([(None,)], "state string"))
    assert tuple(states.state_scores(states.merge_states(every)).first()) == want
    assert tuple(states.state_scores(states.corpus_state(metrics.overlap_stats(df))).first()) == want
    # Merging in two steps, by groups, is the same.
    grouped = states.merge_states(every.withColumn("g", F.pmod(F.hash("state"), F.lit(2))), ("g",))
    assert tuple(states.state_scores(states.merge_states(grouped)).first()) == want
    assert states.state_scores(none).count() == 0
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        states.merge_states(spark.createDataFrame([("no state",)], "state string")).collect()


def test_a_folder_counts_every_example_once(spark, tmp_path):
    rows = _rows(60)
    df = spark.createDataFrame(rows, ROWS)
    at = str(tmp_path / "kept")
    batch = lambda a, b: spark.createDataFrame([*rows[a:b], *rows[a : a + 3], (None, "x", "y", "z")], ROWS)
    states.add_batch(at, batch(0, 20), 0)
    # Late and repeated rows, and a batch that is given again after it failed half way or as a whole.
    states.add_batch(at, batch(10, 40), 1)
    states.add_batch(at, batch(10, 40), 1)
    states.add_batch(at, batch(30, 60), 2)
    states.add_batch(at, df.limit(0), 3)
    assert tuple(states.state_scores(states.merge_states(states.read_states(spark, at))).first()) == _scores(df)
    assert states.read_states(spark, at).count() == 4


def test_a_stream_keeps_a_folder_up(spark, tmp_path):
    rows = _rows(40)
    df = spark.createDataFrame(rows, ROWS)
    source, at, offsets = (str(tmp_path / x) for x in ("rows", "kept", "offsets"))
    df.where("example_id < 25").repartition(3).write.parquet(source)

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        states.keep_up(stream, at, offsets, availableNow=True).awaitTermination()
        return tuple(states.state_scores(states.merge_states(states.read_states(spark, at))).first())

    assert run() == _scores(df.where("example_id < 25"))
    df.where("example_id >= 15").repartition(2).write.mode("append").parquet(source)
    assert run() == _scores(df)
