"""phrases are looked up as they pass their text; no text is copied for each of its phrases."""

from pyspark.sql import functions as F

from palimpsest.operators import phrases


def test_one_shuffle_serves_all_phrases(spark):
    texts = spark.createDataFrame([(1, ["a"] * 500), (2, ["b", None, "b"])], "example_id long, words array<string>")
    asked = texts.select("example_id", F.posexplode("words").alias("phrase_id", "w")).select("example_id", "phrase_id", F.array("w", "w").alias("phrase"))
    found = phrases.phrase_places(texts, asked)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert found.count() == 500 * 499


def test_runs_by_number():
    words = [*"abcabcab", None, *"ab"]
    runs = phrases.Runs(words)
    for n in range(1, 12):
        for i in range(len(words) - n + 1):
            p = words[i : i + n]
            assert runs.of(p) == [j for j in range(len(words) - n + 1) if words[j : j + n] == p]
    assert runs.of(["z"]) == runs.of(["a", "c"]) == runs.of([*"abcabcab", None, *"abz"]) == []
