"""The registered decontamination query against the edit distance of every item to every document."""

import numpy as np
import pytest

from palimpsest.llm import decontam, queries

WORDS = [f"w{k}" for k in range(400)]


def _distance(item, doc):
    """The smallest edit distance of the item to a part of the document, by plain dynamic programming."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(doc, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("even", [True, False])
def test_query_reaches_its_recall_at_the_limit(spark, tmp_path, even):
    rng = np.random.default_rng(11)
    items, docs = [], []
    for k in range(168):
        n = 5 + k % 56
        item = [str(w) for w in rng.choice(WORDS, n)]
        edits = int(n * 0.2 + 1e-9)
        places = [(e + 1) * n // (edits + 1) for e in range(edits)] if even else rng.choice(n, edits, replace=False).tolist()
        words = list(item)
        for at in sorted(places, reverse=True):
            kind = int(rng.integers(3))
            words[at : at + (kind != 1)] = [] if kind == 2 else [f"new{at}"]
        around = [[str(w) for w in rng.choice(WORDS, int(rng.integers(0, 12)))] for _ in range(2)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([*around[0], *words, *around[1]])))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in queries.op8_decontamination(spark, str(tmp_path)).collect()}
    want = {}
    for i, item in items:
        item = item.split()
        for d, doc in docs[: 1 if i else None] + [docs[i]]:
            distance = _distance(item, doc.split())
            if distance <= int(len(item) * 0.2 + 1e-9):
                want[d, i] = distance
    assert len(want) >= 168
    for (d, i), distance in got.items():
        if (d, i) in want:
            assert distance == want[d, i]
        else:
            assert _distance(items[i][1].split(), docs[d][1].split()) == distance
    met = [[(d, i) in got for d, i in want if lo <= len(items[i][1].split()) < hi] for lo, hi in ((5, 10), (10, 20), (20, 40), (40, 61))]
    assert all(met[0]), "short items are looked up exactly"
    assert all(np.mean(m) >= 0.9 for m in met), [np.mean(m) for m in met]
    assert np.mean([x for m in met for x in m]) >= 0.95


@pytest.mark.parametrize("similarity", [0.7, 0.8, 0.9])
def test_plan_holds_for_other_trials(similarity):
    ways = decontam.plan(similarity)
    rng = np.random.default_rng(99)
    for shortest, *_ in ways:
        edits, hits = int(shortest * (1 - similarity) + 1e-9), 0
        for t in range(200):
            item = [str(w) for w in rng.choice(WORDS, shortest, replace=False)]
            edited = decontam._edited(rng, np.arange(shortest), edits, bool(t % 2), 1000)
            text = " ".join(item[w] if w < 1000 else "new" for w in edited)
            hits += bool(decontam.leaks(decontam.Benchmark([(1, " ".join(item))], similarity), [text]))
        assert hits >= 0.92 * 200


def test_intact_runs():
    for size in range(1, 30):
        for edits in range(size):
            run = decontam.intact_run(size, edits)
            assert run * (edits + 1) >= size - edits > (run - 1) * (edits + 1)


def test_one_long_text_and_one_long_item(spark):
    rng = np.random.default_rng(5)
    item = " ".join(rng.choice(WORDS, 3000))
    doc = " ".join(rng.choice(WORDS, 150_000)) + " " + item + " end"
    items = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    docs = spark.createDataFrame([(7, doc, "x")], "doc_id long, text string, item_id string")
    assert sorted(tuple(r) for r in decontam.find_leaks(docs, items).collect()) == [(7, i, 0, 3000, 150_000) for i in (1, 2)]
    assert decontam.drop_contaminated(docs, items).count() == 0
