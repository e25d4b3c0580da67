"""Ranked lexical search against the SQL twin and a plain rewrite."""

import math
import random
import re

import numpy as np
import pytest

import oracle
from palimpsest.llm import lexical, queries

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def _terms(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in own]


def _slow(docs, items, k=10):
    held = [(i, _terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    out = []
    for item in {i for i, _ in items}:
        wanted = {w for i, t in items if i == item for w in _terms(t)}
        scored = []
        for at, (i, own) in enumerate(held):
            score = 0
            for w in wanted & set(own):
                df = sum(w in x for _, x in held)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += weight * ((1_000_000_000 * own.count(w)) // (1000 * own.count(w) + 8 * (10 + (90 * len(own) * n_docs) // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0, at))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def _got(spark, docs, items, **more):
    got = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    return sorted(map(tuple, got.collect()), key=str)


def test_search_matches_sql(spark, sf):
    oracle.compare(queries.op12_lexical(spark, sf), queries.ORACLE_SQL["op12_lexical"], sf)


def test_search_matches_plain_rewrite(spark, monkeypatch):
    """Ties, repeated rows, null ids and texts, long texts, terms beyond ASCII, several passes, small tiles."""
    rnd = random.Random(3)
    pool = ["a", "B2", "été", "Été", "漢字", "İx", "x_y", "K", "zz"]
    docs = [(rnd.choice([None, *range(40)]), " ".join(rnd.choices(pool, k=rnd.randint(0, 12)))) for _ in range(120)]
    docs += [(7, None), (8, ""), (9, "a " * 50_000 + "zz"), (50, ".,;"), *[(i, "same words b2") for i in (3, 2, 2, 1)]]
    items = [(i, " ".join(rnd.choices(pool, k=3))) for i in range(12)] + [(3, "zz b2"), (None, "k a"), (90, None), (91, "absent"), (92, ",")]
    monkeypatch.setattr(lexical, "ITEM_TILE", 3)
    want = _slow(docs, items)
    assert _got(spark, docs, items) == want == _got(spark, docs, items, max_pairs=5)
    assert _got(spark, docs, items, k=2) == _slow(docs, items, 2)


def test_search_of_empty_tables(spark):
    assert _got(spark, [], [(1, "a")]) == _got(spark, [(1, "a")], []) == _got(spark, [], []) == _got(spark, [(1, None)], [(1, "a")]) == []


def test_search_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1.0, 2)], f"{DOCS}, score string, rank double, salt int")
    items = spark.createDataFrame([(5, "b", "x")], f"{ITEMS}, term string")
    assert [r[:3] for r in lexical.search(docs, items).collect()] == [(5, 1, 1)]


@pytest.mark.parametrize("largest", [10, 2**26, 2**50])
def test_products_stay_exact(largest):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, largest, (5, 300)), rng.integers(0, 8, (300, 4))
    assert (lexical.multiply(a.astype(float), b.astype(float)) == a @ b).all()


def test_best_keeps_ties_of_the_smaller_document():
    best = lexical.Best(2, 1)
    for ids, scores in (([9, 8], [5, 5]), ([7, 6], [5, 4]), ([1, 2], [5, 0])):
        best.offer(0, np.array(scores)[:, None], np.array(ids), np.zeros(2, dtype=bool))
        best.settle()
    assert best.doc.tolist() == [1, 7] and best.score.tolist() == [5, 5]
