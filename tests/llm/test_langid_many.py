"""Language inference over many languages, in slices, against estimation over all languages at once."""

import numpy as np
import pytest

from palimpsest.llm import langid


def _model(langs, seed=2):
    rng = np.random.default_rng(seed)
    table = np.log(rng.dirichlet(np.full(langid.BUCKETS, 0.5), 5) + 1e-9).T
    return (table[:, rng.integers(0, 5, langs)] + rng.normal(0, 0.4, (langid.BUCKETS, langs))).astype(np.float32)


def _texts(n=30, seed=3):
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    return ["", "12 34", *(" ".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(n)), "ä" * 3000]


def _likelihoods(text, table):
    bucket, word, _ = langid.trigrams([text])
    logs = np.array([table[bucket[word == w]].astype(float).sum(axis=0) for w in np.unique(word)])
    return np.exp(logs - logs.max(axis=1, keepdims=True))


def test_few_active_languages_reach_the_best_likelihood_over_all():
    table = _model(60)
    for text in _texts()[2:]:
        like = _likelihoods(text, table)
        n = np.array([len(like)])
        order = np.argsort(-np.log(np.maximum(like, 1e-300)).sum(axis=0))[None]
        share, value, gap = langid._full_mixture(like, n, order)
        assert share.sum() == pytest.approx(1) and value[0] == pytest.approx(np.log(np.maximum(like @ share[0], 1e-300)).sum())
        # Plain expectation-maximisation over all languages, for long.
        own = np.full(60, 1 / 60)
        for _ in range(3000):
            own = (like * own / np.maximum(like @ own, 1e-300)[:, None]).mean(axis=0)
        best = np.log(np.maximum(like @ own, 1e-300)).sum()
        assert value[0] + gap[0] >= best - 1e-6 and value[0] >= best - 2 * langid.TOLERANCE


@pytest.mark.parametrize("langs", [1, 3, 40])
def test_slices_of_any_size_give_the_same(langs, monkeypatch):
    table, texts = _model(langs), _texts()
    known, shares = langid.infer(texts, table)
    assert known.tolist() == [False, False] + [True] * (len(texts) - 2)
    assert np.allclose(shares[2:].sum(axis=1), 1) and not shares[:2].any()
    for cells in (1, 700, 40_000):
        monkeypatch.setattr(langid, "CELLS", cells)
        again = langid.infer(texts, table)
        assert (again[0] == known).all() and np.allclose(again[1], shares, atol=1e-9)


def test_a_model_has_one_column_of_figures_for_each_language(spark):
    docs = spark.createDataFrame([("b", "aaa bbb"), ("a", "ccc"), (None, "ddd"), ("b", None), ("c", "123")], "lang string, text string")
    names, table = langid.fit(docs)
    assert names == ["a", "b"]  # a language without a letter is not learned
    for k, text in ((0, "ccc"), (1, "aaa bbb")):
        want = np.full(langid.BUCKETS, langid.SMOOTH)
        np.add.at(want, langid.trigrams([text])[0], 1)
        assert np.array_equal(table[:, k], np.log(want / want.sum()).astype(np.float32))
