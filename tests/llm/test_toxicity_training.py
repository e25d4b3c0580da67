"""Toxicity training and scoring against a plain rewrite, a window, a word and an n-gram at a time."""

import math

import numpy as np
import pytest

from palimpsest.llm import toxicity


def _windows(text):
    words = toxicity.words_of(text)
    starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
    return [words[s : s + toxicity.WINDOW] for s in starts] if words else []


def _mean(vectors):
    return sum(vectors) / len(vectors)


def _plain(texts, toxic, rounds, steps):
    rng = np.random.default_rng(1)
    table, soft, bias = rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.DIMS)), rng.normal(0, 0.1, (toxicity.DIMS, 2)), np.zeros(2)
    bag = {w: toxicity.subwords([w])[0].tolist() for t in texts for w in toxicity.words_of(t)}
    holders = {}
    for d, t in enumerate(texts):
        for b in {b for w in toxicity.words_of(t) for b in bag[w]}:
            holders.setdefault(b, []).append(toxic[d])
    common = {b for b, own in holders.items() if len(own) >= toxicity.LEAST_DOCS}
    for b in set(range(toxicity.BUCKETS)) - common:
        table[b] = 0
    first = {}
    for b, own in holders.items():
        n, bad = len(own), sum(own)
        odds = math.log((bad + 0.5) / (sum(toxic) + 1)) - math.log((n - bad + 0.5) / (len(toxic) - sum(toxic) + 1))
        first[b] = odds * n / (n + toxicity.SHRINK) if b in common else 0.0
    every = [(d, w) for d, t in enumerate(texts) for w in _windows(t)]
    state = {}
    for turn in range(rounds):
        figure = (lambda b: float(table[b] @ (soft[:, 1] - soft[:, 0]))) if turn else first.__getitem__
        value = [_mean([_mean([figure(b) for b in bag[w]]) for w in words]) for _, words in every]
        picked = set()
        for d, bad in enumerate(toxic):
            own = sorted((k for k in range(len(every)) if every[k][0] == d), key=lambda k: -value[k])
            picked |= set(own[: (3 if turn < 2 else 1) if bad else 4])
        picked |= {int(k) for k in rng.choice(len(every), len(every), replace=False) if not toxic[every[k][0]]}
        classes = [toxic[every[k][0]] for k in sorted(picked)]
        for step in range(turn * steps + 1, turn * steps + steps + 1):
            slope = {"soft": np.zeros_like(soft), "bias": np.zeros_like(bias)}
            for k, y in zip(sorted(picked), classes, strict=True):
                words = every[k][1]
                mean = _mean([_mean([table[b] for b in bag[w]]) for w in words])
                p = np.exp(mean @ soft + bias)
                p = (p / p.sum() - np.eye(2)[y]) * 0.5 / classes.count(y)
                slope["soft"] += np.outer(mean, p)
                slope["bias"] += p
                for w in words:
                    for b in bag[w]:
                        slope[b] = slope.get(b, 0) + (soft @ p) / len(words) / len(bag[w]) * (b in common)
            for name, g in slope.items():
                now = {"soft": soft, "bias": bias}[name] if isinstance(name, str) else table[name]
                g = g + (0 if name == "bias" else toxicity.DECAY / 1000 * now)
                a, b = state.get(name, (0, 0))
                state[name] = a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
                now -= toxicity.RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return table @ (soft[:, 1] - soft[:, 0]), bias[1] - bias[0], bag


def test_training_and_scores_match_a_plain_rewrite(monkeypatch):
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(40)]
    texts = [" ".join(rng.choice(pool, n)) for n in (3, 30, 8, 1, 22, 40, 17, 6, 12, 26)] + ["", "one one one"]
    toxic = [1, 1, 0, 0, 1, 0, 0, 1, 0, 0, 0, 1]
    monkeypatch.setattr(toxicity, "ROUNDS", 3)
    monkeypatch.setattr(toxicity, "STEPS", 4)
    figure, bias = toxicity.train(texts, toxic)
    want, want_bias, bag = _plain(texts, toxic, 3, 4)
    assert np.abs(want).max() > 0.05 and np.allclose(figure, want, atol=1e-4) and bias == pytest.approx(want_bias, abs=1e-4)
    for text, score in zip(texts, toxicity.probabilities(texts, figure, bias), strict=True):
        best = max((_mean([_mean([want[b] for b in bag[w]]) for w in words]) for words in _windows(text)), default=0.0)
        assert score == pytest.approx(1 / (1 + math.exp(-best - want_bias)), abs=1e-4)
