"""The chain over lines: exact gradient, exact marginals in segments, texts of any length."""

import resource
import time
from itertools import product

import numpy as np

from rankloom.llm import quality


def log_likelihood(x, lines, y, w, beta, tie):
    """The mean over chains, weighted, by enumeration of all labellings."""
    odds, at, total = x @ beta, 0, 0.0
    for n in lines:
        value = lambda labels: sum(o for o, l in zip(odds[at : at + n], labels) if l) + tie * sum(a == b for a, b in zip(labels, labels[1:]))  # noqa: E731, B023
        total += w[at] * (value(y[at : at + n]) - np.log(sum(np.exp(value(c)) for c in product((0, 1), repeat=int(n)))))
        at += n
    return total / w.sum()


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(4)
    lines = np.array([3, 1, 5, 2])
    x, y = r.normal(size=(11, 4)), r.integers(0, 2, 11).astype(float)
    w, beta, tie, step = np.repeat(r.random(4) + 0.5, lines), r.normal(size=4), 0.6, 1e-5
    slope, pull = quality.gradient(x, lines, y, w, beta, tie)
    for k in range(4):
        e = np.eye(4)[k] * step
        assert np.isclose(slope[k], (log_likelihood(x, lines, y, w, beta + e, tie) - log_likelihood(x, lines, y, w, beta - e, tie)) / (2 * step), atol=1e-7)
    assert np.isclose(pull, (log_likelihood(x, lines, y, w, beta, tie + step) - log_likelihood(x, lines, y, w, beta, tie - step)) / (2 * step), atol=1e-7)


def test_segments_change_nothing():
    r = np.random.default_rng(5)
    lines = np.array([1, 40, 7, 300, 2, 64])
    odds = r.normal(size=lines.sum()) * 8
    odds[50] = 400.0
    want = quality.marginals(odds, lines, 1.1)
    for segment in (1, 2, 5, 64):
        assert np.allclose(quality.marginals(odds, lines, 1.1, segment), want, atol=1e-9)


def test_blocks_change_nothing(monkeypatch):
    r = np.random.default_rng(6)
    texts = ["", "one line", "\n\n", "same\nsame\nsame\n" * 20, "x" * 500, "\n".join("ab c. |!" * r.integers(0, 9) for _ in range(90))]
    beta = r.normal(size=3 * quality.line_features(["a"])[0].shape[1] + 1)
    x, size, lines = quality.line_features(texts)
    want = quality.with_neighbours(x, lines) @ beta
    for piece in (10, 37, 1 << 20):
        monkeypatch.setattr(quality, "PIECE", piece)
        odds, sizes, counts = quality.evidence(texts, beta)
        assert np.allclose(odds, want) and sizes.tolist() == size.tolist() and counts.tolist() == lines.tolist()


def test_a_million_lines_in_little_time_and_memory():
    width = 3 * quality.line_features(["a"])[0].shape[1] + 1
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    value = quality.aggregate(*quality.evidence(["\n" * 1_000_000, "z" * 20_000_000], np.linspace(-1, 1, width)), 0.8)
    assert np.isfinite(value).all() and time.time() - began < 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000


def test_training_sample_is_bounded_by_lines(spark):
    rows = [(i, ("good words here.\n" if i % 2 else "| | !\n") * (1 + i), i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    beta, tie, curve = quality.fit(train, train.select("doc_id", "label"), most_lines=300)
    assert np.isfinite(beta).all() and 0 <= tie <= 1.5
    odd = spark.createDataFrame([(1, "good words here.\n", "x"), (2, "| | !\n", "y")], "doc_id long, text string, SCORE string")
    found = {r.doc_id: r.score for r in quality.score(odd, (beta, tie, curve)).collect()}
    assert found[1] > found[2]
