"""What the quality model learns from: all chosen documents, however long some are."""

import time

import numpy as np
import pytest

from rankloom.llm import quality


@pytest.mark.parametrize(("lines", "most", "want"), [([1, 2, 3], 6, 3), ([1, 2, 3], 5, 2), ([5, 5, 5], 9, 3), ([1] * 10, 4, 1), ([7], 3, 3), ([1, 1, 100, 1000], 50, 24)])
def test_lines_of_each(lines, most, want):
    assert quality.lines_each(np.array(lines), most) == want


def test_long_texts_leave_all_others_in(spark, monkeypatch):
    """400 short labelled documents beside 4 of 190,000 lines."""
    good, bad = "The house stood by the river, and they walked home.", "| buy | now | click |"
    rows = [(i, "\n".join([(good, bad)[i % 2]] * 3), i % 2 == 0) for i in range(400)]
    rows += [(1000 + i, "\n".join([(good, bad)[i % 2]] * 190_000), i % 2 == 0) for i in range(4)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, label int")
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda x, lines, *a: seen.append(lines) or train(x, lines, *a))
    began = time.time()
    model = quality.fit(docs, labels)
    assert time.time() - began < 30
    assert len(seen[0]) == 404 and seen[0].sum() <= 60_000 and (seen[0] == 3).sum() == 400
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 0) for i in range(400))
