"""Keys of an edited text from those of the texts that it is made of."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm import winnowing


@pytest.mark.parametrize(("k", "window"), [(4, 8), (2, 4), (1, 2)])
def test_joined_keys_are_those_of_the_joined_text(spark, k, window):
    rng = random.Random(5)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = []
    for case in range(240):
        # Few signs give equal hashes, so that ties between windows and repeated keys occur.
        alphabet = ["ab", "a", "ab c\n", "aé😀 　xyzuvw", "abcdefghijkl mn\t"][case % 5]
        sizes = [rng.choice([0, 1, 2, 15, 16, 45, 46, 47, 48, 93, 120, 400]) for _ in range(2)]
        own, after = (word(alphabet, n) for n in sizes)
        rows.append((case, own, after, own[: rng.choice([0, 1, 15, len(own) // 2, len(own)])], after[: rng.choice([0, 1, 16, 46, len(after) // 2, len(after)])]))
    df = spark.createDataFrame(rows, "doc_id long, own_text string, next_text string, head string, tail string")
    df = winnowing.with_keys(df, {"own": "own_text", "next_own": "next_text"}, k, window)
    df = winnowing.with_joined_keys(df, k, window)
    df = winnowing.with_keys(df.withColumn("edited", F.concat("head", "tail")), {"plain": "edited"}, k, window)
    found = df.select("doc_id", "new", "plain").collect()
    assert len(found) == 240
    assert [r.doc_id for r in found if r.new != r.plain] == []


def test_edited_texts_are_not_hashed_anew(spark, monkeypatch):
    """Only the signs around a joint are hashed again: 92 a row, whatever the texts."""
    rows = [(n, "".join(chr(97 + (x * x * 31 + n) % 26) for x in range(5000))) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    longest, plain = [], winnowing.with_keys

    def counted(df, texts, *more):
        longest.extend(df.agg(F.max(F.char_length(t))).first()[0] for t in texts.values())
        return plain(df, texts, *more)

    monkeypatch.setattr(winnowing, "with_keys", counted)
    winnowing.edited_fingerprints(docs)
    assert longest == [5000, 92]
