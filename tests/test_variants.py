"""The chooser among variants against a plain greedy loop."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import variants


def plain(sets, worth, most, least_apart, barred=(), prior=()):
    before, out = [p for p in prior if p in sets], []
    while len(out) < most:
        covered = set().union(*[sets[c] for c in before])
        gains = {v: round(sum(worth[i] for i in s - covered), 6) for v, s in sets.items() if v not in before and v not in barred and v not in prior and all(len(s ^ sets[c]) >= least_apart for c in before)}
        best = min(gains, key=lambda v: (-gains[v], v), default=None)
        if best is None or gains[best] <= 0:
            break
        out.append((len(out) + 1, best, len(sets[best]), gains[best]))
        before.append(best)
    return out


@pytest.mark.parametrize(("seed", "batch", "prior", "barred"), [(1, 1, (), ()), (2, 3, ("v03",), ("v05", "v06")), (3, 50, ("gone", "v01", "v02"), ())])
def test_choices_equal_a_plain_greedy_loop(spark, seed, batch, prior, barred):
    rng = random.Random(seed)
    sets = {f"v{n:02}": set(rng.sample(range(120), rng.randint(5, 50))) for n in range(14)}
    sets["v13"] = set(sorted(sets["v00"])[1:])  # too near to v00
    sets["v12"] = set(sets["v11"])
    worth = {i: rng.choice([0, 1, 1, 2, 5]) for i in range(120)}
    rows = spark.createDataFrame([(v, i, worth[i]) for v, s in sets.items() for i in s], "name string, id long, w int")
    found = variants.choose(rows, 8, 6, F.col("w"), barred, prior, batch)
    want = plain(sets, worth, 8, 6, barred, prior)
    assert [tuple(r) for r in found.collect()] == want
    assert len(want) >= 3


def test_hard_rows(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), (None, 2, 1.0), ("b", None, 1.0), ("c", 3, -2.0), ("d", 3, None)], "name string, id long, w double")
    assert [tuple(r) for r in variants.choose(rows, 9, 0, F.col("w")).collect()] == [(1, "a", 1, 1.0)]
    assert variants.choose(rows.where("id > 9"), 9, 0).collect() == []
    assert [r.name for r in variants.choose(rows, 9, 0).collect()] == ["a", "c"]
