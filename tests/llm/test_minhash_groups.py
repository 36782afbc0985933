"""Near-duplicates where groups lie close around the bound, and ids with several texts."""

import random

import pytest

from rankloom.llm import minhash


def shingle_set(text):
    w = (text or "").lower().split()
    return set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()


def smallest_reachable(rows):
    """doc_id -> smallest doc_id that links lead to, over all pairs."""
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if both and 100 * both >= 75 * len(a | b):
                low, high = sorted((find(i), find(j)))
                top[high] = low
    return {i: find(i) for i in top}


def around_the_bound(n, seed=3):
    """Texts that share a base of 300 words, with as many words changed as brings pairs to about the bound."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(r.choice([5, 6, 7, 8, 9])):
            words[r.randrange(300)] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("tile", [minhash.TILE, 40])
def test_group_around_the_bound_and_ids_with_several_texts(spark, tile):
    rows = around_the_bound(250)
    rows += [(5, "one other text of some words"), (900, "one other text of some words"), (5, "one other text of some words")]
    want = smallest_reachable(rows)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tile=tile).collect()
    assert len(found) == len(rows) and len(set(want.values())) > 50
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in found)


def test_tiles_give_links_not_pairs():
    """Rows out of the second pass follow members, whatever the number of similar pairs."""
    import numpy as np

    n = 120
    sets = [np.arange(i, i + 1000, dtype=np.uint64) for i in range(n)]
    args = (np.arange(n), np.arange(n), None, np.full(n, 1000.0), sets.__getitem__, 75)
    for volume in (10**9, 5000):
        assert len(list(minhash.linked_pairs(*args, volume))) == n - 1
    halves = (np.arange(n), np.arange(n), np.arange(n) % 2, np.full(n, 1000.0), sets.__getitem__, 75, 10**9)
    assert len(list(minhash.linked_pairs(*halves))) == n - 1
