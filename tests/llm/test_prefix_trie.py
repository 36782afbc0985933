"""The conversation trie against brute force, and tree contraction on trees of all shapes."""

import math
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from rankloom.llm import prefix_trie, tree_sums


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    ends = lambda k: sha256(",".join(map(str, sorted(c for c in members[k] if len(made[c]) == len(k)))).encode()).hexdigest()
    return sorted(str((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], ends(k))) for k, m in members.items())


def hard_rows():
    r = random.Random(5)
    rows = []
    for c in range(60):
        rows += [(c, t, ("user", "assistant")[t % 2], f"say {r.randint(0, 2)} é") for t in range(r.randint(1, 9))]
    rows += [(200 + c, t, "user", "the same") for c in range(0, 100, 5) for t in range(4)]  # a group of copies
    rows += [(300, t, "user", f"long {t}") for t in range(120)]
    rows += [(401, None, None, None), (401, None, None, None), (402, 1, "a", None), (402, 1, "b", ""), (402, None, "z", "first"), (None, 1, "user", "lost"), (None, None, None, None), (500, 3, "user", "x"), (500, 3, "user", "x"), (998, 1, "user", "gone")]
    return rows + [(-7, 0, "user", "below zero"), (-10, 0, "user", "below"), (-10, 1, "user", "zero")]


def test_trie_equals_brute_force(spark):
    rows = [(*r, 1, "x") for r in hard_rows()]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int, depth string").repartition(3)
    got = prefix_trie.trie(table).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)


def test_no_conversations(spark):
    table = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(table).count() == 0
    assert prefix_trie.trie(table.limit(0)).count() == 0


def test_ends_in_texts_of_few_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    where = spark.range(100).select((F.col("id") % 2).alias("depth"), F.lit(3).cast("long").alias("head"), F.col("id").alias("conv_id"))
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie.ends(where).collect()}
    assert got == {d: sha256(",".join(str(i) for i in range(d, 100, 2)).encode()).hexdigest() for d in (0, 1)}


def shapes():
    r = random.Random(9)
    yield "chain", [None, *range(199)]
    yield "star", [None, *[0] * 300]
    yield "random", [None, *[r.randrange(i) for i in range(1, 400)]]
    yield "caterpillar", [None, *[i - 1 if i % 2 else max(0, i - 2) for i in range(1, 200)]]
    yield "forest", [None if i % 50 == 0 else i - 1 - r.randrange(min(3, i % 50)) for i in range(200)]


@pytest.mark.parametrize(("name", "parents"), list(shapes()))
def test_subtree_totals(spark, name, parents):
    n = len(parents)
    kids = [0] * n
    for p in parents:
        if p is not None:
            kids[p] += 1
    total = [[i + 1, 1] for i in range(n)]
    for i in range(n - 1, -1, -1):
        if parents[i] is not None:
            assert parents[i] < i
            total[parents[i]] = [a + b for a, b in zip(total[parents[i]], total[i])]
    nodes = spark.createDataFrame([(i, p, kids[i], i + 1, 1) for i, p in enumerate(parents)], "node long, parent long, children long, a long, b long")
    got = {r["node"]: [r["a"], r["b"]] for r in tree_sums.subtree_totals(nodes, ["a", "b"]).collect()}
    assert got == dict(enumerate(total))
