"""Merkle manifests: brute force over hard rows and several levels of blocks, and the layout's arithmetic."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from rankloom.llm import merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest int, root string"


def H(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H(["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(nodes, arity):
    """The levels of a tree, from its leaves."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][a : a + arity]) for a in range(0, len(levels[-1]), arity)])
    return levels


def beside(levels, i, arity):
    out = []
    for nodes in levels[:-1]:
        a = i // arity * arity
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + arity])))
        i //= arity
    return out


def plain(rows, arity):
    trees = defaultdict(list)
    for r in rows:
        r = r[:5]
        leaf, tampered = leaf_of(*r), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        text = r[1]
        if tampered and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees[r[3]].append((r[0] is not None, r[0] or 0, leaf, leaf_of(r[0], text, *r[2:]), r[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], arity) for s in trees}
    crown = climb([built[s][-1][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, changed, doc_id) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            way = beside(built[s], i, arity) + beside(crown, k, arity)
            h = changed
            for a, b in way:
                h = H([a, h, b])
            out.append((doc_id, leaf, built[s][-1][0], crown[-1][0], H([a + b for a, b in way]), h, h == crown[-1][0]))
    return sorted(map(str, out))


def hard_rows():
    rows = [(i, f"Text {i} É", "en", f"s{i % 3}", i) for i in range(70)]
    rows += [(100 + i, "One", None, f"only{i}", None) for i in range(20)]
    rows += [(5, "Repeated", "de", "s1", 1)] * 40 + [(5, "repeated", "de", "s1", 1), (None, None, None, None, None), (None, "A", "en", None, 1), (None, "A", "en", None, 1), (-3, "", "", "", 0), (2**62 + 1, "B", "en", "s0", 2), (7, None, "en", "1", 3)]
    return [(*r, "x", 1, "y") for r in rows]


@pytest.mark.parametrize(("arity", "height"), [(16, 3), (2, 2), (3, 1)])
def test_equals_brute_force(spark, arity, height):
    rows = hard_rows()
    leaves = merkle.document_leaves(spark.createDataFrame(rows, DDL).repartition(3))
    got = merkle.prove(leaves, height, arity).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows, arity)


def test_lone_leaf_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "X", "en", "s", 1, "t", 0, "r")], DDL)
    assert [str(tuple(r)) for r in merkle.manifest(docs).collect()] == plain([(1, "X", "en", "s", 1)], 16)
    empty = merkle.manifest(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize(("arity", "levels"), [(2, 7), (3, 4), (16, 4), (5, 1)])
def test_layout_is_a_bijection_with_whole_subtrees(arity, levels):
    """Every place once; a subtree of the lower half lies in one stretch, as does the upper half."""
    places = [merkle.address(d, np.arange(arity**d), levels, arity) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_in(arity, levels)))
    assert places[0].tolist() == [0]
    upper = levels // 2
    if levels > 1:
        size = merkle.nodes_in(arity, upper)
        assert {p for d in range(upper) for p in places[d].tolist()} == set(range(size))
        lower = merkle.nodes_in(arity, levels - upper)
        for k in range(arity**upper):
            mine = [p for d in range(upper, levels) for p in places[d][k * arity ** (d - upper) : (k + 1) * arity ** (d - upper)].tolist()]
            assert sorted(mine) == list(range(size + k * lower, size + (k + 1) * lower))
