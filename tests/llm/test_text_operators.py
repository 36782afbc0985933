"""Operators on documents: each against the library or brute force, and on hard cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from rankloom.llm import bpe, language_id, minhash, packing, quality, suffix_dedup, token_counts, toxicity, winnowing
from rankloom.llm.components import components

SCHEMA = "doc_id long, text string, score double, n long, row string, key long"
rng = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "epsi", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "nu", "xi", "the", "of", "é", "日本", "😀"]
LONG = " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(6000))
PASSAGE = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(60))


def made():
    """Nulls, empty and long texts, copies, near copies, repeated rows and ties."""
    texts = [None, "", " \n\t ", "one", "one", LONG, LONG + " end", PASSAGE, "x " + PASSAGE + " y", "In threen.\n" * 60, "z" * 500, "<|endoftext|> a <|startoftext|>", "Σίσυφος É é", "1 2 3"]
    for _ in range(12):
        base = [rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(80)]
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            for _ in range(rng.randint(1, 4)):
                near[rng.randrange(80)] = "new" + str(rng.randint(0, 9))
            texts.append(" ".join(near))
    rows = [(i, t, 1.0, 2, "r", 3) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[0], (None, "null id " + PASSAGE, 1.0, 2, "r", 3)]


CORPUS = made()


def corpus():
    return CORPUS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of():
    return {i: t or "" for i, t, *_ in corpus()}


def test_packing_keeps_every_token_once(docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    pieces = defaultdict(set)
    for r in rows:
        pieces[r.doc_id].add((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, text in texts_of().items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, path).count() == 0


def test_placements_fit_and_fill():
    r = random.Random(2)
    for _ in range(30):
        hist = Counter(r.randint(1, 64) for _ in range(r.randint(0, 400)))
        room, ranks = defaultdict(int), Counter()
        placed = packing.place(hist, 64)
        for k, (size, rank, each, first, offset) in enumerate(placed):
            following = [p for p in placed[k + 1 :] if p[0] == size]
            end = following[0][1] if following else hist[size]
            assert rank == ranks[size]
            for x in range(rank, end):
                seq, off = first + (x - rank) // each, offset + (x - rank) % each * size
                assert off == room[seq]
                room[seq] += size
            ranks[size] = end
        assert ranks == hist and all(v <= 64 for v in room.values())
        if sum(hist.values()):
            assert len(room) <= 1.35 * sum(k * v for k, v in hist.items()) / 64 + 1


def test_near_duplicates_match_brute_force(docs, none):
    sets = {}
    for i, text in texts_of().items():
        w = text.encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    sets.pop(None)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    for r in minhash.near_duplicates(docs, tile=3).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(none).count() == 0


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(1)
    values = r.integers(0, 2**63, 3000).astype(np.uint64)
    h = minhash.signatures([values[:2000], values[500:2500], np.zeros(0, np.uint64)], 512)
    assert abs((h[0] == h[1]).mean() - 1500 / 2500) < 0.08 and np.isinf(h[2]).all()


def test_components_follow_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_by_brute_force(texts, length=100):
    seen, out = set(), {}
    for i, text in sorted(texts.items(), key=lambda x: -1 if x[0] is None else x[0]):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), kept)
    return out


@pytest.mark.parametrize("most", [None, 200])
def test_repeats_match_brute_force(docs, none, monkeypatch, most):
    if most:
        length = suffix_dedup.resolve_partition
        monkeypatch.setattr(suffix_dedup, "resolve_partition", lambda n: tight(length, n))
    want = removed_by_brute_force(texts_of())
    for r in suffix_dedup.without_repeats(docs).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert suffix_dedup.without_repeats(none).count() == 0


def tight(resolve, n):
    """The same function with room for very few bytes of one hash in its task."""

    def run(batches):
        suffix_dedup.MOST = 200
        yield from resolve(n)(batches)

    return run


def test_language(spark, docs, none):
    path = P.path("piece_bpe_32k.model")
    english, german = "the house is near the river and they walked", "das haus ist nahe dem fluss und sie gingen"
    rows = [(i, " ".join(rng.sample((english, german)[i % 2].split(), 8)), ("en", "de")[i % 2]) for i in range(60)]
    model = language_id.fit(spark.createDataFrame([*rows, (99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string"), path)
    tests = [(1, "they walked to the house"), (2, "sie gingen und das haus"), (3, "123 !!"), (4, None), (5, "")]
    found = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(tests, "doc_id long, text string"), model, path).collect()}
    assert [found[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.identify(docs.select("doc_id", "text", "n"), model, path).count() == len(corpus())
    assert language_id.identify(none.select("doc_id", "text"), model, path).count() == 0
    nothing = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"), path)
    assert {r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), nothing, path).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = [language_id.START, "a", "b", "ab", language_id.START + "a", "ba"]
    p = np.array([0.1, 0.2, 0.3, 0.15, 0.05, 0.2])

    def chance(word):
        if not word:
            return 1.0
        return chance(word[1:]) * language_id.UNKNOWN + sum(q * chance(word[len(s) :]) for s, q in zip(pieces, p) if word.startswith(s))

    lattice = language_id.Lattice(pieces)
    for word in ("▁ab", "▁abba", "▁c", "▁aabab"):
        got = language_id.forward(lattice.numbers([word]), np.append(p, 0.0)[:, None])[0, -1, 0]
        assert got == pytest.approx(chance(word), rel=1e-9)
        for part in (1, 2, 100):
            assert language_id.long_logs(word, lattice, np.append(p, 0.0)[:, None], part)[0] == pytest.approx(np.log(chance(word)), rel=1e-9)


def test_long_runs_are_summed_across_parts_and_long_pieces_are_used(spark):
    path = P.path("piece_bpe_32k.model")
    pieces = language_id.vocabulary(path)
    assert max(map(len, pieces)) > 10
    lattice = language_id.Lattice(pieces)
    r = np.random.default_rng(1)
    probs = np.vstack([r.dirichlet(np.ones(len(pieces)), 3).T, np.zeros((1, 3))])
    word = language_id.START + "internationalisation" * 12
    whole = np.log(language_id.forward(lattice.numbers([word[:30]]), probs)[0, -1])
    assert np.allclose(language_id.long_logs(word[:30], lattice, probs), whole)
    logs = [language_id.long_logs(word, lattice, probs, part) for part in (7, 64, 10**6)]
    assert np.allclose(logs[0], logs[1]) and np.allclose(logs[0], logs[2]) and np.isfinite(logs[0]).all()
    # A run of 15,000 letters, and columns named as the new ones.
    rows = [(i, ("abc ", "xyz ", "日本語 ")[i % 3] * 20, f"l{i % 9}") for i in range(90)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path)
    assert len(model[0]) == 9
    odd = spark.createDataFrame([(1, "日本語" * 5_000, "x", 2)], "doc_id long, text string, Score string, lang_pred int")
    row = language_id.identify(odd, model, path).first()
    assert int(row.lang_pred[1:]) % 3 == 2 and 0 < row.score <= 1


def test_token_counts_reuse_the_cache(spark, docs, none, tmp_path):
    import sentencepiece

    path, cache = P.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(2):
        rows = token_counts.token_counts(docs, path, cache, limit=100).collect()
        assert len(rows) == len(corpus())
        for r in rows:
            text = texts_of()[r.doc_id]
            n = len(library.encode(text))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in corpus()})
    assert token_counts.token_counts(none, path).count() == 0


def test_fingerprints(docs, none):
    from pyspark.sql import functions as F

    rows = winnowing.edited_fingerprints(docs).collect()
    assert len(rows) == len(corpus())
    order = sorted(((-(i if i is not None else -1), t or "", i) for i, t, *_ in corpus()))
    want = Counter()
    for k, (_, text, i) in enumerate(order):
        half, after = len(text) // 2, order[(k + 1) % len(order)][1]
        want[i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    prints = defaultdict(set)
    for r in rows:
        prints[texts_of()[r.doc_id] if r.doc_id is not None else "null"].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in prints.values())
    assert winnowing.edited_fingerprints(none).count() == 0
    near = winnowing.with_keys(docs.where(F.col("doc_id").isin(7, 8)).select("doc_id", F.col("text").alias("t")), {"own": "t"})
    sets = {r.doc_id: {x >> 31 for x in r.own} for r in near.collect()}
    assert len(sets[7] & sets[8]) > 0.7 * len(sets[7])


def test_next_rows_over_many_ranges(spark):
    r = random.Random(9)
    ids = [*r.sample(range(-(10**6), 10**6), 200), *range(50), 7, 7, 2**62, None, None]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter((a, b[1]) for a, b in zip(order, order[1:] + order[:1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for coarse, fine in ((512, 128), (4, 16), (3, 1)):
        found = winnowing.with_next(df, ["text"], bucket_rows=5, coarse=coarse, fine=fine).collect()
        assert Counter(((x.doc_id, x.text), x.next_text) for x in found) == want


def winnowed(text, k=4, window=8):
    """Positions that winnowing keeps, by plain loops over the k-grams' own order of hashes."""
    gone = "".join(text.split())
    n = len(gone)
    grams = [gone[i : i + 4 * k] for i in range(max(1, n - 4 * k + 1))] if n else []
    return gone, grams


def test_fingerprints_match_plain_loops(spark):
    """The kept positions are those of the smallest hash of each window, the rightmost of equal ones."""
    texts = [t for _, t, *_ in corpus() if t][:14] + ["日本語" * 30, "ab" * 200, "a" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    all_keys = {r.doc_id: r.own for r in winnowing.with_keys(df, {"own": "t"}, window=1, k=4).select("doc_id", "own").collect()}
    # With windows of four neighbours every hash of four in a row can be told; wider windows must choose among them.
    wide = {r.doc_id: r.own for r in winnowing.with_keys(df, {"own": "t"}).select("doc_id", "own").collect()}
    for i, text in enumerate(texts):
        gone, grams = winnowed(text)
        places = [winnowing.LOW - (x & winnowing.LOW) for x in wide[i]]
        assert set(wide[i]) <= set(all_keys[i])
        assert places == sorted(places) and all(b - a <= 32 for a, b in zip(places, places[1:]))
        if len(grams) > 32:
            assert places[0] < 32 and places[-1] >= len(grams) - 32
            known = {winnowing.LOW - (x & winnowing.LOW): x >> 31 for x in all_keys[i]}
            for begin in range(len(grams) - 31):
                inside = {p: h for p, h in known.items() if begin <= p < begin + 32}
                least = min(inside.values())
                assert max(p for p, h in inside.items() if h == least) in places
        elif grams:
            assert len(places) == 1


def test_winnowing_keeps_the_rightmost_smallest(spark):
    text = "aa bb aa bb aa bb aa bb aa bb aa bb aa bb aa bb"
    keys = winnowing.with_keys(spark.createDataFrame([(text,)], "t string"), {"own": "t"}, k=2, window=4).first().own
    places = [winnowing.LOW - (x & winnowing.LOW) for x in keys]
    hashes = {x >> 31 for x in keys}
    assert len(hashes) == 1 and all(1 <= b - a <= 4 for a, b in zip(places, places[1:])) and places[0] >= 2


def test_winnowing_finds_shifted_passages_in_text_without_spaces(spark):
    r = random.Random(8)
    text = "".join(chr(r.choice([0x4E00, 0x1F300]) + r.randrange(300)) for _ in range(400))
    rows = [(shift, "甲" * shift + text) for shift in range(6)] + [(6, text[:150] + " \n\u3000" + text[150:])]
    keys = winnowing.with_keys(spark.createDataFrame(rows, "doc_id long, t string"), {"own": "t"}).collect()
    sets = {x.doc_id: {h >> 31 for h in x.own} for x in keys}
    assert all(len(sets[0] & sets[i]) > 0.9 * len(sets[0]) for i in range(1, 7)) and sets[6] == sets[0]
    run = text[200:247]
    both = winnowing.with_keys(spark.createDataFrame([(run + text[:90],), ("xyz" + run + text[300:],)], "t string"), {"own": "t"}).collect()
    assert {h >> 31 for h in both[0].own} & {h >> 31 for h in both[1].own}


def test_toxicity(spark, docs, none):
    bad = ["vile", "nasty", "awful"]
    rows = [(i, " ".join(rng.sample(WORDS, 8) + ([rng.choice(bad)] * 3 if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(240)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(train, train.select("doc_id", "label"))
    tests = spark.createDataFrame([(1, "alpha vile beta"), (2, "alpha beta mu"), (3, None), (4, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(tests, model).collect()}
    assert found[1].score > 0.5 > found[2].score and found[1].evidence[0].label == 1
    assert found[3].score == found[4].score and found[3].evidence == []
    assert toxicity.score(docs.select("doc_id", "text"), model).count() == len(corpus())
    assert toxicity.score(none.select("doc_id", "text"), model).count() == 0
    nothing = toxicity.fit(train, train.select("doc_id", "label").limit(0))
    assert {r.score for r in toxicity.score(tests, nothing).collect()} == {0.0}


def test_toxicity_keeps_rare_and_neutral_features(spark):
    rows = [(i, f"vile rare{i}" if i % 2 else f"mild lone{i}", i % 2) for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(train, train.select("doc_id", "label"))
    assert set(model.index.numbers) == {f for _, t, _ in rows for f in toxicity.counted(t)}
    tests = spark.createDataFrame([(1, "lone4"), (2, "Rare7 unseen"), (3, "unseen")], "doc_id long, text string")
    found = {r.doc_id: [e.doc_id for e in r.evidence] for r in toxicity.score(tests, model).collect()}
    assert found == {1: [4], 2: [7], 3: []}


@pytest.mark.parametrize("long", [0.0, 0.1, 1.0])
def test_block_max_search_is_exact(long):
    r = random.Random(3)
    names = [f"f{i}" for i in range(80)]
    made = lambda most: (np.array(sorted(r.sample(range(80), r.randint(1, most))), np.int64),)
    examples = [(at, np.array([r.randint(1, 4) for _ in at], float)) for (at,) in (made(20) for _ in range(500))]
    examples[7] = examples[300] = examples[450]  # ties go to the smaller number
    index = toxicity.Index(names, np.array([r.uniform(0.1, 5) for _ in names]), examples, block=16, long=long)
    dense = np.zeros((500, 80))
    for i, e in enumerate(examples):
        at, w = index.vector(e)
        dense[i, at] = w
    texts = [examples[300], (np.zeros(0, np.int64), np.zeros(0))] + [(at, np.ones(len(at))) for (at,) in (made(6) for _ in range(50))]
    at, cosine, blocks = index.nearest(texts, 7)
    for t, found, value in zip(texts, at, cosine):
        q = np.zeros(80)
        q[t[0]] = index.vector(t)[1]
        want = np.sort(dense @ q)[::-1][:7]
        assert np.allclose(value, want) and np.allclose(dense[found] @ q, want)
    assert at[0][:3].tolist() == [7, 300, 450] and blocks <= len(texts) * index.blocks
    assert 300 not in index.nearest(texts[:1], 7, np.array([300]))[0][0]


def test_toxicity_gives_way_to_nothing_but_its_own_columns(spark):
    train = spark.createDataFrame([(i, "vile word" if i % 2 else "mild word", i % 2) for i in range(20)], "doc_id long, text string, label int")
    model = toxicity.fit(train, train.select("doc_id", "label"))
    odd = spark.createDataFrame([(1, "vile " * 400_000, "x", "y", ("z",))], "doc_id long, text string, Score string, evidence string, `a b` struct<`c d`: string>")
    row = toxicity.score(odd, model).first()
    assert row.score > 0.5 and row["a b"][0] == "z" and row.doc_id == 1


def test_quality(spark, docs, none):
    good = lambda: "\n".join(" ".join(rng.sample(WORDS, 9)).capitalize() + "." for _ in range(5))
    poor = lambda: "\n".join(" | ".join(rng.sample(WORDS, 5)) for _ in range(5))
    rows = [(i, good() if i % 3 else poor(), int(i % 3 > 0)) for i in range(150)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(train, train.select("doc_id", "label"))
    tests = [(1, good()), (2, poor()), (3, None), (4, ""), (5, "\n\n")]
    found = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert found[1] > 0.5 > found[2] and found[3] == found[4] and all(0 <= s <= 1 for s in found.values())
    assert quality.score(docs.select("doc_id", "text", "n"), model).count() == len(corpus())
    assert quality.score(none.select("doc_id", "text"), model).count() == 0
    assert quality.fit(train, train.select("doc_id", "label").limit(0)) is None


def test_chain_marginals_match_enumeration():
    from itertools import product

    r = np.random.default_rng(0)
    lines = np.array([3, 1, 4])
    odds, tie = r.normal(size=8), 0.7
    got, at = quality.marginals(odds, lines, tie), 0
    for n in lines:
        total, good = 0.0, np.zeros(n)
        for labels in product((0, 1), repeat=int(n)):
            w = np.exp(sum(o for o, y in zip(odds[at : at + n], labels) if y) + tie * sum(a == b for a, b in zip(labels, labels[1:])))
            total += w
            good += w * np.array(labels)
        assert np.allclose(1 / (1 + np.exp(-got[at : at + n])), good / total)
        at += n


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.encoder(path)
    r = random.Random(1)
    extra = ["", "a\x1cb", "İstanbul ǅ ΣΑΣ", "don't WE'LL 'S", "x" * 3000] + ["".join(r.choice("abcdefghé'<>/w|!? \n\t日😀ßÉ0123½") for _ in range(r.randint(1, 60))) for _ in range(500)]
    for text in extra:
        ids = library.encode(text, add_special_tokens=False).ids
        raw = own.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert own.decode(raw).decode() == library.decode(ids, skip_special_tokens=False)
    for row in bpe.bpe_digests(docs, path).collect():
        ids = library.encode(texts_of()[row.doc_id] if row.doc_id is not None else "null id " + PASSAGE, add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.bpe_digests(none, path).count() == 0
    assert bpe.bpe_round_trip(docs, path).count() == len(corpus())
