"""The registered queries and the pipeline's stages over small tables with hard rows, and over empty ones."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("score", pa.string()), ("lang_pred", pa.int32()), ("row", pa.string()), ("key", pa.float64()), ("kept", pa.bool_())])
EN, DE = "the house is near river and they walked with old friend under green tree", "das haus ist nahe dem fluss und sie gingen mit altem freund unter baum"
BAD = ["vile", "nasty", "awful"]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def made():
    r = random.Random(11)
    passage = " ".join(f"passage{r.randint(0, 999)}" for _ in range(70))
    rows, labels = [], []
    for i in range(100, 260):
        lang = ("en", "de")[i % 2]
        words = r.choices((EN, DE)[i % 2].split(), k=40) + [f"w{r.randint(0, 9999)}" for _ in range(20)]
        toxic = i % 7 == 0
        if toxic:
            words += r.choices(BAD, k=8)
        r.shuffle(words)
        lines = [" ".join(words[k : k + 9]) + "." for k in range(0, len(words), 9)] if i % 5 else ["| " + w + " |" for w in words]
        rows.append((i, "\n".join(lines), lang if i % 11 else None, f"s{i % 3}"))
        labels.append((i, int(i % 5 > 0), int(toxic)))
    base = [f"n{r.randint(0, 9999)}" for _ in range(120)]
    for i in range(300, 306):  # near copies: each pair within the bound
        words = list(base)
        words[(i - 300) * 20] = "changed"
        rows.append((i, "the house " + " ".join(words), "en", "s0"))
    rows += [(310, passage, "en", "s1"), (311, "the river and the house " + passage + " they walked", "en", "s1"), (312, rows[0][1], "en", "s1"), (313, rows[0][1], "en", "s2")]
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, " \n\t ", "de", "s0"), (403, "12345 !!", "en", "s0"), (404, "日本語テキスト" * 300, None, "s0"), (405, ("the old tree " * 5 + "\n") * 9000, "en", "s0"), (406, "x" * 200_000, "en", "s0"), (None, "the house near the river", "en", "s0"), (None, None, None, None)]
    rows += [rows[3], rows[3], (401, "", None, None)]
    labels += [labels[5], (400, 1, 0), (9999, 1, 1), (None, 1, 1), (120, None, None)]
    return [(*x, len(x[1] or ""), "own", i, "r", 0.5, True) for i, x in enumerate(rows)], labels


def written(folder, rows, labels, vectors):
    columns = list(zip(*rows)) if rows else [[] for _ in SCHEMA]
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA), folder / "documents.parquet")
    columns = list(zip(*labels)) if labels else [[]] * 3
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "quality", "toxic"), columns, (pa.int64(), pa.int32(), pa.int32()))}), folder / "labels.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())), "score": pa.array(["x"] * len(vectors))}), folder / "embeddings.parquet")
    talk = [(1, 0, "user", "hello"), (1, 1, "assistant", "hello"), (5, 0, "user", "hello"), (None, None, None, None)] if rows else []
    pq.write_table(pa.table({n: pa.array([t[k] for t in talk], kind) for k, (n, kind) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}), folder / "conversations.parquet")
    return str(folder)


VECTORS = [(i, [float((i * 7 + j * 3) % 11 - 5) / 4 for j in range(4)]) for i in range(60)] + [(60, None), (80, [1.0, None, 0.0, 0.0]), (100, [float("nan"), 0, 0, 0]), (120, [float("inf"), 0, 0, 0]), (140, [0.0, 0.0, 0.0, 0.0])]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rows, labels = made()
    return written(tmp_path_factory.mktemp("hard"), rows, labels, VECTORS), rows, labels


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    return written(tmp_path_factory.mktemp("none"), [], [], [])


def run(spark, name, folder):
    return entry.queries()[name](spark, folder)


def ids_of(rows):
    return Counter(x[0] for x in rows)


OPS = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]


@pytest.mark.parametrize("name", OPS)
def test_empty_tables_give_empty_results(spark, nothing, name):
    assert run(spark, name, nothing).collect() == []


def test_packing(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, _ = tables
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = run(spark, "op1_packing", folder).collect()
    want = Counter()
    for x in rows:
        want[x[0]] += len(library.encode(x[1] or "", add_special_tokens=False).ids) + 1
    got, held = Counter(), defaultdict(list)
    for x in found:
        got[x.doc_id] += x.length
        held[x.sequence_id].append((x.offset, x.length))
    assert got == want
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_minhash(spark, tables):
    folder, rows, _ = tables
    found = run(spark, "op2_minhash", folder).collect()
    assert ids_of(found) == ids_of(rows)
    group = {x.doc_id: x.component_id for x in found}
    assert {group[i] for i in range(300, 306)} == {300} and group[312] == group[313] == 100
    assert all(x.kept == (x.doc_id is None or x.doc_id == x.component_id) for x in found)
    assert all(group[i] == i for i in (400, 401, 402, 403)) and {x.n_shingles for x in found if x.doc_id in (400, 401, 402)} == {0}


def test_suffix_dedup(spark, tables):
    folder, rows, _ = tables
    found = run(spark, "op3_suffix_dedup", folder).collect()
    assert ids_of(found) == ids_of(rows)
    by_id = {x.doc_id: x for x in found}
    texts = {x[0]: (x[1] or "").encode() for x in rows}
    assert by_id[312].n_removed == by_id[313].n_removed == by_id[312].n_bytes and by_id[100].n_removed == 0
    assert by_id[311].n_removed >= len(texts[310]) and by_id[310].n_removed == 0
    assert by_id[406].n_removed == 199_999 and by_id[406].n_spans == 1
    assert by_id[406].kept_sha256 == hashlib.sha256(b"x").hexdigest()


def test_language(spark, tables):
    folder, rows, _ = tables
    found = run(spark, "op4_language_id", folder).collect()
    assert ids_of(found) == ids_of(rows)
    for x in found:
        assert x.held_out == (x.doc_id is not None and fold(x.doc_id, 4) == 2) and 0 <= x.score <= 1
        if x.doc_id is not None and 100 <= x.doc_id < 260:
            assert x.lang_pred == ("en", "de")[x.doc_id % 2]
        if x.doc_id in (400, 401, 402, 403):
            assert x.lang_pred == "und"
    assert {x.lang_pred for x in found} <= {"en", "de", "und"}


def test_token_counts(spark, tables):
    import sentencepiece

    folder, rows, _ = tables
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = Counter()
    for x in rows:
        text, n = x[1] or "", len(library.encode(x[1] or ""))
        want[x[0], len(text.encode()), n, n > 4096] += 1
    assert Counter((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in run(spark, "op5_token_counts", folder).collect()) == want


def test_winnowing(spark, tables):
    folder, rows, _ = tables
    found = run(spark, "op6_winnowing", folder).collect()
    assert ids_of(found) == ids_of(rows)
    order = sorted([(x[0] is None, -(x[0] or 0), x[1] or "") for x in rows])
    want = Counter()
    for k, (none, i, text) in enumerate(order):
        half, after = len(text) // 2, order[(k + 1) % len(order)][2]
        want[None if none else -i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in found) == want
    for x in found:
        a, b = ({p.split(":")[0] for p in s.split(" ") if p} for s in (x.fingerprint, x.edited_fingerprint))
        assert x.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0) and 0 <= x.near_next <= 1


@pytest.mark.parametrize("name, n, at, column", [("op7_toxicity", 5, 0, "toxic"), ("op8_quality", 3, 1, "quality")])
def test_learned_scores(spark, tables, name, n, at, column):
    folder, rows, labels = tables
    found = run(spark, name, folder).collect()
    assert ids_of(found) == ids_of(rows)
    truth = {x[0]: x[1 if column == "quality" else 2] for x in labels[:160]}
    right = []
    for x in found:
        assert x.held_out == (x.doc_id is not None and fold(x.doc_id, n) == at)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        if x.held_out and x.doc_id in truth:
            right.append(x.predicted == truth[x.doc_id])
    assert np.mean(right) > 0.85


def test_topk(spark, tables):
    folder, _, _ = tables
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in VECTORS if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:20]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)}
    assert {(x.query_id, x["rank"], x.vec_id, x.score) for x in run(spark, "op9_topk", folder).collect()} == want


def test_bpe(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, _ = tables
    library, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for x in rows:
        ids = library.encode(x[1] or "", add_special_tokens=False).ids
        want[x[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(x[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for x in run(spark, "op10_bpe", folder).collect()) == want


def test_stages(spark, tables, nothing):
    folder, rows, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = spark.read.parquet(f"{nothing}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        left[name] = out.collect()
        assert stage(spark, none, nothing).collect() == []
    toxic = {x[0] for x in labels[:160] if x[2]}
    ids = {n: ids_of(x) for n, x in left.items()}
    whole = ids_of(rows)
    assert sum(ids["toxicity"][i] > 0 for i in toxic) <= 0.2 * len(toxic)
    assert sum(ids["toxicity"][i] for i in whole if i not in toxic) >= 0.95 * sum(n for i, n in whole.items() if i not in toxic)
    assert ids["toxicity"][None] == 2 and ids["toxicity"][400] == 1
    assert all(ids["language"][i] == 0 for i in (400, 401, 402, 403)) and all(ids["language"][i] == whole[i] for i in range(100, 260))
    assert ids["near_dedup"] == whole - Counter({i: 1 for i in (301, 302, 303, 304, 305, 311, 312, 313)})
    assert ids["substring_dedup"] == whole
    texts = {x.doc_id: x for x in left["substring_dedup"]}
    assert texts[312].text == "" and texts[312].n_chars == 0 and texts[406].text == "x" and texts[100].text == rows[0][1]
    assert texts[100].row == "r" and texts[100].kept is True and len(texts[311].text) < 60
    # Without any label or language to learn from, no document is rejected for it.
    for name in ("toxicity", "language"):
        stage = dict(corpus_pipeline.STAGES)[name]
        plain = docs.where("doc_id between 100 and 120").withColumn("lang", docs["lang"].substr(1, 0)).replace("", None, ["lang"])
        assert stage(spark, plain, nothing).count() == plain.count()


def test_pipeline_packs_what_the_stages_keep(spark, tables, nothing):
    folder, rows, _ = tables
    found = entry.queries()["pipeline"](spark, folder).collect()
    ids = {x.doc_id for x in found}
    assert ids and not ids & {311, 312, 313, 301, 302, 303, 304, 305, 400, 401, 402, 403}
    assert all(x.length > 0 and x.offset + x.length <= 2048 for x in found)
    assert corpus_pipeline.run(spark, nothing).collect() == []
