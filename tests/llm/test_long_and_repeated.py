"""White space of any length in packing, and contents that repeat under one id in token counts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm import packing, token_counts
from rankloom.llm import queries as llm

PATH = public_tokenizers.path("byte_bpe_50k.json")
MILLION = 1_000_000


@pytest.fixture(scope="module")
def library():
    coder = Tokenizer.from_file(PATH)
    coder.no_truncation()
    coder.no_padding()
    return lambda text: coder.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("sign", [" ", "\n", " ", "\t \n"])
def test_a_million_of_white_space(library, sign):
    run = (sign * MILLION)[:MILLION]
    for text in (run, f"a{run}", f"{run}b", f"a{run}b<|endoftext|>{run[:5000]}<|endoftext|> c{run[:4096]}　'll"):
        assert packing.byte_encoder(PATH)(text).tolist() == library(text)


def test_ten_million_before_a_letter(library):
    text = " " * (10 * MILLION) + "b"
    assert np.array_equal(packing.byte_encoder(PATH)(text), np.array(library(text), "<u4"))


@pytest.mark.parametrize("length", [4095, 4096, 4097, 9000])
def test_around_the_bound(library, length):
    for text in (" " * length, " " * length + "x", "1" + "\n" * length + "1", " " * length + "<|endoftext|>" + " " * length, "\x1c" * length + "\x1c x"):
        assert packing.byte_encoder(PATH)(text).tolist() == library(text)


def test_through_the_registered_query(spark, library, tmp_path):
    texts = {1: " " * MILLION, 2: "a" + " " * 3 * MILLION + "b", 3: "\n" * 10 * MILLION, 4: "short"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = llm.op1_packing(spark, str(tmp_path)).collect()
    for doc_id, text in texts.items():
        if doc_id != 3:
            ids = np.array([*library(text), 1], "<u4")
            mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc_id)
            assert sum(n for _, n, _ in mine) == len(ids)
            assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in mine)
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 5 * MILLION + 1


def test_each_content_is_encoded_once(spark, monkeypatch, tmp_path):
    """5000 rows of one id and text, 3000 of a null id with another: two texts reach the encoder."""
    rows = [(7, "the same text")] * 5000 + [(None, "another text")] * 3000
    path, log = public_tokenizers.path("piece_bpe_32k.model"), tmp_path / "log"

    def counted(path, name, make=token_counts.count_batch, log=str(log)):
        run = make(path, name)

        def each(batch):
            with open(log, "a") as f:
                f.write(f"{batch.num_rows}\n")
            return run(batch)

        return each

    monkeypatch.setattr(token_counts, "count_batch", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = token_counts.token_counts(docs, path, str(tmp_path / "cache"))
    assert got.count() == 8000
    assert sum(map(int, log.read_text().split())) == 2
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
    token_counts.token_counts(docs, path, str(tmp_path / "cache")).count()
    assert sum(map(int, log.read_text().split())) == 2
