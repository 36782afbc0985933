"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces of the products of their probabilities, got by the forward algorithm; a text's is the product
over its words. Words are runs of letters of any length; long ones are read in parts, with the algorithm's state carried
from one to the next. The probabilities are learned by expectation maximisation over the words of a bounded, hash-chosen
sample of labelled documents, runs of more than TAUGHT signs in parts of that length; scoring reads every whole text
once, without a shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, held, in_arrow, ship, slices, unit_hash, with_new

U64 = np.uint64
#: Longest words, in signs, that expectation maximisation takes whole and whose chance a double holds for certain; signs
#: of a longer word that are looked up at a time.
TAUGHT, PART = 32, 4096
#: Chance of a sign that no piece covers.
UNKNOWN = 1e-7
#: Values that a task remembers of words before it starts anew, and that a block of words fills at a time.
MEMORY, BLOCK = 1_000_000, 1_000_000
START = "▁"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """All pieces of letters of a sentencepiece file, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.vocab_size())}
    return sorted(p for p in pieces if p == START or p.removeprefix(START).isalpha())


class Lattice:
    """Piece numbers of all substrings of words, found by the substrings' hashes."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.by_length = []
        for n in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int64)
            signs = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), "<u4").reshape(len(ids), n).astype(U64)
            keys = self.hashed(signs)
            order = np.argsort(keys)
            self.by_length.append((keys[order], ids[order]))

    @staticmethod
    def hashed(signs: np.ndarray) -> np.ndarray:
        """A hash of each row."""
        out = np.zeros(len(signs), U64)
        for c in range(signs.shape[1]):
            out = (out + signs[:, c] + U64(1)) * U64(0x9E3779B97F4A7C55)
            out ^= out >> U64(29)
        return out

    def numbers(self, words: list[str]) -> np.ndarray:
        """For words of one length: (words, piece length, length) numbers of the pieces that end at a sign, or -1."""
        size = len(words[0])
        most = min(self.longest, size)
        signs = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size).astype(U64)
        out = np.full((len(words), most, size), -1, np.int32)
        running = np.zeros((len(words), size), U64)
        for n in range(1, most + 1):
            # running[:, i]: the hash of the n signs that begin at i
            head = running[:, : size - n + 1]
            running = (head + signs[:, n - 1 :] + U64(1)) * U64(0x9E3779B97F4A7C55)
            running ^= running >> U64(29)
            keys, ids = self.by_length[n - 1]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, running), len(keys) - 1)
                out[:, n - 1, n - 1 :] = np.where(keys[at] == running, ids[at], -1)
        return out


@lru_cache(maxsize=2)
def lattice_of(path: str) -> Lattice:
    return Lattice(vocabulary(path))


def words_of(chunk: str) -> list[str]:
    """The words of a chunk without white space: runs of letters, with a start sign."""
    return [START + r for r in ([chunk] if chunk.isalpha() else "".join(c if c.isalpha() else " " for c in chunk).split())]


def by_size(words: list[str], most: int):
    """Positions of words, grouped by length, in blocks of about `most` signs."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for size, where in groups.items():
        step = max(1, most // size)
        for k in range(0, len(where), step):
            yield size, where[k : k + step]


def forward(numbers: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """(words, length + 1, languages): the chance of each beginning, summed over its segmentations. probs: a row for
    each piece and a last one of zeros."""
    n, most, size = numbers.shape
    out = np.zeros((n, size + 1, probs.shape[1]))
    out[:, 0] = 1.0
    for t in range(1, size + 1):
        now = out[:, t - 1] * UNKNOWN
        for k in range(1, min(most, t) + 1):
            now += out[:, t - k] * probs[numbers[:, k - 1, t - 1]]
        out[:, t] = now
    return out


def backward(numbers: np.ndarray, probs: np.ndarray) -> np.ndarray:
    n, most, size = numbers.shape
    out = np.zeros((n, size + 1, probs.shape[1]))
    out[:, size] = 1.0
    for t in range(size - 1, -1, -1):
        now = out[:, t + 1] * UNKNOWN
        for k in range(1, min(most, size - t) + 1):
            now += out[:, t + k] * probs[numbers[:, k - 1, t + k - 1]]
        out[:, t] = now
    return out


def long_logs(word: str, lattice: Lattice, probs: np.ndarray, part: int = PART) -> np.ndarray:
    """The log chance of a word of any length for each language, by the same sum in bounded memory.

    Of the forward values the last ones that a piece can reach are held, as multiples of a common scale.
    """
    held, logs = np.zeros((lattice.longest, probs.shape[1])), np.zeros(probs.shape[1])
    held[0] = 1.0  # the values before the next sign, the nearest first
    for begin in range(0, len(word), part):
        lead = min(begin, lattice.longest - 1)
        numbers = lattice.numbers([word[begin - lead : begin + part]])[0][:, lead:]
        for t in range(numbers.shape[1]):
            now = held[0] * UNKNOWN + (held[: len(numbers)] * probs[numbers[:, t]]).sum(axis=0)
            held = np.vstack([now, held[:-1]])
            if t % 8 == 7:
                scale = held.max(axis=0)
                held /= scale
                logs += np.log(scale)
    return logs + np.log(held[0])


def learned(words: list[str], counts: np.ndarray, path: str, rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """Probabilities of the vocabulary's pieces by expectation maximisation over counted words."""
    pieces, lattice = vocabulary(path), lattice_of(path)
    size = len(pieces)
    weight = np.array([2.0 ** (len(p) - 1) for p in pieces])
    probs = np.append(weight / weight.sum(), 0.0)[:, None]
    for _ in range(rounds):
        seen = np.zeros(size + 1)
        for _, where in by_size(words, BLOCK):
            numbers, n = lattice.numbers([words[i] for i in where]), counts[where]
            a, b = forward(numbers, probs)[:, :, 0], backward(numbers, probs)[:, :, 0]
            whole = np.maximum(a[:, -1], 1e-290)
            for k in range(1, numbers.shape[1] + 1):
                ids = numbers[:, k - 1, k - 1 :]
                share = a[:, : ids.shape[1]] * probs[ids, 0] * b[:, k:] * (n / whole)[:, None]
                seen += np.bincount(np.where(ids < 0, size, ids).ravel(), share.ravel(), size + 1)
        seen = seen[:size] + smooth
        probs = np.append(seen / seen.sum(), 0.0)[:, None]
    return probs[:size, 0]


class Scorer:
    """Log chances of words for every language, remembered by chunk."""

    def __init__(self, languages: list[str], lattice: Lattice, probs: np.ndarray):
        self.languages, self.lattice = languages, lattice
        self.probs = np.vstack([probs, np.zeros((1, probs.shape[1]))])
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.values = np.zeros((0, len(self.languages) + 1), np.float32)

    def learn(self, chunks: list[str]) -> None:
        """Values of chunks that aren't known yet; the last column counts their words."""
        owner, words = [], []
        for i, c in enumerate(chunks):
            for w in words_of(c):
                owner.append(i)
                words.append(w)
        values = np.zeros((len(chunks), self.values.shape[1]))
        for size, where in by_size(words, BLOCK // self.values.shape[1]):
            if size <= TAUGHT:
                logs = np.log(forward(self.lattice.numbers([words[i] for i in where]), self.probs)[:, -1])
            else:
                logs = np.array([long_logs(words[i], self.lattice, self.probs) for i in where])
            np.add.at(values, np.array(owner)[where], np.hstack([logs, np.ones((len(where), 1))]))
        self.rows.update(zip(chunks, range(len(self.values), len(self.values) + len(chunks))))
        self.values = np.vstack([self.values, values.astype(np.float32)])

    def texts(self, texts: list[str]) -> np.ndarray:
        """(texts, languages + 1): log chances and numbers of words."""
        split = [t.lower().split() for t in texts]
        fresh = list(dict.fromkeys(c for s in split for c in s if c not in self.rows))
        if (len(self.rows) + len(fresh)) * self.values.shape[1] > MEMORY and self.rows:
            self.forget()
            fresh = list(dict.fromkeys(c for s in split for c in s))
        if fresh:
            self.learn(fresh)
        get = self.rows.__getitem__
        return np.array([self.values[list(map(get, s))].sum(axis=0, dtype=np.float64) for s in split]).reshape(len(texts), -1)


def predict_batch(name: str, languages: list[str], path: str, shared, words_for_certainty: float, keep_text: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = held(name, lambda: Scorer(languages, lattice_of(path), shared.value))
        predicted: list[str] = []
        scores: list[float] = []
        for part in slices(batch, most_bytes=1 << 20):
            values = scorer.texts([t or "" for t in part.column("text").to_pylist()])
            for line in values:
                n = line[-1]
                if not n or not languages:
                    predicted.append("und")
                    scores.append(0.0)
                    continue
                # Words of one text aren't independent: many of them count as `words_for_certainty`.
                logs = line[:-1] * min(1.0, words_for_certainty / n)
                chance = np.exp(logs - logs.max())
                best = int(line[:-1].argmax())
                predicted.append(languages[best])
                scores.append(float(chance[best] / chance.sum()))
        names = beside(batch.schema.names, ("lang_pred", "score"), keep_text)
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return run


def fit(labelled: DataFrame, vocabulary_path: str, sample: int = 600) -> tuple[list[str], np.ndarray]:
    """Languages and (pieces x languages) probabilities from labelled (doc_id, text, lang).

    `sample`: documents wanted for each language, chosen by a hash of their ids and texts, which bounds what is learned
    from. The model grows with the number of languages alone, by about 0.2 MB each.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    pieces = vocabulary(vocabulary_path)
    if not sizes:
        return [], np.zeros((len(pieces), 0))
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    chosen = rows.where(unit_hash("doc_id", "text", seed="language") < rate[F.col("lang")]).select("lang", "text")

    def words(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for chunk in text.lower().split():
                for w in words_of(chunk):
                    for k in range(0, len(w), TAUGHT):
                        part = w[k : k + TAUGHT]
                        found[lang, part] = found.get((lang, part), 0) + 1
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"]) if keys else None

    counted = in_arrow(chosen, words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "probs": [learned(pdf["word"].tolist(), pdf["n"].to_numpy(float), vocabulary_path).tolist()]})

    models = {r["lang"]: r["probs"] for r in counted.groupBy("lang").applyInPandas(one, "lang string, probs array<double>").collect()}
    names = sorted(models)
    return names, np.array([models[k] for k in names]).reshape(len(names), len(pieces)).T


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary_path: str, words_for_certainty: float = 40.0, keep_text: bool = False) -> DataFrame:
    """The other columns of docs with lang_pred and score, and the text if wanted, for every row.

    A null text and one without a letter give 'und' with score 0, as does a model without languages. Empty tables give
    empty results; repeated rows are each scored. Columns of docs that are named lang_pred or score give way to the new
    ones.
    """
    import hashlib

    languages, probs = model
    name = hashlib.sha256(repr(languages).encode() + probs.tobytes()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(probs)
    kept, schema = with_new(docs, "lang_pred string, score double", keep_text)
    return in_arrow(kept, predict_batch(name, languages, vocabulary_path, shared, words_for_certainty, keep_text), schema, name)


def bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n
