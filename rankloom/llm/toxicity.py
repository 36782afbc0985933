"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded, hash-chosen sample of labelled documents with all their features (words, and the first five
signs of longer words); the document frequencies of these are counted over all documents. A feature's weight is its
number in the text times its squared inverse frequency, where a feature rarer than one document in RARE counts as one of
that frequency: what is rarer tells nothing about a label and would only fill the vectors' lengths.

Examples stand in blocks, those with the same strongest common feature together. Short posting lists are added up at once. Long lists are kept by block, with each block's
largest weight: what a document has from the short lists and these maxima bounds what any example of the block can
reach. The blocks with the highest bounds are scored first, and then all whose bound reaches the k-th best score, so the
k nearest are exact. Features that no example has can't add to a product and stand outside a document's length, which is
the same for all its neighbours. The neighbours' votes, weighted by the square of the cosine, are brought to a
probability by a logistic curve fitted to the examples, each judged without itself.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, held, in_arrow, labelled_sample, ship, slices, with_new

WORD = re.compile(r"\w+")
PREFIX = 5
RARE = 50
#: Documents that are searched for at a time.
TOGETHER = 64


def counted(text: str) -> dict[str, int]:
    """Features of a text with their numbers."""
    out: dict[str, int] = {}
    for w in WORD.findall(text.lower()):
        out[w] = out.get(w, 0) + 1
    begun: dict[str, int] = {}
    for w, n in out.items():
        if len(w) > PREFIX:
            p = w[:PREFIX] + "*"
            begun[p] = begun.get(p, 0) + n
    return out | begun


def feature_weights(total: float, frequency: np.ndarray) -> np.ndarray:
    return np.minimum(np.log((1 + total) / (1 + frequency)) + 0.01, np.log(RARE)) ** 2


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[i], begin[i] + 1, ... of all i, size[i] of each."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Index:
    """Examples (feature numbers, counts) as unit vectors in a block-max inverted index."""

    def __init__(self, features: list[str], weights: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], block: int = 32, long: float = 0.125):
        self.numbers = {f: i for i, f in enumerate(features)}
        self.weights, self.size, self.block = weights, len(examples), block
        self.blocks = max(1, -(-len(examples) // block))
        rows = [self.vector(e) for e in examples]
        feature = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        weight = np.concatenate([r[1] for r in rows] or [np.zeros(0)])
        many = np.bincount(feature, minlength=len(features)) > max(4, long * self.size)
        #: The number of a feature with a long list among those, or -1; long lists by block; their largest weights.
        self.column = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
        self.lists = np.zeros((int(many.sum()), self.blocks * block))
        is_long = many[feature]
        self.lists[self.column[feature[is_long]], owner[is_long]] = weight[is_long]
        self.most = self.lists.reshape(len(self.lists), self.blocks, block).max(axis=2)
        order = np.argsort(feature[~is_long], kind="stable")
        self.owner, self.weight = owner[~is_long][order].astype(np.int32), weight[~is_long][order]
        #: Where the short list of a feature begins; the next entry is where it ends.
        self.first = np.searchsorted(feature[~is_long][order], np.arange(len(features) + 1))

    def vector(self, features: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and TF-IDF weights, of length 1."""
        at, n = features
        w = n * self.weights[at]
        return at, w / max(np.sqrt((w * w).sum()), 1e-300)

    def known(self, found: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and counts of the features that the index has."""
        get = self.numbers.get
        pairs = [(i, n) for f, n in found.items() if (i := get(f)) is not None]
        return np.array([i for i, _ in pairs], np.int64), np.array([n for _, n in pairs], float)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and cosines (texts x k) of the nearest examples, and how many blocks' long lists were scored.

        Ties go to the smaller number. Where fewer than k have a cosine above 0, the rest has cosine 0. without: an example
        for each text that isn't to be found.
        """
        k, size, wide = min(k, self.size), self.block, self.blocks * self.block
        vectors = [self.vector(t) for t in texts]
        line = np.repeat(np.arange(len(texts)), [len(at) for at, _ in vectors])
        at, w = (np.concatenate(x) for x in zip(*vectors))
        column = self.column[at]
        is_long = column >= 0
        dense = np.zeros((len(texts), len(self.lists)))
        dense[line[is_long], column[is_long]] = w[is_long]
        at, w, line = at[~is_long], w[~is_long], line[~is_long]
        each = self.first[at + 1] - self.first[at]
        where = ranges(self.first[at], each)
        scores = np.bincount(np.repeat(line, each) * wide + self.owner[where], self.weight[where] * np.repeat(w, each), len(texts) * wide).astype(float).reshape(len(texts), wide)
        if without is not None:
            scores[np.arange(len(texts)), without] = -2.0
        bounds = scores.reshape(len(texts), self.blocks, size).max(axis=2) + dense @ self.most
        rank = np.argsort(np.argsort(-bounds, axis=1), axis=1)
        done = rank < max(1, -(-2 * k // size))
        self.score(dense, done, scores)
        shown = np.where(np.repeat(done, size, axis=1), scores, -2.0)
        edge = -np.partition(-shown, k - 1, axis=1)[:, k - 1] if k else np.full(len(texts), np.inf)
        more = ~done & (bounds >= edge[:, None] - 1e-12)
        self.score(dense, more, scores)
        scores = np.where(np.repeat(done | more, size, axis=1), scores, -2.0)[:, : self.size]
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return best, np.maximum(np.take_along_axis(scores, best, 1), 0.0), int((done | more).sum())

    def score(self, dense: np.ndarray, wanted: np.ndarray, scores: np.ndarray) -> None:
        """Add the products of the long lists in the wanted (text, block) to their scores."""
        for b in np.flatnonzero(wanted.any(axis=0)):
            texts, part = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
            scores[texts, part] += dense[texts] @ self.lists[:, part]


def likewise(vectors: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, long: float = 0.125) -> list[int]:
    """The vectors' numbers, ordered by the common feature that weighs most in each: like ones share blocks."""
    common = np.bincount(np.concatenate([at for at, _ in vectors]), minlength=len(weights)) > long * len(vectors)
    heads = []
    for at, n in vectors:
        own = common[at]
        heads.append(int(at[own][np.argmax(n[own] * weights[at[own]])]) if own.any() else -1)
    return np.argsort(heads, kind="stable").tolist()


class Model:
    """An index with the examples' labels and the calibration of votes; share: the part of each label that was sampled."""

    def __init__(self, index: Index, labels: np.ndarray, ids: list, share: dict[int, float], k: int):
        self.index, self.labels, self.ids, self.k = index, labels, ids, k
        # Both labels have one voice together, whatever the sample; the calibration then learns how common each is.
        self.voice = np.where(labels == 1, 1 / max(labels.sum(), 1), 1 / max((1 - labels).sum(), 1))
        self.weights = np.where(labels == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
        self.doubt, self.slope, self.shift = 1e-9, 1.0, 0.0

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What votes yes and no, for each line of neighbours."""
        power = cosine**2 * self.voice[at]
        yes = (power * self.labels[at]).sum(axis=1)
        return yes, power.sum(axis=1) - yes

    def odds(self, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
        return np.log((np.maximum(yes, 0) + self.doubt) / (np.maximum(no, 0) + self.doubt))

    def calibrate(self, yes: np.ndarray, no: np.ndarray) -> None:
        """Fit the logistic curve of labels on votes (Newton's method, a little ridge)."""
        self.doubt = max(0.05 * float(np.mean(yes + no)), 1e-9)
        x = np.stack([self.odds(yes, no), np.ones(len(yes))], 1)
        beta, weights = np.array([1.0, 0.0]), self.weights / self.weights.mean()
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            v = weights * p * (1 - p)
            slope = x.T @ (weights * (self.labels - p)) - 0.1 * (beta - [1.0, 0.0])
            beta = beta + np.linalg.solve(x.T @ (x * v[:, None]) + 0.1 * np.eye(2), slope)
        self.slope, self.shift = float(max(beta[0], 1e-3)), float(beta[1])

    def scores(self, at: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.odds(*self.vote(at, cosine)) + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1000, k: int = 100) -> Model:
    """A model from labels (doc_id, label 0/1) of docs (doc_id, text); the document frequencies are those of all docs.

    `sample`: labelled documents wanted of each label, chosen by a hash of their ids; it bounds the index and what the
    driver holds. Every feature of these documents is in the index. Rows with a null text or label teach nothing; without
    labelled rows every score is 0.
    """
    chosen, share = labelled_sample(docs, labels, sample, "toxicity")

    def featured(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [counted(t) for t in batch.column("text").to_pylist()]
        names, numbers = pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), batch.column("h"), names, numbers], ["doc_id", "label", "h", "f", "n"])

    held = in_arrow(chosen.withColumn("h", F.xxhash64("text")), featured, "doc_id long, label int, h long, f array<string>, n array<int>").toArrow()
    if not held.num_rows:
        return Model(Index([], np.zeros(0), []), np.zeros(0), [], share, k)
    held = held.sort_by([("doc_id", "ascending"), ("h", "ascending")]).combine_chunks()
    words = pc.dictionary_encode(pc.list_flatten(held.column("f"))).combine_chunks()
    names = words.dictionary.to_pylist()
    at, n = words.indices.to_numpy().astype(np.int64), pc.list_flatten(held.column("n")).to_numpy().astype(float)
    stop = np.cumsum(pc.list_value_length(held.column("f")).to_numpy())[:-1]
    vectors, weights = list(zip(np.split(at, stop), np.split(n, stop))), frequencies(docs, names)
    order = likewise(vectors, weights)
    vectors, held = [vectors[i] for i in order], held.select(["doc_id", "label"]).take(pa.array(order))
    model = Model(Index(names, weights, vectors), held.column("label").to_numpy().astype(float), held.column("doc_id").to_pylist(), share, k)
    votes = []
    for i in range(0, len(vectors), TOGETHER):
        part = vectors[i : i + TOGETHER]
        votes.append(model.vote(*model.index.nearest(part, k, np.arange(i, i + len(part)))[:2]))
    model.calibrate(*(np.concatenate(x) for x in zip(*votes)))
    return model


def frequencies(docs: DataFrame, names: list[str]) -> np.ndarray:
    """The weights of features by the numbers of all documents that have them."""
    number = {f: i for i, f in enumerate(names)}

    def partial(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = np.zeros(len(number) + 1, np.int64)
        get = number.get
        for part in slices(batch):
            for text in part.column("text").to_pylist():
                words = set(WORD.findall((text or "").lower()))
                hit = {get(w) for w in words}
                hit |= {get(p) for p in {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}}
                hit.discard(None)
                seen[list(hit)] += 1
                seen[-1] += 1
        at = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["i", "n"])

    found = in_arrow(docs.select("text"), partial, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(names) + 1)
    df[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return feature_weights(df[-1], df[:-1])


MADE = ("score", "evidence")


def score_batch(shared, name: str, evidence: int, keep_text: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, scores, shown = held(name, lambda: shared.value), [], []
        for part in slices(batch, most_rows=TOGETHER):
            texts = [t or "" for t in part.column("text").to_pylist()]
            if not len(model.labels):
                scores += [0.0] * len(texts)
                shown += [[] for _ in texts]
                continue
            at, cosine, _ = model.index.nearest([model.index.known(counted(t)) for t in texts], model.k)
            scores += model.scores(at, cosine).tolist()
            if not evidence:
                shown += [[] for _ in texts]
                continue
            shown += [[{"doc_id": model.ids[i], "cosine": c, "label": int(model.labels[i])} for i, c in zip(a, b) if c > 0] for a, b in zip(at[:, :evidence].tolist(), cosine[:, :evidence].tolist())]
        names = beside(batch.schema.names, MADE, keep_text)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores, pa.float64()), pa.array(shown, kind)], [*names, *MADE])

    return run


def score(docs: DataFrame, model: Model, evidence: int = 3, keep_text: bool = False) -> DataFrame:
    """The other columns of docs with score and evidence (that many nearest examples), and the text if wanted, for every row.

    Null and empty texts, and texts without a known feature, get the score of no neighbours, about that of the labels'
    shares. Empty tables give empty results; repeated rows are each scored. Columns of docs that are named score or
    evidence give way to the new ones.
    """
    import pickle

    name = hashlib.sha256(pickle.dumps((model.labels.tobytes(), model.ids, model.index.weights.tobytes(), model.slope, model.shift))).hexdigest()
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, schema = with_new(docs, "score double, evidence array<struct<doc_id: long, cosine: double, label: int>>", keep_text)
    return in_arrow(kept, score_batch(shared, name, evidence, keep_text), schema, name)
