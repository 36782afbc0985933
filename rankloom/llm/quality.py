"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is linear in its own features and in those of the lines beside it; a
transition weight ties neighbouring labels. The field is trained on a bounded, hash-chosen sample of labelled documents,
whose lines take the document's label as theirs. A document's value are the means, weighted by the lines' lengths, of the
forward-backward marginals and of their log odds, brought to a probability by a logistic curve fitted to the sample.

Of a line only three numbers are held, what it adds to its own evidence and to that of the lines beside it; long texts
are read in blocks of lines. Long chains are cut in segments: the transfer of a message through a whole segment is a
product of two-by-two matrices, so all segments are passed at once and the marginals stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, in_arrow, labelled_sample, materialise, slices, with_new

#: Byte classes that are counted by line.
CLASSES = ("lower", "upper", "digit", "space", "stop", "bar", "bang", "sign", "high")
_CLASS = np.full(256, CLASSES.index("sign"), np.uint8)
_CLASS[range(0x61, 0x7B)] = CLASSES.index("lower")
_CLASS[range(0x41, 0x5B)] = CLASSES.index("upper")
_CLASS[range(0x30, 0x3A)] = CLASSES.index("digit")
_CLASS[[0x20, *range(0x09, 0x0E)]] = CLASSES.index("space")
_CLASS[[ord(c) for c in ".,;:'"]] = CLASSES.index("stop")
_CLASS[ord("|")] = CLASSES.index("bar")
_CLASS[ord("!")] = CLASSES.index("bang")
_CLASS[range(0x80, 0x100)] = CLASSES.index("high")
MOST_LOG_ODDS = 6.0
#: Bytes of a text that are read at a time, if its lines allow it; lines of a chain's segment.
PIECE, SEGMENT = 1 << 20, 4096


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, features), bytes of each line, lines of each text. A text has one line more than line feeds."""
    data = np.frombuffer("\n".join(texts).encode() + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], ends[:-1] + 1])
    lines = np.array([t.count("\n") + 1 for t in texts])
    kinds = _CLASS[data]
    counts = np.stack([np.add.reduceat(kinds == c, begin) for c in range(len(CLASSES))], 1).astype(float)
    counts[:, CLASSES.index("space")] -= 1  # the line feed itself
    size = ends - begin
    share = counts / np.maximum(size, 1)[:, None]
    gaps = counts[:, CLASSES.index("space")]
    words = np.where(size > 0, gaps + 1, 0)
    last = data[np.maximum(ends - 1, 0)]
    same = np.zeros(len(size))
    if len(size) > 1:
        # Equal to the line before, by length and a checksum; the first line of a text has none before.
        sums = np.add.reduceat((data.astype(np.uint32) + 1) * ((np.arange(len(data), dtype=np.uint32) - np.repeat(begin.astype(np.uint32), size + 1)) * 2 + 7), begin)
        same[1:] = (sums[1:] == sums[:-1]) & (size[1:] == size[:-1]) & (size[1:] > 0)
        same[np.cumsum(lines)[:-1]] = 0
    length = (size - gaps) / np.maximum(words, 1)
    other = [np.log1p(size) / 6, np.minimum(length, 30) / 8, (last == ord(".")) & (size > 0), size == 0, same, np.log1p(counts[:, CLASSES.index("bar")]), np.log1p(counts[:, CLASSES.index("bang")]), np.log1p(counts[:, CLASSES.index("sign")])]
    return np.hstack([share, np.sqrt(share), np.stack([np.asarray(x, float) for x in other], 1)]), size, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it in its text (zeros at the ends), and a constant."""
    before, after = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]), np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    stop = np.cumsum(lines)
    before[stop[:-1]] = 0
    after[stop - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def pieces(text: str) -> list[str]:
    """A text in parts of about PIECE signs that end where lines end (the line feed between two parts is in neither)."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = text.rfind("\n", at, at + PIECE)
        cut = cut if cut >= 0 else text.find("\n", at + PIECE)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:]]


def evidence(texts: list[str], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' own log odds under the weights beta of with_neighbours(), their bytes, and the lines of each text."""
    width = len(beta) // 3
    by_place = np.stack([beta[:width], beta[width : 2 * width], beta[2 * width : 3 * width]], 1)
    found, sizes, counts = [], [], []
    whole = [p for t in texts for p in (pieces(t) if len(t) > PIECE else [t])]
    # Short texts together, each part of a long one alone.
    k = 0
    while k < len(whole):
        end, total = k + 1, len(whole[k])
        while end < len(whole) and total + len(whole[end]) <= PIECE:
            total += len(whole[end])
            end += 1
        x, size, lines = line_features(whole[k:end])
        found.append(x @ by_place)
        sizes.append(size)
        counts.append(lines)
        k = end
    values, size, of_piece = np.concatenate(found), np.concatenate(sizes), np.concatenate(counts)
    lines = np.array([t.count("\n") + 1 for t in texts])
    if len(whole) > len(texts):
        # The first line of a later part may repeat the last line of the part before.
        start, same = np.cumsum(of_piece) - of_piece, 2 * len(CLASSES) + 4
        for i in sorted(set(start[1:].tolist()) - set((np.cumsum(lines) - lines).tolist())):
            p = int(np.searchsorted(start, i))
            last = whole[p - 1].rpartition("\n")[2]
            if last and last == whole[p].partition("\n")[0]:
                values[i] += by_place[same]
    odds = values[:, 0] + beta[-1]
    odds[1:] += values[:-1, 1]
    odds[:-1] += values[1:, 2]
    edge = np.cumsum(lines)[:-1]  # between two texts nothing is passed on
    odds[edge] -= values[edge - 1, 1]
    odds[edge - 1] -= values[edge, 2]
    return odds, size, lines


def chains(lines: np.ndarray):
    """For each step t: positions of the t-th lines of the chains that have one, longest chains first; and that order."""
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    sizes = lines[order]
    left = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    return [first[:n] + t for t, n in enumerate(left)], order


def passed(m: np.ndarray, tie: float) -> np.ndarray:
    """Log odds that a neighbour with log odds m sends through the transition."""
    return np.logaddexp(m + tie, 0.0) - np.logaddexp(m, tie)


def toward(odds: np.ndarray, lines: np.ndarray, tie: float, segment: int = SEGMENT) -> np.ndarray:
    """A line's log odds by its own evidence and that of all lines before it in its text."""
    parts = -(-lines // segment)
    own = np.full(int(parts.sum()), segment)
    stop = np.cumsum(parts)
    own[stop - 1] = lines - (parts - 1) * segment
    steps, order = chains(own)
    message = np.zeros(len(own))  # what comes to the first line of a segment; 0 says nothing
    if len(own) > len(lines):
        # e^m goes through a line by (a e^m + b) / (c e^m + d); a segment's matrix is the product of its lines'.
        m = np.broadcast_to(np.eye(2), (len(own), 2, 2)).copy()
        for at in steps:
            o = odds[at]
            down = np.exp(-np.maximum(o, 0))
            line = np.stack([np.exp(np.minimum(o, 0) + tie), np.exp(np.minimum(o, 0)), down, down * np.exp(tie)], 1).reshape(-1, 2, 2)
            m[: len(at)] = line @ m[: len(at)]
            m[: len(at)] /= m[: len(at)].max(axis=(1, 2), keepdims=True)
        with np.errstate(divide="ignore"):
            log = np.empty_like(m)
            log[order] = np.log(m)
        for first, n in zip((stop - parts)[parts > 1], parts[parts > 1]):
            for k in range(first + 1, first + n):
                a, b, c, d = log[k - 1].ravel()
                message[k] = np.logaddexp(a + message[k - 1], b) - np.logaddexp(c + message[k - 1], d)
    out = odds.copy()
    if len(steps):
        out[steps[0]] += passed(message[order], tie)
    for a, b in zip(steps, steps[1:]):
        out[b] += passed(out[a[: len(b)]], tie)
    return out


def both_ways(odds: np.ndarray, lines: np.ndarray, tie: float, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """For each line the log odds by itself and all before it, and by itself and all after it."""
    return toward(odds, lines, tie, segment), toward(odds[::-1], lines[::-1], tie, segment)[::-1]


def marginals(odds: np.ndarray, lines: np.ndarray, tie: float, segment: int = SEGMENT) -> np.ndarray:
    """Log odds of the marginal of 'good' for each line; odds: the lines' own; tie: the gain of equal neighbours."""
    before, after = both_ways(odds, lines, tie, segment)
    return before + after - odds


def gradient(x: np.ndarray, lines: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, tie: float) -> tuple[np.ndarray, float]:
    """The slope, in beta and tie, of the sum of the chains' log conditional likelihoods, a chain weighing what its lines
    have in w, in parts of all.

    It is what the labels y show less what the field expects: of the lines by their marginals, of neighbours by the
    chance of equal ones, from the messages that meet between the two.
    """
    odds = x @ beta
    before, after = both_ways(odds, lines, tie)
    p = 1 / (1 + np.exp(-np.clip(before + after - odds, -30, 30)))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lines) - 1] = False
    here = np.flatnonzero(inner)
    f, g = before[here], after[here + 1]
    expected = 1 / (1 + np.exp(np.logaddexp(f, g) - np.logaddexp(0.0, f + g) - tie))
    shown = (y[here] == y[here + 1]).astype(float)
    return x.T @ (w * (y - p)) / w.sum(), float((w[here] * (shown - expected)).sum() / w.sum())


def train(x: np.ndarray, lines: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 250, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and tie that maximise the chains' conditional likelihood (Adam, a little ridge, a tie of 0 to 1.5). good,
    weight: of each text, whose lines share its weight."""
    beta, tie = np.zeros(x.shape[1]), 0.0
    y, w = np.repeat(good, lines), np.repeat(weight / lines, lines)
    m1 = m2 = np.zeros(len(beta) + 1)
    for t in range(1, rounds + 1):
        slope, pull = gradient(x, lines, y, w, beta, tie)
        g = np.append(slope - ridge * beta, pull - 0.1 * tie)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        beta, tie = beta + step[:-1], float(np.clip(tie + step[-1], 0.0, 1.5))
    return beta, tie


def aggregate(odds: np.ndarray, size: np.ndarray, lines: np.ndarray, tie: float) -> np.ndarray:
    """A value for each text: length-weighted means of the clipped log odds and of the chances of its lines."""
    odds = np.clip(marginals(odds, lines, tie), -MOST_LOG_ODDS, MOST_LOG_ODDS)
    at = np.cumsum(lines) - lines
    weight = size + 1.0
    whole = np.add.reduceat(weight, at)
    return np.stack([np.add.reduceat(odds * weight, at) / whole, np.add.reduceat(weight / (1 + np.exp(-odds)), at) / whole, np.ones(len(lines))], 1)


def calibrated(values: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic curve of labels on values (Newton's method, a little ridge)."""
    beta = np.zeros(values.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(values @ beta, -30, 30)))
        v = weight * p * (1 - p)
        beta = beta + np.linalg.solve(values.T @ (values * v[:, None]) + 0.3 * np.eye(len(beta)), values.T @ (weight * (good - p)) - 0.3 * beta)
    return beta


def lines_each(lines: np.ndarray, most: int) -> int:
    """The largest number of lines, 1 at least, of which texts of so many lines give `most` or fewer altogether."""
    lines = np.sort(lines)
    # With a cap at the k-th smallest, the k before it are whole and the others give as many as the cap.
    whole = np.cumsum(lines) - lines
    left = np.arange(len(lines), 0, -1)
    k = np.searchsorted(whole + lines * left > most, True)
    return int(lines[-1]) if k == len(lines) else max(1, int((most - whole[k]) // left[k]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2500, most_lines: int = 60_000, longest: int = 256) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A model from labels (doc_id, label 0/1) of docs (doc_id, text), or None without labels.

    `sample`: labelled documents wanted of each label, chosen by a hash of their ids; all of them are learned from. A
    document with more than `longest` lines gives a stretch of so many, begun at a place by the hash; if all have more than
    `most_lines` lines together, the stretches are so much shorter that they fit. Both bound what the driver holds, lines'
    features and not texts, and the time that it takes to learn.
    """
    chosen, rate = labelled_sample(docs, labels, sample, "quality")
    chosen = materialise(chosen.withColumn("h", F.xxhash64("doc_id", "text")), "quality-sample")
    n = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines")
    counted = chosen.select(n).toPandas()["lines"].to_numpy()
    if not len(counted):
        return None
    most_each = min(longest, lines_each(counted, most_lines))

    def stretch(text: str, h: int) -> str:
        lines = text.split("\n")
        start = h % max(1, len(lines) - most_each + 1)
        return "\n".join(lines[start : start + most_each])

    def featured(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, size, lines = line_features([stretch(t, h) for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist())])
        x, stop = x.astype(np.float32), np.cumsum(lines)
        parts = [(x[e - n : e].tobytes(), size[e - n : e].astype("<i8").tobytes()) for n, e in zip(lines, stop)]
        return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label").cast(pa.int32()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["h", "label", "x", "size"])

    held = in_arrow(chosen, featured, "h long, label int, x binary, size binary").toArrow().sort_by("h").to_pylist()
    good = np.array([float(r["label"]) for r in held])
    size = [np.frombuffer(r["size"], "<i8") for r in held]
    lines = np.array([len(s) for s in size])
    x = np.vstack([np.frombuffer(r["x"], "<f4").reshape(len(s), -1) for r, s in zip(held, size)]).astype(float)
    x, size = with_neighbours(x, lines), np.concatenate(size)
    weight = np.where(good == 1, 1 / rate[1], 1 / rate[0])
    weight /= weight.mean()
    # Both labels weigh the same for the field; the calibration then learns how common each is.
    even = np.where(good == 1, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9))
    beta, tie = train(x, lines, good, even)
    return beta, tie, calibrated(aggregate(x @ beta, size, lines, tie), good, weight)


def score_batch(model: tuple[np.ndarray, float, np.ndarray] | None):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores: list[float] = []
        for part in slices(batch, most_bytes=1 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            if model is None:
                scores += [0.5] * len(texts)
                continue
            value = aggregate(*evidence(texts, model[0]), model[1]) @ model[2]
            scores += (1 / (1 + np.exp(-np.clip(value, -30, 30)))).tolist()
        names = beside(batch.schema.names, ("score",))
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores, pa.float64())], [*names, "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray] | None) -> DataFrame:
    """The other columns of docs with score in place of text, for every row.

    A null text counts as empty; an empty text is one empty line. Without a model every score is 0.5. Empty tables give
    empty results; repeated rows are each scored. A column of docs that is named score gives way to the new one. Memory
    grows by about 60 bytes with each line of a text, and with its longest line.
    """
    kept, schema = with_new(docs, "score double")
    return in_arrow(kept, score_batch(model), schema)
