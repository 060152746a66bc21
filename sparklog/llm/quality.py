"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines beside it. A document's quality is
the mean of its lines' forward-backward marginals, weighted by their lengths, put through a logistic curve.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_sample, held_out, logistic

#: Labelled documents that are fitted on at most, the longest of them, and lines in all; they are what the driver holds.
FIT_DOCS = 4_000
FIT_CHARS = 20_000
FIT_LINES = 200_000
UPPER, LOWER, DIGIT, STOP, MARK = range(1, 6)


def _classes() -> np.ndarray:
    out = np.zeros(0x250, dtype=np.uint8)
    for c in map(chr, range(0x250)):
        out[ord(c)] = UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else STOP if c in ".,;:?'\"-()" else 0 if c.isspace() else MARK
    return out


_CLASS = _classes()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features and a length for each line that isn't blank; each row also has its neighbours' means."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, 1)), np.zeros(0)
    lengths = np.array([len(x) for x in lines])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], LOWER)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    share = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in (UPPER, LOWER, DIGIT, STOP, MARK)], axis=1) / lengths[:, None]
    rows, before = [], {}
    for line in lines:
        words = line.split()
        n, kinds_of = len(words), len(set(words))
        runs = sum(map(operator.eq, words, words[1:])) / n
        again = before.get(line, 0)
        before[line] = again + 1
        rows.append((math.log1p(n), 1 - kinds_of / n, runs, line.count("|") / n, min(1.0, len(line) / n / 30), float(again > 0), min(1.0, again / 5), float(n <= 2)))
    more = np.array(rows)
    up, mark = share[:, 0], share[:, 4]
    base = np.hstack([share, more, np.stack([up > 0.3, up > 0.6, mark > 0.05, mark > 0.15, more[:, 1] > 0.6, more[:, 1] > 0.85, more[:, 2] > 0.1, more[:, 3] > 0.2, share[:, 1] < 0.5], axis=1)])
    beside = np.zeros_like(base)
    if len(base) > 1:
        beside[1:] += base[:-1]
        beside[:-1] += base[1:]
        beside[1:-1] /= 2
    return np.hstack([base, beside]), lengths.astype(float)


def marginals(scores: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """P(good) of each line by forward-backward; ``scores``: good over bad, ``turn[a, b]``: from a to b, 1 is good."""
    n = len(scores)
    t = np.exp(turn - turn.max())
    (t00, t01), (t10, t11) = t.tolist()
    e = np.clip(scores, -30, 30)
    good, bad = (1 / (1 + np.exp(-e))).tolist(), (1 / (1 + np.exp(e))).tolist()
    ahead, a0, a1 = [], 1.0, 1.0
    for i in range(n):
        if i:
            a0, a1 = a0 * t00 + a1 * t10, a0 * t01 + a1 * t11
        a0, a1 = a0 * bad[i], a1 * good[i]
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
        ahead.append((a0, a1))
    out, b0, b1 = np.empty(n), 1.0, 1.0
    for i in range(n - 1, -1, -1):
        x0, x1 = ahead[i][0] * b0, ahead[i][1] * b1
        out[i] = x1 / (x0 + x1)
        c0, c1 = bad[i] * b0, good[i] * b1
        b0, b1 = t00 * c0 + t01 * c1, t10 * c0 + t11 * c1
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    return out


@dataclass(frozen=True)
class LineField:
    """What has been fitted; without both labels only the prior."""

    weights: np.ndarray | None
    turn: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    curve: tuple[float, float]
    prior: float

    def document(self, text: str | None) -> float:
        """Quality in [0, 1]; a text without any word has 0."""
        x, lengths = line_features(text)
        if not len(lengths):
            return 0.0
        if self.weights is None:
            return self.prior
        p = marginals(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], self.turn)
        return float(1 / (1 + math.exp(-(self.curve[0] * float(p @ lengths / lengths.sum()) + self.curve[1]))))


def _chain_gradient(x: np.ndarray, y: np.ndarray, groups: list[np.ndarray], w: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the conditional log-likelihood; ``groups`` has the rows of documents of one length, a document a row."""
    slope, bend = np.zeros_like(w), np.zeros_like(turn)
    good, off_all = x @ w[:-1].astype(x.dtype) + w[-1], np.zeros(len(y))
    for at in groups:
        d, n = at.shape
        own, score = y[at], np.stack([np.zeros((d, n)), good[at]], axis=2)
        ahead, back = np.zeros((d, n, 2)), np.zeros((d, n, 2))
        ahead[:, 0] = score[:, 0]
        for i in range(1, n):
            ahead[:, i] = score[:, i] + np.logaddexp(ahead[:, i - 1, 0, None] + turn[0], ahead[:, i - 1, 1, None] + turn[1])
        for i in range(n - 2, -1, -1):
            follow = back[:, i + 1] + score[:, i + 1]
            back[:, i] = np.logaddexp(follow[:, 0, None] + turn[:, 0], follow[:, 1, None] + turn[:, 1])
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        off_all[at] = own - np.exp(ahead[:, :, 1] + back[:, :, 1] - z[:, None])
        for a in (0, 1):
            for b in (0, 1):
                if n > 1:
                    p = np.exp(ahead[:, :-1, a] + turn[a, b] + score[:, 1:, b] + back[:, 1:, b] - z[:, None])
                    bend[a, b] += ((own[:, :-1] == a) & (own[:, 1:] == b)).sum() - p.sum()
    slope[:-1] = off_all.astype(x.dtype) @ x
    slope[-1] = off_all.sum()
    return slope, bend


def fit(sample: Iterable[tuple[str, int]], rounds: int = 120, most_lines: int = FIT_LINES) -> LineField:
    """From texts and their labels. Lines begin with their document's label; lines of bad documents that look like
    those of good ones are then taken as good, and the field is fitted to these labels by gradient ascent.

    Texts beyond ``most_lines`` lines in all only count for the prior. Features are held once, in single precision.
    """
    parts, lengths, own, labels, held = [], [], [], [], 0
    for text, label in sample:
        labels.append(label)
        features, sizes = line_features(text)
        if len(sizes) and (held := held + len(sizes)) <= most_lines:
            parts.append(features.astype(np.float32))
            lengths.append(sizes)
            own.append(label)
    prior = float((sum(labels) + 1) / (len(labels) + 2))
    if len(set(own)) < 2:
        return LineField(None, None, None, None, (0.0, 0.0), prior)
    x, own = np.vstack(parts), np.array(own)
    del parts
    ends = np.cumsum([len(n) for n in lengths])
    starts = ends - [len(n) for n in lengths]
    of = np.repeat(np.arange(len(own)), ends - starts)
    mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-3
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    y = own[of].astype(float)
    for _ in range(3):
        w = logistic(x, y, 1e-2)
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        y = np.where((own[of] == 0) & (p < 0.75), 0.0, 1.0)
    groups = [starts[ends - starts == n][:, None] + np.arange(n) for n in np.unique(ends - starts)]
    turn, pace, n = np.zeros((2, 2)), 0.1, len(y)
    m = v = np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        slope, bend = _chain_gradient(x, y, groups, w, turn)
        g = np.concatenate([slope, bend.ravel()]) / n - 1e-3 * np.concatenate([w, turn.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = pace * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, turn = w + step[: len(w)], turn + step[len(w) :].reshape(2, 2)
    scores = x @ w[:-1] + w[-1]
    means = np.array([float(marginals(scores[a:b], turn) @ n / n.sum()) for a, b, n in zip(starts, ends, lengths, strict=True)])
    curve = logistic(means[:, None], own.astype(float), 1e-4)
    return LineField(w, turn, mean, scale, (float(curve[0]), float(curve[1])), prior)


def _scored(rows: DataFrame, kept: str, docs: DataFrame, labels: DataFrame, fit_docs: int, fit_chars: int, fit_lines: int) -> DataFrame:
    """The column ``kept`` of ``rows`` and the ``score`` of their ``text``, by a field fitted on ``docs`` and ``labels``."""
    sample = fit_sample(docs, labels, "quality", fit_docs, fit_chars).toLocalIterator()
    model = fit(((r["text"], int(r["y"])) for r in sample), most_lines=fit_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.document(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=[kept, "score"])

    return rows.select(kept, "text").mapInArrow(run, f"{kept} {rows.select(kept).schema[0].dataType.simpleString()}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, fit_lines: int = FIT_LINES) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every input row.

    Fitted on ``fit_docs`` labelled documents at most, of ``fit_chars`` characters and ``fit_lines`` lines in all at
    most, none of them held out; only texts are features. Every text is scored whole, however long. Texts that are
    null, empty or blank score 0. Without labels of both kinds every other text scores the labels' smoothed share of
    good ones. Repeated rows score alike; empty tables give no rows; other columns are ignored.
    """
    out = _scored(docs, "doc_id", docs, labels, fit_docs, fit_chars, fit_lines)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, fit_lines: int = FIT_LINES) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` would give at least ``threshold``, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    return _scored(rows, "row", docs, labels, fit_docs, fit_chars, fit_lines).where(F.col("score") >= threshold).select("row.*")
