"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe the line and its neighbours,
two transition weights tie it to the line before. Only documents are labelled:
lines of good documents are taken as good, lines of bad ones start as bad, and
in a few rounds the field itself decides which lines of a bad document stay bad
(the worst always does). Forward-backward marginals, weighted by line length,
give the bad share of a document, and a logistic curve fitted on the same
sample turns that share into a score.

The fit uses at most ``SAMPLE`` documents of each label, chosen by a hash of
their id among those that are not held out. Only features and labels of the
sample reach the driver. Scores depend on the text alone.

Defined results: null and empty texts are one empty line and get a score like
any other; labels that are null or not 0 or 1 are not learned from; with nothing
to learn from every score is 0.5; repeated rows get equal scores; a text of any
number of lines is one chain; an empty table gives an empty result; ``fit`` and
``score_documents`` read no columns but those named, ``accepted`` keeps all as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.shared import held_out, rows_of

SAMPLE = 800
ACCEPT = 0.3
ROUNDS, STEPS = 3, 120
#: So many of the longest texts of a batch run one by one once all others have ended.
ALONE = 4
OWN = 9
FEATURES = OWN + 6

_BYTES = np.arange(256)
_KINDS = [
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 48) & (_BYTES <= 57),
    np.isin(_BYTES, np.frombuffer(b"!\"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)),
    (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 0xC0),
]


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths of all lines, and the number of lines of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    upper, digits, marks, lower = (np.add.reduceat(kind[data], starts, dtype=np.int32) for kind in _KINDS)
    counts, words, distinct, echoes, seen_before = [], [], [], [], []
    for text in texts:
        lines = text.split(b"\n")
        counts.append(len(lines))
        seen = set()
        for line in lines:
            own = line.split()
            words.append(len(own))
            distinct.append(len(set(own)))
            echoes.append(sum(map(eq, own, own[1:])))
            seen_before.append(len(own) > 2 and line in seen)
            seen.add(line)
    n_lines, words, distinct, echoes = np.array(counts), np.array(words), np.array(distinct), np.array(echoes)
    some, letters = np.maximum(1, length), np.maximum(1, upper + lower)
    x = np.zeros((len(ends), FEATURES), np.float32)
    x[:, 0] = 1
    x[:, 1] = np.minimum(1, 4 * marks / some)
    x[:, 2] = np.where(upper + lower >= 4, upper / letters, 0)
    x[:, 3] = digits / some
    x[:, 4] = np.where(words >= 8, 1 - distinct / np.maximum(1, words), 0)
    x[:, 5] = echoes / np.maximum(1, words)
    x[:, 6] = seen_before
    x[:, 7] = words < 3
    x[:, 8] = np.log1p(length) / 10
    first = np.zeros(len(ends), bool)
    first[np.cumsum(n_lines)[:-1]] = True
    first[0] = True
    near = np.stack([x[:, 1], x[:, 2], np.maximum(x[:, 4], x[:, 5])], axis=1)
    x[1:, OWN : OWN + 3] = near[:-1] * ~first[1:, None]
    x[:-1, OWN + 3 :] = near[1:] * ~first[1:, None]
    return x, length, n_lines


def _long_chain(up: list[float], stay: float, turn: float) -> tuple[list[float], list[float]]:
    """The two odds of ``forward_backward`` for one text, in plain numbers."""
    r, s = [up[0]], [1.0]
    for u in up[1:]:
        r.append(u * (turn + r[-1] * stay) / (1 + r[-1]))
    for u in up[:0:-1]:
        s.append((1 + stay * u * s[-1]) / (1 + turn * u * s[-1]))
    return r, s[::-1]


def forward_backward(unary: np.ndarray, n_lines: np.ndarray, stay_bad: float, to_bad: float) -> tuple[np.ndarray, np.ndarray, float]:
    """For each line the marginal of bad, and of bad after bad; the log of the partition sum.

    With two states a message is one number, its odds of bad against good. All
    texts go a line further at a time and drop out where they end, so memory is a
    few numbers a line whatever the lengths; the few longest go on alone.
    """
    stay, turn = float(np.exp(stay_bad)), float(np.exp(to_bad))
    up = np.exp(np.clip(unary, -30, 30))
    ahead, back = up.copy(), np.ones(len(up))
    begin, order = np.cumsum(n_lines) - n_lines, np.argsort(-n_lines, kind="stable")
    lengths = n_lines[order]
    together = int(lengths[ALONE]) if len(lengths) > ALONE else 0
    active = np.searchsorted(-lengths, -np.arange(together + 1), side="left")
    firsts = begin[order]
    for k in range(1, together):
        at = firsts[: active[k]] + k
        r = ahead[at - 1]
        ahead[at] = up[at] * (turn + r * stay) / (1 + r)
    for k in range(together - 2, -1, -1):
        at = firsts[: active[k + 1]] + k
        us = up[at + 1] * back[at + 1]
        back[at] = (1 + stay * us) / (1 + turn * us)
    for text in order[: ALONE if together else len(order)]:
        if n_lines[text] > together:
            own = slice(begin[text], begin[text] + n_lines[text])
            ahead[own], back[own] = _long_chain(up[own].tolist(), stay, turn)
    both = ahead * back
    twice = np.zeros((len(up), 2))
    # Pairs of states at each step: from good and from bad into bad.
    r, us = ahead[:-1], up[1:] * back[1:]
    total = 1 + r + us * (turn + r * stay)
    twice[1:, 0], twice[1:, 1] = us * turn / total, us * r * stay / total
    twice[begin] = 0
    return both / (1 + both), twice, float(np.log1p(ahead).sum())


class LineField:
    def __init__(self, weights: np.ndarray, stay_bad: float, to_bad: float, slope: float, offset: float):
        self.weights, self.stay_bad, self.to_bad, self.slope, self.offset = weights, stay_bad, to_bad, slope, offset

    def bad_share(self, x: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """The length-weighted marginal of bad of each text."""
        bad, _, _ = forward_backward(x @ self.weights, n_lines, self.stay_bad, self.to_bad)
        at, weight = np.cumsum(n_lines) - n_lines, length + 1.0
        return np.add.reduceat(bad * weight, at) / np.add.reduceat(weight, at)

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, length, n_lines = line_features(texts)
        return 1 / (1 + np.exp(self.slope * _curve(self.bad_share(x, length, n_lines)) - self.offset))


def _curve(share: np.ndarray) -> np.ndarray:
    return np.log(share + 0.003)


def fit_field(x: np.ndarray, length: np.ndarray, n_lines: np.ndarray, labels: np.ndarray) -> LineField:
    """Weights by Adam on the log-likelihood, with lines of bad documents relabelled between rounds."""
    if not len(labels) or labels.min() == labels.max():
        return LineField(np.zeros(FEATURES), 0.0, 0.0, 0.0, 0.0)
    owner = np.repeat(np.arange(len(n_lines)), n_lines)
    start = np.cumsum(n_lines) - n_lines
    later = np.ones(len(owner), bool)
    later[start] = False
    bad = (labels[owner] == 0).astype(float)
    # Each label weighs the same.
    share = np.where(labels == 0, 0.5 / (labels == 0).sum(), 0.5 / (labels == 1).sum())
    w = np.zeros(FEATURES + 2)
    for _ in range(ROUNDS):
        m, v = np.zeros_like(w), np.zeros_like(w)
        weight = (share / np.maximum(1, np.sqrt(n_lines)))[owner]
        before = np.r_[0, bad[:-1]]
        stayed, turned = bad * before * later, bad * (1 - before) * later
        for step in range(1, STEPS + 1):
            p, twice, _ = forward_backward(x @ w[:FEATURES], n_lines, w[-2], w[-1])
            g = np.r_[x.T @ (weight * (p - bad)), (weight * (twice[:, 1] - stayed)).sum(), (weight * (twice[:, 0] - turned)).sum()] + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        p, _, _ = forward_backward(x @ w[:FEATURES], n_lines, w[-2], w[-1])
        worst = np.maximum.reduceat(p, start)
        bad = ((p >= 0.5) | (p == worst[owner])) * (labels[owner] == 0).astype(float)
    field = LineField(w[:FEATURES].copy(), float(w[-2]), float(w[-1]), 1.0, 0.0)
    c = _curve(field.bad_share(x, length, n_lines))
    slope, offset = 1.0, float(np.median(c))
    for _ in range(400):
        p = 1 / (1 + np.exp(np.clip(slope * c - offset, -50, 50)))
        error = share * (labels - p)
        slope, offset = slope - 2.0 * float((error * c).sum() + 1e-3 * (slope - 1)), offset + 2.0 * float(error.sum())
    field.slope, field.offset = max(0.0, slope), offset
    return field


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """The field fitted on a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & ~held_out("id"))
    chosen = {r.id: r.y for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()}
    if not chosen:
        return fit_field(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, int), np.zeros(0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rows_of(batch, "text"):
                made = [line_features([t]) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x, _, _ in made], pa.binary()), pa.array([n.astype(np.int64).tobytes() for _, n, _ in made], pa.binary())], ["id", "x", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text")).where(F.col("id").isin(list(chosen)))
    sample = sorted(((r.id, bytes(r.x), bytes(r.n)) for r in rows.mapInArrow(features, "id long, x binary, n binary").toLocalIterator()))
    if not sample:
        return fit_field(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, int), np.zeros(0))
    x = np.concatenate([np.frombuffer(s[1], np.float32).reshape(-1, FEATURES) for s in sample]).astype(float)
    lengths = [np.frombuffer(s[2], np.int64) for s in sample]
    return fit_field(x, np.concatenate(lengths), np.array([len(n) for n in lengths]), np.array([chosen[s[0]] for s in sample]))


def score_documents(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rows_of(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(field.score(texts))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))
    return rows.mapInArrow(score, "id long, score double")


def accepted(docs: DataFrame, field: LineField, text_col: str = "text", threshold: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rows_of(batch, text_col):
                yield part.filter(pa.array(field.score([t.encode() for t in texts]) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
