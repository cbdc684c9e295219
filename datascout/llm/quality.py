"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own and those of the lines before and after it; a
transition weight ties it to its neighbours' states. Forward-backward gives the marginal of each
line, and their mean, weighted by length, is the quality of the document, which a logistic curve
turns into a probability. Training lines take the label of their document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.llm.bpe import slices
from datascout.llm.stage import released

#: Labelled documents the model is fitted on, and the characters and lines one of them may have.
SAMPLED_DOCS, SAMPLED_CHARS, SAMPLED_LINES = 3_000, 60_000, 400
EPOCHS, STEP, DECAY = 60, 0.05, 1e-4
BATCH_BYTES = 4_000_000
#: Words that end in a run of symbols other than punctuation.
MARKED = re.compile(r"[^\w\s.,;:!?()'\"\-|]+(?=\s|$)")
#: Character classes by code point, for the planes that hold most letters.
KINDS = np.array(
    [(c := unicodedata.category(chr(i)))[0] == "L" and (2 if c == "Lu" else 1) or (3 if c == "Nd" else 4 if c[0] in "PS" else 0) for i in range(0x3000)],
    np.uint8,
)
OWN = 13


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (a row per line that is not blank; one row of zeros if there is none) and lengths."""
    lines = [s for x in text.split("\n") if (s := x.strip())]
    if not lines:
        return np.zeros((1, OWN)), np.ones(1)
    rows = []
    seen_lines: set[int] = set()
    seen: set[int] = set()
    for line in lines:
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.bincount(KINDS[np.minimum(codes, len(KINDS) - 1)], minlength=5)
        chars, letters = len(codes), kinds[1] + kinds[2]
        words = line.split()
        n = len(words)
        low = line.lower().split() if kinds[2] else words
        triples = set(map(hash, zip(low, low[1:], low[2:])))
        met = len(triples & seen)
        seen |= triples
        name = hash(line)
        rows.append(
            (
                log1p(chars) / 5,
                letters / chars,
                kinds[2] / (letters + 1),
                kinds[3] / chars,
                kinds[4] / chars,
                words.count("|") / n,
                min(chars / n, 40) / 10,
                len(set(low)) / n,
                sum(map(str.__eq__, low, low[1:])) / n,
                len(MARKED.findall(line)) / n,
                line.count("!") / n,
                float(name in seen_lines),
                (max(0, n - 2) - len(triples) + met) / n,
            )
        )
        seen_lines.add(name)
    return np.array(rows, np.float64), np.array([len(x) for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line after, and whether those exist."""
    t = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((t, 3))
    edge[0, 0] = edge[-1, 1] = edge[:, 2] = 1
    return np.hstack([own, before, after, edge])


def marginals(scores: list[float], turn: list[list[float]]) -> list[float]:
    """P(good) of each line from its log-odds and the transition weights turn[from][to]."""
    (bb, bg), (gb, gg) = ([exp(x) for x in row] for row in turn)

    def passed(x: float, a: float, b: float, c: float, d: float) -> float:
        # Log-odds that a neighbour of log-odds x hands on.
        x = exp(max(-50.0, min(50.0, x)))
        return log((a * x + b) / (c * x + d))

    forward, x = [], 0.0
    for i, s in enumerate(scores):
        x = s + (passed(x, gg, bg, gb, bb) if i else 0.0)
        forward.append(x)
    out, back = [0.0] * len(scores), 0.0
    for i in range(len(scores) - 1, -1, -1):
        x = max(-50.0, min(50.0, forward[i] + back))
        out[i] = 1 / (1 + exp(-x))
        back = passed(scores[i] + back, gg, gb, bg, bb)
    return out


class Model:
    """Weights of the field (`w`, `turn`), scaling of the features, and the final curve."""

    def __init__(self, docs: list[tuple[str, int]]):
        self.prior = (1 + sum(y for _, y in docs)) / (2 + len(docs))
        found = [(line_features(t), y) for t, y in docs if t]
        found = [(own, lengths, y) for (own, lengths), y in found if len(own) <= SAMPLED_LINES]
        self.fitted = len({y for _, _, y in found}) == 2
        if not self.fitted:
            return
        x = [with_neighbours(own) for own, _, _ in found]
        flat = np.vstack(x)
        self.mean, self.scale = flat.mean(0), flat.std(0) + 1e-6
        self.mean[-1], self.scale[-1] = 0.0, 1.0
        self.w, self.turn = np.zeros(flat.shape[1]), np.zeros((2, 2))
        self._fit([(a - self.mean) / self.scale for a in x], [y for _, _, y in found])
        self.slope, self.shift = 1.0, 0.0
        quality = np.array([self._quality(own, lengths) for own, lengths, _ in found])
        self._curve(quality, np.array([y for _, _, y in found]))

    def _fit(self, x: list[np.ndarray], y: list[int]) -> None:
        """Adam on the mean log-likelihood of the label sequences, in batches of similar length."""
        order = sorted(range(len(x)), key=lambda i: len(x[i]))
        batches = []
        for a in range(0, len(order), 64):
            some = order[a : a + 64]
            t = max(len(x[i]) for i in some)
            data, mask = np.zeros((len(some), t, len(self.w))), np.zeros((len(some), t))
            for r, i in enumerate(some):
                data[r, : len(x[i])], mask[r, : len(x[i])] = x[i], 1
            batches.append((data, mask, np.array([y[i] for i in some])))
        rng = np.random.default_rng(5)
        theta, m, v, step = np.zeros(len(self.w) + 4), 0.0, 0.0, 0
        for epoch in range(EPOCHS):
            for b in rng.permutation(len(batches)):
                step += 1
                g = self._gradient(theta, *batches[b]) + DECAY * theta
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                rate = STEP * (1 - epoch / EPOCHS)
                theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.turn = theta[:-4], theta[-4:].reshape(2, 2)

    @staticmethod
    def _gradient(theta: np.ndarray, data: np.ndarray, mask: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the negative mean log-likelihood: expected less observed features."""
        b, t, _ = data.shape
        s = data @ theta[:-4]
        trans = np.exp(theta[-4:].reshape(2, 2))
        emit = np.stack([1 / (1 + np.exp(np.clip(s, -50, 50))), 1 / (1 + np.exp(-np.clip(s, -50, 50)))], 2)
        fwd, bwd = np.zeros((b, t, 2)), np.ones((b, t, 2))
        fwd[:, 0] = emit[:, 0]
        for i in range(1, t):
            f = (fwd[:, i - 1] @ trans) * emit[:, i]
            fwd[:, i] = np.where(mask[:, i, None] > 0, f / f.sum(1, keepdims=True), fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            g = (bwd[:, i + 1] * emit[:, i + 1]) @ trans.T
            bwd[:, i] = np.where(mask[:, i + 1, None] > 0, g / g.sum(1, keepdims=True), 1.0)
        joint = fwd * bwd
        good = joint[:, :, 1] / joint.sum(2)
        pull = (good - y[:, None]) * mask
        pairs = fwd[:, :-1, :, None] * trans * (emit * bwd)[:, 1:, None, :]
        pairs = pairs / pairs.sum((2, 3), keepdims=True) * mask[:, 1:, None, None]
        seen = np.zeros((b, 2, 2))
        seen[np.arange(b), y, y] = mask[:, 1:].sum(1)
        turn = (pairs.sum(1) - seen).sum(0)
        return np.concatenate([np.einsum("bt,btf->f", pull, data), turn.reshape(-1)]) / mask.sum()

    def _quality(self, own: np.ndarray, lengths: np.ndarray) -> float:
        scores = ((with_neighbours(own) - self.mean) / self.scale) @ self.w
        good = np.array(marginals(scores.tolist(), self.turn.tolist()))
        return float((good * lengths).sum() / lengths.sum())

    def _curve(self, quality: np.ndarray, y: np.ndarray) -> None:
        """Logistic fit of the labels on the log-odds of the quality, by Newton steps with a ridge."""
        x = np.column_stack([_logit(quality), np.ones(len(quality))])
        beta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            beta = beta - np.linalg.solve(h, x.T @ (p - y) + 0.1 * (beta - [1.0, 0.0]))
        self.slope, self.shift = float(max(beta[0], 0.05)), float(beta[1])

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return float(self.prior)
        return 1 / (1 + exp(-max(-50.0, min(50.0, self.slope * _logit(self._quality(*line_features(text or ""))) + self.shift))))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the part that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most 2 * SAMPLED_DOCS labelled documents that are not held out, chosen by the hash
    of their ids; texts over SAMPLED_CHARS are passed over. Labels other than 0 and 1 are ignored.
    Without documents of both labels every score is the smoothed share of good ones."""
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    one_in = max(1, usable.count() // SAMPLED_DOCS)
    chosen = usable.where(F.pmod(F.xxhash64("i"), F.lit(one_in)) == 0).limit(2 * SAMPLED_DOCS)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.char_length("t") <= SAMPLED_CHARS)
    rows = texts.join(F.broadcast(chosen), "i").select("i", "t", "y").collect()  # bounded by the limit above
    return Model([(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["i"], r["t"]))])


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """Adds the score (0 to 1, higher: label 1 likelier) of each whole text; null counts as empty.

    Every row has a score of its own, equal texts equal ones. Columns of any names pass through; one
    called `into` is replaced.
    """
    kept = docs.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, BATCH_BYTES):
                scores = pa.array([model.score(t.as_py()) for t in part.column(text_col)], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), scores], names=[*names, into])

    return kept.mapInArrow(lambda b: released(run(b)), schema)
