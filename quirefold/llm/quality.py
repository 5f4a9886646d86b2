"""Quality classifier: a linear-chain conditional random field over lines (operator 1).

Every line of a text is good or bad.  A line's features describe the line and
its two neighbours; the chain's transitions tie neighbours together.  The
document's score is the mean of the lines' forward-backward marginals of
"good", weighted by line length in bytes.

Labels exist for documents only, so in training all lines of a document carry
its label; the penalty on the weights keeps the transitions finite.  The model
is fitted on a bounded sample of labelled rows (of the ``max_docs`` labelled
documents with the smallest hash of their id those with ``max_lines`` lines or
fewer), and applied to every line of every document.  Features are made for
some lines at a time and long chains are walked in blocks, so a text of very
many lines costs memory for a few numbers a line.

Defined cases: a null or empty text is one empty line and gets a score like
any other; labels or documents without id, or labels that are null, are no
training rows; without any usable label of either class every score is 0.5;
repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_size, emit, id_and_text

#: Character classes of bytes: letters and the rest of UTF-8 are 0.
_UPPER, _DIGIT, _SPACE, _POINT, _SYMBOL = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = _SYMBOL
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t\r\x0b\x0c\n", _SPACE), (b".,;:'\"-()?", _POINT)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _kind

OWN = ("length", "upper", "symbol", "digit", "point", "repeated_words", "adjacent_words", "word_length", "closed", "short", "repeated_line")
#: Features that a line also takes from the line before and the line after.
NEIGHBOUR = (1, 2, 5, 6, 10)


#: Lines whose features are made at once, and the chain length from which lines are no longer walked one by one.
LINES, LONG = 50_000, 4_096


def own_features(parts: list[tuple[list[str], set[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of lines by themselves and their weights (bytes, 1 at least); each part has its text's lines seen so far."""
    raw = np.frombuffer(("\n".join("\n".join(lines) for lines, _ in parts) + "\n").encode(), np.uint8)
    kind = _CLASS[raw]
    upper = np.flatnonzero(raw == 0xC3) + 1
    kind[upper[(raw[upper] >= 0x80) & (raw[upper] <= 0x9E)]] = _UPPER
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = {k: np.add.reduceat((kind == k).view(np.uint8), starts, dtype=np.int64) for k in (_UPPER, _DIGIT, _SPACE, _POINT, _SYMBOL)}
    size = ends - starts
    solid = np.maximum(size + 1 - count[_SPACE], 1)

    words = []
    for lines, seen in parts:
        for line in lines:
            w = line.split()
            words.append((len(w), len(set(w)), sum(map(eq, w, w[1:])), line in seen))
            if len(w) > 2:
                seen.add(line)
    w = np.array(words, dtype=np.float64).reshape(-1, 4)
    n = np.maximum(w[:, 0], 1)
    last = raw[np.maximum(ends - 1, 0)]
    own = np.stack([
        np.log1p(size) / 6,
        count[_UPPER] / solid,
        np.sqrt(count[_SYMBOL] / solid),
        np.sqrt(count[_DIGIT] / solid),
        np.sqrt(count[_POINT] / solid),
        np.where(w[:, 0] > 0, 1 - w[:, 1] / n, 0) / np.log2(n + 2),
        np.sqrt(w[:, 2] / n),
        np.minimum(solid / n, 40) / 10,
        (size > 0) & np.isin(last, np.frombuffer(b".?!\"", np.uint8)),
        w[:, 0] < 4,
        w[:, 3],
    ], axis=1)
    return own, size + 1


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``own_features`` of all lines of all texts, ``LINES`` or fewer at a time."""
    parts, n = [], 0
    for text in texts:
        lines, seen = text.split("\n"), set()
        for k in range(0, len(lines), LINES):
            part = lines[k : k + LINES]
            if parts and n + len(part) > LINES:
                yield own_features(parts)
                parts, n = [], 0
            parts.append((part, seen))
            n += len(part)
    if parts:
        yield own_features(parts)


def _count_lines(texts: list[str]) -> np.ndarray:
    return np.array([t.count("\n") + 1 for t in texts])


def _borders(n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and of the last line of each text."""
    ends = np.cumsum(n_lines)
    return ends - n_lines, ends - 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines, with the neighbours' and the two borders', and the number of lines of each text."""
    own, n_lines = np.concatenate([x for x, _ in _blocks(texts)]), _count_lines(texts)
    first, final = np.zeros(len(own), bool), np.zeros(len(own), bool)
    for flag, at in zip((first, final), _borders(n_lines)):
        flag[at] = True
    before, after = np.roll(own[:, NEIGHBOUR], 1, axis=0), np.roll(own[:, NEIGHBOUR], -1, axis=0)
    before[first], after[final] = 0, 0
    return np.concatenate([own, before, after, first[:, None], final[:, None]], axis=1), n_lines


def _softplus2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(emission: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For padded chains [n, t]: P(good) of each line, pair counts [n, 2, 2], and log Z [n].

    ``emission`` is the log odds of good; lines beyond a chain's end are masked.
    """
    n, t = emission.shape
    e = np.stack([np.zeros_like(emission), emission], axis=2)
    alpha = np.empty((t, n, 2))
    alpha[0] = e[:, 0]
    for k in range(1, t):
        step = _softplus2(alpha[k - 1][:, :1] + trans[0], alpha[k - 1][:, 1:] + trans[1]) + e[:, k]
        alpha[k] = np.where(mask[:, k, None], step, alpha[k - 1])
    z = _softplus2(alpha[-1][:, 0], alpha[-1][:, 1])
    beta = np.zeros((n, 2))
    good = np.empty((n, t))
    pairs = np.zeros((n, 2, 2))
    for k in range(t - 1, -1, -1):
        good[:, k] = np.exp(alpha[k][:, 1] + beta[:, 1] - z)
        if k:
            right = e[:, k] + beta
            joint = np.exp(alpha[k - 1][:, :, None] + trans[None] + right[:, None, :] - z[:, None, None])
            pairs += np.where(mask[:, k, None, None], joint, 0)
            back = _softplus2(trans[:, 0] + right[:, :1], trans[:, 1] + right[:, 1:])
            beta = np.where(mask[:, k, None], back, beta)
    return good, pairs, z


def long_marginals(emission: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of each line of one chain, walked in about sqrt(n) blocks side by side.

    A block is a 2 x 2 matrix of sums over its paths, so the blocks' borders
    come from one short walk over the matrices in either direction.
    """
    steps = len(emission) - 1
    width = int(np.ceil(np.sqrt(steps)))
    blocks = -(-steps // width)
    e = np.zeros((blocks * width, 2))
    e[:steps, 1] = emission[1:]
    mask = (np.arange(blocks * width) < steps).reshape(blocks, width)
    e = e.reshape(blocks, width, 2)

    def onward(a: np.ndarray, k: int) -> np.ndarray:
        step = np.logaddexp(a[..., :1] + trans[0], a[..., 1:] + trans[1])
        here = (slice(None), *[None] * (a.ndim - 2))
        return np.where(mask[:, k][here][..., None], step + e[:, k][here], a)

    through = np.tile(np.array([[0.0, -np.inf], [-np.inf, 0.0]]), (blocks, 1, 1))
    for k in range(width):
        through = onward(through, k)
    start, end = np.empty((blocks, 2)), np.zeros((blocks, 2))
    at = np.array([0.0, emission[0]])
    for b in range(blocks):
        start[b] = at
        at = np.logaddexp(at[0] + through[b, 0], at[1] + through[b, 1])
    z = np.logaddexp(*at)
    at = np.zeros(2)
    for b in range(blocks - 1, -1, -1):
        end[b] = at
        at = np.logaddexp(through[b, :, 0] + at[0], through[b, :, 1] + at[1])
    first = np.exp(emission[0] + at[1] - z)
    alpha = np.empty((blocks, width))
    for k in range(width):
        start = onward(start, k)
        alpha[:, k] = start[:, 1]
    for k in range(width - 1, -1, -1):
        alpha[:, k] += end[:, 1]
        right = e[:, k] + end
        back = np.logaddexp(trans[:, 0] + right[:, :1], trans[:, 1] + right[:, 1:])
        end = np.where(mask[:, k, None], back, end)
    return np.concatenate([[first], np.exp(alpha.ravel()[:steps] - z)])


def _padded(starts: np.ndarray, n_lines: np.ndarray):
    """Chains of similar length together: (rows of the chains, flat positions [n, t], mask [n, t])."""
    width = 1 << np.ceil(np.log2(n_lines)).astype(int)
    for t in np.unique(width):
        rows = np.flatnonzero(width == t)
        for rows in np.array_split(rows, -(-len(rows) * int(t) // 2_000_000)):
            at = starts[rows, None] + np.arange(t)
            mask = np.arange(t) < n_lines[rows, None]
            yield rows, np.where(mask, at, starts[rows, None]), mask


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        emission, size, n_lines = self.emissions(texts)
        out = np.empty(len(texts))
        short = np.flatnonzero(n_lines <= LONG)
        starts, ends = _borders(n_lines)
        for k in np.flatnonzero(n_lines > LONG):
            w = size[starts[k] : ends[k] + 1]
            out[k] = (long_marginals(emission[starts[k] : ends[k] + 1], self.trans) * w).sum() / w.sum()
        for rows, at, mask in _padded(starts[short], n_lines[short]):
            good, _, _ = forward_backward(np.where(mask, emission[at], 0), mask, self.trans)
            w = np.where(mask, size[at], 0)
            out[short[rows]] = (good * w).sum(1) / w.sum(1)
        return np.clip(out, 0, 1)

    def emissions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds and weight of each line, and the number of lines of each text."""
        w = self.weights / self.scale
        d, k = len(OWN), len(NEIGHBOUR)
        parts = [(x @ w[:d], x[:, NEIGHBOUR] @ w[d : d + k], x[:, NEIGHBOUR] @ w[d + k : d + 2 * k], size) for x, size in _blocks(texts)]
        own, to_next, to_previous, size = map(np.concatenate, zip(*parts))
        n_lines = _count_lines(texts)
        first, final = _borders(n_lines)
        before, after = np.roll(to_next, 1), np.roll(to_previous, -1)
        before[first], after[final] = w[-2], w[-1]
        # A border stands in the place of the neighbour that is missing.
        return own + before + after + self.bias - self.mean @ w, size, n_lines


def fit_chains(x: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, penalty: float = 1e-2, steps: int = 120, rate: float = 0.15) -> Model:
    """Penalised likelihood by Adam; all lines of a chain carry its label; both classes weigh the same per chain."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    x = (x - mean) / scale
    d = x.shape[1]
    theta, m, v = np.zeros(d + 5), np.zeros(d + 5), np.zeros(d + 5)
    groups = list(_padded(_borders(n_lines)[0], n_lines))
    total = len(labels)
    for step in range(1, steps + 1):
        w, b, trans = theta[:d], theta[d], theta[d + 1 :].reshape(2, 2)
        grad = np.zeros_like(theta)
        emission = x @ w + b
        for rows, at, mask in groups:
            good, pairs, _ = forward_backward(np.where(mask, emission[at], 0), mask, trans)
            y = labels[rows]
            per_line = (y[:, None] - good) * mask / n_lines[rows, None]  # each document counts once
            grad[:d] += np.tensordot(per_line, x[at], 2)
            grad[d] += per_line.sum()
            seen = np.zeros_like(pairs)
            seen[np.arange(len(rows)), y, y] = n_lines[rows] - 1
            grad[d + 1 :] += ((seen - pairs) / n_lines[rows, None, None]).sum(0).ravel()
        grad = grad / total - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, theta[:d].copy(), float(theta[d]), theta[d + 1 :].reshape(2, 2).copy())


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 2000, max_lines: int = 400) -> Model | None:
    """The model from at most ``max_docs`` labelled rows whose crc32(doc_id) mod 5 is not 0; None without both classes.

    Documents of more than ``max_lines`` lines are no rows of the sample, so it
    is bounded; those in it count with all their lines.
    """
    arrow_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where("doc_id IS NOT NULL AND quality IN (0, 1) AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "quality").limit(max_docs)
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    # max_docs rows bound the broadcast side; the limit after the join holds where ids repeat.
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").where(breaks < max_lines).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(max_docs)
    schema = pa.schema([("quality", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for t in by_size(batches, limit=2_000_000):
            x, n_lines = line_features(t["text"].to_pylist())
            parts = np.split(x.astype(np.float32), np.cumsum(n_lines)[:-1])
            yield from emit({"quality": t["quality"], "x": [p.tobytes() for p in parts]}, schema)

    found = rows.select("quality", "text").mapInArrow(run, "quality int, x binary").collect()
    y = np.array([r["quality"] for r in found], dtype=int)
    if len(set(y.tolist())) < 2:
        return None
    width = len(OWN) + 2 * len(NEIGHBOUR) + 2
    parts = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, width) for r in found]
    return fit_chains(np.concatenate(parts).astype(np.float64), np.array([len(p) for p in parts]), y)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for t in by_size(batches, limit=4_000_000):
            texts = t["text"].to_pylist()
            yield from emit({"doc_id": t["doc_id"], "score": model.score(texts) if model else [0.5] * len(texts)}, schema)

    arrow_batches(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, all their columns, whose text scores ``threshold`` or more."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for t in by_size(batches, names[at], limit=4_000_000):
            texts = [x or "" for x in t.column(at).to_pylist()]
            keep = model.score(texts) >= threshold if model else np.ones(len(texts), bool)
            yield from t.filter(pa.array(keep)).to_batches()

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
