"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted on the bytes of whole Arrow batches at once (``statistics``). Training
bins every statistic by quantiles, grows each tree level by level from histograms of gradients,
and keeps the trees as flat arrays (statistic, threshold, value) of complete binary trees, so
that scoring walks all rows through a tree with a few numpy operations and no per-row code.

Only the fit uses a bounded sample: the ``max_train_rows`` labelled rows with the smallest hash
of their ids. Every row is scored. Scores depend on the text alone. Null and empty texts get the
score of their all-zero statistics; rows without a label, with a null label or a null doc_id
aren't learned from; a doc_id that repeats in the labels counts once for each label; an
empty training sample gives the score 0.5 for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRAIN_ROWS = 20_000

# ---- statistics ---------------------------------------------------------------------------

_SYMBOLS = {"stop": ".", "comma": ",", "mark": "!?", "colon": ":;", "quote": "\"'`", "dash": "-_", "pipe": "|", "hash": "#", "star": "*", "sign": "$%&@^~=+", "bracket": "()[]{}", "angle": "<>", "slash": "/\\"}
_CLASSES = ["lower", "upper", "digit", "blank", "newline", "wide", *_SYMBOLS]
NAMES = [*_CLASSES, "log_bytes", "log_words", "word_bytes", "long_words", "one_byte_words", "capital_words", "mark_words", "vowels", "same_twice", "same_thrice", "log_lines", "line_bytes", "repeated_lines", "distinct_words", "top_word", "repeated_pairs"]


def _table() -> np.ndarray:
    out = np.full(256, 255, np.uint8)
    for k, name in enumerate(_CLASSES):
        of = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (32, 9, 11, 12, 13), "newline": (10,), "wide": range(128, 256)}.get(name) or [ord(c) for c in _SYMBOLS[name]]
        out[list(of)] = k
    return out


_CLASS = _table()
_VOWEL = np.isin(np.arange(256), [ord(c) for c in "aeiouAEIOU"])


def _sums(flags: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each text, how many of its bytes are flagged."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[starts + lengths] - total[starts]


def _texts(text: str) -> tuple[float, ...]:
    """What needs the words themselves: lines, repeated lines, distinct words, the commonest word, repeated pairs."""
    lines = [x for x in text.split("\n") if x]
    words = text.split()
    n = len(words)
    if not n:
        return len(lines), 0.0, 0.0, 0.0, 0.0
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    return len(lines), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / n, max(counts.values()) / n, 1 - pairs / max(1, n - 1) if n > 1 else 0.0


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    starts, lengths = offsets[:-1] - (offsets[0] if len(offsets) else 0), np.diff(offsets)
    per = np.maximum(lengths, 1)
    kind = _CLASS[data]
    columns = [_sums(kind == k, starts, lengths) / per for k in range(len(_CLASSES))]

    space = (kind == _CLASSES.index("blank")) | (kind == _CLASSES.index("newline"))
    first = np.zeros(len(data), bool)  # where a text begins
    first[starts[lengths > 0]] = True
    begin = ~space & (first | np.concatenate([[True], space[:-1]])[: len(data)])
    at = np.flatnonzero(begin)
    ends = np.flatnonzero(~space & np.concatenate([space[1:] | first[1:], [True]])[: len(data)]) if len(data) else at
    size = ends - at + 1
    of = np.searchsorted(starts + lengths, at, side="right")
    words = np.bincount(of, minlength=len(texts)).astype(float)
    some = np.maximum(words, 1)
    by = lambda flag: np.bincount(of, weights=flag, minlength=len(texts)) / some
    not_word = ~np.isin(kind, [_CLASSES.index(x) for x in ("lower", "upper", "digit", "wide")])
    same = np.concatenate([[False], data[1:] == data[:-1]])[: len(data)] & ~first & ~space
    thrice = same & np.concatenate([[False], same[:-1]])[: len(data)]
    lines, repeated, distinct, top, pairs = np.array([_texts(t) for t in texts.to_pylist()] or np.zeros((0, 5))).T
    columns += [
        np.log1p(lengths), np.log1p(words), by(size), by(size > 16), by(size == 1), by(kind[at] == 1), by(not_word[ends]),
        _sums(_VOWEL[data], starts, lengths) / per, _sums(same, starts, lengths) / per, _sums(thrice, starts, lengths) / per,
        np.log1p(lines), lengths / np.maximum(lines, 1), repeated, distinct, top, pairs,
    ]
    return np.stack(columns, axis=1)


# ---- boosted trees ------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth as flat arrays, a row a tree. Node i has the children 2i+1
    and 2i+2; a row goes right where its statistic exceeds the threshold."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Logistic loss, second-order leaf values, and the split of largest gain over all
    histograms; a node without a gain passes its rows to the left."""
    inner = 2**depth - 1
    if not len(y) or not 0 < y.sum() < len(y):
        base = 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, m = x.shape
    edges = []
    for f in range(m):
        cuts = np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower"))
        edges.append(cuts[cuts < x[:, f].max()])
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = code + np.arange(m) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    logit = np.full(n, base)
    kept = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            slot = ((node - first)[:, None] * (m * bins) + flat).ravel()
            hist = [np.bincount(slot, weights=np.repeat(v, m), minlength=width * m * bins).reshape(width, m, bins) for v in (g, h)]
            gl, hl = (v.cumsum(axis=2) for v in hist)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + l2)
        logit += value[leaf]
        kept.append((feature, threshold, value))
    return Forest(base, *(np.array(v) for v in zip(*kept)))


# ---- Spark --------------------------------------------------------------------------------


def _score(forest: Forest):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first in range(0, part.num_rows, 500):
                cut = part.slice(first, 500)
                p = forest.predict(statistics(cut.column(cut.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], pa.array(p)], [*cut.schema.names[:-1], "score"])

    return run


def _measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for first in range(0, part.num_rows, 500):
            cut = part.slice(first, 500)
            rows = statistics(cut.column(1))
            yield pa.RecordBatch.from_arrays([cut.column(0), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, *, max_train_rows: int = MAX_TRAIN_ROWS, **options) -> Forest:
    """Fits on the ``max_train_rows`` rows of ``labels`` (doc_id, label 0/1) with the smallest hash,
    whose texts are in ``docs``; so at most that many statistics come to the driver."""
    few = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("double").alias("label"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train_rows)
    # the sample is bounded by max_train_rows rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("label", "text")
    rows = texts.mapInArrow(_measure, "label double, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(-1, len(NAMES))
    order = np.lexsort(np.column_stack([rows["label"].to_numpy(), x]).T) if len(x) else slice(None)  # the same model whatever order rows arrive in
    return fit(x[order], rows["label"].to_numpy()[order], **options)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score for each row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(forest), "doc_id long, score double")


def keep(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, in full, that score at least ``threshold``."""
    columns = docs.columns
    rest = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("_text"))
    schema = rest.select("row").schema.add("score", "double")
    return rest.mapInArrow(_score(forest), schema).where(F.col("score") >= threshold).select(*[F.col("row").getField(c).alias(c) for c in columns])
