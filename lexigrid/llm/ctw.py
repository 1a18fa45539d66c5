"""Context-tree weighting over bytes, and a unigram base line over words.

A text is its lower-cased (A-Z) UTF-8 bytes, with START bytes before it and one END byte after it.
Each byte is eight binary decisions, from the high bit down; every decision has a context tree
of its own over the ``DEPTH`` bytes before. A node predicts by the Krichevsky-Trofimov estimate of
its counts, and a tree mixes the estimates of all depths: a node's weighted probability is half its
own estimate plus half the product of its children's, so the chance that the context ends at a
node follows from the training bytes themselves. Unseen contexts predict 1/2 a bit. The code
length of a text is minus the sum of the logarithms over all its bytes.

How it is distributed. The corpus is read once and laid into chunk files of about CHUNK_BYTES of
text; each chunk contributes its distinct (context, byte) strings with training counts. Strings
are gathered by their two nearest context bytes, so each task has whole subtrees. One pass over
them sums what the two upper levels of all trees need (at most 2**16 nodes, a fixed bound, solved on
the driver); a second works out the mixed probability of each string and answers every chunk for
just the strings that it has. The model is never sent anywhere as a whole, and it grows with the
corpus. Word counts go the same way. Chunk files have a name of their own for each attempt of a
task, and only rows of the attempt that succeeded name them.

Defined results: a null or empty text has one token, its end, and is scored by the end's
probability; a text of any length belongs to one chunk, as a whole; rows that repeat a doc_id are texts each; without any training text every bit has
probability 1/2 and base_score is 0 (V and N being 0, c + 1 over N + V + 1 is 1); an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH, CHUNK_BYTES = 5, 8 << 20
START, END = 0xFE, 0xFF  # never in UTF-8
_SQUEEZE = 1
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"

# -- strings of a chunk


def strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: the context, nearest byte on top, above the byte
    itself, as one number; and how many each text has."""
    data = np.frombuffer(b"".join(bytes([START]) * depth + t + bytes([END]) for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    keys = data.astype(np.uint64)
    for k in range(1, depth + 1):
        keys[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * (depth - k + 1))
    return keys[data != START], size


def bucket_of(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """By the two nearest context bytes."""
    near = (keys >> np.uint64(8 * (depth - 1))).astype(np.uint64)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def squeeze(a: np.ndarray) -> bytes:
    """Compressed, byte planes apart."""
    return zstandard.ZstdCompressor(_SQUEEZE).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() or b"")


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys)))


# -- context trees

_SMALL = 1 << 15
_HALF = np.array([math.lgamma(i + 0.5) for i in range(_SMALL)])
_WHOLE = np.array([math.lgamma(i + 1.0) for i in range(_SMALL)])


def _lgamma(n: np.ndarray, plus: float, small: np.ndarray) -> np.ndarray:
    x = n + plus
    big = n >= _SMALL
    out = small[np.where(big, 0, n)]
    if big.any():
        y = x[big]
        out[big] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a, 0.5, _HALF) + _lgamma(b, 0.5, _HALF) - _lgamma(a + b, 1.0, _WHOLE) - math.log(math.pi)


def mix(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted log probability, and the weight of its own estimate."""
    total = np.logaddexp(own, below)
    return total - math.log(2), np.exp(own - total)


class Trees:
    """The subtrees below the two nearest context bytes, for sorted distinct ``keys`` with training
    counts ``n`` (0 for strings that only occur elsewhere: they change nothing)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.depth, self.rows, self.up = depth, {depth: (keys, n)}, {}
        for d in range(depth - 1, 1, -1):
            below, count = self.rows[d + 1]
            shorter = ((below >> np.uint64(16)) << np.uint64(8)) | (below & np.uint64(255))
            found, self.up[d + 1] = np.unique(shorter, return_inverse=True)
            self.rows[d] = found, np.bincount(self.up[d + 1], weights=count, minlength=len(found)).astype(np.int64)

    def bit(self, j: int) -> tuple[dict, dict]:
        """Of bit j, by depth: for each row its node; for each node its zeros, ones, weight, weighted log probability and first row."""
        nodes, of = {}, {}
        for d in range(self.depth, 1, -1):
            keys, n = self.rows[d]
            group = keys >> np.uint64(8 - j)
            new = np.concatenate([[True], group[1:] != group[:-1]])
            first = np.flatnonzero(new)
            of[d] = np.cumsum(new) - 1
            one = (keys >> np.uint64(7 - j)) & np.uint64(1) == 1
            b = np.add.reduceat(np.where(one, n, 0), first)
            a = np.add.reduceat(n, first) - b
            own = log_kt(a, b)
            if d == self.depth:
                total, weight = own, np.ones(len(own))
            else:
                parent = of[d][self.up[d + 1][nodes[d + 1][4]]]
                total, weight = mix(own, np.bincount(parent, weights=nodes[d + 1][3], minlength=len(own)))
            nodes[d] = a, b, weight, total, first
        return nodes, of

    def upper(self) -> tuple[np.ndarray, ...]:
        """What the level above needs, by nearest byte * 256 + (1 << j | bits so far): zeros, ones, and
        the sum of the weighted log probabilities below."""
        place, zeros, ones, below = [], [], [], []
        for j in range(8):
            nodes, _ = self.bit(j)
            a, b, _, total, first = nodes[2]
            key = self.rows[2][0][first]
            at = ((key >> np.uint64(16)) << np.uint64(8) | np.uint64(1 << j) | ((key & np.uint64(255)) >> np.uint64(8 - j))).astype(np.int64)
            place.append(at), zeros.append(a), ones.append(b), below.append(total)
        at, back = np.unique(np.concatenate(place), return_inverse=True)
        total = lambda x: np.bincount(back, weights=np.concatenate(x), minlength=len(at))
        return at, total(zeros).astype(np.int64), total(ones).astype(np.int64), total(below)

    def log10(self, top: "Top") -> np.ndarray:
        """The mixed log10 probability of each key's byte after its context."""
        keys, _ = self.rows[self.depth]
        out = np.zeros(len(keys))
        near = (keys >> np.uint64(8 * self.depth)).astype(np.int64)
        symbol = (keys & np.uint64(255)).astype(np.int64)
        for j in range(8):
            nodes, of = self.bit(j)
            one = (symbol >> (7 - j)) & 1 == 1
            row, p = np.arange(len(keys)), None
            for d in range(self.depth, 1, -1):
                a, b, weight, _, _ = nodes[d]
                node = of[d][row]
                kt = (np.where(one, b[node], a[node]) + 0.5) / (a[node] + b[node] + 1)
                p = kt if p is None else weight[node] * kt + (1 - weight[node]) * p
                row = self.up[d][row] if d > 2 else row
            m = 1 << j | symbol >> (8 - j)
            for a, b, weight, at in ((top.a1, top.b1, top.w1, near << 8 | m), (top.a0, top.b0, top.w0, m)):
                kt = (np.where(one, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
                p = weight[at] * kt + (1 - weight[at]) * p
            out += np.log10(p)
        return out


class Top:
    """The two upper levels of all trees."""

    def __init__(self, at: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.a1, self.b1, low = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
        self.a1[at], self.b1[at], low[at] = zeros, ones, below
        total, self.w1 = mix(log_kt(self.a1, self.b1), low)
        total[(self.a1 + self.b1) == 0] = 0  # unseen nodes
        fold = lambda x: x.reshape(256, 256).sum(axis=0)
        self.a0, self.b0 = fold(self.a1), fold(self.b1)
        _, self.w0 = mix(log_kt(self.a0, self.b0), fold(total))


# -- words


def word_bucket(word: bytes, buckets: int) -> int:
    import zlib

    return zlib.crc32(word) % buckets


# -- Spark

CHUNK = pa.schema([("chunk", pa.string()), ("kind", pa.string()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64())])
CHUNK_SQL = "chunk string, kind string, bucket long, keys binary, counts binary, tokens long"
ANSWER = pa.schema([("chunk", pa.string()), ("kind", pa.string()), ("bucket", pa.int64()), ("values", pa.binary()), ("distinct", pa.int64())])
ANSWER_SQL = "chunk string, kind string, bucket long, values binary, distinct long"


def _text(x) -> bytes:
    return (x or "").encode().lower()  # of bytes, lower() changes A-Z only


def _count(texts: list[bytes], train: np.ndarray, depth: int, buckets: int) -> Iterator[tuple]:
    """kind, bucket, keys, counts, tokens of a chunk."""
    keys, size = strings(texts, depth)
    every, _ = distinct(keys)
    some, n = distinct(keys[np.repeat(train, size)])
    counts = np.zeros(len(every), np.uint32)
    counts[np.searchsorted(every, some)] = n
    where = bucket_of(every, depth, buckets)
    order = np.argsort(where, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        delta = np.diff(every[part], prepend=np.uint64(0))
        yield "string", int(where[part[0]]), squeeze(delta), squeeze(counts[part]), 0
    seen: Counter = Counter()
    other: Counter = Counter()
    for t, learn in zip(texts, train.tolist()):
        (seen if learn else other).update(t.split())
    parts: dict[int, list[bytes]] = {}
    for w in sorted(seen.keys() | other.keys()):
        parts.setdefault(word_bucket(w, buckets), []).append(w)
    ends = int(train.sum())
    if ends:
        parts.setdefault(0, [])
    for b, words in parts.items():
        yield "word", b, zstandard.ZstdCompressor(_SQUEEZE).compress(b" ".join(words)), squeeze(np.array([seen[w] for w in words], np.uint32)), sum(seen[w] for w in words) + (ends if b == 0 else 0)


def _chunker(folder: str, depth: int, buckets: int):
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("train", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/chunks", recursive=True)

        def close(wait: list[pa.RecordBatch]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.arrow"
            held = pa.Table.from_batches(wait, kinds).combine_chunks()
            with fs.open_output_stream(f"{base}/chunks/{name}", compression=None) as out, pa.ipc.new_file(out, kinds, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(held)
            rows = [(name, *r) for r in _count([_text(x) for x in held["text"].to_pylist()], held["train"].to_numpy(), depth, buckets)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNK)], schema=CHUNK)

        wait, size = [], 0
        for part in parts:
            for first in range(0, part.num_rows, 100):
                cut = part.slice(first, 100)
                wait.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cut.columns, kinds)], schema=kinds))
                size += sum(len(x) for x in cut.column(1).to_pylist() if x)
                if size >= CHUNK_BYTES:
                    yield close(wait)
                    wait, size = [], 0
        if wait:
            yield close(wait)

    return run


def _gather(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All chunks' strings of a bucket: the distinct ones with summed counts; of each chunk's, in turn, the place; and how many a chunk has."""
    each = [np.cumsum(unsqueeze(k, "<u8"), dtype=np.uint64) for k in rows["keys"].to_pylist()]
    counts = np.concatenate([unsqueeze(c, "<u4") for c in rows["counts"].to_pylist()])
    keys, back = np.unique(np.concatenate(each), return_inverse=True)
    return keys, np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64), back, [len(e) for e in each]


def _upper(depth: int):
    def run(rows: pa.Table) -> pa.Table:
        keys, n, _, _ = _gather(rows)
        known = n > 0
        if not known.any():
            return pa.table({"at": pa.array([], pa.int64()), "zeros": pa.array([], pa.int64()), "ones": pa.array([], pa.int64()), "below": pa.array([], pa.float64())})
        return pa.table(dict(zip(("at", "zeros", "ones", "below"), map(pa.array, Trees(keys[known], n[known], depth).upper()))))

    return run


def _answer(depth: int, top: Top):
    def run(rows: pa.Table) -> pa.Table:
        bucket, kind, out, known = rows["bucket"][0].as_py(), rows["kind"][0].as_py(), [], 0
        if kind == "string":
            keys, n, back, sizes = _gather(rows)
            found = Trees(keys, n, depth).log10(top).astype(np.float32)[back]
            for chunk, part in zip(rows["chunk"].to_pylist(), np.split(found, np.cumsum(sizes)[:-1])):
                out.append((chunk, kind, bucket, squeeze(part), 0))
        else:
            each = [zstandard.ZstdDecompressor().decompress(k).split() for k in rows["keys"].to_pylist()]
            total: Counter = Counter()
            for words, counts in zip(each, rows["counts"].to_pylist()):
                for w, c in zip(words, unsqueeze(counts, "<u4").tolist()):
                    total[w] += c
            known = sum(c > 0 for c in total.values())
            for chunk, words in zip(rows["chunk"].to_pylist(), each):
                out.append((chunk, kind, bucket, squeeze(np.array([total[w] for w in words], np.uint64)), known))
                known = 0  # said once
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), ANSWER)], schema=ANSWER)

    return run


def _score(folder: str, depth: int, buckets: int, train_tokens: int, train_words: int, ends: int):
    def run(rows: pa.Table) -> pa.Table:
        fs, base = FileSystem.from_uri(folder)
        with fs.open_input_file(f"{base}/chunks/{rows['chunk'][0].as_py()}") as f:
            held = pa.ipc.open_file(f).read_all()
        texts = [_text(x) for x in held["text"].to_pylist()]
        answers = {(k, b): v for k, b, v in zip(rows["kind"].to_pylist(), rows["bucket"].to_pylist(), rows["values"].to_pylist())}

        keys, size = strings(texts, depth)
        code, every = pd.factorize(keys)  # hashed: far cheaper than a search for each byte
        where = bucket_of(every, depth, buckets)
        value = np.zeros(len(every), np.float64)
        order = np.lexsort((every, where))  # a bucket's answers are in the order of its keys
        for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            value[part] = unsqueeze(answers["string", int(where[part[0]])], "<f4")
        starts = np.cumsum(size) - size
        score = np.add.reduceat(value[code], starts)

        words = [t.split() for t in texts]
        parts: dict[int, list[bytes]] = {}
        for w in sorted(set().union(*words)):
            parts.setdefault(word_bucket(w, buckets), []).append(w)
        counts = {}
        for b, some in parts.items():
            counts.update(zip(some, unsqueeze(answers["word", b], "<u8").tolist()))
        vocabulary = train_words + (ends > 0)
        below = math.log10(train_tokens + vocabulary + 1)
        logs = {w: math.log10(c + 1) - below for w, c in counts.items()}
        end = math.log10(ends + 1) - below
        base_score = [math.fsum(map(logs.__getitem__, ws)) + end for ws in words]
        known = [sum(map(bool, map(counts.__getitem__, ws))) + (ends > 0) for ws in words]
        train = held["train"].to_numpy()
        columns = [held["doc_id"].combine_chunks(), pa.array(~train), pa.array([len(ws) + 1 for ws in words]), pa.array(known), pa.array(base_score), pa.array(score), pa.array([len(t) for t in texts])]
        return pa.table([c.cast(f.type) for c, f in zip(columns, SCORED)], schema=SCORED)

    return run


def score(docs: DataFrame, held_out: Column, *, depth: int = DEPTH) -> DataFrame:
    """SCORED_SQL and train_tokens for each row of ``docs`` (doc_id, text), learning from those that aren't ``held_out``.

    score is the log10 probability of the text under the mixed trees (code length in bits: -score * log2(10)),
    base_score that of its words under add-one unigram frequencies; n_known counts tokens seen in training.
    """
    if not 3 <= depth <= 7:
        raise ValueError("depth must be 3 to 7")
    spark, folder = docs.sparkSession, common.shared_dir(docs.sparkSession, "ctw")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~F.coalesce(held_out, F.lit(False))).alias("train"))
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    buckets = max(8, math.ceil(size / CHUNK_BYTES))
    chunks = common.table(rows.mapInArrow(_chunker(folder, depth, buckets), CHUNK_SQL), folder, "counts")
    upper = chunks.where("kind = 'string'").groupBy("bucket").applyInArrow(_upper(depth), "at long, zeros long, ones long, below double")
    solved = upper.groupBy("at").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()  # at most 2**16 rows
    solved = solved.sort_by("at")
    top = Top(*(solved[c].to_numpy() for c in ("at", "zeros", "ones", "below")))
    answers = common.table(chunks.groupBy("kind", "bucket").applyInArrow(_answer(depth, top), ANSWER_SQL), folder, "answers")
    tokens = int(chunks.agg(F.sum("tokens")).first()[0] or 0)
    vocabulary = int(answers.agg(F.sum("distinct")).first()[0] or 0)
    found = answers.groupBy("chunk").applyInArrow(_score(folder, depth, buckets, tokens, vocabulary, texts), SCORED_SQL)
    return found.withColumn("train_tokens", F.lit(tokens).cast("long"))
