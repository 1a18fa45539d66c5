"""Content-addressed store of token ids.

Texts are encoded in ascending doc_id order. A rolling hash over the ids cuts each document's
stream into chunks, so equal passages give equal chunks wherever they lie; a chunk is addressed by
the SHA-256 of its bytes and stored once. A document is a recipe (its chunks' addresses); a shard
of documents has the Merkle root of its recipes in the manifest, and the store has the root of
those. Reading fetches chunks by coalesced byte ranges, checks every address and every root, and
puts the documents together again.

``write`` goes over the corpus once: documents are range-partitioned by doc_id into shards, each
shard's ids are spooled and its recipes listed; the owner of a chunk is its first occurrence, found
by a map-side reducing aggregation over addresses only; each shard then packs the chunks it owns
into compressed blocks. What one task holds is bounded by a shard (``shard_rows`` texts), and a
chunk that a third of all documents have reaches other shards once per shard. Files have names of
their own for each attempt of a task, and only rows of the attempt that succeeded name them.

Defined results: a null or empty text has the end id only; a null doc_id comes first; rows that
repeat a doc_id are documents of their own, ordered by their text's hash; an empty table gives an
empty store. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"LXGPACK1"
#: Chunk lengths in ids: no cut before LEAST, a cut on average after 1 / 2**MASK_BITS more, a forced one after MOST.
LEAST, MASK_BITS, MOST, WINDOW = 128, 9, 2048, 8
BLOCK_BYTES = 64 << 10
_GEAR = np.random.default_rng(20240229).integers(0, 2**64, 1 << 16, np.uint64)

RECIPES = pa.schema([("shard", pa.int64()), ("spool", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("at", pa.int64()), ("n", pa.int64())])))])
RECIPES_SQL = "shard long, spool string, doc_id long, at long, n_tokens long, root binary, chunks array<struct<digest: binary, at: long, n: long>>"
PLACES = pa.schema([("digest", pa.binary()), ("pack", pa.string()), ("block_at", pa.int64()), ("block_len", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
PLACES_SQL = "digest binary, pack string, block_at long, block_len long, start long, n long"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
READ_SQL = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


#: The pre-tokenizer's pattern that Encoder knows, and what it comes to for words of PLAIN characters in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


class _Known(dict):
    """Id bytes by word; what is missing is made when it is first asked for."""

    def __init__(self, make):
        super().__init__({"": b""})
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.make(word)
        return found


class Encoder:
    """Text to id bytes. Only what lies between blanks and line ends is encoded, each such word once;
    the tokenizer must drop white space and never join words across it, as word-level BPE does.

    Where the tokenizer's steps before its model are the known ones, words of ASCII and Latin-1
    letters are cut into the model's pieces here, and each piece goes through the model once. Other
    words go through the whole tokenizer, many at a time, kept apart by a numeral that is one
    token of its own."""

    def __init__(self, path: str, end_id: int, dtype: str = "<u2"):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.model = self.tokenizer.model
        # array() is much faster than numpy for a few ids
        kind = {"<u2": "H", "<u4": "I"}[dtype] if sys.byteorder == "little" else None
        self.packer = (lambda ids: array(kind, ids)) if kind else (lambda ids: np.array(ids, dtype))
        if self.tokenizer.get_vocab_size() > np.iinfo(dtype).max + 1:
            raise ValueError(f"ids of {path} don't fit {dtype}")
        steps = json.loads(self.tokenizer.to_str())
        before, cut = steps["normalizer"] or {}, steps["pre_tokenizer"] or {}
        self.direct = (
            [(n["type"], n.get("pattern"), n.get("content")) for n in before.get("normalizers", [])] == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [(c["type"], c.get("pattern"), c.get("behavior"), c.get("invert"), c.get("add_prefix_space"), c.get("use_regex")) for c in cut.get("pretokenizers", [])] == [("Split", {"Regex": PATTERN}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
            and steps["model"]["type"] == "BPE"
            and steps["post_processor"] is None
        )
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.end = np.array([end_id], dtype).tobytes()
        self.known = _Known(self._word)
        self.pieces: dict[str, bytes] = {}
        for mark in "½²³¼¾¹0":
            ids = self._ids(mark)
            if len(ids) == 1 and self._ids(f"a {mark} b") == self._ids("a") + ids + self._ids("b"):
                self.mark, self.mark_id = mark, ids[0]
                break
        else:
            raise ValueError(f"{path} has no numeral that is one token")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids: list[int]) -> bytes:
        return self.packer(ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece not in self.pieces:
            text = piece if piece.isascii() else "".join(map(self.byte_chars.__getitem__, piece.encode()))
            self.pieces[piece] = self._pack([t.id for t in self.model.tokenize(text)])
        return self.pieces[piece]

    def _word(self, w: str) -> bytes:
        if self.direct:
            if w.isascii():  # most words are letters, with a sign behind them or none
                if w.isalpha():
                    return self._piece(w.lower())
                if w[:-1].isalpha() and "!" <= w[-1] <= "~":
                    return self._piece(w[:-1].lower()) + self._piece(w[-1])
            if PLAIN.fullmatch(w) and "<|" not in w:
                return b"".join(map(self._piece, PIECES.findall(w.lower())))
        return self._pack(self._ids(w))

    def learn(self, words: list[str]) -> None:
        """Words that need the whole tokenizer, many at a time."""
        rest = [w for w in words if not (self.mark in w or "<|" in w or (self.direct and PLAIN.fullmatch(w)))]
        for first in range(0, len(rest), 500):
            some = rest[first : first + 500]
            ids = np.array(self._ids(f" {self.mark} ".join(some)), self.dtype)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            if len(ends) != len(some):  # a word that holds the mark in another form
                for w in some:
                    self.known[w] = self._pack(self._ids(w))
                continue
            begin = 0
            for w, end in zip(some, ends.tolist()):
                self.known[w] = ids[begin:end].tobytes()
                begin = end + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        other = [words for words, t in zip(split, texts) if t and not (self.direct and _latin(t))]
        if other:
            self.learn(list(set().union(*other).difference(self.known)))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) + self.end for words in split]


def _latin(text: str) -> bool:
    """Whether no character lies beyond Latin-1."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def chunk_ends(ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """For documents that lie end to end in ``ids``: where their chunks end, counted from each one's start.
    The hash of a position covers the WINDOW ids up to it, of this document only."""
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(ids)) - np.repeat(starts, lengths)
    gear = _GEAR[ids]
    rolled = gear.copy()
    for k in range(1, WINDOW):
        rolled[k:] += np.where(place[k:] >= k, gear[:-k] << np.uint64(k), np.uint64(0))
    # the top bits have seen the whole window
    cut = np.flatnonzero((rolled >> np.uint64(64 - MASK_BITS)) == 0)
    bounds = np.searchsorted(cut, np.append(starts, len(ids)))
    out = []
    for d, n in enumerate(lengths.tolist()):
        ends, last = [], 0
        for c in (cut[bounds[d] : bounds[d + 1]] - starts[d] + 1).tolist():
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST and c < n:
                ends.append(c)
                last = c
        while n - last > MOST:
            last += MOST
            ends.append(last)
        ends.append(n)
        out.append(ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _spooler(folder: str, path: str, end_id: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/spool", recursive=True)
        shard, encoder, at, rows = TaskContext.get().partitionId(), Encoder(path, end_id, dtype), 0, []
        name = f"{shard:06d}-{uuid.uuid4().hex}.zst"
        with fs.open_output_stream(f"{base}/spool/{name}", compression=None) as raw, zstandard.ZstdCompressor(1).stream_writer(raw, closefd=False) as out:
            for part in parts:
                for first in range(0, part.num_rows, 200):
                    cut = part.slice(first, 200)
                    each = encoder.encode(cut.column(1).to_pylist())
                    data = b"".join(each)
                    lengths = np.array([len(x) // width for x in each])
                    begin = 0
                    for doc, n, ends in zip(cut.column(0).to_pylist(), lengths.tolist(), chunk_ends(np.frombuffer(data, dtype), lengths)):
                        spans = list(zip([0, *ends[:-1]], ends))
                        rows.append((doc, at + begin, n, [{"digest": hashlib.sha256(data[(begin + a) * width : (begin + b) * width]).digest(), "at": at + begin + a, "n": b - a} for a, b in spans]))
                        begin += n
                    out.write(data)
                    at += begin
        root = merkle([b"".join(c["digest"] for c in r[3]) for r in rows])
        for first in range(0, len(rows), 5000):
            yield _batch([(shard, name, doc, a, n, root, chunks) for doc, a, n, chunks in rows[first : first + 5000]], RECIPES)

    return run


def _packer(folder: str, dtype: str):
    width = np.dtype(dtype).itemsize

    def pack(owned: pa.Table) -> pa.Table:
        """The chunks that one shard owns, in the order of the shard, as one pack file."""
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/packs", recursive=True)
        owned = owned.sort_by("at")
        with fs.open_input_stream(f"{base}/spool/{owned['spool'][0].as_py()}", compression=None) as raw:
            data = zstandard.ZstdDecompressor().stream_reader(raw).read()
        name = f"{owned['shard'][0].as_py():06d}-{uuid.uuid4().hex}.pack"
        rows, wait, size, squeeze = [], [], 0, zstandard.ZstdCompressor(3)
        with fs.open_output_stream(f"{base}/packs/{name}", compression=None) as out:
            out.write(MAGIC)
            place = len(MAGIC)

            def flush() -> int:
                block = squeeze.compress(b"".join(x for _, x in wait))
                out.write(block)
                start = 0
                for digest, x in wait:
                    rows.append((digest, name, place, len(block), start, len(x) // width))
                    start += len(x) // width
                return place + len(block)

            for digest, at, n in zip(owned["digest"].to_pylist(), owned["at"].to_pylist(), owned["n"].to_pylist()):
                wait.append((digest, data[at * width : (at + n) * width]))
                size += n * width
                if size >= BLOCK_BYTES:
                    place, wait, size = flush(), [], 0
            if wait:
                place = flush()
        return pa.Table.from_batches([_batch(rows, PLACES)])

    return pack


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1, dtype: str = "<u2", shard_rows: int = 8000) -> str:
    """Stores ``docs`` (doc_id, text) below the URI ``folder``: packs/, recipes, index, places and manifest; returns the store's root."""
    shards = max(1, math.ceil(docs.count() / shard_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the text's hash comes second so that repeated ids can part
    rows = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    recipes = common.table(rows.mapInArrow(_spooler(folder, tokenizer, end_id, dtype), RECIPES_SQL), folder, "recipes")

    refs = recipes.select("shard", "spool", F.explode("chunks").alias("c"))
    per = refs.groupBy(F.col("c.digest").alias("digest"), "shard").agg(F.min(F.struct(F.col("c.at").alias("at"), F.col("c.n").alias("n"), "spool")).alias("first"))
    per = common.table(per.select("digest", "shard", "first"), folder, "occurrences")
    owners = per.groupBy("digest").agg(F.min(F.struct("shard", "first")).alias("o"))
    owned = owners.select("o.shard", "digest", "o.first.at", "o.first.n", "o.first.spool")
    index = common.table(owned.groupBy("shard").applyInArrow(_packer(folder, dtype), PLACES_SQL), folder, "index")
    # which shard reads which chunk where: a digest joins at most one row a shard
    per.select("digest", "shard").join(index, "digest").write.parquet(f"{folder}/places")

    every = recipes.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.first("root").alias("root"))
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row a shard
    manifest = common.table(every.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))), folder, "manifest")
    top = merkle([r.root for r in manifest.select("shard", "root").orderBy("shard").collect()]).hex()  # 32 bytes a shard
    docs.sparkSession.createDataFrame([(top,)], "root string").write.parquet(f"{folder}/root")
    return top


def _reader(folder: str, dtype: str, with_ids: bool):
    width = np.dtype(dtype).itemsize

    def fetch(places: pa.Table) -> dict[bytes, bytes]:
        """The bytes of all chunks that a shard needs, each verified."""
        fs, base = FileSystem.from_uri(f"{folder}/packs")
        found, name, handle, block, at = {}, None, None, b"", -1
        for row in places.sort_by([("pack", "ascending"), ("block_at", "ascending"), ("start", "ascending")]).to_pylist():
            if row["pack"] != name:
                if handle:
                    handle.close()
                name, at = row["pack"], -1
                handle = fs.open_input_file(f"{base}/{name}")
                if handle.read_at(len(MAGIC), 0) != MAGIC:
                    raise ValueError(f"{name} is no pack")
            if row["block_at"] != at:
                at = row["block_at"]
                block = zstandard.ZstdDecompressor().decompress(handle.read_at(row["block_len"], at))
            data = block[row["start"] * width : (row["start"] + row["n"]) * width]
            if hashlib.sha256(data).digest() != row["digest"]:
                raise ValueError(f"a chunk at {name}:{at} is damaged")
            found[row["digest"]] = data
        if handle:
            handle.close()
        return found

    def read(recipes: pa.Table, places: pa.Table) -> pa.Table:
        chunks, rows, leaves = fetch(places), [], []
        recipes = recipes.sort_by("at")
        for r in recipes.select(["doc_id", "at", "n_tokens", "start", "digests"]).to_pylist():
            ids = np.frombuffer(b"".join(chunks[d] for d in r["digests"]), dtype)
            leaves.append(b"".join(r["digests"]))
            if len(ids) != r["n_tokens"]:
                raise ValueError(f"document {r['doc_id']} has {len(ids)} ids instead of {r['n_tokens']}")
            rows.append((r["doc_id"], r["start"] + r["at"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
        if rows and merkle(leaves) != recipes["root"][0].as_py():
            raise ValueError("the recipes of a shard don't match its root")
        return pa.Table.from_batches([_batch(rows, READ)])

    return read


def read(spark: SparkSession, folder: str, *, dtype: str = "<u2", with_ids: bool = True) -> DataFrame:
    """All documents of a store, as READ_SQL, a shard a task."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    roots = manifest.select("shard", "root").orderBy("shard").collect()
    if merkle([r.root for r in roots]).hex() != spark.read.parquet(f"{folder}/root").first().root:
        raise ValueError("the shards' roots don't match the store's")
    recipes = spark.read.parquet(f"{folder}/recipes").join(manifest.select("shard", "start", F.col("root").alias("wanted")), "shard")
    recipes = recipes.select("shard", "doc_id", "at", "n_tokens", "start", F.col("wanted").alias("root"), F.col("chunks.digest").alias("digests"))
    places = spark.read.parquet(f"{folder}/places").select("shard", *PLACES.names)
    return recipes.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(_reader(folder, dtype, with_ids), READ_SQL)
