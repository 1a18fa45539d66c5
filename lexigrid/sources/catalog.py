"""Stored tables and indexes of one corpus, by n, with a sidecar that describes each.

What belongs to an n lies in a folder of its own name: ``grams`` (all windows, sorted by words),
``by_<order>`` (indexes, sorted by their own columns), ``by_frequency``, ``entropy_<bits>`` and, for
tagged corpora, ``vocabulary``. The sidecar n=<n>.json names the folder and lists just what is in it. It is
written last and replaces its predecessor at once, so readers see the old tables or the new ones.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EDGE, LIMITS
from ..engine import NgramTable
from ..functions import patterns, permutations
from ..operators import queries as Q
from ..operators import windows as W

VERSION = 2
#: The orders of a tagged corpus's vocabulary; any known part is the first of one of them.
SUPPLEMENTS = (("classification", "lemma", "inflexion"), ("lemma", "inflexion", "classification"), ("inflexion", "classification", "lemma"))
#: A partial place that stands for at most so many words is searched for as these words; with more it stays a filter.
EXPAND = 1000


def _name(order: Iterable[int]) -> str:
    return "_".join(map(str, order))


def _bits(pattern: str) -> str:
    """"= *" as 10."""
    patterns.parse_entropy(pattern)
    return "".join("1" if p == "=" else "0" for p in patterns.split(pattern))


def _exact(place: patterns.Place) -> bool:
    return place.kind in ("word", "words") or (place.kind == "parts" and bool(place.value) and all(place.value))


def known_prefix(places: list[patterns.Place], order: Iterable[int]) -> int:
    """How many leading columns of an index by ``order`` the pattern fixes to a word."""
    n = 0
    for at in order:
        if at >= len(places) or not _exact(places[at]):
            break
        n += 1
    return n


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs, self.base = FileSystem.from_uri(path)

    # -- writing

    def add(self, table: NgramTable, corpus: str, *, indexes: bool = True, first: int = 0, howmany: int | None = None, top: bool = True, entropies: Iterable[str] = ()) -> None:
        """Stores ``table``; with ``indexes`` the search family, or ``howmany`` of it from the ``first`` on; with
        ``top`` the rows by falling frequency; and an entropy index for each of ``entropies``."""
        if any(e["corpus"] != corpus or e["pos"] != table.pos for e in self.entries().values()):
            raise ValueError("a catalog holds tables of one corpus")
        n, folder = table.n, f"n={table.n}-{uuid.uuid4().hex}"
        root = f"{self.path}/{folder}"
        table.save(f"{root}/grams")
        stored = NgramTable(self.spark.read.parquet(f"{root}/grams"), table.pos)
        orders = list(stored.orders(first, howmany)) if indexes else []
        for order in orders:
            # in the order of their words the stored rows lie in ranges already, so this index needs no shuffle
            stored.save_index(f"{root}/by_{_name(order)}", order, ranged=order == tuple(range(n)))
        sums = stored.grams.groupBy(F.when(F.col("w0") != EDGE, F.floor(F.log2("frequency"))).alias("b")).agg(F.count("*").alias("n"), F.sum("frequency").alias("f")).collect()  # 64 rows at most
        bits = {int(r.b): r.n for r in sums if r.b is not None}
        if top:
            Q.inverted(stored.grams, tuple(range(n))).write.parquet(f"{root}/by_frequency")
        for order in SUPPLEMENTS if table.pos else ():
            W.vocabulary_of(stored.grams).orderBy(*order).write.parquet(f"{root}/vocabulary_{'_'.join(c[0] for c in order)}")
        for pattern in entropies:
            Q.entropy_sorted(Q.entropy_index(stored.grams, pattern), pattern).write.parquet(f"{root}/entropy_{_bits(pattern)}")
        entry = {
            "version": VERSION, "n": n, "corpus": corpus, "pos": table.pos, "folder": folder, "numwords": sum(r.f for r in sums if r.b is not None), "rows": sum(r.n for r in sums),
            "limits": vars(LIMITS), "indexes": [_name(o) for o in orders], "top": top, "frequency_bits": bits, "entropies": [_bits(p) for p in entropies],
        }
        self.fs.create_dir(self.base, recursive=True)
        new = f"{self.base}/.n={n}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(new, compression=None) as out:
            out.write(json.dumps(entry).encode())
        self.fs.move(new, f"{self.base}/n={n}.json")

    # -- what there is

    def entries(self) -> dict[int, dict]:
        out = {}
        for info in self.fs.get_file_info(FileSelector(self.base, allow_not_found=True)):
            if info.type == FileType.File and re.fullmatch(r"n=\d+\.json", info.base_name):
                with self.fs.open_input_stream(info.path) as f:
                    entry = json.loads(f.read())
                if entry["version"] != VERSION:
                    raise ValueError(f"{info.path} has version {entry['version']}, not {VERSION}")
                out[entry["n"]] = entry
        return dict(sorted(out.items()))

    def list_all(self) -> DataFrame:
        """One row of JSON per table."""
        rows = [(n, json.dumps(e)) for n, e in self.entries().items()]
        return self.spark.createDataFrame(rows, "n int, entry string").orderBy("n")

    def list_entropies(self) -> DataFrame:
        """n, pattern: the stored entropy indexes, = standing for a known place."""
        rows = [(n, " ".join("=" if b == "1" else "*" for b in bits)) for n, e in self.entries().items() for bits in e["entropies"]]
        return self.spark.createDataFrame(rows, "n int, pattern string").orderBy("n", "pattern")

    def _entry(self, places: int, exactly: bool = False) -> dict:
        """The smallest table that has room for so many places."""
        for n, entry in self.entries().items():
            if n == places or (n > places and not exactly):
                return entry
        raise ValueError(f"no table for {places} places")

    def _stored(self, entry: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{entry['folder']}/{name}")

    def table(self, n: int) -> NgramTable:
        entry = self._entry(n, exactly=True)
        return NgramTable(self._stored(entry, "grams"), entry["pos"])

    # -- queries

    def _expanded(self, entry: dict, place: patterns.Place) -> patterns.Place:
        """A partial place as the words of the vocabulary that it stands for, where these are few."""
        if place.kind != "parts" or all(place.value):
            return place
        known = {c: v for c, v in zip(SUPPLEMENTS[0], place.value) if v is not None}
        order = next(o for o in SUPPLEMENTS if set(o[: len(known)]) == set(known))  # so the probe is a prefix of a sorted table
        rows = self._stored(entry, f"vocabulary_{'_'.join(c[0] for c in order)}")
        for c, v in known.items():
            rows = rows.where(F.col(c) == v)
        words = [r[0] for r in rows.select(F.concat_ws("|", *SUPPLEMENTS[0])).limit(EXPAND + 1).collect()]
        return patterns.Place("words", tuple(words)) if len(words) <= EXPAND else place

    def found(self, pattern: str) -> DataFrame:
        """What ``pattern`` matches, unordered, from the stored order of columns that begins with most of its words."""
        size = len(patterns.split(pattern))
        entry = self._entry(max(size, 1))
        grams = self._stored(entry, "grams")
        places = patterns.parse(self.spark, pattern, entry["pos"])
        if places is None:
            return Q.search(grams, pattern, entry["pos"])
        if entry["pos"]:
            places = [self._expanded(entry, p) for p in places]
        best = max(map(lambda x: tuple(map(int, x.split("_"))), entry["indexes"]), key=lambda o: known_prefix(places, o), default=())
        if known_prefix(places, best) > known_prefix(places, range(entry["n"])):
            # an index leaves out only windows with an edge in its first column
            grams = self._stored(entry, f"by_{_name(best)}").select(*W.columns(entry["n"]), "frequency")
        return Q.matching(grams, places)

    def search(self, pattern: str) -> DataFrame:
        return Q.ranked(self.found(pattern))

    def entropy_of(self, pattern: str) -> DataFrame:
        """entropy, in one row; null where nothing matches."""
        return Q.entropy_of(self.found(pattern))

    def get_top(self, n: int, m: int) -> DataFrame:
        """The m most frequent n-grams; of the stored rows by frequency, the scan reads just the frequencies that can be among them."""
        entry = self._entry(n, exactly=True)
        if not entry["top"]:
            return self.table(n).get_top(m)
        least, have = 0, 0
        for b, count in sorted(((int(b), c) for b, c in entry["frequency_bits"].items()), reverse=True):
            least, have = b, have + count
            if have >= m:
                break
        return Q.top(self._stored(entry, "by_frequency").where(F.col("frequency") >= (1 << least)), m)

    def entropy_index(self, pattern: str) -> DataFrame:
        n, _ = patterns.parse_entropy(pattern)
        entry = self._entry(n, exactly=True)
        stored = _bits(pattern) in entry["entropies"]
        return self._stored(entry, f"entropy_{_bits(pattern)}") if stored else self.table(n).entropy_index(pattern)

    def entropy_top(self, pattern: str, k: int, min_frequency: int = 1) -> DataFrame:
        return Q.entropy_best(self.entropy_index(pattern), pattern, k, min_frequency)

    def entropy_stats(self, pattern: str) -> DataFrame:
        return Q.entropy_histogram(self.entropy_index(pattern)).orderBy("entropy")

    def wordlength_stats(self, n: int) -> DataFrame:
        return self.table(n).wordlength_stats()


class Catalogs:
    """Several corpora: a folder of catalogs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs, self.base = FileSystem.from_uri(path)

    def corpora(self) -> dict[str, Catalog]:
        """Catalogs by folder name; folders without a table are no catalogs."""
        found = {i.base_name: Catalog(self.spark, f"{self.path}/{i.base_name}") for i in self.fs.get_file_info(FileSelector(self.base, allow_not_found=True)) if i.type == FileType.Directory}
        return {name: c for name, c in sorted(found.items()) if c.entries()}

    def list_all(self) -> DataFrame:
        rows = [(name, n, json.dumps(e)) for name, c in self.corpora().items() for n, e in c.entries().items()]
        return self.spark.createDataFrame(rows, "corpus string, n int, entry string").orderBy("corpus", "n")
