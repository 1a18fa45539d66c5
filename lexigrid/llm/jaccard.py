"""N-gram Jaccard join by vertical partitioning (DataFrame functions only).

1. Every document becomes a set of keys: 52 bits of each shingle's hash below 10 bits of rarity.
   Sorted keys are the global order, rare shingles first. Rarity comes, first, from counts of all
   shingles in 2**17 buckets (how far a bucket lies above what evenly spread shingles would give
   it: passages that many documents share) and, second, from counts of all words in 2**15 buckets,
   whose logarithms add up over the three words. The order decides how much work there is, never
   which pairs are found.
2. Documents with equal sets form a class; from here on only classes are compared.
3. The first fragment of the order, as it falls into each class, is its head: some n - ceil(t n) + k
   keys, long enough that linked classes have at least k of the smaller one's in common there. How
   many heads hold a key is counted exactly; a key that one head holds is dropped, and so is a
   class with fewer than the least k keys left, which is nearly every class without a near copy.
4. The rest of each head is ordered anew, by that count, and a prefix of it makes candidate pairs.
   A pair is named at its first common key: a later one is passed over when the two have one of
   the four keys before it in common too, so near copies don't meet once for each passage.
   Large groups of near copies make stars: a class goes with the class that leads most of its keys
   that LARGE or more hold. Keys make candidates between stars, and of classes outside, only. Any choice of
   stars gives the same result.
5. Two classes of one star are compared directly: the keys that several of the star hold are numbered, the
   most frequent first, the first of them make bit sets, and the few others are looked at only
   where the bits leave it open. Links are added up per class as they are found. What is linked with
   the star's centre is one component by that, so only links of other classes are written.
   Of the other candidates, the whole global order is cut into fragments of about equal weight. Pairs are laid into blocks
   of a bounded number of classes; each (block, fragment) counts the partial overlaps of its pairs
   by itself, and the partial counts are summed per pair and compared with the threshold.
6. Connected components follow from labels that are lowered along links until nothing changes.

A key in a bucket that stands out is not counted per head (its rank stands for its count), so no task
gathers one that a third of all documents hold. Copies are counted by class and never paired.
Keys of 62 bits stand for shingles, 31 bits for the keys before one; two different ones of one pair of
documents meet with a probability below 1e-8 for documents of 1,000 words.

Defined results: a null, empty or blank text has no shingles, is linked with nothing and is its own
component; a text of one or two words has one shingle; a row with a null doc_id counts as a copy
of equal texts, but only sets that some doc_id stands for are compared with others, and where none
does component_id is null; rows that repeat a doc_id count as documents each; an empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE_BUCKETS, WORD_BUCKETS = 17, 15  # bits
HASH_BITS, WORD_BITS = 52, 6
RANK_AT = HASH_BITS + WORD_BITS
#: Classes that share a block side, about; the global order is cut into 2**FRAGMENT_BITS fragments.
BLOCK, FRAGMENT_BITS = 512, 2
SALTS = 16
#: A key that so many classes hold makes them a star, and a star has so many; classes of a star that share a
#: block side, about; longs of a bit set that are compared in compiled code, and at most in all.
LARGE, SIDE, WORDS, MOST_WORDS = 64, 512, 16, 256
#: Of 100 keys of a set, so many more than the prefix of one common key asks for go into its head.
EXTRA = 10
#: What may be broadcast, as hashed rows of numbers.
BROADCAST_BYTES = 32 << 20


def _once(c: Column) -> Column:
    """``c``, computed once a row: no filter or expression that uses it can be pushed below a generator,
    where it would be computed again for every element that a lambda looks at."""
    return F.explode_outer(F.array(c))


def hashed_words(docs: DataFrame) -> DataFrame:
    """doc_id, w: the hashes of the words of each text, in order."""
    words = F.coalesce(common.words(F.col("text"), lower=True), F.array().cast("array<string>"))
    return docs.select("doc_id", _once(F.transform(words, lambda x: F.xxhash64(x))).alias("w"))


def ranks(values: DataFrame, bits: int) -> list[int]:
    """Ranks 0 (rare) to 15 of 2**bits buckets of the longs ``v``, 16 ranks to a long.

    Rank 0 is what lies within two standard deviations above the median bucket; each further rank
    doubles the excess. A rare value that happens to lie in a full bucket only comes later in the order.
    """
    counts = values.groupBy(F.col("v").bitwiseAND((1 << bits) - 1).alias("bucket")).agg(F.count("*").alias("n"))
    per = {r.bucket: r.n for r in counts.where("bucket IS NOT NULL").collect()}  # at most 2**bits rows
    spread_out = sorted([*per.values(), *[0] * ((1 << bits) - len(per))])
    usual = spread_out[len(spread_out) // 2]
    spread = 2 * math.sqrt(max(usual, 1))
    packed = [0] * ((1 << bits) // 16)
    for bucket, n in per.items():
        if n - usual > spread:
            packed[bucket // 16] |= min(15, 1 + int(math.log2((n - usual) / spread))) << 4 * (bucket % 16)
    return [x - (1 << 64) if x >> 63 else x for x in packed]


def _rank(table: list[int], bits: int):
    """The rank of a long by ``table``, as a function of Columns."""
    packed = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded into one literal

    def of(v: Column) -> Column:
        bucket = v.bitwiseAND((1 << bits) - 1)
        place = F.get(packed, F.shiftright(bucket, 4).cast("int"))
        # a shift by a column exists in SQL only
        return F.call_function("shiftrightunsigned", place, (F.lit(4) * bucket.bitwiseAND(15)).cast("int")).bitwiseAND(15)

    return of


def shingles(docs: DataFrame, word_ranks: list[int]) -> DataFrame:
    """doc_id, h: the distinct 3-word shingles (none for texts without words), as HASH_BITS of hash
    below WORD_BITS that add up the ranks of the words."""
    rank = _rank(word_ranks, WORD_BUCKETS)
    low, high = (1 << HASH_BITS) - 1, ((1 << WORD_BITS) - 1) << HASH_BITS
    each = hashed_words(docs).select("doc_id", _once(F.transform("w", lambda x: x.bitwiseAND(low) + F.shiftleft(rank(x), HASH_BITS))).alias("w"))
    w, n = F.col("w"), F.size("w")
    both = lambda x, y: F.xxhash64(x, y).bitwiseAND(low) + x.bitwiseAND(high) + y.bitwiseAND(high)
    of = lambda first: F.slice(w, F.lit(first), F.greatest(n - 2, F.lit(0)))
    three = F.zip_with(F.zip_with(of(1), of(2), both), of(3), both)  # plain numbers: no rows, no lookups by place
    whole = F.when(n > 0, F.array(F.xxhash64(F.lit("short"), n, F.get(w, F.lit(0)), F.get(w, F.lit(1))).bitwiseAND(low))).otherwise(F.array().cast("array<bigint>"))
    return each.select("doc_id", _once(F.array_distinct(F.when(n >= 3, three).otherwise(whole))).alias("h"))


def keyed(hashed: DataFrame, shingle_ranks: list[int]) -> DataFrame:
    """doc_id, keys: the sorted keys of each document."""
    rank = _rank(shingle_ranks, SHINGLE_BUCKETS)
    return hashed.select("doc_id", _once(F.sort_array(F.transform("h", lambda h: F.shiftleft(rank(h), RANK_AT).bitwiseOR(h)))).alias("keys"))


def _ceil(a: Column, num: int, den: int) -> Column:
    return F.floor((a * num + (den - 1)) / den).cast("int")


def _common(n: Column, percent: int) -> Column:
    """Keys that a head reaches beyond a prefix of one common key: those that a linked set of at least this size shares in the heads."""
    return F.least(F.floor(n * EXTRA / 100).cast("int") + 1, _ceil(n, percent, 100))


def _rest(n: Column, percent: int) -> Column:
    """How many keys of a set lie behind its head."""
    return _ceil(n, percent, 100) - _common(n, percent)


def classes(keys: DataFrame, percent: int, folder: str) -> DataFrame:
    """doc_id, n, h1, h2, head: h1 and h2 name a set of keys, head is what it is found by."""
    n = F.col("n")
    rows = keys.select("doc_id", "keys", F.size("keys").alias("n"))
    rows = rows.select("doc_id", "n", F.xxhash64(F.lit(1), "keys").alias("h1"), F.xxhash64(F.lit(2), "keys").alias("h2"), F.when(n > 0, F.slice("keys", F.lit(1), n - _rest(n, percent))).alias("head"))
    return common.table(rows, folder, "classes")


def _beside(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` (numbers), written, and marked for broadcast when its hashed rows take at most
    BROADCAST_BYTES; with more it is joined by a shuffle."""
    small = common.table(df, folder, name)
    return F.broadcast(small) if small.count() * (32 + 16 * len(small.columns)) <= BROADCAST_BYTES else small


def heads(reps: DataFrame, percent: int, folder: str) -> DataFrame:
    """rep, n, m, first: of each class that may be linked at all, how many keys of its head (m) are held by
    other heads too, and the prefix of these that makes candidates, by how many hold them.

    ``reps``: rep, n, head. A class is linked with sets of at least ceil(t n) keys only, so it has
    the least ``_common`` of these in common; ordering those m keys anew, a common one is among the
    first m - least + 1."""
    cold = lambda key: F.shiftright(key, RANK_AT) == 0
    each = reps.select("rep", F.explode(F.filter("head", cold)).alias("key"))
    held = each.withColumn("f", F.count("*").over(Window.partitionBy("key"))).where("f > 1")
    place = F.struct(F.col("f").alias("o"), "key")
    alive = held.groupBy("rep").agg(F.collect_set(place).alias("cold"))
    hot = F.transform(F.filter("head", lambda key: ~cold(key)), lambda key: F.struct((F.shiftright(key, RANK_AT) + F.lit(1 << 48)).alias("o"), key.alias("key")))
    # rows of a repeated id are one class
    own = reps.select("rep", "n", hot.alias("hot")).groupBy("rep").agg(F.first("n").alias("n"), F.first("hot").alias("hot"))
    both = own.join(alive, "rep", "left").withColumn("keys", F.when(F.col("cold").isNull(), F.col("hot")).otherwise(F.concat("cold", "hot")))
    least = _common(_ceil(F.col("n"), percent, 100), percent)
    m = F.size("keys")
    both = both.where(m >= least).select("rep", "n", m.alias("m"), least.alias("least"), F.array_sort("keys").alias("keys"))
    return common.table(both.select("rep", "n", "m", F.slice(F.col("keys.key"), F.lit(1), F.col("m") - F.col("least") + 1).alias("first")), folder, "heads")


def stars(found: DataFrame, folder: str) -> DataFrame:
    """rep, star for the classes of ``heads`` in large groups of alike ones."""
    key = Window.partitionBy("key")
    each = found.select("rep", F.explode("first").alias("key")).select("rep", F.min("rep").over(key).alias("lead"), F.count("*").over(key).alias("f"))
    votes = each.where(F.col("f") >= LARGE).groupBy("rep", "lead").agg(F.count("*").alias("votes"))
    led = common.table(votes.groupBy("rep").agg(F.max_by("lead", F.struct("votes", "lead")).alias("lead")), folder, "led")
    for k in range(2):  # a lead that follows another takes its own along
        above = _beside(led.select(F.col("rep").alias("lead"), F.col("lead").alias("next")), folder, f"above-{k}")
        led = led.join(above, "lead", "left").select("rep", F.coalesce("next", "lead").alias("lead"))
    led = common.table(led, folder, "led-on")
    large = _beside(led.groupBy("lead").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE).select("lead"), folder, "large")
    return common.table(led.join(large, "lead").select("rep", F.xxhash64(F.lit("star"), "lead").alias("star")), folder, "stars")


def candidates(found: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb: pairs of classes of ``heads``, with their ``star`` or null, that aren't of one star and whose
    sizes and prefixes allow a link.

    Both heads together must share what a link takes beyond the longer rest. From a pair's first common
    key on there must be that many keys in both; at later common keys it may fail, since the
    first has named the pair."""
    small = lambda i: F.get("first", i).bitwiseAND(0x7FFFFFFF).cast("int")
    entry = F.transform("first", lambda key, i: F.struct(key.alias("key"), (F.col("m") - i).alias("left"), *[F.when(i >= p, small(i - p)).alias(f"p{p}") for p in range(1, 5)]))
    entries = found.select("rep", "n", "star", F.explode(entry).alias("e")).select("rep", "n", "star", "e.*")
    fits = (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    wanted = _ceil(F.col("a.n") + F.col("b.n"), percent, 100 + percent) - F.greatest(_rest(F.col("a.n"), percent), _rest(F.col("b.n"), percent))
    reach = F.least("a.left", "b.left") >= wanted
    named = F.lit(False)
    for p in range(1, 5):
        named = named | F.col(f"a.p{p}").isin(*[F.col(f"b.p{q}") for q in range(1, 5)])
    may = fits & reach & ~F.coalesce(named, F.lit(False))
    out = lambda pairs: pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    # classes outside of stars with each other, and with those in stars
    a, b = entries.where("star IS NULL").alias("a"), entries.alias("b")
    ordered = F.col("b.star").isNotNull() | (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.rep") < F.col("b.rep")))
    outside = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & ordered & may)
    # stars with each other: a row for each key and star, so that no two of one star meet
    held = entries.where("star IS NOT NULL").groupBy("key", "star").agg(F.collect_list(F.struct("rep", "n", "left", *[f"p{p}" for p in range(1, 5)])).alias("held"))
    x, y = held.select("key", F.col("star").alias("sx"), F.col("held").alias("hx")), held.select("key", F.col("star").alias("sy"), F.col("held").alias("hy"))
    between = x.hint("merge").join(y, "key").where("sx < sy").select(F.explode("hx").alias("a"), "hy").select("a", F.explode("hy").alias("b")).where(may)
    return out(outside).unionByName(out(between)).distinct()


def numbered(sets: DataFrame, folder: str) -> DataFrame:
    """star, rep, n, members, bits, rest, near, sides, side for ``sets`` (star, rep, n, members, keys): the
    numbers of the keys that several of the star hold, as bits and, of rare ones, as a list; ``near`` is the
    larger, the less a set differs from the keys that most of the star hold."""
    sizes = _beside(sets.groupBy("star").agg(F.count("*").alias("size")), folder, "sizes")
    each = sets.select("star", "rep", F.explode("keys").alias("key"))
    held = each.groupBy("star", "key").agg(F.count("*").alias("f")).where("f > 1").join(sizes, "star")
    at = F.row_number().over(Window.partitionBy("star").orderBy(F.desc("f"), "key")) - 1
    held = held.select("star", "key", at.alias("at"), (F.col("f") * 2 > F.col("size")).cast("int").alias("most"), (F.col("f") * 16 >= F.col("size")).alias("often"))
    dense = (F.col("at") < 64 * WORDS) | (F.col("often") & (F.col("at") < 64 * MOST_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63))
    # the numbers below the last dense one are dense, as they go by falling frequency; a rare one is a group by itself
    words = each.join(held, ["star", "key"]).select("rep", "most", F.when(dense, F.shiftright("at", 6)).otherwise(-1 - F.col("at")).alias("word"), bit.alias("bit"))
    words = words.groupBy("rep", "word").agg(F.bit_or("bit").alias("bits"), F.sum("most").alias("most"))
    own = words.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.when(F.col("word") >= 0, F.struct("word", "bits")))).alias("m"), F.collect_list(F.when(F.col("word") < 0, F.col("word"))).alias("rest"), F.sum("most").alias("most"))
    last = F.coalesce(F.array_max(F.map_keys("m")), F.lit(0))
    bits = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    none = F.array().cast("array<bigint>")
    return (
        sets.drop("keys").join(own.select("rep", "most", "rest", bits.alias("bits")), "rep", "left").join(sizes, "star")
        .select("star", "rep", "n", "members", F.coalesce("bits", none).alias("bits"), F.coalesce("rest", F.array().cast("array<int>")).alias("rest"), (F.coalesce("most", F.lit(0)) * 2 - F.col("n")).alias("near"),
                F.ceil(F.col("size") / SIDE).cast("int").alias("sides"))
        .withColumn("side", F.pmod(F.xxhash64("rep"), F.col("sides")).cast("int"))
    )


def _linked(pairs: DataFrame, percent: int, *keep: Column) -> DataFrame:
    """``keep`` and linked for ``pairs`` of rows a, b of ``numbered``."""
    both = F.lit(0)
    for i in range(WORDS):  # plain expressions are compiled, lambdas aren't
        both = both + F.coalesce(F.bit_count(F.get("a.bits", F.lit(i)).bitwiseAND(F.get("b.bits", F.lit(i)))), F.lit(0))
    size = F.least(F.size("a.bits"), F.size("b.bits"))
    tail = lambda c: F.slice(c, F.lit(WORDS + 1), F.greatest(size - WORDS, F.lit(0)))
    more = F.aggregate(F.zip_with(tail("a.bits"), tail("b.bits"), lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda x, y: x + y)
    both = both + F.when(size > WORDS, more).otherwise(F.lit(0))
    least = _ceil(F.col("a.n") + F.col("b.n"), percent, 100 + percent)
    # a column that is used more than once stays a column of its own
    known = pairs.select(*keep, (least - both).alias("lack"), F.col("a.rest").alias("ra"), F.col("b.rest").alias("rb"))
    lack = F.col("lack")
    linked = F.when(lack <= 0, True).when(lack > F.least(F.size("ra"), F.size("rb")), False).otherwise(F.size(F.array_intersect("ra", "rb")) >= lack)
    return known.withColumn("linked", linked)


def inside(sets: DataFrame, percent: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """rep, others and a, b for ``sets`` (star, rep, n, members, keys): how many documents each class is linked
    with inside its star, and links that connect what all those links do."""
    rows = common.table(numbered(sets, folder), folder, "numbered")
    centre = rows.select("star", F.struct("rep", "n", "bits", "rest").alias("b"), "near").groupBy("star").agg(F.max_by("b", F.struct("near", "b.rep")).alias("b"))
    centre = common.table(centre, folder, "centres")
    around = _linked(rows.select("star", F.struct("rep", "n", "bits", "rest").alias("a")).join(centre, "star"), percent, F.col("a.rep").alias("rep"), F.col("b.rep").alias("centre"))
    around = common.table(around.where("linked OR rep = centre").select("rep", "centre"), folder, "around")
    rows = rows.join(_beside(around.select("rep", F.lit(True).alias("central")), folder, "central"), "rep", "left")
    rows = common.table(rows.withColumn("central", F.coalesce("central", F.lit(False))), folder, "inside")
    every = F.sequence(F.lit(0), F.col("sides") - 1)
    of = lambda df, name, i, j: df.select("star", i, j, F.struct("rep", "n", "members", "bits", "rest", "central").alias(name))

    def met(left: DataFrame) -> DataFrame:
        a, b = of(left, "a", F.col("side").alias("i"), F.explode(every).alias("j")), of(rows, "b", F.explode(every).alias("i"), F.col("side").alias("j"))
        return a.hint("merge").join(b, ["star", "i", "j"]).where((F.col("a.rep") != F.col("b.rep")) & (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent))

    others = _linked(met(rows), percent, F.col("a.rep").alias("rep"), F.col("b.members").alias("members"))
    others = others.groupBy("rep").agg(F.sum(F.when(F.col("linked"), F.col("members")).otherwise(F.lit(0))).alias("others"))
    rest = _linked(met(rows.where("NOT central")), percent, F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("b.central").alias("central"))
    rest = rest.where(F.col("linked") & (F.col("central") | (F.col("a") < F.col("b")))).select("a", "b")
    return common.table(others, folder, "others"), around.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).unionByName(rest)


def edges(sets: DataFrame) -> list[int]:
    """Where the global order is cut: the medians over ``sets`` (keys) of their own quantiles."""
    parts = 2**FRAGMENT_BITS
    at = [F.percentile_approx(F.get("keys", F.floor(F.size("keys") * i / parts).cast("int")), 0.5).alias(f"e{i}") for i in range(1, parts)]
    return sorted({int(e) for e in sets.agg(*at).first() if e is not None})  # at most 2**FRAGMENT_BITS - 1 numbers


def cut(keys: Column, at: list[int]) -> Column:
    """The segments of a sorted set of keys: an array of fragment, seg."""
    low, high = [None, *at], [*at, None]
    inside = lambda lo, hi: F.filter(keys, lambda key: (F.lit(True) if lo is None else key >= lo) & (F.lit(True) if hi is None else key < hi))
    return F.array(*[F.struct(F.lit(f).alias("fragment"), inside(lo, hi).alias("seg")) for f, (lo, hi) in enumerate(zip(low, high))])


def overlaps(pairs: DataFrame, segments: DataFrame, folder: str) -> DataFrame:
    """a, b, na, nb, common for ``pairs``, from ``segments`` (rep, fragment, seg)."""
    seen = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("b").alias("o")), F.struct(F.col("b").alias("doc"), F.col("a").alias("o")))).alias("x")).select("x.*")
    near = seen.groupBy("doc").agg(F.least(F.col("doc"), F.min("o")).alias("g"))
    grouped = pairs.join(near.withColumnRenamed("doc", "a"), "a")
    size = grouped.select("g", F.explode(F.array("a", "b")).alias("doc")).distinct().groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("sides"))
    side = lambda c: F.pmod(F.xxhash64(c), F.col("sides"))
    placed = grouped.join(size, "g").select("a", "b", "na", "nb", F.xxhash64("g", side("a"), side("b")).alias("block"))
    members = _beside(placed.select("block", F.explode(F.array("a", "b")).alias("rep")).distinct(), folder, "members")
    held = segments.join(members, "rep").groupBy("block", "fragment").agg(F.collect_list(F.struct("rep", "seg")).alias("held"))
    held = held.select("block", F.col("held.rep").alias("reps"), F.col("held.seg").alias("segs"))
    wanted = placed.groupBy("block").agg(F.collect_list(F.struct("a", "b", "na", "nb")).alias("wanted"))
    at = lambda x: F.array_position("reps", x).cast("int")
    seg = lambda x: F.get(F.col("segs"), at(x) - 1)
    part = lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["na"].alias("na"), p["nb"].alias("nb"), F.coalesce(F.size(F.array_intersect(seg(p["a"]), seg(p["b"]))), F.lit(0)).alias("part"))
    counted = held.join(wanted, "block").select(F.explode(F.transform("wanted", part)).alias("p")).select("p.*")
    return counted.groupBy("a", "b", "na", "nb").agg(F.sum(F.greatest("part", F.lit(0))).alias("common"))


def components(links: DataFrame, folder: str) -> DataFrame:
    """v, label: the smallest vertex that each linked vertex reaches over ``links`` (a, b).

    Every round a vertex takes the smallest label around it and then that label's own label, so
    chains shorten by more than half a round."""
    both = common.table(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*"), folder, "links")
    labels = common.table(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), folder, "labels-0")
    for k in range(1, 1000):
        around = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("near"))
        low = labels.join(around, "v").select("v", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("next"))
        new = common.table(low.join(jump, "low").select("v", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("label")).alias("moved")), folder, f"labels-{k}")
        labels = new.select("v", "label")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def join(docs: DataFrame, *, percent: int = 70) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id for each row of ``docs`` (doc_id, text): documents
    are linked when 100 * common >= percent * united."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = common.shared_dir(docs.sparkSession, "jaccard")
    words = ranks(hashed_words(docs).select(F.explode_outer("w").alias("v")), WORD_BUCKETS)
    found = ranks(shingles(docs, words).select(F.explode_outer("h").alias("v")), SHINGLE_BUCKETS)
    rows = classes(keyed(shingles(docs, words), found), percent, folder)
    # a class is named by its smallest document; min skips null ids
    groups = common.table(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"), F.first("n").alias("n")), folder, "groups")
    ids = groups.where("first IS NOT NULL")
    rep = F.xxhash64("h1", "h2")  # repeated ids may name two classes, so classes have a name of their own
    several = _beside(ids.where("members > 1").select("h1", "h2", "first"), folder, "several")
    reps = rows.where("n > 0 AND doc_id IS NOT NULL").join(several, ["h1", "h2"], "left").where("first IS NULL OR doc_id = first")
    found_by = heads(reps.select(rep.alias("rep"), "n", "head"), percent, folder)
    star = stars(found_by, folder)
    pairs = common.table(candidates(found_by.join(star, "rep", "left"), percent), folder, "pairs")
    rows = common.table(rows.select("doc_id", "n", "h1", "h2"), folder, "rows")
    common.drop(folder, "classes", "several", "heads")  # heads of sets are the most of what is stored

    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(star.select("rep")).distinct()
    texts = docs.join(_beside(ids.select(F.col("first").alias("doc_id"), rep.alias("rep")).join(needed, "rep"), folder, "needed"), "doc_id")
    again = keyed(shingles(texts.select(F.struct("doc_id", "rep").alias("doc_id"), "text"), words), found)
    # of the rows of a repeated id, that of the class
    again = again.where(F.xxhash64(F.xxhash64(F.lit(1), "keys"), F.xxhash64(F.lit(2), "keys")) == F.col("doc_id.rep")).select(F.col("doc_id.rep").alias("rep"), "keys")
    again = common.table(again, folder, "sets")
    segments = again.select("rep", F.explode(cut(F.col("keys"), edges(again))).alias("s")).select("rep", "s.fragment", "s.seg")
    linked = overlaps(pairs, segments, folder).where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent)
    links = common.table(linked.select("a", "b"), folder, "linked")
    named = ids.select(rep.alias("v"), "first", "members")
    starred = again.join(star, "rep").join(named.select(F.col("v").alias("rep"), "members"), "rep").dropDuplicates(["rep"])  # rows of a repeated id
    counted, spanning = inside(starred.select("star", "rep", F.size("keys").alias("n"), "members", "keys"), percent, folder)
    spanning = common.table(links.unionByName(spanning), folder, "spanning")
    # the links and counts are all that is left of them
    common.drop(folder, "pairs", "needed", "sets", "members", "numbered", "inside", "around", "central", "centres", "stars", "led", "led-on")

    label = components(spanning, folder)
    roots = label.join(named, "v").groupBy("label").agg(F.min("first").alias("component"))
    around = links.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("o")), F.struct(F.col("b").alias("v"), F.col("a").alias("o")))).alias("x")).select("x.*")
    others = around.join(named.select(F.col("v").alias("o"), "members"), "o").select("v", F.col("members").alias("others")).unionByName(counted.select(F.col("rep").alias("v"), "others"))
    others = others.groupBy("v").agg(F.sum("others").alias("others"))
    stats = (
        groups.withColumn("v", rep).join(others, "v", "left").join(label.join(roots, "label").select("v", "component"), "v", "left")
        .select("h1", "h2", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("component", "first").alias("component"), "members", "first")
    )
    # Copies of one text may be a third of all rows: a class of several is repeated for every salt.
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    salts = F.when(F.col("members") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(salt("first")))
    stats = stats.select("h1", "h2", "n_similar", "component", F.explode(salts).alias("salt"))
    found = rows.select("doc_id", "n", "h1", "h2", salt("doc_id").alias("salt")).join(stats, ["h1", "h2", "salt"], "left")
    return found.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, *, percent: int = 70) -> DataFrame:
    """The rows of ``docs``, in full, that are the smallest doc_id of their component. Rows that repeat
    that doc_id are copies too, so one of them stays; rows with a null doc_id stay."""
    found = join(docs, percent=percent).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
