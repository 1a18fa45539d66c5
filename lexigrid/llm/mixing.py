"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Every source's documents are put into a seeded pseudo-random order and laid end to end, as
often as the target needs, which gives one stream of words per source. The streams are cut
into blocks of equally many words. The point frac(k / golden ratio) of slot k falls into one
source's interval of the cumulative shares; the r-th slot of a source takes its r-th block.
So the mix holds every source in proportion in each stretch of the schedule, not just in all.

Defined results: a null source is a source of its own and comes last; a null, empty or blank
text has size 0 and nothing of it is taken; rows that repeat a doc_id, or have none, are rows of
their own (those of equal size are laid in any order); a text of any length is cut into blocks; an empty
table gives empty results. ``mix`` ignores other columns, ``mixed`` keeps all, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

GOLDEN = 0.6180339887498949
#: Hex digits of the shuffling hash that make a range bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
#: Slots that are ranked together, and cells that the unit interval is cut into for the lookup.
SLOT_CHUNK, CELLS = 65536, 4096


@dataclass(frozen=True)
class Mix:
    """``sources``: sid, source, source_size, weight, target, take, blocks. ``documents``: rid (its row),
    doc_id, sid, size, start (in its source's stream). ``schedule``: slot, sid, block. ``pieces``: the
    scheduled words: slot, sid, block, rid, doc_id, size, start, epoch, doc_from, n_words."""

    sources: DataFrame
    documents: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def targets(sized: DataFrame, weights=(1, 2, 3), max_repeat: int = 3, block: int = 1024) -> DataFrame:
    """One row per source with its share of all words.

    Sources in code-point order, null last, get ``weights`` in turn. A target is
    min(level * weight, max_repeat * size) with the one level at which all targets add up to
    the words there are; that is where resharing the excess by weight ends.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows without a partition run over one row a source, never over documents.
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("sid", rank - 1).withColumn("weight", turn).withColumn("_cap", F.lit(float(max_repeat)) * F.col("source_size"))
    up = Window.orderBy(F.col("_cap") / F.col("weight"), "sid")
    every = Window.partitionBy(F.lit(1))
    per = (
        per.withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
        # the level is the first, in this order, at which the source itself isn't capped
        .withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "sid", "_level"))).over(every)["_level"])
        .withColumn("target", F.least(F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")), F.col("_cap")))
    )
    take = F.least(F.round("target").cast("long"), F.lit(max_repeat) * F.col("source_size"))
    return per.withColumn("take", take).withColumn("blocks", F.ceil(F.col("take") / F.lit(block)).cast("long")).select("sid", "source", "source_size", "weight", "target", "take", "blocks")


def schedule(sources: DataFrame) -> DataFrame:
    """slot, sid, block: every block of every source exactly once.

    A source whose points come short at the end of the sequence (by O(log slots)) gets its last
    blocks after the last point; points beyond a source's last block are left out.
    """
    spark = sources.sparkSession
    slots = int(sources.agg(F.sum("blocks")).first()[0] or 0)  # one number
    cum = F.sum("blocks").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = sources.where("blocks > 0").withColumn("_hi", cum).withColumn("hi", F.col("_hi") / F.lit(float(max(slots, 1)))).withColumn("lo", (F.col("_hi") - F.col("blocks")) / F.lit(float(max(slots, 1))))
    cells = spans.select("sid", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    at = F.col("slot") * F.lit(GOLDEN) + F.lit(0.5)
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("u", at - F.floor(at)).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(cells, "cell").where("u >= lo AND u < hi").select("slot", "sid", "blocks")
    hit = hit.withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK)).withColumn("one", F.lit(1).cast("long"))
    ranked = common.running_total(hit, ["sid"], "chunk", ["slot"], "one", "block").select("sid", "slot", "block", "blocks")
    reached = ranked.groupBy("sid").agg(F.count("*").alias("got"))
    short = (
        sources.join(reached, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
        .where("got < blocks")
        .select("sid", F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("block"))
    )
    late = short.withColumn("slot", F.row_number().over(Window.orderBy("block", "sid")) + F.lit(slots - 1).cast("long"))
    return ranked.where("block < blocks").select("slot", "sid", "block").unionByName(late.select("slot", "sid", "block"))


def mix(docs: DataFrame, *, weights=(1, 2, 3), max_repeat: int = 3, block: int = 1024, seed: str = "mix", rid: Column | None = None) -> Mix:
    """Plans the mix of ``docs`` (doc_id, text, source); ``rid`` numbers its rows, by default as they come."""
    folder = common.shared_dir(docs.sparkSession, "mix")
    row = F.monotonically_increasing_id() if rid is None else rid
    sized = common.table(docs.select(row.alias("rid"), "doc_id", "source", common.n_words(F.col("text")).alias("size")), folder, "sized")
    sources = common.table(targets(sized, weights, max_repeat, block), folder, "sources")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    placed = (
        sized.join(sources.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")))
        .select("rid", "doc_id", "sid", "size", key.alias("h"))
        .withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    )
    documents = common.table(common.running_total(placed, ["sid"], "bucket", ["h", "size", "rid"], "size", "start").select("rid", "doc_id", "sid", "size", "start"), folder, "documents")
    plan = schedule(sources)
    lo = F.col("start") + F.col("epoch") * F.col("source_size")
    cut = (
        documents.where("size > 0").join(sources.select("sid", "source_size", "take"), "sid")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))).alias("epoch"))
        .withColumn("lo", lo)
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take")))
        .where("lo < hi")
        .select("rid", "doc_id", "sid", "size", "start", "epoch", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("block"))
        .withColumn("_from", F.greatest("lo", F.col("block") * block))
        .withColumn("doc_from", F.col("_from") - F.col("lo"))
        .withColumn("n_words", F.least(F.col("hi"), (F.col("block") + 1) * block) - F.col("_from"))
    )
    pieces = cut.join(plan, ["sid", "block"]).select("slot", "sid", "block", "rid", "doc_id", "size", "start", "epoch", "doc_from", "n_words")
    return Mix(sources, documents, plan, pieces)


def taken(found: Mix) -> DataFrame:
    """doc_id, size, source, source_size, target of each document; taken: the words that the schedule takes of
    it, in how many pieces, and the first_slot that holds one (null: none)."""
    words = found.pieces.groupBy("rid").agg(F.sum("n_words").alias("taken"), F.count("*").alias("pieces"), F.min("slot").alias("first_slot"))
    docs = found.documents.join(words, "rid", "left").join(found.sources, "sid")
    none = F.lit(0).cast("long")
    return docs.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("pieces", none).alias("pieces"), "first_slot")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each scheduled piece, in the order of the schedule, with all columns of
    its document and as ``text`` the words of the piece (the whole text, as it is, where it lies in one
    block). So every block of words stands where its slot is, and each source has just its target."""
    folder = common.shared_dir(docs.sparkSession, "mixed")
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # no name of a document's clashes with those used here
    packed = docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(f"`{c}`").alias(x) for c, x in names.items()])
    packed.write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = docs.sparkSession.read.schema(packed.schema).parquet(f"{folder}/rows")
    found = mix(rows.select("rid", *[F.col(names[c]).alias(c) for c in ("doc_id", "text", "source")]), rid=F.col("rid"), **options)
    plan = found.pieces.groupBy("rid").agg(F.collect_list(F.struct("slot", "epoch", "size", "doc_from", "n_words")).alias("plan"))
    # words are found once a document, and only where it is cut
    cut = F.exists("plan", lambda p: p["n_words"] < p["size"])
    split = rows.join(plan, "rid").select("rid", *names.values(), "plan", F.explode_outer(F.array(F.when(cut, common.words(F.col(names["text"]))))).alias("words"))
    each = split.select("rid", *names.values(), "words", F.explode("plan").alias("p"))
    part = F.array_join(F.slice("words", (F.col("p.doc_from") + 1).cast("int"), F.col("p.n_words").cast("int")), " ")
    text = F.when(F.col("p.n_words") < F.col("p.size"), part).otherwise(F.col(names["text"]))
    laid = each.select(F.col("p.slot").alias("slot"), "rid", F.col("p.epoch").alias("epoch"), *[text.alias(x) if c == "text" else F.col(x) for c, x in names.items()])
    return laid.orderBy("slot", "rid", "epoch").select(*[F.col(x).alias(c) for c, x in names.items()])
