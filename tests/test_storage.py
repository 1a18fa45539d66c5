"""Files, catalog, streaming, and the driver's entry points."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexigrid.engine import NgramEngine
from lexigrid.operators import windows as W
from lexigrid.sources import catalog as catalogs
from lexigrid.sources import corpus, storage
from lexigrid.sources.catalog import Catalog, Catalogs
from lexigrid.streaming.counts import running_counts


def counted(df):
    return Counter({tuple(r)[:-1]: r[-1] for r in df.collect()})


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("c") / "plain.txt"
    path.write_text("a b\nc ---END.OF.DOCUMENT--- a b\n---END.OF.DOCUMENT---\n")
    return NgramEngine(spark).from_files(str(path), 2)


def test_text_files(spark, table, tmp_path):
    expected = {("$", "a"): 2, ("a", "b"): 2, ("b", "c"): 1, ("c", "$"): 1, ("b", "$"): 1}
    assert counted(table.grams) == expected
    corpus.write_index(table.grams, (1, 0), str(tmp_path / "i"))
    lines = [line for p in sorted((tmp_path / "i").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["a\t$\t2", "b\ta\t2", "c\tb\t1"]
    assert counted(corpus.read_index(spark, str(tmp_path / "i"), (1, 0))) == {k: v for k, v in expected.items() if k[1] != "$"}
    (tmp_path / "t").write_text("The DT the\ncat NN cat\n")
    tagged = NgramEngine(spark).from_files(str(tmp_path / "t"), 2, pos=True)
    assert counted(tagged.search("[dt|*|*] cat")) == {("dt|the|the", "nn|cat|cat"): 1}
    (tmp_path / "bad").write_bytes(b"foo---END.OF.DOCUMENT---bar a\xff\xfeb \xc3 c\n")
    assert counted(NgramEngine(spark).from_files(str(tmp_path / "bad"), 1).search("foo---END.OF.DOCUMENT---bar")) == {("foo---endofdocument---bar",): 1}
    assert counted(NgramEngine(spark).from_files(str(tmp_path / "bad"), 2).search("ab c")) == {("ab", "c"): 1}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_files_in_chunks(spark, tmp_path, monkeypatch, n):
    """Windows run over lines, chunks of lines and splits of a file, as they do over one text."""
    rng = random.Random(n)
    folder = tmp_path / "files"
    folder.mkdir()
    texts = []
    for k in range(3):
        lines = [" ".join(rng.choice(["a", "b", "c", "d-e", "---END.OF.DOCUMENT---", "x" * 41, "12"]) for _ in range(rng.choice([0, 0, 1, 2, 9]))) for _ in range(60)]
        texts.append("\n".join(lines) + "\n")
        (folder / f"f{k}").write_text(texts[-1])
    (folder / "empty").write_text("")
    monkeypatch.setattr(corpus, "CHUNK_BITS", 1)
    engine, usual = NgramEngine(spark), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        got = counted(engine.from_files(str(folder), n).grams)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    whole = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got == counted(engine.from_text(whole, n).grams) and got


def test_clashing_names_empty_tables_and_repeated_rows(spark):
    engine = NgramEngine(spark)
    names = "doc_id long, text string, words string, a int, w0 string, frequency int, file string, chunk int"
    rows = [(1, "a b", "x", 1, "y", 2, "f", 0)] * 2 + [(None, None, None, None, None, None, None, None), (1, " ", "x", 1, "y", 2, "f", 0)]
    docs = spark.createDataFrame(rows, names)
    assert counted(engine.from_text(docs, 2).grams) == {("$", "a"): 2, ("a", "b"): 2, ("b", "$"): 2}
    nothing = engine.from_text(docs.limit(0), 2)
    assert nothing.grams.count() == nothing.get_top(3).count() == nothing.search("a *").count() == nothing.entropy_top("= *", 3).count() == 0
    assert nothing.numwords() == 0 and nothing.wordlength_stats().where("frequency > 0").count() == 0
    long = engine.from_text(spark.createDataFrame([(1, "word " * 50_000)], "doc_id long, text string"), 2)
    assert counted(long.search("word word")) == {("word", "word"): 49_999}


def test_generated(spark):
    docs = corpus.generated(spark, 20, words=50, vocabulary=100, seed=3)
    table = NgramEngine(spark).from_text(docs, 1)
    assert docs.count() == 20 and table.numwords() == 1000 and docs.collect() == corpus.generated(spark, 20, words=50, vocabulary=100, seed=3).collect()
    top = table.get_top(100).collect()
    assert len(top) > 30 and top[0].frequency > 5 * top[20].frequency


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalog(spark, table, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/all/cat")
    catalog.add(table, "plain", entropies=["= *"])
    entry = catalog.entries()[2]
    assert entry["numwords"] == 5 and entry["indexes"] == ["0_1", "1_0"] and catalog.list_all().count() == 1
    there = {p.name for p in (tmp_path / "all" / "cat" / entry["folder"]).iterdir()}
    assert there == {"grams", "by_0_1", "by_1_0", "by_frequency", "entropy_10"}
    assert counted(catalog.search("a")) == {("a",): 2}
    for pattern in ("* b", "a *", "a b", "b $", "$ a", "* c"):
        assert counted(catalog.search(pattern)) == counted(table.search(pattern))
    assert "by_1_0" in str(catalog.found("* b").inputFiles()) and "EqualTo(w1,b)" in plan_of(catalog.found("* b"))
    assert "grams" in str(catalog.found("a *").inputFiles())
    for m in (1, 2, 3, 100):
        assert catalog.get_top(2, m).collect() == table.get_top(m).collect()
    assert catalog.entropy_of("b *").first()[0] == pytest.approx(table.entropy_of("b *")) and catalog.entropy_of("nothing *").first()[0] is None
    assert catalog.entropy_top("= *", 2).collect() == table.entropy_top("= *", 2).collect() and catalog.entropy_stats("= *").collect() == table.entropy_stats("= *").collect()
    assert catalog.entropy_top("* =", 2).collect() == table.entropy_top("* =", 2).collect()  # not stored
    assert [tuple(r) for r in catalog.list_entropies().collect()] == [(2, "= *")]
    assert catalog.wordlength_stats(2).collect() == table.wordlength_stats().collect()
    with pytest.raises(ValueError):
        catalog.search("a b c")
    with pytest.raises(ValueError):
        catalog.add(table, "other")
    # a new version doesn't touch what readers of the old one hold
    before = catalog.found("* b")
    catalog.add(table.merge(table), "plain", howmany=1, top=False)
    assert catalog.entries()[2]["indexes"] == ["0_1"] and counted(before) == {("a", "b"): 2} and counted(catalog.search("* b")) == {("a", "b"): 4}
    assert catalog.get_top(2, 1).first().frequency == 4
    (tmp_path / "all" / "nothing").mkdir()
    assert [(r.corpus, r.n) for r in Catalogs(spark, f"file://{tmp_path}/all").list_all().collect()] == [("cat", 2)]


def test_access_path_of_longer_patterns(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcd") for _ in range(30))) for i in range(10)], "doc_id long, text string")
    engine = NgramEngine(spark)
    tables = engine.all_up_to(engine.from_text(docs, 3))
    for n, t in tables.items():
        assert counted(t.grams) == counted(engine.from_text(docs, n).grams)
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    catalog.add(tables[3], "random")
    for pattern, index in {"* * a": "by_2_0_1", "* a *": "by_1_2_0", "* a b": "by_1_2_0", "a * b": "by_2_0_1", "a b *": "grams", "* a": "by_1_2_0", "$ $ a": "by_2_0_1"}.items():
        assert index in str(catalog.found(pattern).inputFiles()), pattern
        assert counted(catalog.search(pattern)) == counted(tables[3].search(pattern))
    lines = "\n".join(rng.choice(["The DT the", "cat NN cat", "cats NN cat", "<s>"]) for _ in range(80))
    pos = Catalog(spark, f"file://{tmp_path}/p")
    tagged = engine.from_text(spark.createDataFrame([(0, lines)], "doc_id long, text string"), 2, pos=True)
    pos.add(tagged, "tagged")
    for pattern, index in {"* [nn|cat|cats]": "by_1_0", "[dt|the|the] *": "grams", "* [nn|cat|*]": "by_1_0", "* cats": "by_1_0", "[*|*|cat] [*|cat|*]": "grams", "$ [nn|*|*]": "by_1_0", "* [xx|*|*]": "by_1_0"}.items():
        assert index in str(pos.found(pattern).inputFiles()) or pattern == "* [xx|*|*]"
        assert counted(pos.search(pattern)) == counted(tagged.search(pattern)), pattern
    assert "In(w1, [nn|cat|cat,nn|cat|cats])" in plan_of(pos.found("* [nn|cat|*]")) or "In(w1, [nn|cat|cats,nn|cat|cat])" in plan_of(pos.found("* [nn|cat|*]"))
    monkeypatch.setattr(catalogs, "EXPAND", 1)
    assert "grams" in str(pos.found("* [nn|cat|*]").inputFiles()) and counted(pos.search("* [nn|cat|*]")) == counted(tagged.search("* [nn|cat|*]"))
    pos.add(tagged, "tagged", first=1, howmany=1)
    assert pos.entries()[2]["indexes"] == ["1_0"]


def test_places(spark, tmp_path):
    rows = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1009).alias("x"))
    got = W.placed(rows, [F.desc("x")], f"file://{tmp_path}/p").collect()
    assert {r.x: r.place for r in got} == {x: k for k, x in enumerate(sorted((i * 7919 % 1009 for i in range(1000)), reverse=True), 1)}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a b c",), ("a b",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    query = running_counts(stream, 2).writeStream.outputMode("complete").format("memory").queryName("grams").start()
    query.processAllAvailable()
    query.stop()
    assert counted(spark.table("grams"))["a", "b"] == 2


def test_entry_points():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 40 and all(map(callable, queries.values()))


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf: dict = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="checkpoint"):
            storage.scratch(Session, "x")
    Session.conf = {"spark.checkpoint.dir": "hdfs:///shared/"}
    assert storage.scratch(Session, "x").startswith("hdfs:///shared/x-")


def test_index_in_the_order_of_words_needs_no_shuffle(spark, table, tmp_path, monkeypatch):
    """The rows that add() has stored lie in ranges of their words, so only other orders are parted anew."""
    parted, kind = [], type(table.grams)
    usual = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *by: parted.append(by) or usual(self, *by))
    catalog = Catalog(spark, f"file://{tmp_path}/once")
    catalog.add(table, "plain", top=False)
    assert parted == [("w0", "w1"), ("w1", "w0")]  # grams, by_1_0
    entry = catalog.entries()[2]
    stored = spark.read.parquet(f"{tmp_path}/once/{entry['folder']}/by_0_1")
    assert counted(stored) == counted(table.index((0, 1))) and (entry["rows"], entry["numwords"]) == (5, 5)
