"""Near copies, the id store and context trees against brute force, and the pipeline's stages."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import common, ctw, idstore, jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


# -- near copies


@pytest.fixture(scope="module")
def joined(docs):
    return jaccard.join(docs).collect()


def test_jaccard(rows, joined):
    sets = [(r[0], shingles(r[1])) for r in rows]
    linked = [{j for j, (_, b) in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 70 * len(a | b)} for i, (_, a) in enumerate(sets)]
    wanted = Counter()
    for i, (doc, s) in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        wanted[doc, len(s), len(linked[i]), min((sets[j][0] for j in seen if sets[j][0] is not None), default=None)] += 1
    assert Counter(map(tuple, joined)) == wanted
    assert sum(bool(x) for x in linked) > 8


def similar_texts(seed):
    """Groups of edited copies on both sides of the threshold, a passage that most share, parts of each other, short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 2, 3])))
    shared = [word() for _ in range(25)]
    texts = []
    for size in (1, 2, 12, 30):
        base = [word() for _ in range(rng.choice([40, 90, 160]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.choice([0.6, 0.7, 0.72, 0.85]))]
            texts.append(" ".join((w[:10] + shared + w[10:]) if rng.random() < 0.5 else w))
    texts += [" ".join([*shared, *(word() for _ in range(rng.choice([0, 3, 5])))]) for _ in range(15)]
    texts += [" ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 4, 60]))) for _ in range(30)]
    return [(i * 3 + 1, t) for i, t in enumerate(texts + texts[:5])]


@pytest.mark.parametrize(("seed", "percent", "broadcast"), [(1, 70, True), (2, 70, False), (3, 50, True), (4, 90, True)])
def test_jaccard_of_groups(spark, monkeypatch, seed, percent, broadcast):
    for name, value in {"BLOCK": 4, "SHINGLE_BUCKETS": 6, "WORD_BUCKETS": 5, **({} if broadcast else {"BROADCAST_BYTES": 0})}.items():
        monkeypatch.setattr(jaccard, name, value)
    made = similar_texts(seed)
    sets = {d: shingles(t) for d, t in made}
    links = {d: {e for e, b in sets.items() if e != d and a and b and 100 * len(a & b) >= percent * len(a | b)} for d, a in sets.items()}
    wanted = set()
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        wanted.add((d, len(sets[d]), len(links[d]), min(seen)))
    got = jaccard.join(spark.createDataFrame(made, "doc_id long, text string"), percent=percent)
    assert {tuple(r) for r in got.collect()} == wanted and sum(map(len, links.values())) > 30


def components_by_definition(texts, percent=70):
    """doc_id, n_shingles, n_similar, component_id, pair by pair."""
    sets = {d: shingles(t) for d, t in texts}
    links = {d: {e for e, b in sets.items() if e != d and a and b and 100 * len(a & b) >= percent * len(a | b)} for d, a in sets.items()}
    found = set()
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        found.add((d, len(sets[d]), len(links[d]), min(seen)))
    return found


@pytest.mark.parametrize(("seed", "percent", "large"), [(5, 70, 2), (6, 50, 3), (7, 90, 2), (8, 70, 8)])
def test_jaccard_in_stars(spark, monkeypatch, seed, percent, large):
    for name, value in {"LARGE": large, "SIDE": 4, "WORDS": 1, "MOST_WORDS": 2, "SHINGLE_BUCKETS": 6, "WORD_BUCKETS": 5}.items():
        monkeypatch.setattr(jaccard, name, value)
    written, table = {}, common.table
    monkeypatch.setattr(common, "table", lambda df, folder, name: written.setdefault(name, table(df, folder, name)))
    monkeypatch.setattr(common, "drop", lambda *names: None)
    made = similar_texts(seed)
    got = jaccard.join(spark.createDataFrame(made, "doc_id long, text string"), percent=percent)
    assert {tuple(r) for r in got.collect()} == components_by_definition(made, percent)
    assert written["stars"].count() >= 10 and written["around"].count() > 0


def test_large_group_of_near_copies_makes_no_pairs(spark, monkeypatch):
    rng, pairs = random.Random(9), []
    table = common.table

    def counted(df, folder, name):
        out = table(df, folder, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(common, "table", counted)
    base = [f"w{i}" for i in range(150)]
    made = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    got = jaccard.join(spark.createDataFrame(made, "doc_id long, text string"))
    wanted = components_by_definition(made)
    assert {tuple(r) for r in got.collect()} == wanted and sum(r[2] for r in wanted) > 10_000
    assert sum(pairs) < 5 * len(made)  # not 160 * 159 / 2


def test_one_of_each_group(docs, joined, empty):
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter({r.doc_id for r in joined if r.doc_id == r.component_id})
    assert jaccard.join(empty).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)]
    df = spark.createDataFrame([(a * 7919 % 1009, b * 7919 % 1009) for a, b in links], "a long, b long")
    got = {r.v: r.label for r in jaccard.components(df, common.shared_dir(spark, "t")).collect()}
    chain = [i * 7919 % 1009 for i in range(41)]
    assert {got[v] for v in chain} == {min(chain)} and len(set(got.values())) == 2


# -- id store


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_encoder_is_the_tokenizer(tokenizer):
    encoder, rng = idstore.Encoder(tokenizer, 1), random.Random(2)
    assert encoder.direct
    for letters in ("aAbB'sS tTdDmrReEvVlLéÉßÿÖ÷×µªº ​ 　\x1c\x85\n\t!?.,<|endoftext|>12٣ﬁ漢👍🏽\x00½İΣς`~", "aAbBsStTdDmrRlL!.''éÉß12 \n"):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
        for text, data in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(data, "<u2")[:-1].tolist() == encoder._ids(text), text


def test_chunks_follow_the_content():
    rng = np.random.default_rng(4)
    body = rng.integers(0, 40000, 30000).astype("<u2")

    def cut(ids):
        ends = idstore.chunk_ends(ids, np.array([len(ids)]))[0]
        return [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends)]

    plain, moved = cut(body), cut(np.concatenate([body[:5], rng.integers(0, 40000, 777).astype("<u2"), body[5:]]))
    assert sum(len(c) for c in plain) == len(body) and len(set(plain) & set(moved)) > len(plain) - 6
    assert all(idstore.LEAST <= len(c) <= idstore.MOST for c in plain[:-1])
    same = np.full(10000, 7, "<u2")
    assert max(len(c) for c in cut(same)) <= idstore.MOST
    both = idstore.chunk_ends(np.concatenate([body, same]), np.array([len(body), len(same)]))
    assert both == [idstore.chunk_ends(x, np.array([len(x)]))[0] for x in (body, same)]


def test_store_round_trip(spark, docs, rows, empty, tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    folder = common.shared_dir(spark, "t")
    idstore.write(docs, folder, tokenizer, shard_rows=20)
    got = sorted(idstore.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    texts, start = defaultdict(list), 0
    for r in rows:
        texts[r[0]].append([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1])
    for r in got:
        ids = list(r.ids)
        assert ids in texts[r.doc_id] and (r.start, r.n_tokens) == (start, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    index = spark.read.parquet(f"{folder}/index")
    assert index.count() == index.select("digest").distinct().count() < spark.read.parquet(f"{folder}/recipes").select(F.explode("chunks")).count()
    nothing = common.shared_dir(spark, "t")
    idstore.write(empty, nothing, tokenizer)
    assert idstore.read(spark, nothing).count() == 0


# -- context trees


def slow_log10(train, texts, depth):
    """By the definition: a dictionary of nodes, products over all children, no arrays."""
    counts = defaultdict(lambda: [0, 0])
    symbols = lambda t: [ctw.START] * depth + list(t) + [ctw.END]
    for t in train:
        s = symbols(t)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                context = tuple(s[i - d : i])
                for j in range(8):
                    counts[context, 1 << j | s[i] >> (8 - j)][s[i] >> (7 - j) & 1] += 1
    children = defaultdict(list)
    for context, m in list(counts):
        if context:
            children[context[1:], m].append((context, m))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, own_weight = {}, {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[node])
        if len(node[0]) == depth:
            weighted[node], own_weight[node] = own, 1.0
        else:
            below = sum(weighted[c] for c in children[node])
            weighted[node] = np.logaddexp(own, below) - math.log(2)
            own_weight[node] = math.exp(own - np.logaddexp(own, below))

    def bit(s, i, j, d):
        node = (tuple(s[i - d : i]), 1 << j | s[i] >> (8 - j))
        if node not in counts:
            return 0.5
        own = (counts[node][s[i] >> (7 - j) & 1] + 0.5) / (sum(counts[node]) + 1)
        return own if d == depth else own_weight[node] * own + (1 - own_weight[node]) * bit(s, i, j, d + 1)

    return [sum(math.log10(bit(s, i, j, 0)) for i in range(depth, len(s)) for j in range(8)) for s in map(symbols, texts)]


def test_context_trees(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 4000)
    few = docs.where("doc_id < 78 OR doc_id IS NULL")
    held = F.col("doc_id") % 5 == 2
    got = ctw.score(few, held, depth=3).collect()
    mine = [r for r in rows if r[0] is None or r[0] < 78]
    low = lambda t: (t or "").encode().lower()
    train = [low(r[1]) for r in mine if r[0] is None or r[0] % 5 != 2]
    c = Counter(w for t in train for w in [*t.split(), b"\n"])
    n, v = sum(c.values()), len(c)
    exact = slow_log10(train, [low(r[1]) for r in mine], 3)
    wanted = {}
    for r, s in zip(mine, exact):
        tokens = [*low(r[1]).split(), b"\n"]
        wanted[r[0]] = (r[0] is not None and r[0] % 5 == 2, len(tokens), sum(c[w] > 0 for w in tokens), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), s)
    assert len(got) == len(mine)
    for r in got:
        w = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (*w[:3], n)
        assert r.base_score == pytest.approx(w[3], abs=1e-9) and r.score == pytest.approx(w[4], rel=1e-5, abs=1e-5)
    assert ctw.score(empty, F.lit(False)).count() == 0


def test_context_trees_of_full_depth_and_a_long_text(spark, rows):
    long = next(r[1] for r in rows if r[0] == 81)[:15_000]
    made = [(1, "abra cadabra " * 20), (2, "Abra cadabra abra"), (3, long), (4, long[3000:5000]), (5, "")]
    got = {r.doc_id: r for r in ctw.score(spark.createDataFrame(made, "doc_id long, text string"), F.col("doc_id") == 4).collect()}
    low = [t.encode().lower() for _, t in made]
    for (doc, _), s in zip(made, slow_log10([t for (d, _), t in zip(made, low) if d != 4], low, ctw.DEPTH)):
        assert got[doc].score == pytest.approx(s, rel=1e-5, abs=1e-5)
    assert -got[3].score < 0.7 * math.log10(256) * len(low[2])  # it learnt


def test_probabilities_add_up():
    train = [b"abab abba", b"baab"]
    rest = [bytes(x) for x in product(range(256), repeat=1)]
    total = sum(10**s for s in slow_log10(train, rest, 2)) + 10 ** slow_log10(train, [b""], 2)[0]
    assert 0 < total < 1
    keys, size = ctw.strings(train, 3)
    assert len(keys) == size.sum() == 15
    for kind, values in (("<u8", keys), ("<u4", np.arange(5, dtype=np.uint32)), ("<f4", np.zeros(0, np.float32))):
        assert (ctw.unsqueeze(ctw.squeeze(values), kind) == values).all()


# -- pipeline


def test_pipeline_stages(spark, tmp_path, docs, rows):
    spark.createDataFrame([(r[0], r[1], "en", r[2], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(size > 5), 0) for r in rows if r[0] is not None and r[0] < 40 for size in [len(words(r[1]))]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "mixing", "best-fit packing"]
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    mixed = None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        mixed, read = read, spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 3:
            assert read.columns == mixed.columns
    sizes = Counter()
    for r in mixed.collect():
        sizes[r.doc_id] += len(words(r.text)) + 1
    packed = Counter()
    for r in read.collect():
        packed[r.doc_id] += r.length
    assert packed == sizes and sum(sizes.values()) > 1000


def test_pipeline_of_nothing(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, _id long, row string, words string"
    for k, (docs, labels) in enumerate([([], []), ([(1, None, None, None, None, 1, "r", "w"), (None, "", "en", "a", 0, 2, "r", "w"), (2, "just a few words here", "en", None, 21, 3, None, None)] * 2, [])]):
        d = tmp_path / str(k)
        spark.createDataFrame(docs, names).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(d)).collect()
        assert (not got) if not docs else {r.doc_id for r in got} <= {1, 2, None} and sum(r.length - 1 for r in got) == 5
