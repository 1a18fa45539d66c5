"""Word rules, windows, and queries on a small corpus whose counts can be checked by hand or by a
plain reimplementation."""

import math
import unicodedata
from collections import Counter

import pytest

from lexigrid.engine import NgramEngine, NgramTable
from lexigrid.functions import patterns, permutations
from lexigrid.operators import windows as W

LONG40, LONG41 = "a" * 40, "b" * 41


def words_of(spark, *texts, pos=False):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.words for r in W.text_words(df, pos=pos).orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("It is. This, IS", ["it", "is", "this", "is"]),
        ("2nd don't --X-r...ay x- 12 -- end", ["nd", "dont", "x-ray", "x-", "end"]),
        ("ﬁnland finland straße", ["finland", "finland", "straße"]),
        ("Åber Åber", ["åber", "åber"]),
        ("ΑΣ İx", ["ας".replace("ς", "σ"), "ix"]),
        (f"x {LONG40} y {LONG41} z", ["x", LONG40, "y", None, "z"]),
        ("a ---END.OF.DOCUMENT--- b", ["a", None, "b"]),
        ("a b　c\nd", ["a", "b", "c", "d"]),
        ("", []),
        (None, None),
    ],
)
def test_words(spark, text, words):
    expected = words and [w and unicodedata.normalize("NFKD", w) for w in words]
    assert words_of(spark, text) == [expected]


@pytest.mark.parametrize(
    ("lines", "words"),
    [
        ("is\tVBZ\tbe\nusing\tVVG\tuse", ["vbz|be|is", "vvg|use|using"]),
        ("is VBZ be\n, , ,\nusing VVG use", ["vbz|be|is", "vvg|use|using"]),  # ignored, not a break
        ("is VBZ be\n<s>\nusing VVG use", ["vbz|be|is", None, "vvg|use|using"]),
        ("word NN <unknown>", [None]),
        ("a DT a extra", [None]),
        ("a DT a ", [None]),
        ("a DT a\r", [None]),
        ("word NN 5", []),
        (f"{LONG41} NN", [None]),
        (f"a NN {LONG41}", [None]),
        ("'s POS 's", ["pos|s|s"]),
    ],
)
def test_tagged_lines(spark, lines, words):
    assert words_of(spark, lines, pos=True) == [words]


def brute(texts, n):
    """T_n of texts whose words need no cleaning; a "|" breaks a segment."""
    out = Counter()
    for text in texts:
        for segment in text.split("|"):
            if ws := segment.split():
                laid = ["$"] * (n - 1) + ws + ["$"] * (n - 1)
                out.update(tuple(laid[i : i + n]) for i in range(len(laid) - n + 1))
    return out


TEXTS = ["the cat of the cat of the hat", "the cat|of the", "a", "the hat of a cat of the hat|the|a b c d e f"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t.replace("|", f" {LONG41} {LONG41} ")) for i, t in enumerate([*TEXTS, "", "12 34"])] + [(99, None)], "doc_id long, text string")
    return {n: NgramTable(NgramEngine(spark).from_text(docs, n).grams.cache()) for n in range(1, 5)}


def rows(df):
    return Counter({tuple(r)[:-1]: r[-1] for r in df.collect()})


@pytest.mark.parametrize("n", range(1, 5))
def test_windows_and_indexes(tables, n):
    expected = brute(TEXTS, n)
    assert rows(tables[n].grams) == expected
    words = sum(len(t.replace("|", " ").split()) for t in TEXTS)
    assert tables[n].numwords() == words
    for order, index in tables[n].indexes().items():
        got = [tuple(r) for r in index.collect()]
        assert dict((g[:-1], g[-1]) for g in got) == {tuple(w[k] for k in order): c for w, c in expected.items() if w[order[0]] != "$"}
        assert sum(g[-1] for g in got) == words
        assert got == sorted(got)


@pytest.mark.parametrize(("pattern", "keep"), [("the *", lambda w: w[0] == "the"), ("* of the", lambda w: w[1:] == ("of", "the")), ("the $", lambda w: w == ("the", "$")), ("The * OF!", lambda w: w[0] == "the" and w[2] == "of"), ("$ the *", lambda w: w[:2] == ("$", "the"))])
def test_search_and_rollup(tables, pattern, keep):
    n = len(pattern.split())
    expected = Counter({w: c for w, c in brute(TEXTS, n).items() if keep(w)})
    for longer in range(n, 5):
        assert rows(tables[longer].search(pattern)) == expected
    got = [(-r.frequency, tuple(r)[:-1]) for r in tables[n].search(pattern).collect()]
    assert got == sorted(got)


def test_search_errors(tables):
    for bad in ("", "* *", "*x y", "12 the", "a b c d e"):
        with pytest.raises(patterns.PatternError):
            tables[4].search(bad)
    assert tables[2].search(f"{LONG41} the").count() == 0
    with pytest.raises(ValueError):
        tables[2].entropy_of("nowhere *")


def test_top(tables):
    got = [tuple(r) for r in tables[2].get_top(5).collect()]
    every = [(*w, c) for w, c in brute(TEXTS, 2).items() if w[0] != "$"]
    assert got == sorted(every, key=lambda r: (r[2], r[0], r[1]), reverse=True)[:5]


def entropy(counts):
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts)


@pytest.mark.parametrize(("pattern", "at"), [("= *", 0), ("* =", 1), ("= * =", 2), ("= = *", 0), ("* = =", 1)])
def test_entropy(tables, pattern, at):
    places = pattern.split()
    known = [k for k, p in enumerate(places) if p == "="]
    groups = {}
    for w, c in brute(TEXTS, len(places)).items():
        if w[at] != "$":
            groups.setdefault(tuple(w[k] for k in known), []).append(c)
    table = tables[len(places)]
    got = {tuple(r)[: len(known)]: (r.entropy, r.frequency, r.n_completions) for r in table.entropy_index(pattern).collect()}
    assert got.keys() == groups.keys()
    for k, counts in groups.items():
        assert got[k] == (pytest.approx(entropy(counts), abs=1e-9), sum(counts), len(counts))
        assert len(counts) > 1 or got[k][0] == 0.0
    stats = {r.entropy: r.n for r in table.entropy_stats(pattern).collect()}
    assert sum(stats.values()) == len(groups)
    best = table.entropy_top(pattern, 4, 2).collect()
    wanted = sorted((round(entropy(c), 9), *([k[known.index(at)]] if at in known else []), k) for k, c in groups.items() if len(c) > 1 or sum(c) >= 2)[:4]
    assert [round(r.entropy, 9) for r in best] == [abs(w[0]) for w in wanted]
    assert all(r[k] == "*" for r in best for k in range(len(places)) if k not in known)


def test_entropy_of(tables):
    counts = [c for w, c in brute(TEXTS, 2).items() if w[0] == "the"]
    assert tables[2].entropy_of("the *") == pytest.approx(entropy(counts))


def test_lengths(tables):
    got = {r.length: r.frequency for r in tables[2].wordlength_stats().collect()}
    expected = Counter()
    for w, c in brute(TEXTS, 2).items():
        if w[0] != "$":
            expected[len("\t".join(w))] += c
    assert sorted(got) == list(range(1, 84)) and {k: v for k, v in got.items() if v} == expected


def test_merge_is_independent_of_parts(spark, tables):
    engine = NgramEngine(spark)
    parts = [engine.from_text(spark.createDataFrame([(0, t.replace("|", f" {LONG41} "))], "doc_id long, text string"), 3) for t in TEXTS]
    merged = parts[0].merge(parts[1]).merge(parts[2]).merge(parts[3])
    assert rows(merged.grams) == brute(TEXTS, 3)


def test_save_and_load(spark, tables, tmp_path):
    tables[3].save(str(tmp_path / "t"))
    loaded = NgramEngine(spark).load(str(tmp_path / "t"))
    assert rows(loaded.grams) == brute(TEXTS, 3)
    plan = loaded.search("the of *")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(w0,the)" in plan


def test_tagged_search(spark):
    lines = "The DT the\ncat NN cat\nthe DT the\ncats NN cat\n<s>\nthe XX the\ncat NN cat"
    table = NgramEngine(spark).from_text(spark.createDataFrame([(0, lines)], "doc_id long, text string"), 2, pos=True)
    assert rows(table.search("[dt|*|the] [nn|cat|*]")) == {("dt|the|the", "nn|cat|cat"): 1, ("dt|the|the", "nn|cat|cats"): 1}
    assert rows(table.search("[*|the|*] cat")) == {("dt|the|the", "nn|cat|cat"): 1, ("xx|the|the", "nn|cat|cat"): 1}
    assert rows(table.search_regrouped("the cat")) == {("the", "cat"): 2}
    with pytest.raises(patterns.PatternError):
        table.search("[dt|the] cat")
    with pytest.raises(ValueError):
        table.wordlength_stats()


def test_orders():
    assert list(permutations.orders(3)) == [(0, 1, 2), (2, 0, 1), (1, 2, 0)]
    assert set(permutations.orders(4)) == {(0, 1, 2, 3), (1, 2, 3, 0), (1, 3, 0, 2), (2, 0, 3, 1), (2, 3, 0, 1), (3, 0, 1, 2)}
    for n in range(1, 9):
        found = list(permutations.orders(n))
        assert len(found) == len(set(found)) == math.comb(n, n // 2)
        for k in range(1, n):  # every set of known places is some order's beginning
            assert len({frozenset(o[:k]) for o in found}) == math.comb(n, k)


def test_sorted_check(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "b", "d", "c"])], "row long, w0 string")
    assert W.unsorted_rows(df, ["w0"]).first()[0] == 2
    far = spark.createDataFrame([(0, "f"), (1, "g"), (5 << 33, "a"), ((5 << 33) + 1, "b"), (9 << 33, "z")], "row long, w0 string")
    assert W.unsorted_rows(far, ["w0"]).first()[0] == 1
    assert W.unsorted_rows(df.limit(0), ["w0"]).first()[0] == 0


@pytest.mark.parametrize("word", ["the\ufe0f", "\U0001f130", "\u1734reversed", "ﬁn", "İSTANBUL", "Σ", "x\u00ad-y", "ªb", "a\u0345", "\u0903a"])
def test_patterns_follow_the_tables(spark, word):
    """A pattern that is the text itself finds the word that the text gave."""
    engine = NgramEngine(spark)
    table = engine.from_text(spark.createDataFrame([(0, f"a {word} b")], "doc_id long, text string"), 3)
    assert rows(table.search(f"a {word} b")) == {("a", words_of(spark, word)[0][0], "b"): 1}


def test_patterns_of_null_words(spark, tables):
    assert tables[2].search("---END.OF.DOCUMENT--- the").count() == 0
    assert rows(tables[2].search("the\u2003of")) == rows(tables[2].search("the of"))


def test_hexadecimal(spark, tables):
    from lexigrid.operators import queries as Q

    counts = tables[2].wordlength_stats()
    text = Q.hexadecimal(counts)
    assert text.first() == ("0" * 15 + "1", "0" * 16) and Q.decimal(text, ["length", "frequency"]).collect() == counts.collect()


def test_windows_and_tagged_texts_are_compiled(spark):
    """Windows come from exploded starts, and a usual tagged text is read by one expression, not by lambdas for each."""
    held = W.text_words(spark.createDataFrame([(0, "a b")], "doc_id long, text string"))
    plan = W.windows(held, 3)._jdf.queryExecution().executedPlan().toString()
    assert "inline(" not in plan and "explode(CASE WHEN (size(a" in plan


@pytest.mark.parametrize("odd", ["", "a b c d", "a\u00a0b c d", "<s>", "x NN y ", f"{LONG41}", f"a {LONG41}", f"{LONG40} NN a", f"{'é' * 14} NN a", "5 NN word", "ﬁn NN ﬁn", "Über NN -über", "Ŀ NN ŀ", ", , ,"])
def test_tagged_texts_as_their_lines(spark, odd):
    """The one expression gives what lines read one by one give."""
    lines = ["Cat NN cat", odd, "Bär\tNN\tbär.", "the DT the"]
    each = [w for line in lines for w in (words_of(spark, line + "\n<s>", pos=True)[0] or [])[:-1]]  # a tag has lines read one by one
    assert words_of(spark, "\n".join(lines), pos=True) == [each]


def test_top_without_the_table(spark, monkeypatch):
    """The most frequent n-grams by way of hashes: with ties, with fewer rows than asked for, and where hashes meet."""
    from lexigrid.operators import queries as Q

    docs = spark.createDataFrame([(i, t.replace("|", f" {LONG41} ")) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    held = W.text_words(docs)
    wanted = lambda m: sorted(((*w, c) for w, c in brute(TEXTS, 3).items() if w[0] != "$"), key=lambda r: (r[3], *r[:3]), reverse=True)[:m]
    for again, hash_of in ((100, None), (1, None), (100, lambda *c: Q.F.length(c[0]).cast("long"))):
        monkeypatch.setattr(Q, "AGAIN", again)
        if hash_of:
            monkeypatch.setattr(Q.F, "xxhash64", hash_of)
        for m in (1, 3, 1000):
            assert [tuple(r) for r in Q.top_of(held, 3, m).collect()] == wanted(m)
