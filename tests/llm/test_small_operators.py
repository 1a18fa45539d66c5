"""Packing, classifier, archive, chat, audio, mixing and top-k against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import chat, common, media, mixing, packing, quality, topk, warc


def words(text):
    return (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if text else []


def size(text):
    return sum(w != "" for w in words(text))


# -- packing


def naive(lengths, capacities, long_cost):
    """Best fit with the same costs, by lists."""
    left, bins, stamp = Counter(lengths), [], {}
    for now, n in enumerate(lengths):
        left[n] -= 1
        fits = [r for r, _ in bins if r >= n]
        if fits:  # of equally good bins, the one that was used last
            b = max((k for k, (r, _) in enumerate(bins) if r == min(fits)), key=stamp.get)
        else:
            best = None
            for c in sorted(capacities):
                if c >= n:
                    room, got, top = c - n, 0, c - n
                    for m in sorted((m for m in left if left[m]), reverse=True):
                        if m <= min(room, top):
                            k = min(left[m], room // m)
                            got, room, top = got + k * m, room - k * m, m - 1
                    cost = c * (1 + c / long_cost) / (n + got)
                    if best is None or cost <= best[0]:
                        best = cost, c
            bins.append((best[1], 0))
            b = len(bins) - 1
        bins[b] = bins[b][0] - n, bins[b][1] + n
        stamp[b] = now
    return Counter(f for _, f in bins)


def test_packing_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(30):
        capacities = sorted(rng.sample(range(8, 65), 3))
        lengths = sorted((rng.randint(1, capacities[-1]) for _ in range(rng.randint(0, 60))), reverse=True)
        where, final = packing.plan(lengths, capacities, 500.0)
        filled = Counter()
        for n, b in zip(lengths, where):
            filled[b] += n
        assert all(final[b] == min(c for c in capacities if c >= f) for b, f in filled.items()) and len(final) == len(filled)
        expected = naive(lengths, capacities, 500.0)
        assert Counter(filled.values()) == expected


def test_packing(docs, rows, empty):
    found = packing.pack(docs, capacities=(64, 128, 256), group_rows=20).collect()
    wanted = Counter((r[0], size(r[1]) + 1) for r in rows)
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    for doc, n in {(d, n) for d, n in wanted}:
        of = sorted((r.start, r.length) for r in pieces[doc])
        assert sum(x for _, x in of) == sum(k * c for (d, k), c in wanted.items() if d == doc)
    bins = defaultdict(list)
    for r in found:
        bins[r.bin_id].append(r)
    for of in bins.values():
        at = 0
        for r in sorted(of, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.length
        assert of[0].capacity == min(c for c in (64, 128, 256) if c >= at) and len({r.capacity for r in of}) == 1
    assert packing.pack(empty).count() == 0


def test_packed_tokens(spark, docs):
    rng = random.Random(6)
    made = [(i, [rng.randint(1, 999) for _ in range(rng.choice([1, 5, 30, 64, 65, 300]))]) for i in range(60)] + [(7, [1, 2]), (None, [3]), (8, []), (9, None)]
    tokens = spark.createDataFrame(made, "doc_id long, ids array<int>")
    found = packing.pack_tokens(tokens, capacities=(16, 32, 64), group_rows=25, pad_id=-1).collect()
    assert len({r.bin_id for r in found}) == len(found)
    pieces = defaultdict(list)
    for r in found:
        assert len(r.tokens) == len(r.positions) == len(r.segments) == r.capacity
        at = 0
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts), 1):
            end = at + r.segments.count(k)
            assert r.segments[at:end] == [k] * (end - at) and r.positions[at:end] == list(range(end - at))
            pieces[doc].append((start, tuple(r.tokens[at:end])))
            at = end
        assert r.tokens[at:] == [-1] * (r.capacity - at) and not any(r.segments[at:]) and (r.capacity == 16 or at > r.capacity // 2)
    wanted = defaultdict(list)
    for doc, ids in made:
        wanted[doc] += [(k, tuple(ids[k : k + 64])) for k in range(0, len(ids or []), 64)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items() if v}
    assert packing.pack_tokens(tokens.limit(0)).count() == 0


# -- classifier


def test_statistics_do_not_depend_on_batches():
    texts = ["Plain text here.\nAnd more.", "", None, "AAA!! BBB!!", "x" * 5000, "é ü", " ", "same\nsame\nsame"]
    every = quality.statistics(pa.array(texts))
    assert np.isfinite(every).all() and every.shape == (len(texts), len(quality.NAMES))
    for k, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([t])), every[k]), t
    assert np.allclose(quality.statistics(pa.array(["skip", *texts]).slice(1)), every)
    named = dict(zip(quality.NAMES, every[3]))
    assert named["upper"] == 6 / 11 and named["mark"] == 4 / 11 and named["mark_words"] == 1 and named["repeated_pairs"] == 0
    assert dict(zip(quality.NAMES, every[7]))["repeated_lines"] == pytest.approx(2 / 3)


def test_forest_learns_and_traverses():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    forest = quality.fit(x[:2000], y[:2000], trees=40)
    assert ((forest.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    for row in x[2000:2020]:  # a walk by hand
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - len(f)]
        assert forest.predict(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    for labels in (np.zeros(0), np.ones(5)):
        assert len(quality.fit(np.zeros((len(labels), 4)), labels).predict(np.zeros((3, 4)))) == 3


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None)], "doc_id long, label int")
    forest = quality.train(docs, labels, trees=5)
    got = quality.score(docs, forest)
    assert got.count() == docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    kept = quality.keep(docs, forest, 0.0)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(empty, forest).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_held_out_accuracy(spark):
    """On labelled documents that the classifier never saw."""
    from lexigrid.llm import q_quality

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    got = q_quality.op3_quality(spark, d).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in got) / len(got)
    good = sum(r.quality for r in got) / len(got)
    assert len(got) > 80 and right >= 0.95 and right > max(good, 1 - good) + 0.05


# -- archive


def test_archive(spark):
    long = "<p>" + "ü" * 5000
    pages = [(3, "http://a/ b", long), (1, None, long), (2, "http://c\r\nX: y", "short"), (5, "u", "short"), (7, "v", None), (8, "w", ""), (9, "http://é", long), (None, "n", long), (11, "r", "z" * 100), (11, "r", "z" * 100), (12, "t", "z" * 100)]
    pages += [(21, "p", "A" * 200), (22, "p", "B" * 200), (25, "p", "A" * 200), (25, "p", "C" * 200), (26, "p", "A" * 200), (26, "p", "B" * 200), (None, "q", "D" * 200), (None, "r", "D" * 200)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, offset int")
    folder = common.shared_dir(spark, "t")
    index = warc.write(df, folder)
    assert index.count() == len(pages)
    got = sorted((tuple(r)[:5] for r in warc.read(index, folder).collect()), key=str)
    wanted = []
    for page, _, html in pages:
        data = (html or "").encode()
        first = min((p for p, _, h in pages if h == html and p is not None), default=None)
        again = len(data) >= 100 and first is not None and (page is None or page > first)
        wanted.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(wanted, key=str)
    some = warc.read(index.where("page_id IN (1, 8)"), folder, gap=0).collect()
    assert {(r.page_id, r.payload.decode()) for r in some} == {(1, long), (8, "")}
    assert warc.read(warc.write(df.limit(0), common.shared_dir(spark, "t")), folder).count() == 0
    with pytest.raises(Exception, match="damaged"):
        warc.read(index.where("page_id = 1").withColumn("payload_digest", F.lit("0")), folder).collect()


# -- chat


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "pair_id long, turn long, role string, text string, part string")


def check_pairs(chosen, rejected):
    """Against Python: one prompt, both completions and the characters trained on, a pair at a time."""
    sides, null = [], lambda x: (x is not None, x if x is not None else "")
    for df in (chosen, rejected):
        by = defaultdict(list)
        for pair, *turn in {(r.pair_id, r.turn, r.role, r.text) for r in df.collect()}:
            by[pair].append(turn)
        sides.append({k: [t[1:] for t in sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, null(t[1]), null(t[2])))] for k, v in by.items()})
    show = lambda role, text: f"<|im_start|>{'user' if role is None else role}\n{text or ''}<|im_end|>\n"
    got = defaultdict(list)
    for r in chat.format_pairs(chat.positions(chosen), chat.positions(rejected)).orderBy("pos").collect():
        got[r.pair_id].append(r)
    assert got.keys() == sides[0].keys() | sides[1].keys()
    for pair, rows in got.items():
        a, b = (s.get(pair, []) for s in sides)
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert [r.pos for r in rows] == list(range(max(len(a), len(b))))
        for name, wanted in (("prompt", a[:same]), ("chosen", a[same:]), ("rejected", b[same:])):
            held = [r for r in rows if r[name] is not None]
            whole = "".join(r[name] for r in held)
            assert whole == "".join(show(*t) for t in wanted) and len(held) == len(wanted)
            for r, (role, text) in zip(held, wanted):
                assert whole[r[f"{name}_start"] :].startswith(r[name])
                if name != "prompt":
                    lo, hi = r[f"{name}_mask_start"], r[f"{name}_mask_end"]
                    assert (lo is not None) == (role == "assistant") and (lo is None or whole[lo:hi] == (text or "") + "<|im_end|>")


def test_preference_pairs_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURN_BUCKET", 3)
    rng = random.Random(4)
    made = [(p, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é" * 5])) for p in [*range(12), None] for t in range(rng.choice([0, 1, 5, 25]))]
    other = [(p, t, role, text if rng.random() < 0.93 else "changed") for p, t, role, text in made if rng.random() < 0.98]
    check_pairs(turns(spark, made), turns(spark, other))


def test_preference_pairs(spark):
    chosen = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 5, "user", None), (2, 9, "assistant", "a"), (3, 0, "user", "only"), (None, 0, None, "n"), (4, None, "system", "s"), (4, 0, "assistant", "")])
    rejected = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", ""), (2, 1, "assistant", "a"), (3, 0, "user", "only"), (None, 0, None, "n"), (5, 0, "assistant", "new")])
    check_pairs(chosen, rejected)
    rows = chat.format_pairs(chat.positions(chosen), chat.positions(rejected)).collect()
    at = {(r.pair_id, r.pos): r for r in rows}
    assert len(at) == len(rows) and at[1, 0].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert (at[1, 1].chosen, at[1, 1].rejected) == ("<|im_start|>assistant\nyes<|im_end|>\n", "<|im_start|>assistant\nno<|im_end|>\n") and at[1, 2].chosen is None
    assert at[2, 0].prompt is None  # a null text isn't an empty one
    assert at[None, 0].prompt == "<|im_start|>user\nn<|im_end|>\n" and at[4, 0].chosen and at[5, 0].rejected and not at[5, 0].chosen
    none = chat.positions(chosen.limit(0))
    assert chat.format_pairs(none, none).count() == 0


# -- audio


def test_media(docs, rows, empty):
    got = media.fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.to_wav(padded)
        assert media.from_wav(stored) == padded and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert list(r.fp_time) == sorted(r.fp_time) and len(r.fp_time) == len(r.fp_hash)
        by[data].add((r.feature, tuple(r.fp_hash)))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v))[0] for k, v in by.items() if len(k) > 3000}) == sum(len(k) > 3000 for k in by)
    assert media.fingerprints(empty).count() == 0


def test_spectrum_finds_a_tone_and_blocks_agree(monkeypatch):
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * np.arange(20000) / media.FRAME)).astype(np.uint8)
    power, at = media.spectrum_bands(tone)
    assert (at[:-1, 2] == 40).all() and power[:-1, 2].min() > 100 * power[:-1, 0].max()
    noise = np.random.default_rng(0).integers(0, 256, 50000, np.uint8)
    whole = media.fingerprint(noise)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(media.fingerprint(noise), whole))


def slow_fingerprint(x):
    """By the definition: a Fourier matrix, one frame, band and peak at a time."""
    n = max(1, -(-(len(x) - media.FRAME) // media.HOP) + 1)
    matrix = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    best = []
    for t in range(n):
        frame = np.zeros(media.FRAME)
        part = x[t * media.HOP : t * media.HOP + media.FRAME]
        frame[: len(part)] = part
        power = abs(matrix @ ((frame - frame.mean()) * np.hanning(media.FRAME))) ** 2
        best.append([max((power[f], -f) for f in range(a, b)) for a, b in zip(media.EDGES, media.EDGES[1:])])
    found = []
    for t in range(n):
        for b in range(len(best[0])):
            p = best[t][b][0]
            if p > 1e-6 and all(p > best[u][b][0] for u in range(max(0, t - media.NEAR), t)) and all(p >= best[u][b][0] for u in range(t + 1, min(n, t + media.NEAR + 1))):
                found.append((t, -best[t][b][1]))
    return sorted((t, f << 15 | g << 6 | u - t) for k, (t, f) in enumerate(found) for u, g in found[k + 1 : k + 1 + media.FAN] if u - t <= media.REACH)


def test_fingerprints_against_the_definition(spark):
    rng = np.random.default_rng(1)
    for size in (64, 512, 513, 5000, 30_000):
        noise = rng.integers(0, 256, size, np.uint8)
        time, hashed = media.fingerprint(noise)
        assert list(zip(time.tolist(), hashed.tolist())) == slow_fingerprint(noise)
    folder = common.shared_dir(spark, "t")
    held = media.store(spark.createDataFrame([(1, "héllo", 0), (2, None, 0)], "doc_id long, text string, media int"), folder)
    assert {(r.doc_id, r.n_bytes, media.from_wav(r.media)) for r in held.collect()} == {(1, 6, "héllo".encode() + bytes(58)), (2, 0, bytes(64))}


# -- mixing


def test_mixing(docs, rows, empty):
    found = mixing.mix(docs, block=64)
    got = mixing.taken(found).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    target, open_ = {}, sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(open_)}
    total = sum(sizes.values())
    while True:  # share, stop at the caps, share the excess again
        free = [s for s in open_ if s not in target]
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.taken(mixing.mix(docs, block=64)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    slots = sorted((r.slot, r.sid, r.block) for r in found.schedule.collect())
    blocks = {r.sid: r.blocks for r in found.sources.collect()}
    assert Counter(s for _, s, _ in slots) == {s: b for s, b in blocks.items() if b} and len({x[0] for x in slots}) == len(slots)
    for n in (20, 60):  # every beginning of the schedule is near the shares
        for s, b in blocks.items():
            assert abs(sum(x[1] == s for x in slots[:n]) - min(n, len(slots)) * b / len(slots)) < 6
    assert mixing.taken(mixing.mix(empty)).count() == 0
    # the mix itself: pieces in the order of the schedule, which together are the words taken
    clash = docs.withColumns({"_id": F.lit(1), "_copy": F.lit(2), "rid": F.lit(3), "slot": F.lit(4), "words": F.lit("w"), "a.b": F.lit(5)})
    mixed = mixing.mixed(clash, block=64)
    assert mixed.columns == clash.columns
    laid = mixed.collect()
    sums = Counter()
    for r in laid:
        sums[r.doc_id] += size(r.text)
        assert (r["_id"], r["_copy"], r.rid, r.slot, r.words, r["a.b"]) == (1, 2, 3, 4, "w", 5) and size(r.text) <= 64
    wanted = Counter()
    for r in got:
        wanted[r.doc_id] += r.taken
    assert sums == +wanted
    plan = sorted((p.slot, p.rid, p.epoch, p.doc_id, p.n_words) for p in found.pieces.collect())
    assert [x[4] for x in plan] and sorted((str(r.doc_id), size(r.text)) for r in laid) == sorted((str(x[3]), x[4]) for x in plan)
    named = {s: k for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    runs, at = [], 0
    while at < len(laid):  # each block's pieces stand together, in the order of its slot
        sid, left = named[laid[at].source], None
        slot, want_sid, block = slots[len(runs)]
        assert sid == want_sid
        left = sum(x[4] for x in plan if x[0] == slot)
        while left:
            assert named[laid[at].source] == sid
            left -= size(laid[at].text)
            at += 1
        runs.append(sid)
    assert len(runs) == len(slots)
    long = {r.doc_id: r for r in docs.where("doc_id = 81").collect()}[81]
    pieces = [w for r in laid if r.doc_id == 81 for w in words(r.text) if w]
    assert set(pieces) <= set(words(long.text)) and mixing.mixed(clash.limit(0)).count() == 0


# -- top-k


def test_search_prunes_and_is_exact():
    rng = np.random.default_rng(5)
    ids = np.arange(700) * 3
    near = np.repeat(rng.integers(-60, 60, (7, 6)), 100, axis=0) + rng.integers(-2, 3, (700, 6))
    for vectors, fewer in ((near, True), (rng.permutation(near), True), (rng.integers(-3, 4, (700, 6)), False), (near * 2**24, False)):
        queries = vectors[::50]
        place, score, scored = topk.search(ids, vectors, ids[::50], queries, 5, block=20)
        for q in range(len(queries)):
            exact = sorted(((-int(queries[q] @ v), int(i)) for i, v in zip(ids, vectors) if i != ids[::50][q]))[:5]
            assert [(-int(s), int(ids[p])) for s, p in zip(score[q], place[q])] == exact
        if fewer:
            assert scored < 0.5 * len(queries) * 35


def test_topk(spark):
    inf = float("inf")
    data = [(0, [0.5, 1.0]), (1, [1.0, -1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [float("nan")]), (8, []), (9, [2.0]), (None, [9.0, 9.0]), (10, [-0.001, 0.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in topk.topk(df, F.col("vec_id") % 5 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 2, 98304), (0, 2, 2, 98304), (0, 3, 3, 98304)]
    assert [g for g in got if g[0] == 10] == [(10, 1, 0, -128), (10, 2, 1, -256), (10, 3, 2, -256)] or [g[3] for g in got if g[0] == 10] == [0, -128, -256]
    assert {g[0] for g in got} == {0, 10}
    assert topk.topk(df.limit(0), F.lit(True)).count() == 0
