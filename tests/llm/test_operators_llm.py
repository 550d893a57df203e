import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import decontaminate, kdtree, minhash, mixing, quality, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


def docs(spark, rows):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, 1, -5, -5.0) for i, t, s in rows], DOCS)


def text(rng, n, words=300):
    return " ".join(f"w{rng.integers(0, words)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(0)
    long = text(rng, 60_000, 5000)
    rows = [(1, None, "a"), (2, "", None), (3, "  \n\t ", "a"), (4, "One", "b"), (5, "one", "b"), (6, long, "a"), (7, long + " more", "c"), (None, "x y z", "a"), (8, "a b c d", "a"), (8, "a b c d", "a"), (9, "A b C d", None)]
    return docs(spark, rows)


# --- 10


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk_against_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.2, (700, 16)) * np.exp(spread * rng.normal(0, 1, (700, 1)))
    v[100:140] = v[7]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (950, [1.0, None] + [0.0] * 14), (1000, [float("nan")] * 16), (1050, [0.0] * 16), (1100, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    q = {i: np.floor(256 * np.array(r)).astype(np.int64) for i, r in rows if r is not None and None not in r and np.isfinite(r).all()}
    want = set()
    for i in (i for i in q if i % 50 == 0):
        s = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
        want |= {(i, k + 1, j, -x) for k, (x, j) in enumerate(s)}
    assert {tuple(r) for r in got} == want


def test_topk_of_repeated_ids_and_unit_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (400, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i % 130, [float(x) for x in r]) for i, r in enumerate(v)] + [(50, [float(x) for x in v[50]])] * 3  # three ids of four rows, and equal rows
    got = Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0).collect())
    q = [np.floor(256 * np.array(r)).astype(np.int64) for _, r in rows]
    want = Counter()
    for a, (i, _) in enumerate(rows):
        if i % 50 == 0:
            s = sorted((-int(q[a] @ q[b]), j) for b, (j, _) in enumerate(rows) if b != a)[:5]
            want.update((i, k + 1, j, -x) for k, (x, j) in enumerate(s))
    assert got == want


def test_topk_exact_beyond_float(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**22, 3.0]), (2, [2.0**45, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 2).collect()
    assert {r["vec_id"]: r["score"] for r in got} == {1: 2**60 + 3 * 2**16, 2: 2**63 - 1}


def test_topk_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


# --- 2


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^ \t\n\v\f\r]+", t or "")]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_minhash_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, at = [], 0
    for _ in range(40):
        base = text(rng, int(rng.integers(5, 150))).split()
        for _ in range(int(rng.integers(1, 6))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"new{rng.integers(0, 9)}"
            rows.append((at, " ".join(w)))
            at += 1
    group = text(rng, 200).split()  # a large group of near copies
    for k in range(150):
        w = list(group)
        w[k % 200] = f"changed{k}"
        rows.append((at + k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_minhash_true_pairs_in_a_family_below_the_threshold(spark):
    rng = np.random.default_rng(11)
    passage, rows = text(rng, 180, 5000).split(), []
    for k in range(400):  # siblings are 0.82 alike, and every 20th has a near copy that is 0.88 like it
        own = [f"own{k}n{i}" for i in range(20)]
        rows.append((k, " ".join(passage + own)))
        if k % 20 == 0:
            rows.append((1000 + k, " ".join(passage + own[:-13] + [f"other{k}n{i}" for i in range(13)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 85).collect()}
    want = brute_components(rows, 3, 85)
    assert sum(i != c for i, (_, c) in want.items()) == 20
    assert got == want


def test_minhash_of_ids_that_do_not_tell_texts_apart(spark):
    rng = np.random.default_rng(12)
    a, b, c = (text(rng, 80, 5000) for _ in range(3))
    rows = [(7, a), (7, b), (3, b + " end"), (9, a + " end"), (None, c), (None, c + " end"), (7, a), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df, 3, 85).collect())
    assert got == [(False, 3, 79, 3, True), (False, 7, 78, 3, False), (False, 7, 78, 7, True), (False, 7, 78, 7, True), (False, 9, 79, 7, False), (False, 12, 0, 12, True), (True, 0, 78, 0, False), (True, 0, 79, 0, False)]
    left = [(r["doc_id"], r["text"][:9]) for r in minhash.deduplicated(df, 3, 85).collect()]
    assert Counter(left)[7, a[:9]] == 1
    assert {x for x, _ in left} == {3, 7, None, 12}
    assert len(left) == 4


def test_minhash_edges(spark, odd):
    got = minhash.near_duplicates(odd, 3, 85).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 11
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4, 8)] == [0, 0, 0, 1, 2]
    assert all(by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3, 4, 6, 8))
    assert by[5]["component_id"] == 4
    assert by[7]["component_id"] == 6
    assert by[9]["component_id"] == 8
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


# --- 3


def test_decontamination_finds_copies_and_new_numbers(spark):
    item = "A train leaves Boston at 30 km per hour and reaches the river after 4 hours while Maria waits at the old station with 12 apples in her bag"
    other = item.replace("30", "55").replace("Maria", "Peter").replace("4 hours", "9 hours")
    broken = "A train leaves Boston at 30 km per hour and reaches the river after 4 hours. Nothing else here is like the item at all, it goes on about other things."
    rng = np.random.default_rng(1)
    rows = [(1, text(rng, 50) + " " + item + " " + text(rng, 50), "a"), (2, "intro " + other, "a"), (3, broken, "a"), (4, text(rng, 200), "a"), (5, None, "a"), (6, "", "a")]
    items = spark.createDataFrame([(10, item, "x"), (11, "too short", "x"), (12, None, "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in decontaminate.leaks(docs(spark, rows), items).collect()}
    assert got == {(1, 10): False, (2, 10): True}
    assert decontaminate.leaks(docs(spark, rows).limit(0), items).count() == 0
    assert decontaminate.leaks(docs(spark, rows), items.limit(0)).count() == 0


def test_decontamination_of_short_and_dense_items_and_long_runs(spark):
    rng = np.random.default_rng(6)
    long = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(1000))
    items = [(1, "What is 12 + 5?"), (2, "3 7 11 19 23 31 43 47 59 61 73 88"), (3, long), (4, "?!"), (5, "Name the red planet.")]
    part = " ".join(long.split()[300:700])
    rows = [(1, "They ask: what is 12 + 5? Nobody knows.", "a"), (2, "they ask what is 12 - 5, or 12 + 6", "a"), (3, "rows 3 7 11 19 23 31 43 47 59 61 73 88 end", "a"), (4, "rows 3 8 11 20 23 32 43 48 59 62 73 89 end", "a"), (5, "intro " + part, "a"), (6, " ".join(long.split()[300:320]), "a"), (7, "Please name the red planet, now!", "a"), (8, "name the blue planet", "a")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (7, 5)}


def test_inconsistent_values_do_not_count(spark):
    item = "there were 5 red birds on the wall and then all 5 red birds flew off to the 5 red trees by the lake near the mill"
    bad = "there were 5 red birds on the wall and then all 6 red birds flew off to the 7 red trees by the lake near the mill"
    got = {r["doc_id"]: r["matched"] for r in decontaminate.leaks(docs(spark, [(1, item, "a"), (2, bad, "a")]), spark.createDataFrame([(1, item)], "item_id long, text string"), share=0.0).collect()}
    assert got[2] < got[1]


def test_decontamination_of_names_that_open_sentences_and_of_several_copies(spark):
    item = "Tom has 5 apples in a small basket near the door. Tom gives 2 of the apples to his friend Mary-Ann at school. O'Brien then asks how many apples are left in the basket."
    one = item.replace("Tom", "Anna").replace("Mary-Ann", "Jean-Luc").replace("O'Brien", "McDonald").replace("5", "7")
    two = item.replace("Tom", "Karl").replace("Mary-Ann", "Lisa").replace("O'Brien", "Smith").replace("5", "9").replace("2", "4")
    mixed = item.replace("Tom", "Anna", 1)
    rows = [(1, one, "a"), (2, f'He said: "{one}" And then: {two}', "a"), (3, one.replace("Anna", "\ue001Anna"), "a"), (4, mixed, "a"), (5, "Tom has nothing. Nobody gives apples.", "a")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["changed"], r["matched"], r["windows"]) for r in decontaminate.leaks(docs(spark, rows), items).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert all(got[i][0] for i in (1, 2, 3))
    assert all(got[i][1] == got[i][2] for i in (1, 2, 3))
    assert got[4][1] < got[4][2]


# --- 4


def test_warc_any_split_gives_every_record_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, f"http://x/{i} y\n", text(rng, int(rng.integers(1, 400)))) for i in range(60)] + [(60, None, None), (61, "u", ""), (62, "u", "same"), (63, "u", "same"), (64, "u", "<p>" + "x" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write(df, path)
    seen = []
    for size in (997, 20_000, 1 << 25):
        got = warc.read(spark, path, size).collect()
        seen.append(sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in got))
        texts = {r["page_id"]: bytes(r["payload"] or b"") for r in got if r["record_type"] == "response"}
    assert seen[0] == seen[1] == seen[2]
    assert len(seen[0]) == 65
    want = {i: (t or "").encode() for i, _, t in rows}
    assert all(texts[i] == want[i] for i in texts)
    assert {r[0]: r[3:] for r in seen[0]}[62] == ("revisit", 63)
    assert {r[0]: r[3:] for r in seen[0]}[60] == ("revisit", 61)
    assert all(r[2] == warc.digest(want[r[0]]) and r[1] == len(want[r[0]]) for r in seen[0])
    warc.write(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_large_member_keeps_its_end():
    import gzip

    body = bytes(1 << 24)
    line = warc.line_of(warc.record(1, "u", body, "S", len(body), None, "d")) + b"\0"
    assert warc.parse(gzip.decompress(line))["block"] == body

    class Source:
        size = len(line)

        def at(self, pos, n):
            return line[pos : pos + n]

    assert [p for p, _ in warc.members(Source(), 0, len(line))] == [0]


# --- 5 and 9


def test_scores_hold_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    for run, label, least in ((quality.op9_quality, "quality", 0.98), (toxicity.op5_toxicity, "toxic", 0.95)):
        got = run(spark, d).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
        assert got >= least


def test_index_finds_the_nearest_exactly():
    rng = np.random.default_rng(7)
    vocabulary = np.arange(60)
    ex = []
    for i in range(3000):
        at = np.sort(rng.choice(60, int(rng.integers(0, 7)), False))
        ex.append((i, int(rng.random() < (0.9 if 3 in at else 0.1)), at, rng.integers(1, 4, len(at))))
    x = toxicity.Index(vocabulary, ex, 9)
    where = {i: k for k, i in enumerate(x.ids)}
    dense, label = np.zeros((3000, 60)), np.zeros(3000)
    for i, y, at, c in ex:
        dense[where[i], at] = x.weights(at, c)
        label[where[i]] = y
    votes = []
    for k in range(60):
        at, c = ex[k][2], ex[k][3]
        cos = dense @ (dense[where[k]] if len(at) else np.zeros(60))
        best = np.lexsort((np.arange(3000), -np.round(cos, 12)))[:9]
        best = best[cos[best] > 0]
        i, got = x.nearest(at, c)
        assert np.allclose(got, cos[best])
        if len(at):
            w = cos[best]
            share = (w @ label[i] + 0.2 * label.mean()) / (w.sum() + 0.2)
            score, evidence = x.vote(at, c)
            assert abs(score - np.interp(share, *x.knots)) < 1e-9
            assert evidence == [x.ids[j] for j in i[:5]]
            votes.append((share, score))
    votes.sort()
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(votes, votes[1:], strict=False))


def test_calibrated_scores_are_rates():
    rng = np.random.default_rng(3)
    x = rng.random(20_000)
    y = (rng.random(20_000) < x**2).astype(float)
    at, rate = toxicity.monotone(x, y)
    for v in (0.1, 0.3, 0.5, 0.7, 0.9):
        assert abs(np.interp(v, at, rate) - v**2) < 0.05


def test_quality_votes_against_plain_loops():
    rng = np.random.default_rng(8)
    x = np.maximum(rng.normal(0, 1, (500, quality.FEATURES)), 0).astype(np.float32)
    x[40:60] = x[7]  # ties
    y = (rng.random(500) < 0.4).astype(float)
    m = quality.fit(x[:300], y[:300], 16)
    got = m.scores(x)
    assert len({*got[40:60], got[7]}) == 1
    for i in range(0, 500, 7):
        a = (x[i] * m.idf).astype(np.float32) @ m.basis
        cos = np.round(m.vectors @ (a / np.linalg.norm(a)), 4)
        assert np.abs(m.cosines(x[i : i + 1])[0] - cos).max() < 2e-4
        cos = m.cosines(x[i : i + 1])[0]
        last = sorted(cos)[-m.voters]
        more, same = [j for j in range(300) if cos[j] > last], [j for j in range(300) if cos[j] == last]
        w = {j: max(float(cos[j]), 0.0) ** 8 for j in more} | {j: max(float(last), 0.0) ** 8 * (m.voters - len(more)) / len(same) for j in same}
        want = (sum(w[j] * y[j] for j in w) + 0.1 * m.base) / (sum(w.values()) + 0.1)
        assert abs(got[i] - want) < 1e-6


def test_scores_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0, "x"), (6, 0, 1, "x"), (6, 0, 1, "x"), (7, None, None, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for lab in (labels, labels.limit(0)):
        a = quality.score(odd, lab).collect()
        b = toxicity.score(odd, toxicity.fit(odd, lab)).collect()
        for rows in (a, b):
            assert len(rows) == 11
            assert all(0 <= r["score"] <= 1 for r in rows)
        same = [r["score"] for r in a if r["doc_id"] in (1, 2, 3)]
        assert len(set(same)) == 1
    kept = quality.score(odd, labels, keep=True)
    assert kept.columns == odd.columns
    assert quality.score(odd.limit(0), labels).count() == 0


# --- 7 and 8


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, text(rng, int(rng.integers(1, 80))), ["hot", "hot", "cold", "tiny", None][min(4, int(rng.integers(0, 60)) // 12)] if i % 40 else "rare") for i in range(1500)]
    got = mixing.schedule(docs(spark, rows)).groupBy("source").agg(F.first("source_size").alias("size"), F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    total = sum(r["size"] for r in got)
    assert sum(r["target"] for r in got) == pytest.approx(1.5 * total)
    for r in got:
        assert r["target"] <= 2 * r["size"] + 1e-6
        assert abs(r["taken"] - r["target"]) <= 160
    mixed = mixing.mix(docs(spark, rows).drop("size"))
    assert mixed.count() == mixing.schedule(docs(spark, rows)).agg(F.sum("copies")).first()[0]


def test_mix_edges(spark, odd):
    got = mixing.schedule(odd.drop("size"))
    rows = got.collect()
    assert len(rows) == 11
    assert all(0 <= r["copies"] <= 2 for r in rows)
    assert all(r["copies"] == 0 for r in rows if not (r["text"] or "").strip())
    assert mixing.schedule(odd.limit(0)).count() == 0
    assert mixing.schedule(docs(spark, [(1, None, "a")])).first()["copies"] == 0


def test_mix_of_repeated_ids_agrees_on_reruns(spark):
    rng = np.random.default_rng(13)
    rows = [(None if i % 3 else 5, text(rng, int(rng.integers(1, 40))), "a" if i % 2 else "b") for i in range(600)]
    runs = []
    for n in (1, 7):
        got = mixing.schedule(docs(spark, rows).drop("size").repartition(n)).select("doc_id", "text", "source", "copies").collect()
        runs.append(Counter(tuple(r) for r in got))
    assert runs[0] == runs[1]
    clash = docs(spark, rows).selectExpr("*", "1 as _h", "2 as _src", "3 as _b", "4 as _id")
    assert mixing.schedule(clash).select("_h", "_src", "_b", "_id").distinct().collect() == [(1, 2, 3, 4)]


def test_shards_of_repeated_and_null_ids_are_even(spark):
    d = docs(spark, [(None if i % 2 else 7, "same text", "s") for i in range(20_000)])
    size = np.bincount([r["shard"] for r in kdtree.shard(d, 8).collect()], minlength=8)
    assert size.max() - size.min() <= 1
    named = kdtree.shard(d.withColumn("id", F.lit(1)), 4, dimensions={"id": F.length("text").cast("double"), "h": F.lit(0.0), "node": F.lit(1.0)})
    assert sorted(r["count"] for r in named.groupBy("shard").count().collect()) == [5000] * 4


def test_shards_are_even_and_gapless(spark, odd):
    rng = np.random.default_rng(8)
    d = docs(spark, [(i, "same" if i % 3 == 0 else text(rng, int(rng.integers(1, 60))), "s") for i in range(3000)])
    for n in (1, 3, 8):
        rows = kdtree.shard(d, n).collect()
        size = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], n)
        assert size.max() - size.min() <= 800
        for k in range(n):
            assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    rows = kdtree.shard(odd.drop("size"), 4).collect()
    assert len(rows) == 11
    assert {r["doc_id"]: r["text_crc32"] for r in rows}[1] == 0
    assert kdtree.shard(odd.limit(0), 8).count() == 0
    assert kdtree.shard(d, target_bytes=10**9).select("shard").distinct().count() == 1
