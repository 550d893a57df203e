import re
from collections import Counter

import corpus_pipeline as p

D = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^ \t\n\v\f\r]+", t or "")


def sets(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    frames = [docs]
    for i, (_, f) in enumerate(p.STAGES):
        f(spark, frames[-1], D).write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
    rows = [{r["doc_id"]: r["text"] for r in x.collect()} for x in frames[:5]]
    assert all(x.columns == docs.columns for x in frames[1:5])

    judged = [(i, labels[i]) for i in rows[0] if i in labels]
    assert sum((i in rows[1]) == bool(y) for i, y in judged) >= 0.97 * len(judged)

    s = {i: sets(t) for i, t in rows[1].items()}
    ids, root = sorted(s), {i: i for i in s}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert set(rows[2]) == {i for i in ids if top(i) == i}

    flat = lambda t: " ".join(re.sub(r"[^\w\s]", "", t.lower()).split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert set(rows[3]) == {i for i, t in rows[2].items() if not any(x in flat(t) for x in items)}

    taken = Counter(r["doc_id"] for r in frames[4].collect())
    size = {i: len(words(t)) for i, t in rows[3].items()}
    assert max(taken.values()) <= 2
    total, got = sum(size.values()), sum(n * size[i] for i, n in taken.items())
    assert 1.5 * total - max(size.values()) <= got <= 1.5 * total

    index = frames[5].collect()
    assert sorted(r["slot"] for r in index) == list(range(len(index)))
    assert len(index) > 0
