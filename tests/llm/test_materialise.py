import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import materialise as m


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 1\n\t.é'!  ", max_size=40))
def test_cached_words_give_the_tokenizers_own_tokens(text):
    t = m.Tokenizer.of(m.VOCABULARY)
    assert t(text) == t.plain(text)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_permutes(n):
    got = m.feistel(np.arange(n), n, 7)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != m.feistel(np.arange(n), n, 8)).any()


def test_round_trip(spark, tmp_path):
    texts = ["one two  three", None, "", "x " * 900, "same", "same"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, slot string").repartition(3)
    uri = f"file://{tmp_path}/out"
    index = m.materialise_order(df, uri, length=16, shard_bytes=16 * 2 * 5, key=3).orderBy("slot").collect()
    n = len(index)
    assert [r["slot"] for r in index] == list(range(n))
    assert [r["slot"] for r in sorted(index, key=lambda r: r["seq"])] == m.feistel(np.arange(n), n, 3).tolist()
    rows = m.read_slots(uri, 0, n)
    assert (m.read_slots(uri, 7, 6) == rows[7:13]).all()
    assert len(m.read_slots(uri, n - 2, 9)) == 2
    by_seq = sorted(index, key=lambda r: r["seq"])
    stream = np.concatenate([rows[r["slot"]][: r["n_tokens"]] for r in by_seq])
    assert all(r["n_tokens"] == 16 for r in by_seq[:-1])
    t = m.Tokenizer.of(m.VOCABULARY)
    docs = sorted("".join(map(chr, d)) for d in np.split(stream, np.flatnonzero(stream == m.END) + 1)[:-1])
    want = sorted("".join(map(chr, np.append(np.frombuffer(t.plain(x or ""), "<u2"), m.END))) for x in texts)
    assert docs == want


def test_order_does_not_depend_on_splits(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(0, 60))))) for i in range(900)]
    for k in range(3):  # several row groups a file, so that small splits cut files
        spark.createDataFrame(rows[300 * k : 300 * k + 300], "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/in/{k}")
    old, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    for size in ("128m", "6k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        seen.append([tuple(r) for r in m.materialise_order(df, f"file://{tmp_path}/{size}", length=32, shard_bytes=32 * 2 * 7).orderBy("slot").collect()])
        seen.append(m.read_slots(f"file://{tmp_path}/{size}", 0, 10**6).tobytes())
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[2]
    assert seen[1] == seen[3]
    assert len(seen[0]) > 100


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.materialise_order(df, f"file://{tmp_path}/e").count() == 0
