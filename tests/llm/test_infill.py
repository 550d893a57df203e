import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import infill


def plainly(doc_id, text):
    t = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    pre, mid, suf = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_runs_find_every_offset(texts):
    whole = "".join(texts)
    data = whole.encode()
    runs = infill.ClassRuns(np.frombuffer(data, np.uint8))
    want = [len(whole[:k].encode()) for k in range(len(whole) + 1)]
    assert runs.byte_of(np.arange(len(whole) + 1)).tolist() == want
    assert runs.unit_of(np.array(want)).tolist() == list(range(len(whole) + 1))
    # runs are maximal
    assert all(x != y for x, y in zip(runs.kinds, runs.kinds[1:]))


def test_against_plain_slicing(spark):
    rng = np.random.default_rng(3)
    pieces = ["abc ", "é", "日本", "🙂🙂", "\n\t", "<P", "S>", "<", "ß", "\x00", "́"]
    rows = [(i, "".join(pieces[k] for k in rng.integers(0, len(pieces), int(rng.integers(0, 60))))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "has <M> in it"), (None, "no id"), (503, "日" * 3_000_000 + "end"), (7, "again"), (7, "again"), (504, "x")]
    df = spark.createDataFrame([(i, t, "en", -1, "mine") for i, t in rows], "doc_id long, text string, lang string, n int, output string")
    got = infill.fill_in_middle(df.repartition(3)).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((str(i), *map(str, plainly(i, t))) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["n"]), r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in got) == want
    assert all(r["back"] == (r["text"] or "") and r["lang"] == "en" for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_slices_bound_what_is_encoded_together(spark, monkeypatch):
    assert list(infill._slices(np.array([3 << 20, 2 << 20, 1, 9 << 20, 0, 1]))) == [(0, 1), (1, 3), (3, 4), (4, 6)]
    assert list(infill._slices(np.array([], np.int64))) == []


@pytest.mark.parametrize("marks", [("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>"), ("[a]", "[b]", "[c]")])
def test_other_sentinels_and_rates(spark, marks):
    df = spark.createDataFrame([(i, f"text number {i} é") for i in range(50)], "doc_id long, text string")
    got = infill.fill_in_middle(df, rate=100, swapped=50, seed="x", sentinels=marks).withColumn("back", infill.restore(F.col("output"), F.col("form"), marks)).collect()
    assert all(r["back"] == r["text"] and all(m in r["output"] for m in marks) for r in got)
    assert {r["form"] for r in got} == {"psm", "spm"}


def test_empty_table(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
