from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import negatives

TOP = 2**62 - 1


def plainly(rows, positives=5, k=5, low=80, high=100):
    """Every window sorted whole; ``rows`` are (id, vector, label)."""
    q = []
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and None not in v and np.isfinite(v).all():
            q.append((i, [int(max(-(2**62), min(2**62, np.floor(256 * float(x))))) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = Counter()
    for a, (i, v, y) in enumerate(q):
        if i % 100:
            continue
        others = [(max(-TOP, min(TOP, sum(s * t for s, t in zip(v, w)))), j, z) for b, (j, w, z) in enumerate(q) if b != a and len(w) == len(v)]
        for ps, p, _ in sorted((x for x in others if x[2] == y), key=lambda x: (-x[0], x[1]))[:positives]:
            fits = sorted((x for x in others if x[2] != y and low * ps <= 100 * x[0] <= high * ps), key=lambda x: (-x[0], x[1]))[:k]
            out.update((i, p, r + 1, j, ps, s) for r, (s, j, _) in enumerate(fits))
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, -1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, rank int").repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return Counter(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, label, **options).collect())


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_against_sorting_every_window(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 128)
    monkeypatch.setattr(negatives, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, 8)
    v = base + spread * rng.normal(0, 1, (900, 8))
    rows = [(i, [float(x) for x in r], int(rng.integers(0, 3))) for i, r in enumerate(v)]
    assert mined(spark, rows) == plainly(rows)
    assert mined(spark, rows, positives=2, negatives=3, low=50, high=90) == plainly(rows, 2, 3, 50, 90)


def test_ties_copies_and_a_hot_label(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 0.2, (60, 4))
    # 1500 copies of few vectors, most of one label: the k-th score is shared by hundreds of rows
    rows = [(i, [float(x) for x in v[i % 5 if i % 3 else i % 60]], 1 if i % 4 else i % 10) for i in range(1500)]
    assert mined(spark, rows) == plainly(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 0.3, (300, 6))
    rows = [(i % 150, [float(x) for x in r], i % 3) for i, r in enumerate(v)]  # two rows of each id
    rows += [(0, [float(x) for x in v[0]], 0)] * 2
    rows += [(100, None, 1), (200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (300, [float("nan")] * 6, 1), (400, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1), (500, [0.1] * 6, None), (600, [], 1), (601, [], 2), (603, [], 1), (700, [1.0, 2.0], 1), (800, [-0.4] * 6, 2), (900, [0.0] * 6, 0), (1000, [1.0, 2.0], 2), (1001, [1.0, 2.1], 1), (1002, [1.0, 2.2], 2)]
    want = plainly(rows)
    assert mined(spark, rows) == want
    assert {x[0] for x in want} >= {0, 100, 600}


def test_scores_beyond_float_and_beyond_long(spark):
    big = 2.0**22
    rows = [(100, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big, 2.0], 2), (3, [big, 2.5], 2), (4, [big, 3.0], 2), (200, [2.0**70, 0.0], 3), (5, [2.0**69, 0.0], 3), (6, [2.0**60, 0.0], 4), (8, [-(2.0**60), 0.0], 4)]
    assert mined(spark, rows) == plainly(rows)


def test_empty_tables_and_windows(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])
    assert not mined(spark, [(100, [1.0], 1), (2, [1.0], 2)])
    assert not mined(spark, [(100, [1.0], 1), (3, [-1.0], 1), (2, [-1.0], 2)])
