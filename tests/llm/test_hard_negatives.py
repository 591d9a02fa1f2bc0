import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from sensorlake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    once = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            once[i] = min(once.get(i, (label, v)), (label, v))
    out = []
    for a in sorted(once):
        if a % every:
            continue
        score = {i: max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(once[a][1], v)))) for i, (_, v) in once.items()}
        order = sorted((i for i in once if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if once[i][0] == once[a][0]][:positives]:
            hits = [i for i in order if once[i][0] != once[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(hits, 1)]
    return sorted(out)


def mined(spark, rows, every, more="", **options):
    df = spark.createDataFrame(rows, SCHEMA + more)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % every == 0, **options).collect())


def test_equals_brute_force_with_ties_and_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(150)]  # a large group of equal vectors
    want = brute(rows, 10)
    assert len(want) > 500 and mined(spark, rows, 10) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", 300)
    monkeypatch.setattr(hard_negatives, "TILE", 7)
    assert mined(spark, rows, 10) == want


def test_rows_that_take_no_part_repeats_lengths_and_huge_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [2.0, 1.0], 1), (0, [9.0, 9.0], 2), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5], 2), (3, [0.9, 0.1, 5.0], 2),
            (4, [], 2), (5, [], 1), (6, None, 1), (7, [nan, 1.0], 1), (8, [inf], 1), (9, [None, 1.0], 1), (11, [1.0, 1.0], None), (None, [1.0], 1),
            (10, [1e15, 0.0], 3), (12, [0.1, -1.0], 3), (13, [0.05, 1e8], 4), (14, [3e38, 1e38], 4), (15, [-3e38, 0.0], 3), (20, [-1.0, -1.0], 5), (21, [1.0, 0.0], 5), (22, [0.0, 0.0], 6)]
    padded = [(i, None if v is None else v + [0.0] * (3 - len(v)), label) for i, v, label in rows]
    want = brute(padded, 10)
    assert {0, 10} <= {r[0] for r in want} and mined(spark, rows, 10) == want


def test_empty_table_other_columns_and_bounds(spark):
    assert mined(spark, [], 10) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]
    clash = [(*r, 7, "x", 1.5) for r in rows]
    assert mined(spark, clash, 10, ", id long, v string, score double") == mined(spark, rows, 10) == [(0, 1, 1, 2, 65536, 32768)]
    with pytest.raises(ValueError):
        mined(spark, rows, 10, high=101)
