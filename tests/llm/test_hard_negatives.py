"""Radix selection against sorting all rows of each window."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from skylark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def plain(table, positives=5, negatives=10, low=30, high=90):
    """table: (id, vector, label); rows are told apart by their place."""
    rows = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in table if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s, k: (-s, rows[k][0] is None, rows[k][0] or 0)
    out = []
    for a, (i, v, c) in enumerate(rows):
        if i is None or i % 100:
            continue
        score = [sum(x * y for x, y in zip(v, w)) for _, w, _ in rows]
        near = sorted((k for k in range(len(rows)) if k != a and rows[k][2] == c), key=lambda k: order(score[k], k))[:positives]
        for p in near:
            fits = [k for k in range(len(rows)) if rows[k][2] != c and low * score[p] <= 100 * score[k] <= high * score[p]]
            for rank, k in enumerate(sorted(fits, key=lambda k: order(score[k], k))[:negatives], 1):
                out.append((i, rows[p][0], rank, rows[k][0], score[p], score[k]))
    return Counter(out)


def run(spark, table, **options):
    df = spark.createDataFrame([(*r, "clash") for r in table], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_ties_nulls_repeats_and_blocks(spark, monkeypatch):
    rng = random.Random(4)
    common = [0.5, 0.25, -0.125, 0.75]
    table = [(i, [rng.uniform(-1, 1) for _ in range(4)], rng.randrange(4)) for i in range(260)]
    table += [(300 + i, common, i % 3) for i in range(150)]  # one very common vector
    table += [(-7, common, 1), (None, common, 2), (None, common, 2), (2**62, common, 2), (-(2**62), common, 1)]
    table += [(500, None, 1), (501, common, None), (600, [1.0, None, 0.0, 0.0], 1), (700, [math.inf, 0.0, 0.0, 0.0], 1), (800, [math.nan] * 4, 2)]
    table += [(900, [], 1), (901, [0.5], 1), (902, [0.5, 0.5, 0.5, 0.5, 0.5], 2), (100, table[100][1], table[100][2]), (400, common, 1)]
    monkeypatch.setattr(hard_negatives, "DIGIT", 256)
    monkeypatch.setattr(hard_negatives, "TILE", 2)
    assert run(spark, table) == plain(table)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1500)
    assert run(spark, table, positives=2, negatives=3) == plain(table, 2, 3)


def test_great_components_and_empty_tables(spark):
    table = [(0, [1e6, 2e6], 1), (1, [3e6, 1e6], 1), (2, [1e6, 1e6], 2), (3, [5e5, 5e5], 2)]
    assert run(spark, table) == plain(table)
    assert sum(run(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [1e20], 2)]).values()) == 0
    assert run(spark, []) == Counter() and run(spark, [(1, [1.0], 1)]) == Counter() and run(spark, [(100, [1.0], 1)]) == Counter()


def test_great_scores_stay_exact(spark):
    table = [(0, [2.0**20, 3.0], 1), (1, [2.0**20, 1.0], 1), (2, [2.0**20, 2.0], 1), *[(i, [2.0**19, i / 256], 2) for i in range(3, 30)]]
    assert run(spark, table) == plain(table)
