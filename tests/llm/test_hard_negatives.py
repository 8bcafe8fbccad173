"""op11 against brute force: ties, odd rows, several cells, windows at their edges."""

import numpy as np
import pytest

from packetlake.llm import hard_negatives as H
from packetlake.llm import queries
from tests.llm.conftest import SF001

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows):
    made = [(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows]
    return spark.createDataFrame(made, SCHEMA).selectExpr(
        "*", "0 AS vec", "0 AS row", "0 AS col", "0 AS d", "0 AS place", "0 AS anchor", "0 AS rank", "0 AS score", "0 AS kind")


def brute(rows, every=100, positives=5, negatives=10, scale=256):
    fit = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64), label) for i, v, label in rows
           if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, q, label in fit:
        if a % every:
            continue
        scored = sorted((-int(q @ v), i, other) for i, v, other in fit if i != a and len(v) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [(s, i) for s, i, other in scored if other != label and -30 * ps <= -100 * s <= -90 * ps][:negatives]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i) in enumerate(hard)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    assert found(queries.op11_hard_negatives(spark, SF001)) == brute(rows) != []


@pytest.mark.parametrize("cells", [8192, 16])
def test_ties_repeats_and_odd_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(H, "ROWS_PER_CELL", cells)
    monkeypatch.setattr(H, "ANCHORS_PER_CELL", 2)
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (90, 3)).astype(float)
    rows = [(i * 10, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(0, [3.0, 3.0, 3.0], 0), (15, [2.0, 2.0, 2.0], 0), (15, [1.0, 1.0, 1.0], 1), (15, [1.0, 1.0, 1.0], 1), (100, [1.0, 0.0], 1)]
    odd = [(1000, None, 1), (1100, [1.0, None, 1.0], 1), (1200, [float("nan")] * 3, 1), (1300, [float("inf")] * 3, 1), (1400, [], 1),
           (None, [1.0] * 3, 1), (1500, [1.0] * 3, None), (1600, [0.0] * 3, 2), (1700, [0.0] * 3, 2)]
    assert found(H.mine(table(spark, rows + odd), "vec_id % 100 = 0")) == brute(rows + odd)


def test_empty_and_lonely(spark):
    assert H.mine(table(spark, []), "vec_id % 100 = 0").count() == 0
    assert H.mine(table(spark, [(100, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)]), "vec_id % 100 = 0").count() == 0


def test_hot_label(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).astype(float).tolist(), int(i % 9 == 0)) for i in range(400)]
    assert found(H.mine(table(spark, rows), "vec_id % 100 = 0")) == brute(rows)


def test_products_are_exact():
    a = np.array([[1 << 30, -(1 << 28)], [3, 4]], np.int64)
    assert H.products(a, a).tolist() == [[int(p @ q) for q in a] for p in a]


def test_windows():
    for score in range(-7, 60):
        lo, hi = H.window(score, 30, 90)
        for s in range(-20, 70):
            assert (lo <= s <= hi) == (30 * score <= 100 * s <= 90 * score)


def test_stream_keeps_windows_only():
    """Anchors that follow each other do not share windows; a window closes at its lower end."""
    rows = [(1, 100, 90, 0, 5), (1, 100, 81, 1, 7), (1, 100, 50, 0, 6), (1, 100, 45, 1, 8), (1, 100, 20, 1, 9), (2, 200, 30, 1, 7)]
    assert list(H.give_out(iter(rows), 10, 30, 90)) == [(100, 5, 1, 7, 90, 81), (100, 5, 2, 8, 90, 45), (100, 6, 1, 8, 50, 45), (100, 6, 2, 9, 50, 20)]
