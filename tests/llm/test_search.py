"""op6 against exact products, op8's recall against brute force."""

import numpy as np
import pytest

from packetlake.llm import multi_index, queries, topk_segments
from packetlake.llm import vectors as V
from tests.llm.conftest import SF001

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 AS vec", "0 AS row", "0 AS col", "0 AS rank", "0 AS score")


def load(path):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{path}/embeddings.parquet")
    return t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)


def brute(ids, x, score, ascending, every=100, k=10):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s, rest = score(x[i], x), ids != ids[i]
        order = np.lexsort((ids[rest], s[rest] if ascending else -s[rest]))[:k]
        out += [(int(ids[i]), n + 1, int(ids[rest][j]), s[rest][j]) for n, j in enumerate(order)]
    return out


def products(q, x):
    return np.floor(x * 1024).astype(np.int64) @ np.floor(q * 1024).astype(np.int64)


def distances(q, x):
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def test_top_k_of_a_table(spark):
    got = sorted(map(tuple, queries.op6_segment_top_k(spark, SF001).collect()))
    assert got == sorted(brute(*load(SF001), products, False))


@pytest.mark.parametrize("cells", [4096, 7])
def test_top_k_ties_and_odd_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(V, "ROWS_PER_CELL", cells)
    monkeypatch.setattr(V, "QUERIES_PER_CELL", 2)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6)).astype(np.float32).astype(np.float64)
    x[10:40] = x[0]
    x[5] = 0
    ids = np.arange(0, 600, 10)
    odd = [(1000, None), (1001, [1, None, 1, 1, 1, 1]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1100, [1, 2]), (1200, []), (None, [1] * 6)]
    found = topk_segments.exact_top_k(table(spark, [*zip(ids.tolist(), x, strict=True), *odd]), "vec_id % 100 = 0")
    assert sorted(map(tuple, found.collect())) == sorted(brute(ids, x, products, False))


def test_few_or_no_rows(spark):
    for search in (topk_segments.exact_top_k, multi_index.nearest):
        assert search(table(spark, []), "vec_id % 100 = 0").count() == 0
        assert search(table(spark, [(0, [1, 2])]), "vec_id % 100 = 0").count() == 0
        rows = search(table(spark, [(0, [1, 2]), (7, [2, 1]), (3, [2, 1]), (3, [2, 1])]), "vec_id % 100 = 0").collect()
        assert [(r.query_id, r.rank, r.vec_id) for r in sorted(rows)] == [(0, 1, 3), (0, 2, 3), (0, 3, 7)]


def test_repeated_ids_and_mixed_lengths(spark, write_table):
    """Every row is a candidate; vectors of different lengths are not compared; the SQL says the same."""
    import duckdb

    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=int(d)).astype(np.float32).astype(float).tolist()) for i, d in
            zip(rng.integers(0, 210, 260), rng.choice([3, 3, 3, 5], 260), strict=True)]
    rows += [(1, [5.0] * 3), (1, [9.0] * 3), (100, [1.0] * 3), (100, [-1.0] * 3), (100, [1.0] * 5)]
    folder = write_table(embeddings=spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    got = sorted(map(tuple, queries.op6_segment_top_k(spark, folder).select("query_id", "rank", "vec_id", "score").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.ORACLES["op6_segment_top_k"]).fetchall())
    assert (100, 1, 1) in {r[:3] for r in got}
    near = [tuple(r) for r in queries.op8_multi_index_hashing(spark, folder).collect()]
    want = {}
    for q, a in rows:
        if q % 100 == 0:
            want.setdefault(q, []).extend((float(np.sqrt(((np.array(a) - b) ** 2).sum())), i) for i, b in rows if i != q and len(b) == len(a))
    want = {(q, n + 1, i) for q, found in want.items() for n, (_, i) in enumerate(sorted(found)[:10])}
    assert len({r[:3] for r in near} & want) >= 0.9 * len(want) and len(near) == len(want)


@pytest.mark.parametrize("d", [1, 5, 64])
def test_segment_bounds_hold_and_get_closer(d):
    rng = np.random.default_rng(d)
    a, b = rng.normal(size=(50, d)), rng.normal(size=(50, d))
    last = np.zeros(50)
    for s in [s for s in (1, 2, 4, 8, 16, 32, 64) if d % s == 0 and s <= d]:
        bound = ((topk_segments.segment_features(a, s) - topk_segments.segment_features(b, s)) ** 2).sum(1)
        assert (bound <= ((a - b) ** 2).sum(1) + 1e-9).all() and (bound >= last - 1e-9).all()
        last = bound


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    tables = multi_index.MultiIndex(codes)
    for radius in (0, 3, 7, 8, 11, 32):
        got = tables.within(codes[0], radius)
        assert got.tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[0]).sum(1) <= radius).tolist()


@pytest.mark.parametrize("folder", [SF001, "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    want = {(q, i): s for q, _, i, s in brute(*load(folder), distances, True)}
    got = queries.op8_multi_index_hashing(spark, folder).collect()
    hits = [(r.query_id, r.vec_id) for r in got if (r.query_id, r.vec_id) in want]
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    assert all(abs(r.score - want[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in want)


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(np.float64)
    x[100:200] = x[0]
    ids = np.arange(300)
    odd = [(1000, None), (1100, [0] * 8), (1200, [1, None] + [1] * 6), (1300, [float("nan")] * 8), (None, [1] * 8)]
    got = sorted(map(tuple, multi_index.nearest(table(spark, [*zip(ids.tolist(), x, strict=True), *odd]), "vec_id % 100 = 0").collect()))
    want = sorted(brute(ids, x, distances, True))
    assert len(got) == len(want) and len({r[:3] for r in got} & {r[:3] for r in want}) >= 0.9 * len(want)
    assert [r for r in got if r[0] == 0] == [r for r in want if r[0] == 0]
