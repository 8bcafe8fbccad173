"""P1–P16, L1–L3, U1, D1, A1 and V1–V3 on the fixture table at sf0.01."""

import pytest
from pyspark.sql import functions as F

from packetlake.operators import query as Q
from packetlake.operators.verify import FilterSetting, verify_filter
from packetlake.schema import TARGET_COLS
from tests.conftest import SF01

# The documented corpus with the row counts after cursor 100 (FIXTURES §2).
CORPUS = [
    ("dst_port IN (80, 443)", 5656),
    ("src_ip != '127.0.0.1' AND dst_ip != '127.0.0.1' AND src_ip != '::1'", 8999),
    ("src_ip LIKE '192.168.1.%'", 2605),
    ("pname = 'python' OR pname LIKE 'chrome%'", 1980),
    ("dst_port != 53 AND pname != 'mDNSResponder'", 6787),
    ("is_binary = false AND (payload_utf8 LIKE '%password%' OR payload_utf8 LIKE '%token%')", 1653),
    ("is_binary = false AND payload_utf8 LIKE 'GET %'", 1633),
    ("is_binary = false AND payload_utf8 LIKE '%example.com%'", 1651),
    ("is_binary = false AND payload_utf8 LIKE '{%}'", 1633),
    ("(src_ip = '192.168.1.5' OR dst_port = 3306) AND length < 1000", 1297),
    ("lower(pname) = 'curl'", 1979),
    ("SELECT * FROM packets WHERE pname = 'curl' UNION SELECT * FROM packets WHERE pname = 'wget'", 3959),
]


def _plan(spark, df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def _source(spark):
    from packetlake.sources import fixtures
    return lambda s: fixtures.packets(s, SF01)


@pytest.mark.parametrize("text,rows", CORPUS)
def test_corpus(spark, packets01, text, rows):
    src = packets01 if not Q.is_full_select(text) else _source(spark)
    df = Q.customized(src, text, 100, base=spark)
    assert df.columns == TARGET_COLS
    out = df.collect()
    assert len(out) == rows
    idx = [r["index"] for r in out]
    assert idx == sorted(idx) and min(idx) > 100


def test_cursor_none_and_zero(packets01):
    assert Q.since_index_no_payload(packets01, None).first()["index"] == 0
    assert Q.since_index_no_payload(packets01, 0).first()["index"] == 1


def test_full_select_trailing_semicolon_and_12_column_contract(spark):
    df = Q.customized(_source(spark), "  SELECT * FROM packets WHERE index < 5 ;  ; ", None, base=spark)
    assert [r["index"] for r in df.collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception):
        Q.customized(_source(spark), "SELECT pname, count(*) AS n FROM packets GROUP BY pname", 0, base=spark)


def test_with_and_parenthesised(spark, packets01):
    a = Q.customized(_source(spark), "WITH x AS (SELECT * FROM packets) SELECT * FROM x WHERE index < 3", None,
                     base=spark)
    assert a.count() == 3
    b = Q.customized(packets01, "(index < 3) OR (index = 7)", None, base=spark)
    assert [r["index"] for r in b.collect()] == [0, 1, 2, 7]
    c = Q.customized(_source(spark), "(SELECT * FROM packets WHERE index < 2)", None, base=spark)
    assert c.count() == 2


def test_double_quoted_identifier_in_full_sql(spark):
    df = Q.customized(_source(spark), 'SELECT * FROM packets WHERE "pname" = \'curl\'', 100, base=spark)
    assert df.count() == 1979


def test_lookup(packets01):
    row = Q.packet_by_index(packets01, 987).collect()
    assert len(row) == 1 and row[0]["is_binary"] and len(row[0]["payload_binary"]) == 18
    assert Q.packet_by_index(packets01, 10**9).count() == 0


def test_lookup_pushes_filter_to_scan(spark, tmp_path):
    from packetlake.sources import fixtures
    path = str(tmp_path / "p")
    fixtures.packets(spark, SF01).write.parquet(path)
    df = Q.packet_by_index(spark.read.parquet(path), 42)
    plan = _plan(spark, df)
    assert "PushedFilters: [IsNotNull(index), EqualTo(index,42)]" in plan


def test_lookup_many(spark, packets01):
    ids = spark.createDataFrame([(1,), (5,), (5,), (10**9,)], "index bigint")
    assert sorted(r["index"] for r in Q.lookup_many(packets01, ids).collect()) == [1, 5]


def test_offset(packets01):
    out = Q.offset(packets01.filter("pname = 'wget'"), 3).select("index").collect()
    assert [r["index"] for r in out][:2] == [16, 21]


def test_union_by_index_equals_union(spark, packets01):
    a = Q.union_by_index(packets01, ["pname = 'curl'", "pname = 'wget'"], 100)
    b = Q.customized(_source(spark), CORPUS[-1][0], 100, base=spark)
    assert a.count() == 3959
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_delivered_count(packets01):
    assert Q.delivered_count(Q.customized(packets01, "dst_port IN (80, 443)", 100)).first()[0] == 5656


@pytest.mark.parametrize("bad", [
    "pname = 'curl' ORDER BY timestamp DESC",
    "1=1) OR (1=1",
    "no_such_column = 1",
    "SELECT pname FROM packets",
    "SELECT index, timestamp, uuid, src_ip, src_port, dst_ip, dst_port, pid, pname, 1 AS type, length, "
    "is_binary FROM packets",
])
def test_refusals(spark, bad):
    assert verify_filter(spark, bad) is not None


@pytest.mark.parametrize("good", ["", "   ", "dst_port = 80", "dst_port = '80'",
                                  "SELECT * FROM packets WHERE pname = 'curl' UNION SELECT * FROM packets"])
def test_accepted(spark, good):
    assert verify_filter(spark, good) is None


def test_verify_only_on_change(spark):
    s = FilterSetting(spark, "dst_port = 80")
    s.set("dst_port = 80")
    assert s.checks == 1
    with pytest.raises(ValueError):
        s.set("nope nope")
    assert s.text == "dst_port = 80"


def test_condition_is_pushed_into_scan(spark, tmp_path):
    from packetlake.sources import fixtures
    path = str(tmp_path / "p")
    fixtures.packets(spark, SF01).write.parquet(path)
    df = Q.condition_filter(spark.read.parquet(path), "dst_port IN (80, 443) AND pname LIKE 'chrome%'", 100)
    plan = _plan(spark, df)
    assert "StartsWith(pname,chrome)" in plan and "GreaterThan(index,100)" in plan
    assert "payload_binary" not in plan.split("ReadSchema:")[1].split("\n")[0]


@pytest.mark.parametrize("sql,local", [
    ("SELECT * FROM packets WHERE pname = 'curl' UNION SELECT * FROM packets WHERE pname = 'wget'", True),
    ("WITH big AS (SELECT * FROM packets WHERE length >= 1000) SELECT * FROM big WHERE pname <> 'curl'", True),
    ("SELECT * FROM (SELECT * FROM packets WHERE dst_port = 443) AS t WHERE pname = 'wget'", True),
    ("SELECT * FROM packets WHERE index < 3 LIMIT 3", False),
    ("SELECT * FROM packets WHERE index = (SELECT max(index) FROM packets)", False),
    ("SELECT p.* FROM packets p JOIN packets q ON p.index = q.index + 1", False),
    ("SELECT * FROM packets EXCEPT SELECT * FROM packets WHERE pname = 'curl'", False),
    ("dst_port = 80", False),
])
def test_row_local_full_sql(spark, sql, local):
    from packetlake.operators.verify import full_sql_is_row_local
    assert full_sql_is_row_local(spark, sql) is local


def test_double_quotes_name_columns_in_conditions_too(spark):
    from packetlake.sources import fixtures
    df = Q.customized(lambda s: fixtures.packets_table(s, SF01), '"pname" = \'curl\'', 100, base=spark)
    assert df.count() == 1979


def test_condition_with_subquery_reads_packets(spark):
    from packetlake.sources import fixtures
    cond = "index IN (SELECT max(index) FROM packets WHERE pname = 'wget')"
    assert verify_filter(spark, cond) is None
    out = Q.customized(lambda s: fixtures.packets_table(s, SF01), cond, 100, base=spark).collect()
    assert [r["index"] for r in out] == [9996]


@pytest.mark.parametrize("cond,local", [
    ("", True),
    ("payload_utf8 LIKE '%select%'", True),
    ("dst_port IN (80, 443) AND pname = 'curl'", True),
    ("index = (SELECT max(index) FROM packets)", False),
    ("index IN (SELECT index FROM packets WHERE pname = 'curl')", False),
])
def test_row_local_conditions(spark, cond, local):
    from packetlake.operators.verify import filter_is_row_local
    assert filter_is_row_local(spark, cond) is local


def test_one_rule_for_names_and_backslashes(spark):
    """The answer does not depend on the kind of source, and the caller's own view stays."""
    rows = [(i, t, False, text) for i, t, text in ((0, "curl", "C:\\temp"), (1, "wget", "C:\temp"), (2, "it's", ""))]
    given = spark.createDataFrame(rows, "index bigint, pname string, is_binary boolean, payload_utf8 string")
    from packetlake.schema import PACKET_SCHEMA
    packets = given.select(*[F.col(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name)
                             for f in PACKET_SCHEMA.fields])
    spark.range(7).createOrReplaceTempView("packets")
    asked = {'"pname" = \'curl\'': [0], "payload_utf8 = 'C:\\temp'": [0], "payload_utf8 LIKE '%C:\\\\temp%'": [0], "pname = 'it''s'": [2],
             "index IN (SELECT max(index) FROM packets)": [2], 'SELECT * FROM packets WHERE "pname" = \'wget\'': [1]}
    for text, expected in asked.items():
        for source in (packets, lambda s: s.createDataFrame(packets.collect(), packets.schema)):
            assert [r["index"] for r in Q.customized(source, text, base=spark).collect()] == expected, text
    assert spark.table("packets").count() == 7
    spark.catalog.dropTempView("packets")
