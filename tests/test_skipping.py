"""The trigram index and the zone map: which files are read, and that no row is lost."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packetlake.operators import skipping as S
from packetlake.operators.query import since_index_no_payload
from packetlake.plans import catalog
from packetlake.schema import PACKET_SCHEMA
from packetlake.sources import fixtures
from tests.conftest import SF001

WORDS = ["password=abc", "token: xyz\nnext line", "plain é text 𝄞 here", "", "ab", "{\"k\": 1}", "100%_sure", "back\\slash", "{}"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """One file a text, 20 indexes each."""
    root = str(tmp_path_factory.mktemp("skip"))
    base = fixtures.packets_table(spark, SF001).limit(1).drop("index", "payload_utf8", "is_binary")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(WORDS)], "n bigint, payload_utf8 string")
    rows = (texts.crossJoin(spark.range(20)).crossJoin(base).withColumn("index", F.col("n") * 20 + F.col("id"))
            .withColumn("is_binary", F.lit(False)).select(*[f.name for f in PACKET_SCHEMA.fields]))
    for i in range(len(WORDS)):
        rows.where(f"index div 20 = {i}").coalesce(1).write.mode("append").parquet(f"{root}/packets")
    return S.FileIndex(spark, f"{root}/packets", f"{root}/files").build()


def files(df):
    return len(df.inputFiles())


@pytest.mark.parametrize("patterns,most", [
    (["%password%"], 1), (["%token%", "%password%"], 2), (["%xyz\nnext%"], 1), (["%é text 𝄞%"], 1), (["%nowhere to be found%"], 0),
    (["%100\\%\\_sure%"], 1), (["{\"k\"%}"], 1), (["%pass_ord%"], 1), (["%ab%"], 9), (["%"], 9), (["{%}"], 9), (["%back\\\\sla%"], 1)])
def test_search_reads_few_files_and_loses_nothing(spark, index, patterns, most):
    whole = spark.read.schema(PACKET_SCHEMA).parquet(index.path)
    like = F.lit(False)
    for p in patterns:
        like = like | F.col("payload_utf8").like(p)
    found = index.search(patterns)
    assert sorted(r["index"] for r in found.collect()) == sorted(r["index"] for r in whole.filter(like).collect())
    assert files(found) <= most if most else found.count() == 0


@settings(max_examples=6, deadline=None)
@given(st.integers(0, len(WORDS) - 1), st.integers(0, 10), st.integers(0, 12))
def test_any_part_of_a_text_is_found(index, which, start, size):
    part = WORDS[which][start:start + size].replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    assert index.search([f"%{part}%"]).where(f"index div 20 = {which}").count() == 20


def test_files_that_came_later_are_read(spark, index, tmp_path):
    later = S.FileIndex(spark, str(tmp_path / "packets"), str(tmp_path / "files"))
    rows = spark.read.schema(PACKET_SCHEMA).parquet(index.path)
    rows.where("index < 20").coalesce(1).write.parquet(later.path)
    later.build()
    rows.where("index >= 40 AND index < 60").coalesce(1).write.mode("append").parquet(later.path)
    assert later.search(["%plain%"]).count() == 20
    assert later.lookup(spark.range(45, 47).withColumnRenamed("id", "index")).count() == 2


def test_lookup_reads_the_files_that_hold_an_id(spark, index):
    ids = spark.createDataFrame([(3,), (3,), (45,), (46,), (170,), (9999,), (-5,), (None,)], "index bigint")
    found = index.lookup(ids)
    assert sorted(r["index"] for r in found.collect()) == [3, 45, 46, 170] and files(found) <= 3
    assert index.lookup(ids.where("index > 9000")).count() == 0


def test_literals():
    assert S.literals("%a\\%b_c%") == ["a%b", "c"] and S.literals("%") == [] and S.literals("x\\") == ["x\\"]
    assert S.trigrams("abcab") == ["abc", "bca", "cab"] and S.trigrams("ab") == []


def test_given_table(spark):
    found = fixtures.packets_index(spark, SF001).search(["%password%", "%token%"], ~F.col("is_binary"))
    want = catalog.REGISTRY["pred_like_contains"].build(spark, SF001)
    assert [r["index"] for r in since_index_no_payload(found, 100).collect()] == [r["index"] for r in want.collect()]
