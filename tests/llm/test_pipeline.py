"""The pipeline's stages, one by one, against brute force over what the stage before kept."""

from collections import Counter

import corpus_pipeline
from packetlake.llm import pii, queries, stages, token_counts
from tests.llm.conftest import SF001
from tests.llm.test_near_duplicates import brute_components, brute_print
from tests.llm.test_pii import plain_spans
from tests.llm.test_tokens_and_packing import BYTES, check_packing
from tests.llm.test_urls_and_mixing import targets

LABELS = "doc_id bigint, quality int, toxic int"


def test_stages(spark, tmp_path):
    names, kept = [], [spark.read.parquet(f"{SF001}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        out = stage(spark, kept[-1], SF001)
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    docs, clean, single, masked, mixed, packed = [d.collect() for d in kept]
    for d in kept[:5]:
        assert d.columns == kept[0].columns
    # Toxicity: what the query predicts.
    toxic = {r.doc_id for r in queries.op3_toxicity_pu(spark, SF001).collect() if r.predicted}
    assert {r.doc_id for r in clean} == {r.doc_id for r in docs} - toxic and toxic
    # Near duplicates: the smallest id of each component, text untouched.
    prints = {r.doc_id: brute_print(r.text) for r in clean}
    label, least = brute_components(prints.values()), {}
    for i, f in sorted(prints.items(), reverse=True):
        least[label[f]] = i
    assert sorted(r.doc_id for r in single) == sorted(least.values()) and set(single) <= set(clean)
    # Personal data: no base span is left, texts without any are untouched.
    before = {r.doc_id: r.text for r in single}
    assert len(masked) == len(single)
    for r in masked:
        assert not plain_spans(r.text) or "[" in r.text
        if not plain_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]
    assert any(pii.base_spans(t) for t in before.values())
    # Mix: whole copies near the targets, none more than three times.
    size, held = {r.doc_id: len(r.text.encode().split()) for r in masked}, Counter(r.doc_id for r in mixed)
    assert max(held.values()) <= 3 and set(mixed) <= set(masked)
    totals = Counter()
    for r in masked:
        totals[r.source] += size[r.doc_id]
    got, want = Counter(), targets(totals)
    for r in mixed:
        got[r.source] += size[r.doc_id]
    for s in totals:
        biggest = max(size[r.doc_id] for r in masked if r.source == s)
        assert abs(got[s] - want[s]) <= biggest + 0.01 * want[s]
    # Packing: an exact round trip of what is left.
    texts = {r.doc_id: r.text for r in mixed}
    once = {}
    for r in packed:
        once.setdefault((r.doc_id, r.piece), r)
    assert Counter((r.doc_id, r.piece) for r in packed) == {k: held[k[0]] for k in once}
    for i in texts:
        assert sum(r.length for k, r in once.items() if k[0] == i) == len(token_counts.load(BYTES).encode(texts[i], add_special_tokens=False).ids) + 1


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF001).collect()
    bins = Counter()
    for r in rows:
        bins[r.sequence_id] += r.length
    assert rows and max(bins.values()) <= 1024


def test_odd_rows(spark, make_docs, write_table):
    rows = [(None, None), (None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (2, ""), (3, "mail x@y.zz now", None), (4, "other " * 2000), (5, None)]
    folder = write_table(documents=make_docs(rows), labels=spark.createDataFrame([(1, 0, 0), (None, 0, None)], LABELS))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.count()
    assert Counter(r.doc_id for r in stages.drop_near_duplicates(spark, docs, folder).collect()) == {1: 1, 2: 1, 3: 1, 4: 1}
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_table(spark, make_docs, write_table):
    folder = write_table(documents=make_docs([]), labels=spark.createDataFrame([], LABELS))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_check_packing_is_used(spark):
    rows = queries.op4_best_fit_packing(spark, SF001).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert check_packing(rows, texts, token_counts.load(BYTES)) > 0


def test_groups_that_share_their_smallest_id(spark, make_docs, write_table):
    """Two groups named by the same repeated id each keep one document."""
    one, other = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))
    rows = [(5, one), (5, other), (8, other), (9, one), (5, other)]
    folder = write_table(documents=make_docs(rows))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stages.drop_near_duplicates(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, one), (5, other)])


def test_stages_with_clashing_names(spark, make_docs, write_table):
    """Columns named like any that the stages use inside pass through them unchanged."""
    names = ["_score", "_d", "_g", "_digest", "_times", "_spans", "_copy", "_text", "row", "d", "g", "body", "spans", "terms", "slot", "copy", "slots",
             "times", "of_d", "kept_d", "removed", "toxic", "equal_rows"]
    rows = [(i, f"plain words number {i} and mail a{i}@b.cc here", "s") for i in range(20)]
    docs = make_docs(rows).selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    folder = write_table(labels=spark.createDataFrame([(i, 0, 0) for i in range(20)], LABELS), documents=docs)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[n] == n for r in found for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= 20
