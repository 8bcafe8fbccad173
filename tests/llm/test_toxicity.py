"""op3: held-out accuracy, and the risk estimator itself."""

import random
import zlib

import numpy as np

from packetlake.llm import queries, toxicity_pu
from tests.llm.conftest import SF001

LABELS = "doc_id bigint, quality int, toxic int"


def auc(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1
    pos = truth.sum()
    return (order[truth].sum() - pos * (pos + 1) / 2) / (pos * (~truth).sum())


def test_held_out_rows_of_a_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op3_toxicity_pu(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    unseen = [i for i in labels if rows[i].held_out]
    truth = np.array([labels[i] == 1 for i in unseen])
    assert auc(np.array([rows[i].score for i in unseen]), truth) > 0.95
    guess = np.array([rows[i].predicted == 1 for i in unseen])
    assert 2 * (guess & truth).sum() / (guess.sum() + truth.sum()) > 0.85


def corpus(n=600):
    rnd = random.Random(4)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = " ".join(rnd.choices(plain, k=30) + (["Vile,", "brute!"] if toxic else []))
        rows.append((i, text))
        if rnd.random() < 0.6:
            labels.append((i, 0, int(toxic)))
    return rows, labels


def test_learns_and_scores_odd_rows(spark, make_docs):
    rows, labels = corpus()
    odd = [(None, "vile brute"), (9000, None), (9001, ""), (9002, "plain text"), (9002, "plain text"), (9003, "x " * 30000 + "vile brute")]
    docs = make_docs(rows + odd)
    more = labels + [(None, 0, 1), (7777, 0, 1), (9002, None, None), (0, 0, 1), (0, 0, 0)]
    model = toxicity_pu.train(docs, spark.createDataFrame(more, LABELS))
    out = toxicity_pu.score(docs, model).collect()
    assert len(out) == len(rows) + len(odd)
    assert all((r.score >= 0.3) == (r.doc_id % 6 == 0) for r in out if r.doc_id is not None and r.doc_id < 9000)
    assert [r.score >= 0.3 for r in out if r.doc_id is None] == [True]
    assert sorted(r.score >= 0.3 for r in out if r.doc_id and r.doc_id >= 9000) == [False] * 4 + [True]


def test_held_out_labels_do_not_matter(spark, make_docs):
    rows, labels = corpus(300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    docs = make_docs(rows)
    assert toxicity_pu.train(docs, spark.createDataFrame(labels, LABELS)) == toxicity_pu.train(docs, spark.createDataFrame(turned, LABELS))


def test_repeated_ids_and_order_change_nothing(spark, make_docs):
    """An id on 1,000 rows is sampled once; the order of the rows does not matter."""
    rows, labels = corpus(300)
    often = [(1, rows[1][1])] * 1000
    table = spark.createDataFrame(labels, LABELS)
    one, two, three = (toxicity_pu.train(make_docs(r), table, 40, 200) for r in (rows + often, often + rows, [*reversed(rows)]))
    assert one == two == three and one["weights"]


def test_words_and_scores_by_brute_force(spark, make_docs):
    """The words of the classifier and the score of every text, recomputed from the definition."""
    rows, labels = corpus(400)
    toxic_ids = {i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 4 != 2}
    usable = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    all_ids = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    held = {i: toxicity_pu.words(t) for i, t in rows}
    prior = sum(usable.values()) / len(usable)
    gains = {}
    for w in set().union(*(held[i] for i in toxic_ids)):
        n = sum(w in held[i] for i in toxic_ids)
        share = n / len(toxic_ids)
        clean = max(0.0, sum(w in held[i] for i in all_ids) / len(all_ids) - prior * share) / (1 - prior)
        gain = share * np.log((share + 1e-4) / (clean + 1e-4))
        if n >= toxicity_pu.LEAST_TEXTS and share >= toxicity_pu.LEAST_SHARE and gain > 0:
            gains[w] = gain
    model = toxicity_pu.train(make_docs(rows), spark.createDataFrame(labels, LABELS))
    assert set(model["weights"]) == set(sorted(gains, key=lambda w: (-gains[w], w))[:toxicity_pu.VOCABULARY])
    for r in toxicity_pu.score(make_docs(rows), model).collect():
        z = model["bias"] + sum(w for k, w in model["weights"].items() if k in held[r.doc_id])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_nothing_to_learn_from(spark, make_docs, write_table):
    for rows, labels in (([], []), ([(1, "a")], []), ([(1, "a"), (2, None)], [(1, 0, 0)]), ([(1, "a")], [(1, 0, None)])):
        folder = write_table(documents=make_docs(rows), labels=spark.createDataFrame(labels, LABELS))
        assert [(r.score, r.predicted) for r in queries.op3_toxicity_pu(spark, folder).collect()] == [(0.0, 0)] * len(rows)


def test_risk_is_never_negative():
    rng = np.random.default_rng(0)
    toxic = (rng.random((50, 20)) < 0.5).astype(np.float32)
    _, _, risks = toxicity_pu.fit(toxic, np.vstack([toxic, np.zeros((150, 20), np.float32)]), 0.25)
    assert min(risks) >= 0 and risks[-1] < risks[0]


def test_table_with_few_labels(spark):
    assert queries.op3_toxicity_pu(spark, SF001).count() == spark.read.parquet(f"{SF001}/documents.parquet").count()
