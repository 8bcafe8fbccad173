"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts are learned from: the risk of a
linear classifier is the class prior times its risk on the toxic texts, plus
its negative-class risk on the unlabelled texts less the prior times that on
the toxic ones.  That second part estimates the risk on clean texts and can't be negative;
where it falls below zero the step goes back up its gradient instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TOXIC_ROWS = 4_096        # confirmed toxic texts learned from, at most: those of smallest id hash
UNLABELLED_ROWS = 12_288  # unlabelled texts learned from, at most: those of smallest id hash
VOCABULARY = 512          # words the classifier knows, at most
LEAST_SHARE = 0.01        # of the toxic texts that hold a known word
LEAST_TEXTS = 4
PREFIX = 5                # letters of the word beginnings that count as words too
STEPS, RATE = 400, 0.05
DECAY = 0.6               # weight decay, shared out over the toxic texts
THRESHOLD = 0.3
CACHE_ROWS = 200_000

_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def words(text: str) -> set[str]:
    """The words of a text, and the beginnings of longer ones (``begin*``)."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:PREFIX] + "*" for w in found if len(w) > PREFIX}


def _sample(ids: DataFrame, rows: int, seed: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)


def _sampled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(toxic, doc_id, text) of the sampled ids; of an id on several rows, one text, the one of least hash: so at most a row an id."""
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .groupBy("toxic", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")))


def vocabulary(sampled: DataFrame, prior: float) -> list[str]:
    """Words that tell toxic from clean texts: the clean share of a word is what the prior leaves of its share in all.

    Each task counts the texts that hold a word; at most ``VOCABULARY`` words reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = (Counter(), Counter()), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(2)), strict=True):
                seen[toxic].update(words(text))
                texts[toxic] += 1
        for toxic in (0, 1):
            if texts[toxic]:
                known = ["", *seen[toxic]]          # the empty word counts the texts
                n = [texts[toxic], *seen[toxic].values()]
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(known), pa.int32()), pa.array(known, pa.string()), pa.array(n, pa.int64())],
                                                 names=["toxic", "word", "n"])

    counts = (sampled.mapInArrow(count, "toxic int, word string, n bigint").groupBy("word")
              .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("in_toxic"),
                   F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("in_all")))
    counts = common.durable(counts.where(F.col("in_toxic") >= LEAST_TEXTS))
    every = counts.where("word = ''").first()
    if every is None:
        return []
    share = F.col("in_toxic") / F.lit(every["in_toxic"])
    clean = F.greatest(F.lit(0.0), F.col("in_all") / F.lit(max(1, every["in_all"])) - prior * share) / (1 - prior)
    gain = share * F.log((share + 1e-4) / (clean + 1e-4))
    best = (counts.where((F.col("word") != "") & (F.col("in_toxic") >= LEAST_SHARE * every["in_toxic"])).withColumn("gain", gain)
            .where("gain > 0").orderBy(F.desc("gain"), "word").limit(VOCABULARY))
    return [r["word"] for r in best.collect()]


def presence(sampled: DataFrame, known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(toxic, unlabelled): which known words each sampled text holds, in the order of ids."""
    at = {w: i for i, w in enumerate(known)}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = []
        for text in common.texts(batch.column(2)):
            row = np.zeros(len(at), np.uint8)
            row[[at[w] for w in words(text) if w in at]] = 1
            held.append(np.packbits(row).tobytes())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(held, pa.binary())], names=["toxic", "doc_id", "held"])

    found = common.map_batches(sampled, work, "toxic int, doc_id bigint, held binary").toArrow().sort_by([("toxic", "ascending"), ("doc_id", "ascending")])
    toxic = found.column("toxic").to_numpy() == 1
    bits = np.frombuffer(b"".join(found.column("held").to_pylist()), np.uint8).reshape(len(toxic), -1)
    x = np.unpackbits(bits, axis=1, count=len(known)).astype(np.float32)
    return x[toxic], x[~toxic]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float, list[float]]:
    """(weights, bias, risks) of the non-negative risk with logistic loss, by Adam."""
    d = toxic.shape[1]
    w, m, v, risks = (*np.zeros((3, d + 1), np.float32), [])
    w[d] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        p, u = _sigmoid(toxic @ w[:d] + w[d]), _sigmoid(unlabelled @ w[:d] + w[d])
        positive = prior * -np.log(np.maximum(p, 1e-12)).mean()
        negative = -np.log(np.maximum(1 - u, 1e-12)).mean() - prior * -np.log(np.maximum(1 - p, 1e-12)).mean()
        risks.append(positive + max(0.0, negative))
        # Gradients with respect to the scores, then to the weights.
        as_negative_u, as_negative_p = u / len(u), prior * p / len(p)
        if negative >= 0:
            on_u, on_p = as_negative_u, -prior * (1 - p) / len(p) - as_negative_p
        else:
            on_u, on_p = -as_negative_u, as_negative_p
        on_u, on_p = on_u.astype(np.float32), on_p.astype(np.float32)
        g = np.concatenate([unlabelled.T @ on_u + toxic.T @ on_p + np.float32(DECAY / len(p)) * w[:d], [on_u.sum() + on_p.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return w[:d], float(w[d]), risks


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> dict:
    """{"weights": {word: weight}, "bias"}: the classifier, from labels of rows that are not held out.

    The prior is the toxic share of those labels; of labels that contradict
    each other the toxic one counts, null labels do not.  An id is sampled once, however often it occurs, ties
    of the sample go to smaller ids, and the same rows in another order give the same classifier.  Without toxic
    texts to learn from, or a word that they share, every score is 0.
    """
    usable = (labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
              .groupBy("doc_id").agg((F.max("toxic") > 0).alias("is_toxic")))
    share = usable.agg(F.avg(F.col("is_toxic").cast("double")).alias("prior")).first()["prior"]
    toxic_ids = _sample(usable.where("is_toxic").select("doc_id"), toxic_rows, 1)
    all_ids = _sample(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct(), unlabelled_rows, 2)
    nothing = {"weights": {}, "bias": -np.inf}
    if not share:
        return nothing
    ids = common.durable(toxic_ids.select("doc_id", F.lit(1).alias("toxic")).unionByName(all_ids.select("doc_id", F.lit(0).alias("toxic"))))
    prior, sampled = min(max(float(share), 1e-3), 0.5), common.durable(_sampled(docs, ids))
    known = vocabulary(sampled, prior)
    if not known:
        return nothing
    toxic, unlabelled = presence(sampled, known)
    if not (len(toxic) and len(unlabelled)):
        return nothing
    w, bias, _ = fit(toxic, unlabelled, prior)
    return {"weights": dict(zip(known, w.tolist(), strict=True)), "bias": bias}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
          out: str = "score") -> DataFrame:
    """(doc_id, score) of every row, or the ``keep`` columns and the score as ``out``: whole texts, each known word counted once.

    A null text counts as empty; its score is what the bias alone gives.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, cache = shared.value["weights"], shared.value["bias"], {}

        def known(piece: str) -> tuple[str, ...]:
            return tuple(w for w in words(piece) if w in weights)

        for batch in batches:
            logits = []
            for body in common.texts(batch.column(batch.num_columns - 1)):
                found = set()
                for piece in set(body.split()):
                    got = cache.get(piece)
                    if got is None:
                        got = known(piece)
                        if len(cache) >= CACHE_ROWS:
                            cache.clear()
                        if len(piece) <= 64:
                            cache[piece] = got
                    found.update(got)
                logits.append(bias + sum(weights[w] for w in sorted(found)))
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-np.asarray(logits, np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], out])

    kept = keep or [doc_id]
    rows = docs.select(*kept, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{out}` double"
    return rows.mapInArrow(work, schema)
