"""Personal data: patterns, and the terms that reveal them by corpus co-occurrence.

Four patterns find the protected entities.  A term of a document that holds an
entity, wherever it stands in it, discloses the entity as far as seeing the term
raises the entity's probability: the pointwise mutual information over documents,
log2(p(e, t) / (p(e) p(t))), against the entity's own information, -log2 p(e).
A ratio of 1 means that the term gives the entity away.  Terms above one
threshold are generalised, above a higher one removed, wherever they occur.
Document counts of terms, entities and pairs cover whole texts of the whole corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LEAST_DOCUMENTS = 3       # with both the entity and the term
GENERALISE, REMOVE = 0.8, 0.95
COUNTER_ROWS = 150_000    # terms a task counts before it passes its counts on
CACHE_ROWS = 400_000      # pieces whose terms a task keeps, longer ones than LONGEST_KEPT left out
LONGEST_KEPT = 64
SPLIT_TEXTS = 1_000       # texts that are split into words at a time
SALTS = 16                # parts that the rows of a hot entity or term are joined in
MASK_BITS = 22            # of the table that tells which terms may be disclosing

# Each starts where the pattern's leftmost match must start; what a match takes is as in the pattern itself.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_IP_END = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]")      # every ip holds it, and it is found from its first character on
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Local part, @ and a domain of two labels or more, found from each @ on."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four patterns, by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    if _IP_END.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if len(digits) <= 19 and len(digits) >= 16 and luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def term_of(piece: str) -> str:
    """The term of a word: lower case, without what is not alphanumeric at its ends."""
    if piece.isalnum():
        return piece.lower()
    if piece[:-1].isalnum():
        return piece[:-1].lower()
    a, b = 0, len(piece)
    while a < b and not piece[a].isalnum():
        a += 1
    while b > a and not piece[b - 1].isalnum():
        b -= 1
    return piece[a:b].lower()


def _hash(value: str) -> int:
    h = xxhash.xxh64_intdigest(value, 5)
    return h - (1 << 64) if h >> 63 else h


class _Kept(dict):
    """What ``of`` gives for a piece of text, kept for the next time; of bounded size."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, piece: str):
        found = self.of(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= CACHE_ROWS:
                self.clear()
            self[piece] = found
        return found


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, piece, pieces): the number of the text that each word is of, and of the word among the different ``pieces``."""
    words = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = words.flatten().dictionary_encode()
    pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    of, piece = pc.list_parent_indices(words).to_numpy(), coded.indices.to_numpy()
    if "" in pieces:        # white space at an end leaves an empty word
        there = piece != pieces.index("")
        of, piece = of[there], piece[there]
    return of, piece, pieces


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SPLIT_TEXTS) for batch in batches for at in range(0, batch.num_rows, SPLIT_TEXTS))


_WORD = re.compile(r"\S+")


def _trimmed(text: str, a: int, b: int) -> tuple[str, int, int] | None:
    """(term, start, end) of a word without what is not alphanumeric at its ends, if two characters are left."""
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return (text[a:b].lower(), a, b) if b - a > 1 else None


def words_outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words of a text, of two characters or more, outside of some spans; a span cuts words."""
    out, at = [], 0
    for low, high in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
        out += filter(None, (_trimmed(text, *m.span()) for m in _WORD.finditer(text, at, max(at, low))))
        at = max(at, high)
    return out


def words_among(text: str, pieces: set[str]) -> list[tuple[str, int, int]]:
    """What ``words_outside`` gives, without spans, for the words that stand in ``text`` as one of ``pieces``, by piece."""
    out = []
    for piece in pieces:
        at, size = text.find(piece), len(piece)
        while at >= 0:
            end = at + size
            if (at == 0 or text[at - 1].isspace()) and (end == len(text) or text[end].isspace()) and (word := _trimmed(text, at, end)):
                out.append(word)
            at = text.find(piece, at + 1)
    return out


def near_terms(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words that may disclose the entity of one span: all words of the text outside of it."""
    return words_outside(text, [("", start, end)])


_FACTS = ("tag int, doc_id bigint, digest bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, "
          "base_sha256 string, row bigint, entities array<bigint>, terms array<bigint>, term bigint, n bigint")
_DOC, _HELD, _TERM = 0, 1, 2


def _facts(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row per document, the entities and terms of each that holds entities, and counts of terms."""
    names = [f.split()[0] for f in _FACTS.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    types = [kinds[f.split()[1]] for f in _FACTS.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    def counts_of(counts: dict[int, int]) -> pa.RecordBatch:
        empty = [pa.nulls(len(counts), t) for t in types]
        empty[names.index("tag")] = pa.array([_TERM] * len(counts), pa.int32())
        empty[names.index("term")] = pa.array(list(counts), pa.int64())
        empty[names.index("n")] = pa.array(list(counts.values()), pa.int64())
        return pa.RecordBatch.from_arrays(empty, names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = {}, TaskContext.get().partitionId() << 33
        term = _Kept(lambda piece: _hash(term_of(piece))).__getitem__
        for batch in _slices(batches):
            rows = []
            of, piece, pieces = _split(batch.column(2))
            distinct, number = np.unique(np.fromiter(map(term, pieces), np.int64, len(pieces)), return_inverse=True)
            held_by = np.sort(of * len(distinct) + number[piece])     # text and term
            held_by = held_by[np.append(True, held_by[1:] != held_by[:-1])[:len(held_by)]]
            texts_with = np.bincount(held_by % max(1, len(distinct)), minlength=len(distinct))
            for key, n in zip(distinct.tolist(), texts_with.tolist(), strict=True):
                if n:
                    counts[key] = counts.get(key, 0) + n
            for key, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         common.texts(batch.column(2)), strict=True):
                spans = base_spans(text)
                base, per = span_text(spans), Counter(k for k, _, _ in spans)
                rows.append({"tag": _DOC, "doc_id": key, "digest": digest, "base": base,
                             "base_sha256": hashlib.sha256(base.encode()).hexdigest()} | {f"n_{k}": per[k] for k in KINDS})
                if spans:
                    terms = {_hash(word) for word in {w for w, _, _ in words_outside(text, spans)}}
                    rows.append({"tag": _HELD, "row": held, "entities": list({_entity(text, s) for s in spans}), "terms": list(terms)})
                    held += 1
                    for key in terms.difference(map(term, set(text.split()))):     # of words that a span cuts
                        counts[key] = counts.get(key, 0) + 1
            if rows:
                yield batch_of(rows)
            if len(counts) >= COUNTER_ROWS:
                yield counts_of(counts)
                counts = {}
        if counts:
            yield counts_of(counts)

    return docs.mapInArrow(work, _FACTS)


def _entity(text: str, span: tuple[str, int, int]) -> int:
    return _hash(f"{span[0]}:{text[span[1]:span[2]]}")


def _salted(big: DataFrame, few: DataFrame, keys: list[str], spread) -> DataFrame:
    """``big`` joined to ``few``, which is unique in ``keys``; a hot key's rows are dealt to ``SALTS`` parts by ``spread``."""
    copies = few.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"]).drop("_salt")


def _mask(terms: DataFrame) -> np.ndarray:
    """A table of bits: whether a term's low ``MASK_BITS`` bits are those of one of ``terms``; of bounded size, for any number."""
    low = F.col("term").bitwiseAND((1 << MASK_BITS) - 1)
    cells = (terms.select(F.shiftright(low, 5).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(31).cast("int")).alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (MASK_BITS - 5), np.uint32)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, digest, entities, term, start, stop) of the words whose term may be one of ``terms``, and their document's entities."""
    mask = docs.sparkSession.sparkContext.broadcast(_mask(terms))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, low = np.unpackbits(mask.value, bitorder="little").tobytes(), (1 << MASK_BITS) - 1
        asked = _Kept(lambda piece: may[_hash(term_of(piece)) & low]).__getitem__
        for batch in _slices(batches):
            rows, of_text = [], defaultdict(set)
            of, piece, pieces = _split(batch.column(2))
            found = np.fromiter(map(asked, pieces), bool, len(pieces))[piece]
            for i, at in zip(of[found].tolist(), piece[found].tolist(), strict=True):
                of_text[i].add(pieces[at])
            for i, (key, digest, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                        common.texts(batch.column(2)), strict=True)):
                spans = base_spans(text)
                if not spans and i not in of_text:
                    continue
                entities = list({_entity(text, s) for s in spans})
                words = [(_hash(term), a, b) for term, a, b in (words_outside(text, spans) if spans else words_among(text, of_text[i]))]
                rows += [(key, digest, entities, *word) for word in words if may[word[0] & low]]
            if rows:
                types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 names=["doc_id", "digest", "entities", "term", "start", "stop"])

    return docs.mapInArrow(work, "doc_id bigint, digest bigint, entities array<bigint>, term bigint, start int, stop int")


def _digest(text: str):
    return F.xxhash64(F.col(text))


def find_spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE,
               doc_id: str = "doc_id", text: str = "text", everywhere: bool = False) -> DataFrame:
    """(doc_id, digest, n_email, n_ip, n_card, n_phone, base_sha256, spans, terms) of every row, whole texts.

    spans: the base spans, then ``term:start:end`` of the words that disclose an entity; terms: the latter
    as (start, stop, action) with action 'generalise' or 'remove'.  A disclosing term is given at all its places
    in the documents that hold its entity; with ``everywhere`` in every document, as the query and the pipeline
    ask for.  Null texts are empty.  digest tells rows of one doc_id apart; equal rows get equal results, and each
    counts as a document.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), _digest(text).alias("digest"), F.col(text).alias("text"))
    facts = common.durable(_facts(rows))
    documents = facts.where(F.col("tag") == _DOC).drop("row", "entities", "terms", "term", "n")
    total = documents.count()
    held = facts.where(F.col("tag") == _HELD)
    in_rows = held.select("row", F.explode("entities").alias("entity"))
    entities = common.durable(in_rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
                              .where(F.col("n_entity") >= LEAST_DOCUMENTS))
    pairs = (_salted(in_rows, entities.select("entity"), ["entity"], F.col("row")).join(held.select("row", "terms"), "row")
             .select("entity", F.explode("terms").alias("term"))
             .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= LEAST_DOCUMENTS))
    terms = facts.where(F.col("tag") == _TERM).groupBy("term").agg(F.sum("n").alias("n_term"))
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * float(total) / (F.col("n_entity") * F.col("n_term")))
    disclosing = (pairs.join(entities, "entity").join(terms, "term")
                  .where(information > 0).withColumn("ratio", mutual / information)
                  .where(F.col("ratio") >= generalise).select("entity", "term", "ratio"))
    disclosing = common.durable(disclosing)
    found = _occurrences(rows, disclosing.select("term"))
    if everywhere:
        marked = _salted(found, disclosing.groupBy("term").agg(F.max("ratio").alias("ratio")), ["term"], F.col("digest"))
    else:
        marked = _salted(found.withColumn("entity", F.explode("entities")), disclosing, ["entity", "term"], F.col("digest"))
    spans = (marked
             .groupBy(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), "start", "stop").agg(F.max("ratio").alias("ratio"))
             .groupBy("_d", "_g").agg(F.sort_array(F.collect_list(F.struct(
                 "start", "stop", F.when(F.col("ratio") >= remove, "remove").otherwise("generalise").alias("action")))).alias("terms")))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("digest").eqNullSafe(F.col("_g"))
    added = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["stop"].cast("string")))
    return (documents.join(common.durable(spans), same, "left")
            .withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), added))
            .select("doc_id", "digest", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "terms"))


def sanitised(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its texts rewritten by the spans of :func:`find_spans` over the same rows.

    A base span becomes its kind in brackets ([EMAIL], ...); overlapping ones
    become the first one's kind.  A disclosing term is generalised to [NUMBER],
    [NAME] (capitalised) or [WORD], or removed.  Texts without spans stay as they are, null included.
    """
    plans = (found.where(F.col("spans") != "").groupBy(F.col("doc_id").alias("of_d"), F.col("digest").alias("of_g"))
             .agg(F.first("spans").alias("spans"), F.first("terms").alias("terms")))
    # The document is one struct here, so that no column of its can clash.
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("d"), _digest(text).alias("g"), F.col(text).alias("body"))
    same = F.col("d").eqNullSafe(F.col("of_d")) & F.col("g").eqNullSafe(F.col("of_g"))
    joined = whole.join(common.durable(plans), same, "left")
    removed = F.transform(F.filter("terms", lambda t: t["action"] == "remove"), lambda t: t["start"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [t if s is None else rewrite(t, s, set(r or ())) for t, s, r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["row", "body"])

    schema = f"row {whole.schema['row'].dataType.simpleString()}, body string"
    done = common.map_batches(joined.select("row", "body", "spans", removed.alias("removed")), work, schema)
    return done.select(*[F.col("body").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def rewrite(text: str, spans: str, removed: set[int]) -> str:
    """``text`` with its spans replaced, from left to right."""
    out, last = [], 0
    parsed = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    for a, b, kind in parsed:
        if a < last:
            last = max(last, b)
            continue
        out.append(text[last:a])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif a not in removed:
            word = text[a:b]
            out.append("[NUMBER]" if word[0].isdigit() else "[NAME]" if word[0].isupper() else "[WORD]")
        last = b
    return "".join([*out, text[last:]])
