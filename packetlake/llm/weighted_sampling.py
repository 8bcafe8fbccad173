"""Document fingerprints by consistent weighted sampling.

A document is its words, each weighted by how often it occurs.  For a sample
and a word of weight w, hashes of the word give r and c, distributed as
Gamma(2, 1), and b, uniform in (0, 1); with t = floor(ln w / r + b) the word's
value is ln c - r * (t - b + 1), and the sample is the (word, t) of the least value.  Two documents
agree in a sample with the probability sum(min weights) / sum(max weights),
their generalised Jaccard similarity, so the share of equal samples estimates it.
Everything is built from DataFrame functions: a word's value and its (word, t)
are packed into one long, so a signature is a set of plain minima.

The exponential of a word's value is exponentially distributed with rate w, so the least of a text of W words lies
below DRAWS / W but for one sample in e**DRAWS.  A value above that is not worth its logarithms: it exceeds
ln c - ln w - r, and (1 - e**-c) * e**-r, a product of the uniform numbers, tells without them.  A
text with a sample that is not below the bound is sampled again in full, so the bound changes no result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import assign_index
from . import common

SAMPLES = 64             # a multiple of 4: four samples of 16 bits make 16 hex digits
TOGETHER = 8             # samples, at most, that one row of a term takes: code for more is too long for the JVM to compile
KNOWN_TERMS = 32_768     # frequent (word, weight) pairs whose samples are taken once and broadcast: 520 bytes each
COUNTED_DOCS = 16_384    # documents, about, that these are found in; which pairs are known changes no result
SPACE = r"[\x20\x09-\x0D]+"
LOWEST = 128.0           # values lie above -LOWEST: r is at most 46, ln w at most 44
DRAWS = 24.0             # values are sampled below DRAWS / words of the text
SCALE = float(1 << 23)   # steps of a value; (value + LOWEST) * SCALE stays below 2**31


Sample = int | tuple[Column, list[int]]     # a sample's number, or numbers and the column of the place of a row's number among them


def _constant(j: Sample, i: int) -> Column:
    """The i-th of a sample's three 64-bit constants (multiples of the golden ratio's)."""
    if not isinstance(j, int):
        return F.get(F.array(*[_constant(x, i) for x in j[1]]), j[0])
    c = (3 * j + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return F.lit(c - (1 << 64) if c >= 1 << 63 else c)


def _uniforms(h: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from the halves of a hash."""
    return ((F.shiftrightunsigned(h, 32) + F.lit(0.5)) / F.lit(float(1 << 32)),
            (h.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) / F.lit(float(1 << 32)))


def products(term: Column, j: Sample) -> tuple[Column, Column]:
    """The products of two uniform numbers of a term in sample ``j`` that give r and c."""
    (u1, u2), (u3, u4) = (_uniforms(F.xxhash64(term.bitwiseXOR(_constant(j, i)))) for i in range(2))
    return u1 * u2, u3 * u4


def sample(term: Column, log_weight: Column, j: Sample, made: tuple[Column, Column] | None = None) -> Column:
    """The value of a term in sample ``j`` above, 32 bits of (term, t) below: the least wins.  ``made``: its ``products``."""
    of_r, of_c = made or products(term, j)
    m = F.xxhash64(term.bitwiseXOR(_constant(j, 2)))
    b, _ = _uniforms(m)
    r = -F.ln(of_r)
    t = F.floor(log_weight / r + b)
    value = F.ln(-F.ln(of_c)) - r * (t - b + 1)
    mark = m.bitwiseXOR(F.shiftleft(t, 8)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(F.floor((value + F.lit(LOWEST)) * F.lit(SCALE)), 32).bitwiseOR(mark)


def may_be_least(term: Column, weight: Column, words: Column, j: Sample, made: tuple[Column, Column] | None = None) -> Column:
    """Whether the term's value in sample ``j`` may lie below ln(DRAWS / words); a thousandth covers rounding."""
    of_r, of_c = made or products(term, j)
    return (F.lit(1.0) - of_c) * of_r * words <= weight * F.lit(1.001 * DRAWS)


def _below(values: Column, words: Column) -> Column:
    """Whether every sample lies below the bound: then no value left out is less."""
    bound = F.floor((F.ln(F.lit(DRAWS) / words) + F.lit(LOWEST)) * F.lit(SCALE))
    return F.forall(values, lambda x: F.shiftright(x, 32) < bound)


def _some_words(text: str) -> Column:
    """The words of a text; the empty word, once, if it has none."""
    empty = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) == 0
    return F.when(empty, F.array(F.lit(""))).otherwise(F.array_remove(F.split(F.col(text), SPACE), ""))


def known_samples(texts: DataFrame, text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(_term, _n, _known): the samples of at most ``KNOWN_TERMS`` pairs of a word and a weight that occur in many of ``texts``."""
    held = (texts.select(F.monotonically_increasing_id().alias("_row"), F.explode(_some_words(text)).alias("_word"))
            .groupBy("_row", F.xxhash64("_word").alias("_term")).agg(F.count(F.lit(1)).alias("_n")))
    often = (held.groupBy("_term", "_n").agg(F.count(F.lit(1)).alias("_docs"))
             .orderBy(F.desc("_docs"), "_term", "_n").limit(KNOWN_TERMS))
    pair = F.col("_term"), F.ln("_n")
    return common.durable(often.select("_term", "_n", F.array(*[sample(*pair, j) for j in range(samples)]).alias("_known")))


def _least(terms: DataFrame, keys: list[str], known: DataFrame | None, samples: int, words: str | None = None) -> DataFrame:
    """(keys, _v, _first): the least value of each sample over the rows (keys, _term, _n), and the least _term.

    With ``words``, a column of the texts' sizes, values that are not below the bound may be left out.
    The samples are taken ``TOGETHER`` at a time, each time by a row of the term's own.
    """
    together = math.gcd(samples, TOGETHER)
    parts = samples // together
    if known is not None:
        terms = terms.join(F.broadcast(known), ["_term", "_n"], "left")
    terms = terms.withColumn("_log", F.ln("_n")).withColumn("_part", F.explode(F.array(*[F.lit(p) for p in range(parts)])))
    numbers = [(F.col("_part"), list(range(j, samples, together))) for j in range(together)]
    value = lambda j: sample(F.col("_term"), F.col("_log"), numbers[j])
    if known is not None:
        new = value
        if words is not None:
            # Columns of their own: written out at each of their uses, they make plans that a driver has hardly room for.
            unknown = F.col("_known").isNull()
            terms = terms.select("*", *[F.when(unknown, p).alias(f"_{name}{j}") for j in range(together)
                                        for name, p in zip("rc", products(F.col("_term"), numbers[j]), strict=True)])
            made = lambda j: (F.col(f"_r{j}"), F.col(f"_c{j}"))
            new = lambda j: F.when(may_be_least(F.col("_term"), F.col("_n"), F.col(words), numbers[j], made(j)),
                                   sample(F.col("_term"), F.col("_log"), numbers[j], made(j)))
        place = lambda j: F.col("_part") * together + j
        value = lambda j: F.when(F.col("_known").isNotNull(), F.get("_known", place(j))).otherwise(new(j))
    least = terms.groupBy(*keys, "_part").agg(*[F.min(value(j)).alias(f"_m{j}") for j in range(together)], F.min("_term").alias("_first"))
    values = F.array(*[F.col(f"_m{j}") for j in range(together)])
    of_parts = F.array_sort(F.collect_list(F.struct("_part", values.alias("_v"))))
    return (least.groupBy(*keys).agg(of_parts.alias("_v"), F.min("_first").alias("_first"))
            .select(*keys, F.flatten(F.col("_v._v")).alias("_v"), "_first"))


def _digits(values: Column) -> Column:
    """Four hex digits a sample."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFF)))), 4, "0")), "")


def signatures(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(keys, signature): ``samples`` times four hex digits for every row; ``keys`` name a row."""
    terms = (texts.select(*keys, F.explode(_some_words(text)).alias("_word"))
             .groupBy(*keys, F.xxhash64("_word").alias("_term")).agg(F.count(F.lit(1)).alias("_n")))
    return _least(terms, keys, None, samples).select(*keys, _digits(F.col("_v")).alias("signature"))


OWN, EDITED, BOTH, DIGEST = 1, 2, 3, 4     # whose word a row is; DIGEST and the three after it are parts of the SHA-256


def pair_signatures(texts: DataFrame, keys: list[str], known: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint, edited_fingerprint, edited_sha256) of the ``text`` and the ``edited`` text of every row; ``keys`` name a row.

    Rows with a sample that the bound does not settle are sampled again in full; there are hardly any.
    """
    found = common.durable(_pair_signatures(texts, keys, known, samples, bounded=True))
    left = found.where("NOT _settled").select(*keys)
    found = found.where("_settled")
    if not left.isEmpty():
        found = found.unionByName(_pair_signatures(texts.join(left, keys, "left_semi"), keys, known, samples, bounded=False))
    return found.drop("_settled")


def _pair_signatures(texts: DataFrame, keys: list[str], known: DataFrame, samples: int, bounded: bool) -> DataFrame:
    """What ``pair_signatures`` returns and ``_settled``: whether no value left out can be less.

    A word with the same weight in both is sampled once.  ``texts`` that are partitioned by some of ``keys``
    are not shuffled: words are counted and samples taken where the texts are.  The hash goes along as four
    rows, so that the texts are read once.
    """
    least_size = F.least(F.size(_some_words("text")), F.size(_some_words("edited")))
    names, keys = keys, [*keys, "_words"]
    texts = texts.withColumn("_words", least_size if bounded else F.lit(1))
    body = lambda of, column: F.struct(F.lit(of).alias("of"), column.alias("body"))
    hashed = texts.select(*keys, "text", "edited", F.sha2("edited", 256).alias("_sha"))
    each = F.explode(F.array(body(OWN, F.col("text")), body(EDITED, F.col("edited")),
                             *[body(DIGEST + i, F.substring("_sha", 16 * i + 1, 16)) for i in range(4)]))
    words = (hashed.select(*keys, each.alias("_e")).select(*keys, F.col("_e.of").alias("_of"), F.col("_e.body").alias("_body"))
             .select(*keys, "_of", F.explode(_some_words("_body")).alias("_word")))
    term = F.when(F.col("_of") >= DIGEST, F.conv("_word", 16, -10).cast("bigint")).otherwise(F.xxhash64("_word"))
    counts = words.groupBy(*keys, term.alias("_term")).agg(
        F.count(F.when(F.col("_of") == OWN, 1)).alias("_n1"), F.count(F.when(F.col("_of") == EDITED, 1)).alias("_n2"),
        F.bit_or(F.when(F.col("_of") >= DIGEST, F.expr(f"shiftleft(1, _of - {DIGEST})")).otherwise(0)).alias("_parts"))
    one = lambda of, n: F.struct(F.lit(of).alias("of"), F.col(n).alias("n"))
    weights = (F.when(F.col("_n1") == F.col("_n2"), F.array(one(BOTH, "_n1"))).otherwise(F.array(one(OWN, "_n1"), one(EDITED, "_n2"))))
    part = F.array(*[F.struct(F.lit(DIGEST + i).alias("of"), F.getbit("_parts", F.lit(i)).cast("bigint").alias("n")) for i in range(4)])
    terms = (counts.withColumn("_t", F.explode(F.when(F.col("_parts") == 0, weights).otherwise(F.concat(weights, part))))
             .select(*keys, "_term", F.col("_t.of").alias("_of"), F.col("_t.n").alias("_n")).where("_n > 0"))
    rows = (_least(terms, [*keys, "_of"], known, samples, "_words" if bounded else None)
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_of", "_first", "_v"))).alias("_p")))
    largest = F.array_repeat(F.lit((1 << 63) - 1), samples)
    least = lambda of: F.aggregate(F.filter("_p", lambda p: p["_of"].isin(of, BOTH)), largest,
                                   lambda all_, p: F.zip_with(all_, p["_v"], lambda x, y: F.least(x, y)))
    sha = F.array_join(F.transform(F.filter("_p", lambda p: p["_of"] >= DIGEST), lambda p: F.lpad(F.lower(F.hex(p["_first"])), 16, "0")), "")
    rows = rows.select(*keys, least(OWN).alias("_own"), least(EDITED).alias("_edited"), sha.alias("edited_sha256"))
    settled = _below(F.col("_own"), F.col("_words")) & _below(F.col("_edited"), F.col("_words")) if bounded else F.lit(True)
    return rows.select(*names, _digits(F.col("_own")).alias("fingerprint"), _digits(F.col("_edited")).alias("edited_fingerprint"),
                       "edited_sha256", settled.alias("_settled"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two signature columns."""
    same = lambda j: F.substring(F.col(a), 4 * j + 1, F.lit(4)) == F.substring(F.col(b), 4 * j + 1, F.lit(4))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), same)) / F.lit(float(samples))


def _following(keyed: DataFrame) -> DataFrame:
    """(id, digest, no_id, n_chars, next_id, next_digest, self, copies): the next document of each, ascending, around at the end.

    Rows equal in id and text are one row here: all copies but the last are
    followed by another copy of themselves (``self``).
    """
    known = (keyed.groupBy("id", "digest", "no_id").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies")))
    ordered = common.durable(assign_index(known.withColumn("_with_id", ~F.col("no_id")), ["_with_id", "id", "digest"], out="_at")
                             .drop("_with_id"))
    n = ordered.count()
    after = ordered.select(F.col("id").alias("next_id"), F.col("digest").alias("next_digest"),
                           F.pmod(F.col("_at") - 1, F.lit(max(n, 1))).alias("_at"))
    last = ordered.join(after, "_at").select("id", "digest", "no_id", "n_chars", "next_id", "next_digest",
                                             F.lit(False).alias("self"), F.lit(1).cast("bigint").alias("copies"))
    same = (ordered.where("copies > 1")
            .select("id", "digest", "no_id", "n_chars", F.col("id").alias("next_id"), F.col("digest").alias("next_digest"),
                    F.lit(True).alias("self"), (F.col("copies") - 1).alias("copies")))
    return common.durable(last.unionByName(same))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per input row.

    The edited text is the text with its last half (rounded down) replaced by as many of the first code
    points of the next document, or all of it.  Documents are ordered by id, null ids first, rows of
    one id by a 64-bit hash of their text; equal rows are interchangeable and follow each
    other.  A null text counts as empty; a single document is its own next.  Other columns are not read.
    Texts are shuffled once, the beginnings that go into other documents once more.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), body.alias("text"))
    rows = rows.select(F.coalesce("_id", F.lit(0)).alias("id"), F.xxhash64("text", F.col("_id").isNull()).alias("digest"),
                       F.col("_id").isNull().alias("no_id"), "text")
    pairs = _following(rows.select("id", "digest", "no_id", F.char_length("text").cast("bigint").alias("n_chars")))
    whole = rows.groupBy("id", "digest").agg(F.first("text").alias("text"))
    half = F.expr("cast(n_chars div 2 as int)")
    asked = pairs.select(F.col("next_id").alias("id"), F.col("next_digest").alias("digest"),
                         F.col("id").alias("_to"), F.col("digest").alias("_to_digest"), "n_chars", "self")
    heads = (whole.join(asked, ["id", "digest"])
             .select(F.col("_to").alias("id"), F.col("_to_digest").alias("digest"), "n_chars", "self",
                     F.expr("substring(text, 1, cast(n_chars div 2 as int))").alias("_head")))
    joined = whole.join(heads, ["id", "digest"])      # one row a document, and one (``self``) for its copies
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.col("_head"))
    edited = joined.select("id", "digest", "self", "text", edited.alias("edited"))
    few = max(1, pairs.count() // COUNTED_DOCS)
    known = known_samples(rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(few)) == 0), samples=samples)
    signed = pair_signatures(edited, ["id", "digest", "self"], known, samples)
    theirs = signed.where("NOT self").select(F.col("id").alias("next_id"), F.col("digest").alias("next_digest"), F.col("fingerprint").alias("_next"))
    found = pairs.join(theirs, ["next_id", "next_digest"]).join(signed, ["id", "digest", "self"])
    return (found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
                    likeness("fingerprint", "_next", samples).alias("near_next")))
