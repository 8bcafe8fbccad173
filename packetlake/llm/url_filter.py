"""URL rules by a blocked Bloom filter and an exact hash join, in DataFrame operations only.

A rule (action, host, path) is listed under its canonical URL, host followed
by path.  A page can only fit rules whose host is a suffix of its host at a
label and whose path is a prefix of its path, so its candidates are built from
the label counts and path lengths that the rules have.  A blocked Bloom filter
of the listed URLs (one 64-bit word per block) passes the possible hits, and
the exact hash join against the rules removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 20     # bound of the broadcast filter: 64-bit words (8 MB); more rules only raise its false positives
RULES_PER_BLOCK = 4      # 16 bits of a word for each rule
BITS = 4                 # bits a rule sets in its word


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, lower).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _word(key: Column) -> Column:
    """The bits of ``key`` inside its word, from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    bits = None
    for i in range(BITS):
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        bits = one if bits is None else bits.bitwiseOR(one)
    return bits


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, word): the filter's words that hold a bit, at most ``blocks`` rows."""
    return (keys.select(_block(F.col(key), blocks).alias("block"), _word(F.col(key)).alias("word"))
            .groupBy("block").agg(F.bit_or("word").alias("word")))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules`` has action ('allow' or 'block'), host (lower case) and path.  The
    longest rule that fits wins (then the one with the longer host, then allow);
    a page that no rule fits is allowed, as it is not listed.  Null or
    ``://``-less urls have an empty host and path and fit no rule.  Repeated
    rows and null ids stay; other columns are not read.
    """
    rules = rules.select("action", "host", "path").where("host is not null and path is not null").distinct()
    listed = rules.withColumn("rule", F.concat("host", "path"))
    # The filter's size and the shapes of the rules: a handful of numbers.
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
                       F.collect_set(F.length("path")).alias("lengths")).first()
    blocks = min(MAX_BLOCKS, max(1, -(-shape["n"] // RULES_PER_BLOCK)))

    asked = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                         url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    # One row per (host, path) and candidate; the same host and path meet before they are looked up.
    distinct = asked.select("host", "path").distinct()
    n_labels = F.size(F.split("host", r"\."))
    none = F.array().cast("array<struct<host:string,path:string>>")
    candidates = F.concat(none, *[
        F.when((n_labels >= k) & (F.length("path") >= n), F.array(F.struct(
            F.substring_index("host", ".", -k).alias("host"), F.substring("path", 1, n).alias("path")))).otherwise(none)
        for k in sorted(shape["labels"]) for n in sorted(shape["lengths"])])
    asked_keys = (distinct.withColumn("c", F.explode(candidates))
                  .select("host", "path", F.col("c.host").alias("rule_host"), F.col("c.path").alias("rule_path"),
                          F.concat("c.host", "c.path").alias("key")))
    words = bloom_filter(listed, "rule", blocks).withColumnRenamed("block", "_block")
    possible = (asked_keys.withColumn("_block", _block(F.col("key"), blocks))
                .join(F.broadcast(words), "_block")
                .where(F.col("word").bitwiseAND(_word(F.col("key"))) == _word(F.col("key"))))
    exact = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action", "rule")
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"),
                          F.when(F.col("action") == "allow", 1).otherwise(0).alias("allow"), "rule", "action"))
    judged = (possible.join(exact, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best.alias("best"))
              .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action")))
    return (asked.join(judged, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict")))
