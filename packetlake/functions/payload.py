"""Payload classification: text, binary, or the third state.

A payload is *binary* unless its first 100 bytes are UTF-8, where a character
cut off by the end of those 100 bytes still counts as UTF-8.  A non-binary
payload goes to ``payload_utf8`` only if the *whole* payload is valid UTF-8;
otherwise both columns are empty/kept as bytes ("third state"): ``is_binary``
false, empty text, bytes in ``payload_binary``.

Everything is a native expression (hex + regex on at most 200 hex digits,
``is_valid_utf8``), so it runs inside whole-stage codegen with no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: number of leading bytes inspected by the text/binary test.
SNIFF_LEN = 100

# UTF-8 well-formedness (RFC 3629, table 3-7 of the Unicode standard) written
# over the upper-case hex text of the bytes, two hex digits per byte.
_CONT = "[89AB][0-9A-F]"  # 80..BF
_CHAR = "|".join([
    "[0-7][0-9A-F]",                                  # 00..7F
    f"(?:C[2-9A-F]|D[0-9A-F]){_CONT}",                # C2..DF 80..BF
    f"E0[AB][0-9A-F]{_CONT}",                         # E0 A0..BF 80..BF
    f"E[1-9A-CEF]{_CONT}{_CONT}",                     # E1..EC, EE..EF
    f"ED[89][0-9A-F]{_CONT}",                         # ED 80..9F 80..BF
    f"F0[9AB][0-9A-F]{_CONT}{_CONT}",                 # F0 90..BF
    f"F[1-3]{_CONT}{_CONT}{_CONT}",                   # F1..F3
    f"F48[0-9A-F]{_CONT}{_CONT}",                     # F4 80..8F
])
# A proper prefix of one of the multi-byte forms above (cut off at the end).
_TAIL = "|".join([
    "C[2-9A-F]|D[0-9A-F]",
    "E0(?:[AB][0-9A-F])?",
    f"E[1-9A-CEF](?:{_CONT})?",
    "ED(?:[89][0-9A-F])?",
    f"F0(?:[9AB][0-9A-F](?:{_CONT})?)?",
    f"F[1-3](?:{_CONT}(?:{_CONT})?)?",
    f"F4(?:8[0-9A-F](?:{_CONT})?)?",
])
UTF8_PREFIX_HEX_RX = f"^(?:{_CHAR})*(?:{_TAIL})?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_utf8_prefix(payload) -> Column:
    """True when the first ``SNIFF_LEN`` bytes are UTF-8, a cut-off tail allowed.

    The common case (a wholly valid prefix) is answered by ``is_valid_utf8``;
    only the rest pays for the regex over the hex text.
    """
    head = F.substring(_col(payload), 1, SNIFF_LEN)
    return (F.when(F.is_valid_utf8(head.cast("string")), F.lit(True))
            .otherwise(F.hex(head).rlike(UTF8_PREFIX_HEX_RX)))


def is_binary(payload) -> Column:
    """``is_binary`` of a payload."""
    return ~is_utf8_prefix(payload)


def text_ok(payload, binary_flag: Column | None = None) -> Column:
    """The payload goes to ``payload_utf8`` (not binary and wholly valid)."""
    flag = is_binary(payload) if binary_flag is None else binary_flag
    return ~flag & F.is_valid_utf8(_col(payload).cast("string"))


def split_payload(payload, binary_flag: Column | None = None) -> tuple[Column, Column]:
    """(``payload_utf8``, ``payload_binary``) of a payload."""
    ok = text_ok(payload, binary_flag)
    p = _col(payload)
    utf8 = F.when(ok, p.cast("string")).otherwise(F.lit(""))
    binary = F.when(ok, F.lit(bytearray())).otherwise(p)
    return utf8, binary


def classify(df, payload: str = "payload"):
    """Add ``is_binary``, ``payload_utf8``, ``payload_binary``; drop ``payload``."""
    flagged = df.withColumn("is_binary", is_binary(payload))
    utf8, binary = split_payload(payload, F.col("is_binary"))
    return flagged.withColumn("payload_utf8", utf8).withColumn("payload_binary", binary).drop(payload)
