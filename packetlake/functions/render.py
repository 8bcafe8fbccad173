"""Rendering rules of the packet list and the packet detail, as Spark columns.

Every rule is a native expression, so a listing of the whole table is one
scan inside whole-stage code generation; nothing is computed on the driver.
Times are rendered in UTC unless a zone is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
NS_ABOVE = 10**15      # a raw timestamp above this reads as nanoseconds
US_ABOVE = 10**12      # above this: microseconds
MS_ABOVE = 10**9       # above this: milliseconds; otherwise seconds
INVALID_TIME = "Invalid timestamp"
TIME_FMT = "HH:mm:ss"
DATE_TIME_FMT = "yyyy/MM/dd HH:mm:ss"
PROTOCOL_NAMES = ["Unknown", "HttpRequest", "Http2Request", "HttpResponse", "Http2Response", "WebSocket"]
MISSING = "N/A"
NO_TEXT = "No text payload"
KIB = 1024
MIB = 1024 * 1024

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(c: Column, d: int) -> Column:
    """Integer division (``div``): exact on BIGINT, unlike ``/`` (double)."""
    return F.call_function("div", c, F.lit(d))


def _valid(ts: Column) -> Column:
    return ts.isNotNull() & (ts > 0)


# F1
def epoch_millis(ts, unit: str = "auto") -> Column:
    """Milliseconds since the epoch of a raw capture timestamp; null if invalid.

    ``unit="auto"`` decides by magnitude (strict ``>``): above 1e15 ns, above
    1e12 µs, above 1e9 ms, else seconds.  An explicit unit reads every value in
    that unit.
    """
    t = _c(ts)
    by_unit = {"ns": _div(t, 10**6), "us": _div(t, 10**3), "ms": t, "s": t * 1000}
    if unit == "auto":
        ms = (F.when(t > NS_ABOVE, _div(t, 10**6))
              .when(t > US_ABOVE, _div(t, 10**3))
              .when(t > MS_ABOVE, t)
              .otherwise(t * 1000))
    else:
        ms = by_unit[unit]
    return F.when(_valid(t), ms.cast("bigint"))


def _sub_ms_micros(ts, unit: str = "auto") -> Column:
    """The microseconds shown after the seconds: those *within* the millisecond."""
    t = _c(ts)
    if unit == "auto":
        return (F.when(t > NS_ABOVE, _div(t % 10**6, 1000))
                .when(t > US_ABOVE, t % 1000)
                .otherwise(F.lit(0))).cast("bigint")
    return {"ns": _div(t % 10**6, 1000), "us": t % 1000}.get(unit, F.lit(0)).cast("bigint")


# F2
def to_timestamp(ts, unit: str = "auto") -> Column:
    """The instant (``TIMESTAMP``) of a raw timestamp; null if invalid."""
    return F.timestamp_millis(epoch_millis(ts, unit))


def _utc_wall_clock(ts, unit: str) -> Column:
    """UTC wall-clock ``TIMESTAMP_NTZ`` of a raw value, independent of the session zone."""
    return F.timestamp_add("MILLISECOND", epoch_millis(ts, unit), F.expr(_EPOCH_NTZ))


def _wall(ts, unit: str, zone: str) -> Column:
    utc = _utc_wall_clock(ts, unit)
    if zone.upper() == "UTC":
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


# F3
def format_time(ts, include_date: bool = False, show_micros: bool = True,
                unit: str = "auto", zone: str = "UTC") -> Column:
    """``HH:mm:ss`` (or ``yyyy/MM/dd HH:mm:ss``) plus ``.µµµ`` when non-zero."""
    t = _c(ts)
    base = F.date_format(_wall(t, unit, zone), DATE_TIME_FMT if include_date else TIME_FMT)
    if show_micros:
        us = _sub_ms_micros(t, unit)
        base = F.concat(base, F.when(us > 0, F.concat(F.lit("."), F.lpad(us.cast("string"), 3, "0")))
                        .otherwise(F.lit("")))
    return F.when(_valid(t), base).otherwise(F.lit(INVALID_TIME))


# F4
def format_time_ns(ts, include_date: bool = False, zone: str = "UTC") -> Column:
    """Nanosecond values get ``.µµµnnn``; other values fall back to ``format_time``."""
    t = _c(ts)
    rem = t % 10**6
    ns_text = F.concat(
        F.date_format(_wall(t, "auto", zone), DATE_TIME_FMT if include_date else TIME_FMT),
        F.lit("."),
        F.lpad(_div(rem, 1000).cast("string"), 3, "0"),
        F.lpad((rem % 1000).cast("string"), 3, "0"))
    return (F.when(_valid(t) & (t > NS_ABOVE), ns_text)
            .otherwise(format_time(t, include_date=include_date, show_micros=True, zone=zone)))


# F5
def format_size(n) -> Column:
    """``0 B`` for missing/0/negative; ``n B``; one decimal ``KB``; one decimal ``MB``."""
    b = _c(n)
    return (F.when(b.isNull() | (b <= 0), F.lit("0 B"))
            .when(b < KIB, F.concat(b.cast("string"), F.lit(" B")))
            .when(b < MIB, F.format_string("%.1f KB", b.cast("double") / KIB))
            .otherwise(F.format_string("%.1f MB", b.cast("double") / MIB)))


# F6
def protocol_name(type_col) -> Column:
    t = _c(type_col)
    expr = F.when(t.isNull(), F.lit("Unknown"))
    for code, name in enumerate(PROTOCOL_NAMES):
        expr = expr.when(t == code, F.lit(name))
    return expr.otherwise(F.concat(F.lit("Unknown ("), t.cast("string"), F.lit(")")))


def _or_missing(s) -> Column:
    return F.coalesce(F.nullif(_c(s), F.lit("")), F.lit(MISSING))


# F7
def endpoint_label(ip, port) -> Column:
    """``ip:port``; empty ip → ``N/A``, missing port → 0."""
    return F.concat(_or_missing(ip), F.lit(":"), F.coalesce(_c(port), F.lit(0)).cast("string"))


# F8
def process_label(pname, pid) -> Column:
    """``pname (pid)``; empty name → ``N/A``, missing pid → ``N/A``."""
    return F.concat(_or_missing(pname), F.lit(" ("),
                    F.coalesce(_c(pid).cast("string"), F.lit(MISSING)), F.lit(")"))


def text_or_missing(s) -> Column:
    return _or_missing(s)


def _spaced(hex_pairs: Column) -> Column:
    return F.regexp_replace(hex_pairs, "(..)(?=.)", "$1 ")


# F9
def hex_dump(payload) -> Column:
    """``Binary data (n bytes):`` then 16 bytes a line: offset, ``: ``, bytes.

    The offset is lower-case hex, at least 4 digits; bytes 8..15 of a line are
    set off by two spaces.  Built per line (``n/16`` array elements), not per
    byte.
    """
    p = _c(payload)
    n = F.octet_length(p)
    lines = F.transform(
        F.sequence(F.lit(0), _div(F.greatest(n, F.lit(1)) - 1, 16).cast("int")),
        lambda k: _dump_line(p, k))
    body = F.when(n > 0, F.array_join(lines, "")).otherwise(F.lit(""))
    return F.concat(F.lit("Binary data ("), n.cast("string"), F.lit(" bytes):"), body)


def _dump_line(p: Column, k: Column) -> Column:
    off = F.lower(F.hex(k * 16))
    off = F.when(F.length(off) < 4, F.lpad(off, 4, "0")).otherwise(off)
    line = F.lower(F.hex(F.substring(p, k * 16 + 1, 16)))
    left, right = F.substring(line, 1, 16), F.substring(line, 17, 16)
    return F.concat(F.lit("\n"), off, F.lit(": "), _spaced(left),
                    F.when(F.length(right) > 0, F.concat(F.lit("  "), _spaced(right))).otherwise(F.lit("")))


# F10
def payload_render(is_binary, payload_utf8, payload_binary) -> Column:
    """Binary → hex dump; otherwise the text, or ``No text payload`` when empty."""
    return (F.when(_c(is_binary), hex_dump(payload_binary))
            .otherwise(F.coalesce(F.nullif(_c(payload_utf8), F.lit("")), F.lit(NO_TEXT))))


# F11
ISSUE_COLS = ["index", "timestamp", "uuid", "type", "length", "is_binary"]


def packet_issues(cols: list[str] = ISSUE_COLS) -> Column:
    """Array of ``"<col> is missing"`` for the required columns that are null."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in cols]))


def packet_valid(cols: list[str] = ISSUE_COLS) -> Column:
    return F.size(packet_issues(cols)) == 0
