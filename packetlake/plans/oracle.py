"""DuckDB statements that compute, independently, what each registered query returns.

The ``packets`` CTE writes the three payload columns *by construction* from
the fixture rules (which kind is text, binary or the third state), while the
Spark side computes them from the bytes; the two meet only in the result.
"""

from __future__ import annotations

TARGET = "index, timestamp, uuid, src_ip, src_port, dst_ip, dst_port, pid, pname, type, length, is_binary"
ALL_HEX = TARGET + ", payload_utf8, hex(payload_binary) AS payload_binary"

PACKETS_CTE = """
WITH ev AS (
  SELECT e.event_id AS index,
         epoch_us(e.ts) * 1000 AS timestamp,
         md5(cast(e.event_id AS varchar)) AS uuid,
         concat('192.168.', cast(e.user_id % 4 AS varchar), '.', cast(e.user_id % 250 AS varchar)) AS src_ip,
         cast(32768 + e.event_id % 28000 AS bigint) AS src_port,
         CASE WHEN e.event_id % 11 = 0 THEN '127.0.0.1'
              ELSE concat('104.16.', cast(e.event_id % 3 AS varchar), '.', cast(e.event_id % 200 AS varchar)) END AS dst_ip,
         cast(CASE e.event_id % 7 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 8080 WHEN 3 THEN 53
                                  WHEN 4 THEN 3306 ELSE 443 END AS bigint) AS dst_port,
         cast(1000 + e.user_id AS int) AS pid,
         CASE e.event_id % 5 WHEN 0 THEN 'curl' WHEN 1 THEN 'wget' WHEN 2 THEN 'chrome'
                             WHEN 3 THEN 'python3' ELSE 'mDNSResponder' END AS pname,
         cast(e.event_id % 7 AS bigint) AS type,
         CASE WHEN e.event_id % 97 = 0 THEN 6 ELSE e.event_id % 6 END AS kind,
         CASE WHEN e.event_id % 97 = 0 THEN NULL
              WHEN e.event_id % 6 = 0 THEN concat('GET /item/', cast(e.user_id AS varchar), ' HTTP/1.1', chr(10),
                                                  'Host: shop.example.com')
              WHEN e.event_id % 6 = 1 THEN e.props
              WHEN e.event_id % 6 = 2 THEN concat('POST /login password=p', cast(e.event_id AS varchar))
              WHEN e.event_id % 6 = 4 THEN coalesce(d.text, '')
              WHEN e.event_id % 6 = 5 THEN '' END AS txt
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id // 6 % (SELECT count(*) FROM documents)
),
packets AS (
  SELECT index, timestamp, uuid, src_ip, src_port, dst_ip, dst_port, pid, pname, type,
         cast(CASE kind WHEN 3 THEN 18 WHEN 6 THEN 121 ELSE octet_length(encode(txt)) END AS bigint) AS length,
         kind = 3 AS is_binary,
         coalesce(txt, '') AS payload_utf8,
         CASE kind WHEN 3 THEN unhex('ffd8' || md5(cast(index AS varchar)))
                   WHEN 6 THEN unhex(repeat('61', 120) || 'ff')
                   ELSE ''::blob END AS payload_binary
  FROM ev
)
"""


def over_packets(body: str) -> str:
    """A statement over the ``packets`` CTE."""
    return PACKETS_CTE + body


def feed(condition: str, after: int) -> str:
    """Mode A as the reference composes it."""
    return over_packets(f"SELECT {TARGET} FROM packets WHERE ({condition}) AND index > {after} ORDER BY index")


def full(sql: str, after: int) -> str:
    """Mode B as the reference composes it."""
    return over_packets(f"SELECT {TARGET} FROM ({sql}) AS user_view WHERE index > {after} ORDER BY index")


# Epoch rules (F1/F3/F4) over a raw value ``t``.
def millis(t: str) -> str:
    return (f"CASE WHEN {t} IS NULL OR {t} <= 0 THEN NULL WHEN {t} > 1000000000000000 THEN {t} // 1000000 "
            f"WHEN {t} > 1000000000000 THEN {t} // 1000 WHEN {t} > 1000000000 THEN {t} ELSE {t} * 1000 END")


def sub_ms_micros(t: str) -> str:
    return (f"CASE WHEN {t} > 1000000000000000 THEN ({t} % 1000000) // 1000 "
            f"WHEN {t} > 1000000000000 THEN {t} % 1000 ELSE 0 END")


def fmt_time(t: str, with_date: bool) -> str:
    pattern = "%Y/%m/%d %H:%M:%S" if with_date else "%H:%M:%S"
    us = sub_ms_micros(t)
    return (f"CASE WHEN {t} IS NULL OR {t} <= 0 THEN 'Invalid timestamp' ELSE "
            f"strftime(epoch_ms({millis(t)}), '{pattern}') || "
            f"CASE WHEN {us} > 0 THEN '.' || lpad(cast({us} AS varchar), 3, '0') ELSE '' END END")


def fmt_time_ns(t: str, with_date: bool) -> str:
    pattern = "%Y/%m/%d %H:%M:%S" if with_date else "%H:%M:%S"
    return (f"CASE WHEN {t} > 1000000000000000 THEN strftime(epoch_ms({t} // 1000000), '{pattern}') || '.' || "
            f"lpad(cast(({t} % 1000000) // 1000 AS varchar), 3, '0') || lpad(cast({t} % 1000 AS varchar), 3, '0') "
            f"ELSE {fmt_time(t, with_date)} END")


def fmt_size(b: str) -> str:
    # round() first: printf alone rounds ties to even, the rule rounds them up.
    return (f"CASE WHEN {b} IS NULL OR {b} <= 0 THEN '0 B' WHEN {b} < 1024 THEN cast({b} AS varchar) || ' B' "
            f"WHEN {b} < 1048576 THEN printf('%.1f KB', round({b} / 1024, 1)) "
            f"ELSE printf('%.1f MB', round({b} / 1048576, 1)) END")


def protocol(t: str) -> str:
    return (f"CASE WHEN {t} IS NULL THEN 'Unknown' WHEN {t} = 0 THEN 'Unknown' WHEN {t} = 1 THEN 'HttpRequest' "
            f"WHEN {t} = 2 THEN 'Http2Request' WHEN {t} = 3 THEN 'HttpResponse' WHEN {t} = 4 THEN 'Http2Response' "
            f"WHEN {t} = 5 THEN 'WebSocket' ELSE 'Unknown (' || cast({t} AS varchar) || ')' END")


def endpoint(ip: str, port: str) -> str:
    return f"coalesce(nullif({ip}, ''), 'N/A') || ':' || cast(coalesce({port}, 0) AS varchar)"


def process(name: str, pid: str) -> str:
    return f"coalesce(nullif({name}, ''), 'N/A') || ' (' || coalesce(cast({pid} AS varchar), 'N/A') || ')'"


def hexdump(b: str) -> str:
    """The dump written byte by byte, as the viewer builds it."""
    h = f"hex({b})"
    per_byte = (f"CASE WHEN i % 16 = 0 THEN chr(10) || format('{{:04x}}', i) || ': ' || lower(substring({h}, 2 * i + 1, 2)) "
                f"WHEN i % 8 = 0 THEN '  ' || lower(substring({h}, 2 * i + 1, 2)) "
                f"ELSE ' ' || lower(substring({h}, 2 * i + 1, 2)) END")
    return (f"'Binary data (' || cast(octet_length({b}) AS varchar) || ' bytes):' || "
            f"coalesce(array_to_string(list_transform(range(0, octet_length({b})), lambda i: {per_byte}), ''), '')")


def render_payload(is_bin: str, utf8: str, b: str) -> str:
    return f"CASE WHEN {is_bin} THEN {hexdump(b)} ELSE coalesce(nullif({utf8}, ''), 'No text payload') END"
