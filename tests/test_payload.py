"""text/binary/third-state split, byte by byte."""

from hypothesis import given, settings, strategies as st

from packetlake.functions.payload import SNIFF_LEN, classify

# (bytes, is_binary, text or None, binary kept)
CASES = [
    (b"", False, "", False),
    (b"GET / HTTP/1.1", False, "GET / HTTP/1.1", False),
    (b"\x00A", False, "\x00A", False),
    (b"\xff\xd8", True, "", True),
    (b"a" * 99 + b"\xc3\xa9", False, "a" * 99 + "é", False),
    (b"abc\xe2\x82", False, "", True),
    (b"a" * 99 + b"\xff", True, "", True),
    (b"a" * 100 + b"\xff", False, "", True),
    (b"\xed\xa0", True, "", True),
    (b"\xed\xa0\x80", True, "", True),
    (b"\xc0\x80", True, "", True),
    (b"\xf4\x90\x80\x80", True, "", True),
    (b"\xf4\x8f\xbf", False, "", True),
]


def _classify(spark, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload binary")
    out = classify(df).orderBy("i").collect()
    return [(r.is_binary, r.payload_utf8, bytes(r.payload_binary)) for r in out]


def test_fixture_cases(spark):
    got = _classify(spark, [c[0] for c in CASES])
    for (payload, is_bin, text, kept), (g_bin, g_text, g_bytes) in zip(CASES, got):
        assert g_bin == is_bin, payload
        assert g_text == text, payload
        assert g_bytes == (payload if kept else b""), payload


# A byte-wise model of "valid UTF-8, a cut-off last character allowed".
def _seq_len_and_second(b0):
    if b0 < 0x80:
        return 1, None
    if 0xC2 <= b0 <= 0xDF:
        return 2, (0x80, 0xBF)
    if b0 == 0xE0:
        return 3, (0xA0, 0xBF)
    if 0xE1 <= b0 <= 0xEC or 0xEE <= b0 <= 0xEF:
        return 3, (0x80, 0xBF)
    if b0 == 0xED:
        return 3, (0x80, 0x9F)
    if b0 == 0xF0:
        return 4, (0x90, 0xBF)
    if 0xF1 <= b0 <= 0xF3:
        return 4, (0x80, 0xBF)
    if b0 == 0xF4:
        return 4, (0x80, 0x8F)
    return 0, None


def model_prefix_ok(data: bytes) -> bool:
    data = data[:SNIFF_LEN]
    i = 0
    while i < len(data):
        n, second = _seq_len_and_second(data[i])
        if n == 0:
            return False
        for k in range(1, n):
            if i + k >= len(data):
                return True  # cut off by the end: still counts
            lo, hi = second if k == 1 else (0x80, 0xBF)
            if not lo <= data[i + k] <= hi:
                return False
        i += n
    return True


def model(data: bytes):
    is_bin = not model_prefix_ok(data)
    if is_bin:
        return True, "", data
    try:
        return False, data.decode("utf-8"), b""
    except UnicodeDecodeError:
        return False, "", data


_byte_soup = st.lists(
    st.one_of(st.binary(min_size=0, max_size=4),
              st.sampled_from([b"\xc3\xa9", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"\xed\x9f\xbf", b"\xed\xa0\x80",
                               b"\xf4\x8f\xbf\xbf", b"\xf4\x90", b"\xe0\xa0", b"\xe0\x9f", b"\xc1\xbf", b"a" * 40])),
    max_size=12).map(b"".join)


@settings(max_examples=25, deadline=None)
@given(st.lists(_byte_soup, min_size=1, max_size=40))
def test_against_model(spark, payloads):
    got = _classify(spark, payloads)
    for payload, g in zip(payloads, got):
        assert g == model(payload), payload


def test_model_agrees_on_fixture_cases():
    for payload, is_bin, text, kept in CASES:
        assert model(payload) == (is_bin, text, payload if kept else b"")


def test_classification_plan_has_no_python(spark):
    df = spark.createDataFrame([(b"x",)], "payload binary")
    plan = classify(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
