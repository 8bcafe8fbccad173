"""op5: base spans against the patterns themselves, disclosure against a brute-force count."""

import hashlib
import math
import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from packetlake.llm import pii, queries
from tests.llm.conftest import SF001

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=600)
@given(st.text(alphabet="a.@-+ 0129()é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_known_spans():
    text = "x a.b@c.de, 1.2.3.4 300.1.1.1 0001.02.3.4, 4111 1111 1111 1111, 4111111111111112, +1 (017) 555-7713 +12"
    assert pii.base_spans(text) == plain_spans(text)
    assert [k for k, _, _ in plain_spans(text)] == ["email", "ip", "ip", "card", "phone"]


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "@" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@b." * 80_000):
        pii.base_spans(text)


def test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = queries.op5_pii_disclosure(spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        base = pii.span_text(spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in base.split(",") if s]


def disclosed(texts):
    """{row: [(start, end, action)]} by counting over all rows."""
    n, docs = len(texts), [t or "" for t in texts]
    df, both, ent = {}, {}, {}
    for t in docs:
        for w in {pii.term_of(p) for p in t.split()}:
            df[w] = df.get(w, 0) + 1
        found = pii.base_spans(t)
        for e in {(k, t[a:b]) for k, a, b in found}:
            ent[e] = ent.get(e, 0) + 1
        for p in {((k, t[a:b]), w) for k, a, b in found for w, s, z in pii.near_terms(t, a, b)
                  if not any(s < y and z > x for _, x, y in found)}:
            both[p] = both.get(p, 0) + 1
    out = {}
    for i, t in enumerate(docs):
        best = {}
        found = pii.base_spans(t)
        for k, a, b in found:
            e = (k, t[a:b])
            for w, s, z in pii.near_terms(t, a, b):
                if both.get((e, w), 0) >= 3 and ent[e] < n and not any(s < y and z > x for _, x, y in found):
                    ratio = math.log2(both[e, w] * n / (ent[e] * df[w])) / math.log2(n / ent[e])
                    if ratio >= pii.GENERALISE - 1e-12:
                        best[s, z] = max(best.get((s, z), 0), ratio)
        out[i] = [(s, z, "remove" if r >= pii.REMOVE else "generalise") for (s, z), r in sorted(best.items())]
    return out


def corpus():
    rnd = random.Random(2)
    common = [f"w{i}" for i in range(60)]
    rows = [" ".join(rnd.choices(common, k=25)) for _ in range(150)]
    rows += [" ".join(rnd.choices(common, k=6)) + " Jane Dorvik, jane@mail.example.org called " + " ".join(rnd.choices(common, k=6)) for _ in range(5)]
    rows += ["also Jane alone", "mail bob@x.org twice bob@x.org", None, "", "jane@mail.example.org"]
    return rows


def test_disclosing_terms(spark, make_docs):
    texts = corpus()
    rows = pii.find_spans(make_docs(enumerate(texts))).collect()
    want = disclosed(texts)
    assert {r.doc_id: [tuple(t) for t in r.terms or ()] for r in rows} == want
    assert any(want.values())
    out = {r.doc_id: r.text for r in pii.sanitised(make_docs(enumerate(texts)), pii.find_spans(make_docs(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        if not want[i] and not pii.base_spans(t or ""):
            assert out[i] == t
        else:
            assert "example.org" not in out[i] and "Dorvik" not in out[i]


def test_odd_rows(spark, make_docs):
    rows = [(None, "a@b.cd " * 3), (1, None), (1, ""), (2, "a@b.cd x"), (2, "a@b.cd x"), (2, "other a@b.cd"), (3, "y" * 50000 + " a@b.cd " + "z " * 50000)]
    got = pii.find_spans(make_docs(rows)).collect()
    assert len(got) == len(rows) and sum(r.n_email for r in got) == 7
    clean = pii.sanitised(make_docs(rows), pii.find_spans(make_docs(rows)))
    assert clean.columns == make_docs(rows).columns and clean.count() == len(rows)
    assert pii.find_spans(make_docs([])).count() == 0
    assert pii.sanitised(make_docs([]), pii.find_spans(make_docs([]))).count() == 0


def test_rewrite():
    text = "Call Bob at b@c.de or 12 now"
    assert pii.rewrite(text, "email:12:18,term:5:8,term:22:24,term:25:28", {25}) == "Call [NAME] at [EMAIL] or [NUMBER] "


def test_terms_of_whole_documents(spark, make_docs):
    """A term far from its entity counts, and goes at all its places: in its documents, and where the entity does not stand."""
    draw = random.Random(4)
    filler = lambda n: " ".join(f"w{draw.randrange(40)}" for _ in range(n))
    texts = [filler(60) for _ in range(300)]
    texts += [f"{filler(9)} Quillon {filler(90)} +1 (017) 555-7713 {filler(9)} Quillon" for _ in range(5)] + [f"{filler(30)} Quillon {filler(5)}"]
    docs = make_docs(enumerate(texts))
    for everywhere in (False, True):
        got = {r.doc_id: {texts[r.doc_id][t.start:t.stop] for t in r.terms or ()} for r in pii.find_spans(docs, everywhere=everywhere).collect()}
        assert got == {i: {"Quillon"} if 300 <= i < 305 + everywhere else set() for i in range(306)}
    out = {r.doc_id: r.text for r in pii.sanitised(docs, pii.find_spans(docs, everywhere=True)).collect()}
    assert not any("Quillon" in t for t in out.values()) and all(out[i] == t for i, t in enumerate(texts[:300]))


@settings(max_examples=300)
@given(st.lists(st.none() | st.text(alphabet="aB.-é7 \x1c\x85\u2003\n\t", max_size=30), max_size=5))
def test_texts_are_split_at_once_as_one_by_one(texts):
    of, piece, pieces = pii._split(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        words = [pieces[p] for p in piece[of == i]]
        assert words == (text or "").split()
        every = pii.words_outside(text or "", [])
        assert sorted(pii.words_among(text or "", set(words))) == sorted(every)
        some = set(words[::2])
        asked = [m.span() for m in re.finditer(r"\S+", text or "") if m.group() in some]
        assert sorted(pii.words_among(text or "", some)) == sorted(w for w in every if any(a <= w[1] and w[2] <= b for a, b in asked))
