import hashlib
import math
import re
from collections import defaultdict

import pytest
from conftest import sentence

from changelens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, m.start(), m.end(), m[0]))
    return found


TEXTS = [
    "mail a.b@c.de, ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (988) 555-2485 end",
    "x a@b.c_d@e.f 999.1.1.1 1.2.3.4.5.6.7.8 +1 10.0.0.1 22 33 44 000.00000001.255.0",
    "4111111111111111 4111111111111112 \U0001f600 q@w.er 4111-1111-1111-1111",
    "@ a@b a@b. a@.b %@x.y.z-w a@b.c@d.e +12345678 +123456789 +1234567890123456 +1 2",
    "é4111111111111111é ü+49 30 1234567ü \n1.2.3.4\n",
    "1" * 5000 + " " + "a" * 5000 + "@ " + "b.c@d." * 300 + "1.2.3." * 500,
    *[f"{sentence(i)} u{i}@h{i}.org {sentence(i + 1)} 10.1.2.{i % 300}" for i in range(20)],
]


def test_base_spans_equal_a_plain_reading(spark, documents):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in pii.span_report(documents(rows)).collect()}
    for i, text in enumerate(TEXTS):
        spans = base(text)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), text[:80]
        assert got[i]["spans"] == written
        for kind in PATTERNS:
            assert got[i][f"n_{kind}"] == sum(s[0] == kind for s in spans)


def test_many_matches_in_one_text(documents):
    text = " ".join(f"a{i}@b.cd" for i in range(3000))
    row = pii.span_report(documents([(1, text, "a")])).collect()[0]
    assert row["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base(text))


def secret_rows():
    rows = []
    for i in range(12):
        rows.append((i, f"{sentence(i, 9)} ask Zebulon about boss@corp.example today {sentence(i + 50, 9)}", "a"))
    for i in range(12, 400):
        rows.append((i, f"{sentence(i, 12)} about today ask", "a"))
    rows.append((400, "zebulon is quoted here without the address", "a"))
    rows.append((401, f"boss@corp.example again and Zebulon, ZEBULON. {sentence(7, 9)}", "b"))
    return rows


def test_disclosing_terms_equal_the_definition(spark, documents):
    rows = secret_rows()
    settings = pii.Disclosure()
    docs = documents(rows)
    found = pii.base_spans(docs, settings)
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosing_terms(docs, found, settings).collect()}
    n = len(rows)
    holds = [i for i, t, _ in rows if "boss@corp.example" in t]
    near, contexts = defaultdict(set), defaultdict(set)
    words_of = [set(re.findall(r"[^\W\d_]+", t.lower())) for _, t, _ in rows]
    for i in holds:
        text = rows[i][1]
        for m in re.finditer("boss@corp.example", text):
            left = re.findall(r"[^\W\d_]+", re.sub(r"^[^\W\d_]+", " ", text[max(0, m.start() - 200) : m.start()].lower()))[-8:]
            right = re.findall(r"[^\W\d_]+", re.sub(r"[^\W\d_]+$", " ", text[m.end() : m.end() + 200].lower()))[:8]
            context = tuple(sorted({w for w in left + right if len(w) >= 3}))
            for w in context:
                near[w].add(i)
                contexts[w].add(context)
    want = {}
    for w in near:
        given = min(1.0, len(near[w]) / sum(w in ws for ws in words_of))
        share = 1 - math.log(given) / math.log(len(holds) / n)
        if len(contexts[w]) >= 3 and share >= settings.generalise_at:
            want["email:boss@corp.example", w] = share
    assert got == pytest.approx(want)
    assert ("email:boss@corp.example", "zebulon") in got and ("email:boss@corp.example", "ask") not in got


def test_terms_are_marked_where_the_entity_is(documents):
    rows = secret_rows()
    got = {r["doc_id"]: r for r in pii.span_report(documents(rows)).collect()}
    text = rows[401][1]
    marked = [s.split(":") for s in got[401]["spans"].split(",") if s.startswith("term")]
    assert [text[int(a) : int(b)] for _, a, b in marked][:2] == ["Zebulon", "ZEBULON"]
    assert got[400]["n_term"] == 0 and got[0]["n_term"] >= 1
    assert all(got[i]["spans"] == "" for i in range(12, 400))


def test_sanitised_text(documents):
    rows = [*secret_rows(), (500, None, "a"), (501, "", "a"), (502, "+1 10.0.0.1 22 33 44 x@y.zz\u00e9", "a")]
    docs = documents(rows)
    out = pii.sanitised(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(got) == len(rows)
    assert "boss@" not in "".join(t or "" for t in got.values())
    assert "ebulon" not in got[3] and "[email]" in got[3] and got[400] == rows[400][1]
    assert got[500] is None and got[501] == "" and got[502] == "[phone] [email]\u00e9"
    assert all(got[i] == rows[i][1] for i in range(12, 400))


def test_messy_rows(messy, messy_rows, empty):
    got = pii.span_report(messy).collect()
    assert len(got) == len(messy_rows)
    nine = next(r for r in got if r["doc_id"] == 9)
    assert nine["n_email"] == 300
    assert all(r["spans"] == "" for r in got if r["doc_id"] in (3, 4, 5))
    assert pii.span_report(empty).collect() == [] and pii.sanitised(empty).collect() == []
    assert pii.sanitised(messy).count() == len(messy_rows)


def test_no_python_in_the_plan(documents):
    plan = pii.sanitised(documents([(1, "a@b.cd", "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
