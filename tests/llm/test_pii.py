import random
import re

from pyspark.sql import functions as F

from neo.llm import pii as P
from tests.llm.conftest import odd_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = (lambda s: re.sub("[^0-9]", "", s))
    luhn = (lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0)
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_rules_on_random_text():
    rng = random.Random(7)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
             for letters in ("aB1.@-+ 0(9)%_é4", "1234567890.- +") for _ in range(8000)]
    for text in texts:
        got = sorted(((k, a, b) for k, a, b, base, _ in P.proposals(text) if base),
                     key=lambda s: (s[1], P.KINDS.index(s[0])))
        assert got == brute(text), text


def corpus(n=300):
    rng = random.Random(8)
    out = []
    for i in range(n):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        out.append((i, rng.choice([
            f"mail a{i}@mail{i}.example.com now", f"host 10.0.{i % 256}.7 and 10.0.{i}.999", f"call +1 (555) 555-{i:04d} x",
            f'token = "{secret}"', f"commit {secret[:20]}", "card 4111 1111 1111 1111", "card 4111 1111 1111 1112",
            "no data at all", f"ring (555) 555-{i:04d}"])))
    return out


def test_spans(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = P.find(df)
    got = {r.doc_id: r.spans for r in found.collect()}
    for i, text in rows:
        base = [(s.kind, s.first, s.last) for s in got[i] if s.base]
        assert base == brute(text)
        starts = [(s.first, s.kind_no) for s in got[i]]
        assert starts == sorted(starts) and all(s.base or 0.5 <= s.p <= 1 for s in got[i])
        if text.startswith("token"):
            assert [s.kind for s in got[i] if not s.base] == ["secret"]
        if text.startswith("commit"):
            assert not got[i]
    clean = {r.doc_id: r.text for r in P.redact(df, found).collect()}
    assert all("[email]" in clean[i] and "@" not in clean[i] for i, t in rows if t.startswith("mail"))
    assert all(clean[i] == t for i, t in rows if t == "no data at all")
    text = found.select("doc_id", P.joined(F.filter("spans", lambda s: s["base"])).alias("s"))
    assert all(r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(dict(rows)[r.doc_id])) for r in text.collect())


def test_odd_rows(odd, none):
    assert sorted([str(r.doc_id) for r in P.find(odd).collect()]) == sorted(str(r[0]) for r in odd_rows())
    assert P.find(none).count() == 0
    assert P.redact(odd, P.find(odd)).columns == odd.columns


def test_redaction_keeps_to_its_text(spark):
    """Rows of one id with different texts, and columns with the names of the join."""
    texts = {(1, "write to ann@example.org now"): "write to [email] now", (1, "host 10.20.30.40 of yesterday"): "host [ip] of yesterday",
             (None, "ask bob@example.org"): "ask [email]", (2, None): None}
    df = spark.createDataFrame([(i, t, "x", 7, "s") for i, t in texts], "doc_id int, text string, _id string, row_key int, spans string")
    out = P.redact(df, P.find(df))
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(i), str(t)) for (i, _), t in texts.items())


def test_trees_learn_from_every_candidate(spark):
    """No kind is cut to a sample, and a frequent kind weighs no more than the limit."""
    texts = [(i, f"mail a{i}@mail.example.com, host 10.0.0.{i % 400}") for i in range(2500)]
    spans = P.candidates(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = P.examples(spans, 100).toPandas()
    assert len(rows) == 5000 and rows[rows.kind == "email"].held_out.sum() > 700
    known = rows[~rows.held_out].groupby(["kind", "label"]).weight.sum()
    assert all(abs(w - 100) < 1e-6 for w in known)
