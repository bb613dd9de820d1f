"""Personal data: base spans against plain regular expressions, found spans by learnt patterns, odd rows."""

import hashlib
import re

import duckdb
import pytest

from assayloom.llm import pii as P
from small_tables import docs_of  # noqa: F401

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def fine(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if fine(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


ODD = [
    None, "", "a@b.c.d@e.f g@h", "a@b.c_x@d.e-f.g", "x@y.z" * 40, "1.2.3.4.5.6.7.8 .9.9.9.9 256.1.1.1 1.2.3.0000255 01.2.3.4", "é" * 50 + "😀 4111 1111 1111 1111-",
    "4111111111111111 4111-1111-1111-1111 41111111111111112 0 1 2", "+1 (052) 555-0934 +12345 ++49 30 1234567890 +1234567890123456", "1" * 5000, "a" * 20000 + "@" + "b." * 3000 + "c",
    "7 " * 4000, "@@@", "+", "1.1.1", "x@y", "4111 1111  1111 1111", "a.b.c.d@e.f,4242424242424242+15555550100;10.0.0.1",
]


def test_base_spans(docs_of):
    docs = docs_of(ODD, extra="base")
    for r in P.find(docs).selectExpr("doc_id", "base", "spans").collect():
        got = ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.base)
        assert got == base(ODD[r.doc_id]), ODD[r.doc_id][:60]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_patterns_find_what_has_no_known_shape(docs_of):
    known = [f'see token = "{hashlib.sha1(str(i).encode()).hexdigest()}" here' for i in range(8)]
    new = ['see token = "ZX-99817-QQ-1234" here', 'see token = "" here', "serial ZX-99817-AA-1234 stays clean", "call 20240101-0001 is no secret"]
    docs = docs_of(known + new)
    spans = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in P.find(docs).collect()}
    assert all(spans[i] == [("secret", 13, 53)] for i in range(8))
    assert spans[8] == [("secret", 13, 29)] and not spans[9] and not spans[10] and not spans[11]


BOOTSTRAP = {
    "email": ("please mail ", lambda i: f"user{chr(97 + i)}@site.org"), "ip": ("the host ", lambda i: f"10.0.0.{i}"),
    "card": ("card number: ", lambda i: next(f"4111 1111 11{i:02d} {k:04d}" for k in range(10) if luhn(f"4111111111{i:02d}{k:04d}"))),
    "phone": ("call me: ", lambda i: f"+1 (974) 555-34{i:02d}"),
    "secret": ('a very long key before it, token="', lambda i: hashlib.sha1(str(i).encode()).hexdigest()),
}


def test_every_kind_bootstraps_a_pattern(docs_of):
    texts = [f"we said {before}{one(i)} today" for before, one in BOOTSTRAP.values() for i in range(8)]
    new = [f"we said {before}ZX-99817-QQ-1234 today" for before, _ in BOOTSTRAP.values()]
    far = "x" * 60 + "\u00e9="  # what touches a token counts whole, however long
    texts += [far + hashlib.sha1(f"far{i}".encode()).hexdigest() for i in range(8)]
    clean = ["x" * 50 + "\u00e9=ZX-99817-QQ-1234", "serial ZX-99817-AA-1234"]
    spans = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in P.find(docs_of(texts + new + clean)).collect()}
    for i, (kind, (before, _)) in enumerate(BOOTSTRAP.items()):
        at = len("we said ") + len(before)
        assert spans[len(texts) + i] == [(kind, at, at + 16)], kind
        assert {s[0] for j in range(8 * i, 8 * i + 8) for s in spans[j]} == {kind}
    assert not spans[len(texts) + 5] and not spans[len(texts) + 6]


def test_a_common_context_of_mixed_tokens_is_not_believed(docs_of):
    texts = [f"the code {i:08d}x" for i in range(30)] + ["the code " + "a1" * 20]
    spans = {r.doc_id: r.spans for r in P.find(docs_of(texts)).collect()}
    assert not any(spans[i] for i in range(30)) and len(spans[30]) == 1


def test_rows(docs_of):
    docs = docs_of([(None, "a@b.c", "s"), (5, "a@b.c", "s"), (5, "a@b.c", "s")])
    assert sorted((r.doc_id or 0, len(r.base)) for r in P.find(docs).collect()) == [(0, 1), (5, 1), (5, 1)]
    assert P.find(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["n_email", "n_ip", "n_card", "n_phone"])
def test_whole_table(spark, folder, name, _cache={}):
    if not _cache:
        _cache.update({r.doc_id: r for r in P.op2(spark, folder).collect()})
    kind = name[2:]
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall():
        spans = base(text)
        assert _cache[i][name] == spans.count(kind + ":")
        assert _cache[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(_cache[i].spans.split(","))
