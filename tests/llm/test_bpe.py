"""BPE against the tokenizers library, on whole tables and on odd texts."""

import struct

import duckdb
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from assayloom.llm import bpe
from conftest import FOLDER
from small_tables import docs_of  # noqa: F401

PATH = bpe.vocabulary()
REFERENCE = Tokenizer.from_file(PATH)


def expected(text):
    ids = REFERENCE.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), REFERENCE.decode(ids, skip_special_tokens=False)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall():
        assert got[i] == expected(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aaabceinoorsttth'' .,!0123ÉéßñΣÀİ日😀ﬁ\t\ń \u0085\x1c​ǅ½²")), max_size=60))
def test_odd_letters(text):
    tool = bpe.codec(PATH)
    assert tool.encode(text) == expected(text)[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|end", "a", " ", "'s", "Σ", "́", "</w>"]), max_size=9))
def test_special_strings(parts):
    assert bpe.codec(PATH).encode("".join(parts)) == expected("".join(parts))[0]


def test_rows(docs_of):
    texts = ["aaaaaaaaaaaaaaaaaaaaaaab" * 2000, "", None, "x y", "x y", "word " * 50_000]
    docs = docs_of(texts, extra="ids")
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, t in enumerate(texts):
        ids, decoded = expected(t)
        assert got[i] == (len(ids) // 4, ids, decoded)
    assert bpe.encode(docs.where("false"), PATH).count() == 0


def test_caches_let_old_entries_go(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 1500)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 2)
    tool = bpe.Codec(PATH)
    for text in ("one two three four five", "six seven one two", "one nine", "x" * 5000, "one six", "two", "ten one"):
        assert tool.encode(text) == expected(text)[0]
        assert tool.runs.held <= 1500 + 21_000 and len(tool.runs.new) + len(tool.runs.old) < 15


def test_one_pass_and_odd_names(spark, docs_of):
    docs = docs_of(["x y", None, "x y"]).selectExpr("*", "1 AS `a.b`", "'k' AS decoded")
    got = bpe.encode(docs, PATH, ["doc_id", "a.b"], decoded=True)
    assert got.columns == ["doc_id", "a.b", "n_tokens", "ids", "decoded"]
    assert [(r.doc_id, r[1], bytes(r.ids), r.decoded) for r in got.orderBy("doc_id").collect()] == [
        (0, 1, *expected("x y")), (1, 1, b"", ""), (2, 1, *expected("x y")),
    ]
    null = got.selectExpr("doc_id", "IF(doc_id = 0, NULL, ids) AS ids")
    assert {r.doc_id: r.decoded for r in bpe.decode(null, PATH).collect()} == {0: "", 1: "", 2: expected("x y")[1]}


def test_automaton_links_lead_to_shorter_tokens():
    tool = bpe.codec(PATH)
    names = {0: ""}
    for step, at in sorted(tool.next.items(), key=lambda e: e[1]):
        names[at] = names[step >> 21] + chr(step & 0x1FFFFF)
    for at in range(1, len(names), 97):
        assert len(names[at]) == tool.length[at] and names[at].endswith(names[tool.fail[at]]) and tool.fail[at] != at
        assert tool.link[at] == 0 or tool.token[tool.link[at]] >= 0
