"""License scans: fixed phrases by brute force, aligned notices, mandatory phrases, odd rows."""

import re

import duckdb

from assayloom.llm import license_scan as L
from small_tables import docs_of  # noqa: F401


def plain(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words, places, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text), [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i: i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


TEXTS = [
    None, "", "CC-BY", "cc by cc by", "xcc by cc byx cc_by", "All rights reserved. ALL RIGHTS RESERVED", "é cc\nby é all rights  reserved general public license",
    "word " * 20000 + "Released under the MIT License.", "the mit of license", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files",
    "permission is granted", "gnu general public license version 3", "İK ſ all rights reserved", "general public general public license",
]


def test_base_and_labels(docs_of):
    got = {r.doc_id: r for r in L.scan(docs_of(TEXTS, extra="labels")).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text), text
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert got[7].labels == ["mit"] and got[9].labels == ["apache-2.0", "cc-by", "cc-by-nc-4.0"]
    assert got[10].labels == ["mit"] and got[10].score >= 0.3
    assert got[8].labels == [] and got[11].labels == [] and got[8].score == 0
    assert "gpl-3.0" in got[12].labels


NOTICE = {label: notice for label, _, notice in reversed(L.TEMPLATES)}
SEVERAL = [
    ("bsd", "mit"), ("bsd", "isc", "apache-2.0", "mit"), ("mpl-2.0", "gpl-2.0", "cc-by-nc-4.0", "mit", "apache-2.0"),
    tuple(sorted(NOTICE)),
]


def test_every_notice_of_a_text_is_found(docs_of):
    texts = ["\n".join(NOTICE[x] for x in several) for several in SEVERAL]
    long_mit = next(n for label, key, n in L.TEMPLATES if key.startswith("permission is hereby"))
    texts.append(" ".join([long_mit, NOTICE["cc-by-nc-4.0"], NOTICE["apache-2.0"]]))
    # rarer words of a notice that stand elsewhere do not hide its mandatory phrase
    texts.append("software associated documentation restriction deal obtaining copy files " * 3 + long_mit)
    wanted = [*SEVERAL, ("mit", "cc-by-nc-4.0", "apache-2.0"), ("mit",)]
    common = [NOTICE[x] for x in ("mit", "cc-by-nc-4.0", "apache-2.0") for _ in range(20)]
    got = {r.doc_id: r.labels for r in L.scan(docs_of(texts + common)).collect()}
    for i, labels in enumerate(wanted):
        assert set(got[i]) - set(L.PHRASES.values()) == set(labels), texts[i]


def test_whole_table(spark, folder):
    got = {r.doc_id: r for r in L.op7(spark, folder).collect()}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall():
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, [x for x in r.base_labels.split(",") if x]) == plain(text)


def test_rows(docs_of):
    docs = docs_of([(None, "cc by", "s"), (1, "cc by", "s"), (1, "cc by", "s"), (1, "the mit license", "s")])
    got = sorted((r.doc_id or 0, r.n_base, tuple(r.labels)) for r in L.scan(docs).collect())
    assert got == [(0, 1, ("cc-by",)), (1, 0, ("mit",)), (1, 1, ("cc-by",)), (1, 1, ("cc-by",))]
    assert L.scan(docs.where("false")).count() == 0
