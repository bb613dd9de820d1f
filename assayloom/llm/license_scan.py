"""License scans with a positional index of rare words.

Notice templates are indexed as postings (word, template, position). The rarity of the templates' words is counted over all
documents. A template can stand only in a file that holds all words of its mandatory phrase; of each such template the
rarest words of that phrase are looked up, whatever else the file holds. The difference of their position in the file and in
the template is the same for all words of one notice, so postings are intersected by that difference. A template counts only
where its mandatory phrase stands at its place. Fixed phrases are labelled besides. Everything is DataFrame operations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.llm.registry import query
from assayloom.llm.tables import documents, narrow_side, put

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licence notices as (label, mandatory phrase, notice).
TEMPLATES = (
    ("cc-by-nc-4.0", "cc by nc 4 0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "cc by 4 0", "This work is licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "cc by sa 4 0", "This work is licensed under CC BY-SA 4.0."),
    ("mit", "the mit license", "Released under the MIT License."),
    ("mit", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "the apache license version 2 0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "gnu general public license version 3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "gnu general public license version 2", "This program is free software under the terms of the GNU General Public License, version 2."),
    ("lgpl", "gnu lesser general public license", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "gnu affero general public license", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)
#: How many of a mandatory phrase's rarest words are looked up, the share of a template's rarity that must stand in place.
RARE_WORDS, LEAST_SHARE = 8, 0.3

_LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: str) -> list[str]:
    return re.findall(_LETTER + "+", text.lower())


def phrase_pattern(words: list[str]) -> str:
    """Finds the words one after another, A-Z as a-z."""
    each = ["".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words]
    return f"(?<!{_LETTER})" + _BETWEEN.join(each) + f"(?!{_LETTER})"


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_LETTER + "+")).cast("long")


def _all_held(words: list[str]) -> Column:
    """Whether a file's licence words, `held`, hold all of these: no phrase stands without its words."""
    return F.size(F.array_except(F.array(*[F.lit(w) for w in dict.fromkeys(words)]), "held")) == 0


def base_labels(text: Column, n_words: Column) -> Column:
    """struct(n_base, first_word, last_word, labels): all places of the fixed phrases, by word number.

    A text is searched only for phrases whose words it holds.
    """
    none = F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"),
        F.lit(None).cast("string").alias("label"),
    )
    found = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        pattern = phrase_pattern(words)
        parts = F.split(text, pattern, -1)
        some = F.struct(
            (F.size(parts) - 1).cast("long").alias("n"), count_words(F.get(parts, F.lit(0))).alias("first"),
            (n_words - len(words) - count_words(F.element_at(parts, -1))).alias("last"), F.lit(label).alias("label"),
        )
        found.append(F.when(_all_held(words) & F.regexp_like(text, F.lit(pattern)), some).otherwise(none))
    n = found[0]["n"] + found[1]["n"] + found[2]["n"]
    return F.struct(
        n.alias("n_base"), F.least(*[f["first"] for f in found]).alias("first_word"),
        F.greatest(*[f["last"] for f in found]).alias("last_word"), F.array_compact(F.array(*[f["label"] for f in found])).alias("labels"),
    )


def _index(spark: SparkSession, templates) -> DataFrame:
    """Postings (template, word, at) and of each template its words, key words and key place; a few hundred rows."""
    rows = []
    for t, (label, key, notice) in enumerate(templates):
        words, key_words = split_words(notice), key.split()
        place = next(i for i in range(len(words)) if words[i: i + len(key_words)] == key_words)
        rows += [(t, label, w, i, words, key_words, place) for i, w in enumerate(words)]
    kinds = "template int, label string, word string, at int, words array<string>, key array<string>, key_at int"
    return spark.createDataFrame(rows, kinds)


def scan(docs: DataFrame, templates=TEMPLATES, rare: int = RARE_WORDS, least: float = LEAST_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score.

    A null text counts as empty. score is the largest share of a template's rarity that stands in place, 1 for a fixed phrase
    and 0 without any label. Other columns are not read.
    """
    spark = docs.sparkSession
    postings = _index(spark, templates)
    vocabulary = sorted({w for _, _, notice in templates for w in split_words(notice)} | {w for p in PHRASES for w in p.split()})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # lower() also changes letters beyond A-Z, into other letters: words keep their number and places
    words = F.regexp_extract_all(F.lower("text"), F.lit(_LETTER + "+"), F.lit(0))
    first = docs.select("doc_id", text.alias("text")).withColumn("words", words).withColumn(
        "held", F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))
    ).withColumn("n_words", F.size("words").cast("long"))
    # the templates that can stand: a lookup of their own words misses none of them
    could = F.array_compact(F.array(*[F.when(_all_held(key.split()), F.lit(t)) for t, (_, key, _) in enumerate(templates)]))
    # the row number is fixed by writing
    rows = put(
        first.withColumn("base", base_labels(F.col("text"), F.col("n_words"))).withColumn("could", could).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "base.*", "held", "could",
            F.when(F.size("could") > 0, F.col("words")).alias("words"),
        ), "license-rows",
    )
    rarity = _rarity(rows, vocabulary)
    found = put(_aligned(rows, postings, rarity, rare, least), "license-labels")
    side = narrow_side(found.withColumnRenamed("row", "f_row"))
    out = rows.join(side, rows["row"] == side["f_row"], "left")
    own = F.coalesce("found", F.array().cast("array<string>"))
    score = F.when(F.size("labels") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.sort_array(F.array_distinct("labels")).alias("base_labels"),
        F.sort_array(F.array_union("labels", own)).alias("labels"), score.alias("score"),
    )


def _rarity(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, idf) for every word of the templates, counted over all rows."""
    spark = rows.sparkSession
    counts = rows.select(F.explode("held").alias("c_word")).groupBy("c_word").agg(F.count("*").alias("df"))
    total = rows.agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(w,) for w in vocabulary], "word string").join(F.broadcast(total))
    return every.join(counts, F.col("word") == F.col("c_word"), "left").select(
        "word", F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 0.5)).alias("idf"),
    )


def _aligned(rows: DataFrame, postings: DataFrame, rarity: DataFrame, rare: int, least: float) -> DataFrame:
    """(row, found, share): labels of the templates that stand in place, for rows with a mandatory phrase."""
    rarity = F.broadcast(rarity)  # one row per word of the templates
    known = postings.join(rarity, "word")
    # the rarest words of each mandatory phrase, at all their places in it: wherever the phrase stands, all of them do
    in_key = known.where((F.col("at") >= F.col("key_at")) & (F.col("at") < F.col("key_at") + F.size("key")))
    ranked = in_key.groupBy("template").agg(
        F.slice(F.sort_array(F.collect_set(F.struct((-F.col("idf")).alias("i"), "word"))), 1, rare).alias("rarest"),
    ).select(F.col("template").alias("r_template"), F.transform("rarest", lambda x: x["word"]).alias("rarest"))
    looked = in_key.join(ranked, F.col("template") == F.col("r_template")).where(F.array_contains("rarest", F.col("word")))
    table = F.broadcast(looked.withColumnRenamed("word", "p_word"))
    needed = looked.groupBy("template").agg(F.count("*").alias("needed"))
    files = rows.where("words IS NOT NULL").select("row", "words", "could")
    places = files.select("row", "could", F.posexplode("words").alias("pos", "word"))
    hits = places.join(table, F.col("word") == F.col("p_word")).where(F.array_contains("could", F.col("template")))
    shifts = hits.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("shift")).agg(
        F.count("*").alias("met"), F.first("label").alias("label"), F.first("words").alias("t_words"),
        F.first("key").alias("key"), F.first("key_at").alias("key_at"),
    ).join(F.broadcast(needed), "template").where("met = needed")
    whole = known.groupBy("template").agg(F.sum("idf").alias("all"), F.collect_list(F.struct("word", "idf")).alias("weights"))
    checked = shifts.join(F.broadcast(whole), "template").join(files.select(F.col("row").alias("w_row"), "words"), F.col("row") == F.col("w_row"))
    stands = F.slice("words", F.col("shift") + F.col("key_at") + 1, F.size("key")) == F.col("key")
    idf = F.map_from_entries(F.array_distinct("weights"))
    placed = F.aggregate(
        F.zip_with("t_words", F.sequence(F.lit(0), F.size("t_words") - 1), lambda w, i: F.when(F.get(F.col("words"), F.col("shift") + i) == w, idf[w]).otherwise(0.0)),
        F.lit(0.0), lambda a, x: a + x,
    )
    kept = checked.where(stands).withColumn("share", F.least(F.lit(1.0), placed / F.col("all"))).where(F.col("share") >= least)
    return kept.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )
