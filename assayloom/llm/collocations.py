"""Phrase collocations by multikey quicksort of suffixes.

Every word of a text starts a suffix of up to four words that ends with its piece. Tasks turn texts into chunks of suffixes:
sorted, equal ones folded with their number, words as numbers of the chunk's own sorted word list. Suffixes are then routed
by their leading words: sorted marks of all chunks give borders that cut the order of (lang, words) into parts of like size,
so that the suffixes of a phrase lie in one part or in parts next to each other. A part sorts pointers to its suffixes by a
three-way quicksort that goes one word deeper only inside equal partitions. The weight of an equal partition is the number of
times its phrase occurs; partitions below the least count are abandoned unsorted. Phrases that may go on in another part are
exactly the leading words of a part's first and last suffix; their shares are handed on whatever they are and summed.

A passage that is copied everywhere is one suffix with a number in each chunk, and a hot word is spread over as many parts as
it fills, so no key can fill a task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayloom.llm.registry import query
from assayloom.llm.tables import arrow_batches, documents, put
from assayloom.operators.ranking import rank_within, top_n_by_group

#: Words of the longest phrase.
DEPTH = 4


@dataclass(frozen=True)
class Sizes:
    """Words of one chunk, folded suffixes of a part, and folded suffixes from mark to mark; results do not depend on them."""

    chunk: int = 1_000_000
    part: int = 2_000_000
    mark: int = 8_192


#: Bytes of a text that are split at once.
_SLICE = 1 << 16
#: Partitions of at most so many pointers are finished by one plain sort.
_SMALL = 2_048
_BREAK = b"\xff"  # stands in no UTF-8 text

_TABLE = bytearray(range(256))
for _c in range(0x41, 0x5B):
    _TABLE[_c] += 0x20
for _c in (*b".,;:!?", *range(0x0A, 0x0E)):
    _TABLE[_c] = 0xFF
_TABLE[0x09] = 0x20
_TABLE = bytes(_TABLE)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte of their places, compressed."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _loose(held: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(held, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


class _Chunk:
    """The words of one language's texts in a row, as numbers; 0 ends a piece."""

    def __init__(self, sizes: Sizes):
        self.sizes = sizes
        self.start()

    def start(self, words: list[bytes] = ()) -> None:
        self.numbers = defaultdict(count().__next__)
        self.numbers[_BREAK]
        self.words = list(map(self.numbers.__getitem__, words))

    def add(self, text: str) -> Iterator[tuple]:
        clean = text.encode("utf-8", "replace").translate(_TABLE).replace(_BREAK, b" \xff ")
        at = 0
        while at < len(clean):
            end = clean.find(b" ", at + _SLICE)
            end = len(clean) if end < 0 else end
            self.words.extend(map(self.numbers.__getitem__, clean[at:end].split()))
            at = end
            if len(self.words) >= self.sizes.chunk:
                yield from self.cut(False)
        self.words.append(0)

    def cut(self, last: bool) -> Iterator[tuple]:
        """The folded suffixes so far; the last words wait for what follows them unless nothing does."""
        ids, names = np.array(self.words + [0] * (DEPTH if last else 0), np.int64), list(self.numbers)
        order = sorted(range(1, len(names)), key=names.__getitem__)
        rank = np.zeros(len(names), np.uint64)
        rank[order] = np.arange(1, len(names))
        ids = rank[ids]
        n = max(0, len(ids) - DEPTH + 1)
        columns = [ids[:n]]
        for i in range(1, DEPTH):
            columns.append(np.where(columns[-1] > 0, ids[i: n + i], 0))
        live = columns[0] > 0
        high, low = [(a[live] << np.uint64(32)) | b[live] for a, b in (columns[:2], columns[2:])]
        tail = [] if last else [names[i] for i in self.words[n:]]
        self.start(tail)
        if not len(high):
            return
        by = np.lexsort((low, high))
        high, low = high[by], low[by]
        heads = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
        times = np.diff(np.append(heads, len(high)))
        high, low = high[heads], low[heads]
        ids = [high >> np.uint64(32), high & np.uint64(0xFFFFFFFF), low >> np.uint64(32), low & np.uint64(0xFFFFFFFF)]
        names = [names[i] for i in order]
        marks = [
            {f"w{j}": names[int(c[at]) - 1].decode() if c[at] else "" for j, c in enumerate(ids)}
            for at in range(self.sizes.mark // 2, len(heads), self.sizes.mark)
        ]
        yield len(heads), b" ".join(names), [_squeezed(c) for c in ids], _squeezed(times), marks


_WORDS = [f"w{j}" for j in range(DEPTH)]
_SUFFIXES = "n long, names binary, " + ", ".join(f"{w} binary" for w in _WORDS) + ", times binary"
_MARKS = "marks array<struct<" + ", ".join(f"{w}: string" for w in _WORDS) + ">>"


def _row(head: dict, n: int, names: bytes, ids: list[bytes], times: bytes) -> dict:
    return {**head, "n": [n], "names": [names], **{w: [c] for w, c in zip(_WORDS, ids)}, "times": [times]}


def _schema() -> pa.Schema:
    binary = [(c, pa.binary()) for c in ("names", *_WORDS, "times")]
    return pa.schema([("n", pa.int64()), *binary])


def suffix_chunks(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of folded suffixes of the rows' whole texts: lang, n, the sorted words, four columns of numbers, times, marks."""
    marks = pa.list_(pa.struct([(w, pa.string()) for w in _WORDS]))
    schema = pa.unify_schemas([pa.schema([("lang", pa.string())]), _schema(), pa.schema([("marks", marks)])])

    def run(batches):
        def out(lang, made):
            for n, names, ids, times, m in made:
                yield pa.RecordBatch.from_pydict({**_row({"lang": [lang]}, n, names, ids, times), "marks": [m]}, schema)

        chunks: dict[str, _Chunk] = defaultdict(lambda: _Chunk(sizes))
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    yield from out(lang, chunks[lang].add(text))
            while sum(len(c.words) for c in chunks.values()) > 2 * sizes.chunk:
                most = max(chunks, key=lambda k: len(chunks[k].words))
                yield from out(most, chunks.pop(most).cut(True))
        for lang, c in chunks.items():
            yield from out(lang, c.cut(True))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"lang string, {_SUFFIXES}, {_MARKS}")


def _borders(chunks: DataFrame, sizes: Sizes) -> list[tuple[bytes, ...]]:
    """First suffixes (lang and words) of all parts but the first: one for every part's size, from the marks of all chunks."""
    marks = chunks.select("lang", F.explode("marks").alias("m")).select("lang", "m.*")
    step = max(1, sizes.part // sizes.mark)
    ranked = rank_within(marks, [], ["lang", *_WORDS], "rank").where(F.col("rank") % step == 0)
    return sorted({tuple(v.encode() for v in r) for r in ranked.select("lang", *_WORDS).collect()})


def _first_not_below(columns: list[np.ndarray], key: list[float]) -> int:
    lo, hi = 0, len(columns[0])
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if [float(c[mid]) for c in columns] < key else (lo, mid)
    return lo


def _routed(chunks: DataFrame, borders: list[tuple[bytes, ...]]) -> DataFrame:
    """The chunks cut at the borders; each piece with its part's number and only the words that it uses."""
    schema = pa.unify_schemas([pa.schema([("part", pa.int32()), ("lang", pa.string())]), _schema()])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                lang, n = row["lang"].encode(), row["n"]
                names = row["names"].split(b" ")
                ids, times = [_loose(row[w], n) for w in _WORDS], _loose(row["times"], n)
                first = sum(1 for x in borders if x[0] < lang)
                cuts = [0]
                for border in borders[first:]:
                    if border[0] != lang:
                        break
                    key = []
                    for w in border[1:]:
                        at = bisect_left(names, w)
                        key.append(0.0 if not w else at + 1.0 if at < len(names) and names[at] == w else at + 0.5)
                    cuts.append(_first_not_below(ids, key))
                for i, (a, z) in enumerate(zip(cuts, [*cuts[1:], n])):
                    if a < z:
                        piece = np.stack([c[a:z] for c in ids])
                        used = np.unique(piece)
                        used = used[used > 0]
                        small = np.searchsorted(used, piece) + (piece > 0)
                        head = {"part": [first + i], "lang": [row["lang"]]}
                        packed = b" ".join([names[j - 1] for j in used.tolist()])
                        yield pa.RecordBatch.from_pydict(
                            _row(head, z - a, packed, [_squeezed(c) for c in small], _squeezed(times[a:z])), schema
                        )

    return chunks.drop("marks").mapInArrow(run, f"part int, lang string, {_SUFFIXES}")


def equal_partitions(words: list[np.ndarray], times: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(number of words, one pointer, weight) of every equal partition that weighs `least` or more.

    A three-way quicksort of pointers: `words` holds the suffixes' words by depth, 0 after their end.
    """
    stack = [(np.arange(len(times)), 0)]
    while stack:
        at, depth = stack.pop()
        key = words[depth][at]
        if not key.all():
            at = at[key > 0]
            key = words[depth][at]
        if times[at].sum() < least:
            continue  # nothing inside can reach the least count
        if len(at) <= _SMALL:
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            weights = np.add.reduceat(times[at], heads)
            ends = np.append(heads[1:], len(at))
            equal = [(at[heads[i]: ends[i]], int(weights[i])) for i in np.flatnonzero(weights >= least)]
        else:
            pivot = np.sort(key[np.linspace(0, len(key) - 1, 9).astype(np.int64)])[4]
            stack += [(at[key < pivot], depth), (at[key > pivot], depth)]
            same = at[key == pivot]
            weight = int(times[same].sum())
            equal = [(same, weight)] if weight >= least else []
        for same, weight in equal:
            yield depth + 1, int(same[0]), weight
            if depth + 1 < len(words):
                stack.append((same, depth + 1))


class _Part:
    """The suffixes of one language in one part."""

    def __init__(self):
        self.numbers, self.ids, self.times, self.edges = defaultdict(count(1).__next__), [], [], []

    def add(self, row: dict) -> None:
        names, n = row["names"].split(b" "), row["n"]
        own = np.array([0, *map(self.numbers.__getitem__, names)], np.int32)
        ids = own[np.stack([_loose(row[w], n) for w in _WORDS])]
        self.ids.append(ids)
        self.times.append(_loose(row["times"], n).astype(np.int64))
        at = [b""] + names
        self.edges += [tuple(at[int(_loose(row[w], n)[i])] for w in _WORDS) for i in (0, n - 1)]

    def phrases(self, least: int) -> Iterator[tuple[int, str, int]]:
        """(number of words, phrase, weight); weights of phrases at the part's edges are shares of any size."""
        words, times = list(np.concatenate(self.ids, axis=1)), np.concatenate(self.times)
        names = [b"", *self.numbers]
        yield 0, "", int(times.sum())
        edges = {e[:k] for e in (min(self.edges), max(self.edges)) for k in range(1, DEPTH + 1) if all(e[:k])}
        for e in sorted(edges):
            same = np.ones(len(times), bool)
            for column, w in zip(words, e):
                same &= column == self.numbers[w]
            yield len(e), b" ".join(e).decode(), int(times[same].sum())
        for k, at, weight in equal_partitions(words, times, least):
            phrase = tuple(names[int(words[j][at])] for j in range(k))
            if phrase not in edges:
                yield k, b" ".join(phrase).decode(), weight


def phrase_counts(docs: DataFrame, least: int, sizes: Sizes = Sizes()) -> DataFrame:
    """Written (lang, n_words, phrase, f) of every phrase of 1 to 4 words with f >= least; n_words 0 counts a language's words.

    Texts are lower-cased in A-Z, cut into pieces at .,;:!? and line ends, and into words at blanks and tabs; phrases lie
    within a piece, overlaps count. A null text is empty, a null lang is `und`, repeated rows count each time, and other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with arrow_batches(spark):
        chunks = put(suffix_chunks(docs, sizes), "suffix-chunks")
        borders = _borders(chunks, sizes)

        def run(batches):
            def out(lang, part):
                rows = list(part.phrases(least))
                k, phrases, f = zip(*rows)
                return pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows)), pa.array(k, pa.int32()), pa.array(phrases, pa.string()), pa.array(f, pa.int64())],
                    names=["lang", "n_words", "phrase", "f"],
                )

            now, part = None, None
            for b in batches:
                for row in b.to_pylist():
                    if (row["part"], row["lang"]) != now:
                        if part:
                            yield out(now[1], part)
                        now, part = (row["part"], row["lang"]), _Part()
                    part.add(row)
            if part:
                yield out(now[1], part)

        dealt = _routed(chunks, borders).repartitionById(len(borders) + 1, F.col("part")).sortWithinPartitions("part", "lang")
        shares = put(dealt.mapInArrow(run, "lang string, n_words int, phrase string, f long"), "phrase-shares")
    whole = shares.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    return put(whole.where(f"n_words = 0 OR f >= {int(least)}"), "phrases")


def collocations(
    docs: DataFrame, top: int = 2000, least: int = 30, covered: int = 80, sizes: Sizes = Sizes(),
) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to 4 words with a >= least occurrences scores floor(2000000 a / (l + r)) at its lowest cut into a first part
    (l occurrences) and a rest (r), ties to the shortest first part. A phrase inside a longer one that has at least `covered`
    percent of its occurrences is dropped. Order: score and a descending, phrase ascending. Rows as in `phrase_counts`.
    """
    counts = phrase_counts(docs, least, sizes)
    known = counts.where("n_words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("f_part"))
    found = counts.where("n_words > 1")
    words = F.split("phrase", " ")
    piece = lambda a, n: F.array_join(F.slice("ws", a, n), " ")
    cuts = found.withColumn("ws", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", piece(F.lit(1), F.col("k")).alias("left"),
        piece(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("part").alias(side), F.col("f_part").alias(name)), ["lang", side])
    score = F.expr("(CAST(a AS decimal(20, 0)) * 2000000) DIV (CAST(l AS decimal(20, 0)) + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = found.where("n_words > 2").withColumn("ws", words).withColumn("k", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("k") + 1)))
    longer = inner.groupBy("lang", piece(F.col("at"), F.col("k")).alias("phrase")).agg(F.max("f").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (wide("most") * 100 < wide("a") * covered)
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = top_n_by_group(kept, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op13_collocations", r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
    n AS (SELECT lang, cast(sum(len(ws)) AS bigint) AS n FROM w GROUP BY 1),
    u AS (SELECT lang, row_number() OVER () AS p, ws FROM w),
    t AS (SELECT lang, p, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM u),
    e AS (SELECT lang, a, lead(a, 1) OVER x AS b, lead(a, 2) OVER x AS c, lead(a, 3) OVER x AS d FROM t WINDOW x AS (PARTITION BY p ORDER BY i)),
    g AS (SELECT lang, a AS phrase FROM e UNION ALL SELECT lang, a || ' ' || b FROM e WHERE b IS NOT NULL
        UNION ALL SELECT lang, a || ' ' || b || ' ' || c FROM e WHERE c IS NOT NULL
        UNION ALL SELECT lang, a || ' ' || b || ' ' || c || ' ' || d FROM e WHERE d IS NOT NULL),
    h AS (SELECT lang, phrase, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 30),
    f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws, len(string_split(phrase, ' ')) AS k FROM h),
    halves AS (SELECT lang, phrase, a, unnest(range(1, k)) AS j, ws, k FROM f WHERE k > 1),
    sides AS (SELECT lang, phrase, a, j, array_to_string(ws[1 : j], ' ') AS x, array_to_string(ws[j + 1 : k], ' ') AS y FROM halves),
    cut AS (SELECT s.lang, s.phrase, s.a, j, l.a AS l, r.a AS r, (2000000::HUGEINT * s.a) // (l.a + r.a) AS score
        FROM sides s JOIN f l ON l.lang = s.lang AND l.phrase = s.x JOIN f r ON r.lang = s.lang AND r.phrase = s.y),
    s AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS rn FROM cut),
    b AS (SELECT c.lang, array_to_string(c.ws[i : i + k2 - 1], ' ') AS phrase, max(c.a) AS most
        FROM f c, (VALUES (2), (3)) AS d(k2), (VALUES (1), (2), (3)) AS z(i) WHERE k2 < c.k AND i + k2 - 1 <= c.k GROUP BY 1, 2),
    o AS (SELECT s.lang, s.phrase, s.a, s.l, s.r, cast(s.score AS bigint) AS score FROM s LEFT JOIN b ON b.lang = s.lang AND b.phrase = s.phrase
        WHERE rn = 1 AND (b.most IS NULL OR 100 * b.most < 80 * s.a)),
    q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
    SELECT q.lang, rank, phrase, a, l, r, n.n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
