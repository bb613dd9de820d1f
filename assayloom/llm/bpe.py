"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word the last token of its encoding is unique. A token that ends at the prefix's end is that last token
exactly if it may stand after the last token of what lies before it: no merge across their border would come first. The
tokens that end at each place come from an automaton of the vocabulary with suffix links, in flat arrays: its state at a place
is the longest suffix that begins a token, and the links lead to the shorter ones. The pair test walks the merge trees along
the border. Back-pointers from the whole word give the ids. No merge list is run over the
text. Words are taken in sorted order, so that a prefix which the next word shares keeps its answer.

The vocabulary is a file of the tokenizers format with word ends; its path is a parameter, and tasks load it once per worker.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayloom.llm.registry import query
from assayloom.llm.tables import documents, small_batches

#: Bytes of words, and of runs between white space, whose ids a worker keeps, and pairs whose test it keeps.
CACHED_BYTES = 64 << 20
CACHED_PAIRS = 150_000
#: Bytes of an entry besides its strings.
_ENTRY = 200
_END = "\U0010fffd"
#: Characters at which str.split() splits though the vocabulary's white space does not hold them.
_SPLITS_MORE = regex.compile("[\x1c-\x1f]")
_NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Recent:
    """Entries used of late, in about so many bytes: the older half goes when the newer one is full.

    Entries go between batches only, so that all of one batch is in `new`.
    """

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.new: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if self.held > self.most // 2:
            self.new, self.old, self.held = {}, self.new, 0

    def missing(self, keys: set) -> list:
        """The keys that are held nowhere; those of the older half come to the newer one."""
        out = []
        for k in keys.difference(self.new):
            if k in self.old:
                self.learn(k, self.old[k])
            else:
                out.append(k)
        return out

    def learn(self, key, value: bytes) -> None:
        self.new[key] = value
        self.held += _ENTRY + len(value) + (2 * len(key) if isinstance(key, str) else 0)


class Codec:
    """Encoder and decoder of one vocabulary file (BPE with an end-of-word suffix, byte letters, lower case)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.border = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern, regex.V0)
        self.codes = [ord(letter) for letter in byte_letters()]
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            a, b, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault(a << 32 | b, r)
            self.halves.setdefault(whole, (a, b, r))
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.words, self.runs = Recent(CACHED_BYTES), Recent(CACHED_BYTES)
        self._automaton()
        names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in special.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]

    def _automaton(self) -> None:
        """States are beginnings of tokens: next state by letter, token, length, and suffix links."""
        self.next: dict[int, int] = {}
        self.token, self.length = array("i", [-1]), array("i", [0])
        edges = []
        for s, t in self.vocab.items():
            if self._stands(t):
                key = s[: -len(self.suffix)] + _END if s.endswith(self.suffix) and s != self.suffix else s
                state = 0
                for n, letter in enumerate(key, 1):
                    step = state << 21 | ord(letter)
                    at = self.next.get(step)
                    if at is None:
                        at = self.next[step] = len(self.token)
                        self.token.append(-1)
                        self.length.append(n)
                        edges.append((n, state, ord(letter), at))
                    state = at
                self.token[state] = t
        #: the longest shorter suffix that is a state, and the longest that is a token
        self.fail, self.link = array("i", bytes(4 * len(self.token))), array("i", bytes(4 * len(self.token)))
        for n, state, letter, at in sorted(edges):
            low = self._step(self.fail[state], letter) if n > 1 else 0
            self.fail[at] = low
            self.link[at] = low if self.token[low] >= 0 else self.link[low]

    def _step(self, state: int, letter: int) -> int:
        while True:
            at = self.next.get(state << 21 | letter)
            if at is not None:
                return at
            if not state:
                return 0
            state = self.fail[state]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of a token while it is built, each with the rank at which it is merged away."""
        out = self.edges[side].get(token)
        if out is None:
            out, at, until = [(token, _NEVER)], token, _NEVER
            while at in self.halves:
                *parts, until = self.halves[at]
                at = parts[side]
                out.append((at, until))
            self.edges[side][token] = out
        return out

    def _stands(self, token: int) -> bool:
        """Whether a token's own string is encoded as that token: its halves stand, and may stand side by side until merged."""
        if token not in self.halves:
            return True
        a, b, r = self.halves[token]
        return self._stands(a) and self._stands(b) and self._free(a, b, r)

    def _free(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of a and b comes first, up to the rank `before`."""
        rank, left = self.rank, self._edge(b, 0)
        for x, x_until in self._edge(a, 1):
            for y, y_until in left:
                r = rank.get(x << 32 | y)
                if r is not None and r < before and r < x_until and r <= y_until:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._free(a, b, _NEVER)
        return known

    def _learn(self, words: set[str]) -> None:
        """Stores the ids of words as little-endian 32-bit integers."""
        codes, compatible, known, following = self.codes, self.compatible, self.pairs.get, self.next.get
        tokens, lengths, link, fail, end_code = self.token, self.length, self.link, self.fail, ord(_END)
        last, back, states, before = [-1], [0], [0], b""
        for spell, word in sorted([(w.encode("utf-8", "replace"), w) for w in words]):
            shared = 0
            for x, y in zip(spell, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], back[shared + 1:], states[shared + 1:]
            state, at = states[-1], shared
            for letter in [*[codes[b] for b in spell[shared:]], end_code]:
                at += 1
                after = following(state << 21 | letter)
                while after is None and state:
                    state = fail[state]
                    after = following(state << 21 | letter)
                state = after or 0
                states.append(state)
                end = state if tokens[state] >= 0 else link[state]
                while end:
                    token, start = tokens[end], at - lengths[end]
                    if start:
                        left = last[start]
                        if left >= 0:
                            free = known(left << 32 | token)
                            if free is None:
                                free = compatible(left, token)
                            if free:
                                break
                        end = link[end]
                    else:
                        break
                if end:
                    last.append(token)
                    back.append(start)
                else:
                    last.append(-1)
                    back.append(0)
            ids = []
            while at:
                ids.append(last[at])
                at = back[at]
            ids.reverse()
            self.words.learn(word, array("I", ids).tobytes())
            before = spell

    def _pieces(self, run: str) -> list[str]:
        if not run.isascii() and not unicodedata.is_normalized("NFC", run):
            run = unicodedata.normalize("NFC", run)
        # letter by letter, so that a final capital sigma is no special case
        return self.pieces.findall("".join([c.lower() for c in run]) if "Σ" in run else run.lower())

    def _parts(self, text: str) -> list[str | int]:
        """Runs between white space, and the ids of special strings, in order."""
        out, at = [], 0
        for m in [*self.border.finditer(text), None]:
            part = text[at:m.start()] if m else text[at:]
            out += [part] if _SPLITS_MORE.search(part) else part.split()
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null is empty. Special strings in a text become their ids."""
        runs, words = self.runs, self.words
        runs.turn()
        words.turn()
        parts = [self._parts(t) if t else [] for t in texts]
        new: dict[str, list[str]] = {}
        for p in parts:
            for run in runs.missing(set(p)):
                if isinstance(run, int):
                    runs.learn(run, run.to_bytes(4, "little"))
                elif run not in new:
                    new[run] = self._pieces(run)
        self._learn(words.missing({w for pieces in new.values() for w in pieces}))
        for run, pieces in new.items():
            runs.learn(run, b"".join([words.new[w] for w in pieces]))
        ids = runs.new
        return [b"".join([ids[run] for run in p]) for p in parts]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


    def decode(self, ids: bytes | None) -> str:
        """The tokens' strings with blanks between, as a vocabulary without a decoder gives them; null ids are none."""
        names = self.names
        return " ".join([names[i] for i in memoryview(ids).cast("I")]) if ids else ""


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _arrow(rows: DataFrame, names: list[str], path: str, make, added: str) -> DataFrame:
    """`rows` with the columns that make(codec, batch) adds; columns go by place, since names may hold dots."""
    places = [f"c{i}" for i in range(len(rows.columns))]

    def run(batches):
        tool = codec(path)
        for b in _batches(batches):
            kept, made = make(tool, b)
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f"c{i}" for i in range(len(kept) + len(made))])

    kinds = [f.dataType.simpleString() for f in rows.schema][: len(names)] + added.split()
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))
    return rows.toDF(*places).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """doc_id (or the columns in `keep`), n_tokens and ids (binary, little-endian 32-bit) of every row's whole text.

    With `decoded`, the text that the ids decode to as well, made in the same pass. A null or empty text has no tokens and
    decodes to the empty text. Repeated rows give repeated results; other columns are not read; a table without rows gives
    none. The vocabulary is opened by executors at `path`.
    """
    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession)

    def make(tool, b):
        ids = tool.encode_all(b.column(len(keep)).to_pylist())
        made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
        if decoded:
            made.append(pa.array([tool.decode(i) for i in ids], pa.string()))
        return b.columns[: len(keep)], made

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string"))
    out = _arrow(rows, keep, path, make, "long binary" + decoded * " string")
    return out.toDF(*keep, "n_tokens", "ids", *["decoded"] * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded, the text of `ids` (null: empty), to every row; repeated rows give repeated results."""
    names = encoded.columns

    def make(tool, b):
        texts = [tool.decode(i) for i in b.column(names.index("ids")).to_pylist()]
        return b.columns, [pa.array(texts, pa.string())]

    return _arrow(encoded, names, path, make, "string").toDF(*names, "decoded")


def vocabulary() -> str:
    """The vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    return encode(documents(spark, sf_dir), path, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
