"""BPE encoding by backtracking over longest tokens, and decoding with an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import text_blocks

MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: Bytes of the texts that are encoded together.
BLOCK_BYTES = 4 << 20
#: Characters of encoded words, and pairs of tokens, kept between batches; all are dropped when there are more. Only time changes.
CACHE_CHARS, CACHE_PAIRS = 8 << 20, 1 << 20
#: What a byte becomes as the last of a word, where the vocabulary marks word ends.
LAST = 256
#: Characters below need no Unicode tables newer than Python's.
LOW = 0x300
_HIGH = re.compile(f"[^\\x00-{chr(LOW - 1)}]")
#: Parts of a tokenizer file that are understood, besides its added tokens and tables.
_KNOWN = {
    "normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"], "post_processor": None, "decoder": None,
}


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _ranges(inside: set[int]) -> str:
    """Code points as the inside of a character class."""
    ordered = sorted(inside)
    cuts = [0, *(i for i in range(1, len(ordered)) if ordered[i] != ordered[i - 1] + 1), len(ordered)]
    spans = [(ordered[a], ordered[b - 1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def _class_of(pattern: str) -> set[int]:
    """The code points that a class of the library's regular expressions holds; its Unicode tables can be newer than ours."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return {ord(c) for a in range(0, len(every), 1 << 16) for w, _ in split.pre_tokenize_str(every[a : a + (1 << 16)]) for c in w}


class Vocabulary:
    """Tokens, merges and rules of a tokenizer file, which can be sent to tasks.

    Inside, tokens are numbered so that single symbols come first and merges follow in their
    order; ``ids`` has the numbers of the file. A symbol is a byte, or a byte that ends a word.
    """

    def __init__(self, spec: dict, word_pattern: str, blanks: str):
        """``blanks``: the white space other than the blank itself, as the inside of a character class."""
        self.spec, self.word_pattern, self.blanks = spec, word_pattern, blanks

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Reads the file; one with rules or added tokens of other kinds raises ValueError."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)

        def kinds(part: dict | None) -> list[str] | None:
            return None if part is None else [p["type"] for p in part.get("normalizers") or part.get("pretokenizers") or [part]]

        model = spec["model"]
        known = all(kinds(spec[part]) == want for part, want in _KNOWN.items()) and model["type"] == "BPE"
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        added = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (known and plain and added):
            raise ValueError(f"{path} has rules that are not supported")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        classes = {name: _class_of(name) for name in ("\\p{L}", "\\p{N}", "\\s")}
        for name, inside in classes.items():
            pattern = pattern.replace(name, _ranges(inside))
        return cls({k: spec[k] for k in ("added_tokens", "normalizer", "model")}, pattern, _ranges(classes["\\s"] - {0x20}))

    def __reduce__(self):
        return Vocabulary, (self.spec, self.word_pattern, self.blanks)

    @cached_property
    def mark(self) -> str:
        return hashlib.sha256((json.dumps(self.spec) + self.word_pattern).encode()).hexdigest()

    @cached_property
    def words(self) -> tuple[re.Pattern, re.Pattern]:
        """What finds the words of any text, and of a text below U+0300, where small classes do."""
        low = re.sub(r"(\\U[0-9a-f]{8})-(\\U[0-9a-f]{8})", lambda m: m[0] if int(m[1][2:], 16) < LOW else "", self.word_pattern)
        return re.compile(self.word_pattern), re.compile(low)

    @cached_property
    def space(self) -> re.Pattern:
        """Runs of white space that are not one blank already."""
        return re.compile(f"[ {self.blanks}]{{2,}}|[{self.blanks}]")

    @cached_property
    def added(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self.spec["added_tokens"]}

    @cached_property
    def suffix(self) -> str:
        return self.spec["model"]["end_of_word_suffix"] or ""

    @cached_property
    def tables(self) -> tuple[list[str], list[int], int, dict[int, int], list[int], list[int]]:
        """Of tokens by inner number: texts in symbols, ids of the file, how many are symbols, merges by pair, left and right parts."""
        vocab, merges = self.spec["model"]["vocab"], self.spec["model"]["merges"]
        letters = {c: b for b, c in enumerate(byte_letters())}
        made = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        made_set = set(made)
        base = sorted((t for t in vocab if t not in made_set and t not in self.added), key=vocab.__getitem__)
        names = base + made
        number = {t: i for i, t in enumerate(names)}
        if len(number) != len(names) or not all(t in vocab for t in made):
            raise ValueError("a token comes from two merges, or from none")

        def symbols(token: str) -> str:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            places = [letters[c] for c in (token[: -len(self.suffix)] if ends else token)]
            return "".join(map(chr, places[:-1])) + chr(places[-1] + LAST * ends)

        texts = [symbols(t) for t in names]
        if {*texts[: len(base)]} != {chr(s) for s in range(LAST * (2 if self.suffix else 1))}:
            raise ValueError("the single symbols are not the bytes")
        left, right, pairs = [-1] * len(base), [-1] * len(base), {}
        for i, m in enumerate(merges, len(base)):
            a, b = (number[p] for p in (m if isinstance(m, list) else m.split(" ")))
            left.append(a)
            right.append(b)
            pairs[a * len(names) + b] = i
        return texts, [vocab[t] for t in names], len(base), pairs, left, right

    @cached_property
    def surface(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ids decode to, a blank after each, end to end as bytes; where each id's begin, and how many they are."""
        names = {i: t for t, i in self.spec["model"]["vocab"].items()} | {i: t for t, i in self.added.items()}
        parts = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        sizes = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


class Encoder:
    """Encodes texts as the merges do, without merging.

    A row of tokens is what the merges give exactly if every two neighbours are what the merges
    give for the two of them alone. So the longest token at each place, found for all places by one
    pass of an automaton over the reversed word, is tried first, then the shorter ones that it
    begins with; where none goes with its left neighbour, that place is dead and the last token is
    taken back. What comes before a place can be encoded in one way only, so a dead place stays
    dead, and the work is linear in the length of the word.
    """

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        self.texts, ids, self.n_base, self.pairs, self.left, self.right = vocabulary.tables
        self.id_bytes = [int(i).to_bytes(4, "little") for i in ids]
        self.size = [len(t) for t in self.texts]
        # A token that its own text does not merge to can be no neighbour of anything.
        whole: list[bool] = [True] * self.n_base
        for t in range(self.n_base, len(self.texts)):
            a, b = self.left[t], self.right[t]
            whole.append(whole[a] and whole[b] and self.compatible(a, b, t))
        self.token = {s: t for t, s in enumerate(self.texts) if whole[t]}
        self.shorter = [next((self.token[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.token), -1) for s in self.texts]
        self.automaton = ahocorasick.Automaton()
        for s, t in self.token.items():
            self.automaton.add_word(s[::-1], t)
        self.automaton.make_automaton()
        self.table: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_chars = 0
        empty = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "pre_tokenizer": None,
                 "post_processor": None, "decoder": None, "normalizer": vocabulary.spec["normalizer"],
                 "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.normalizer = Tokenizer.from_str(json.dumps(empty)).normalizer
        special = sorted(vocabulary.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def compatible(self, left: int, right: int, limit: int = 1 << 62) -> bool:
        """Whether the merges leave the border between two tokens alone.

        Both are taken apart again, the later merge first. The two symbols or tokens that then meet
        at the border must not make a merge that comes before the one just undone; at equal rank the
        merge further left comes first.
        """
        n, pairs = len(self.texts), self.pairs
        while True:
            if pairs.get(left * n + right, limit) < limit:
                return False
            if max(left, right) < self.n_base:
                return True
            if left > right:
                limit, left = left, self.right[left]
            else:
                limit, right = right + 1, self.left[right]

    def encode_symbols(self, word: str) -> list[int]:
        """Inner numbers of the tokens of one word."""
        if (only := self.token.get(word)) is not None:
            return [only]
        n, names, table, shorter, size = len(word), len(self.texts), self.table, self.shorter, self.size
        # By the characters from the end of the word; of those that end at one place the automaton names the longest first.
        longest = dict(reversed(list(self.automaton.iter(word[::-1]))))
        if len(table) > CACHE_PAIRS:
            table.clear()
        out: list[int] = []
        dead = bytearray(n + 1)
        at, t = 0, longest[n - 1]
        while at < n:
            while t >= 0:
                if not dead[at + size[t]]:
                    if not out:
                        break
                    pair = out[-1] * names + t
                    fits = table.get(pair)
                    if fits is None:
                        fits = table[pair] = self.compatible(out[-1], t)
                    if fits:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += size[t]
                t = longest[n - 1 - at] if at < n else -1
            else:
                dead[at] = 1
                t = out.pop()
                at -= size[t]
                t = shorter[t]
        return out

    def learn(self, words: set[str]) -> None:
        """Puts the ids of the words, as little-endian unsigned 32-bit integers, into ``known``."""
        if self.known_chars > CACHE_CHARS:
            self.known.clear()
            self.known_chars = 0
        last = LAST if self.vocabulary.suffix else 0
        for word in [w for w in words if w not in self.known]:
            data = word.encode()
            symbols = data[:-1].decode("latin-1") + chr(data[-1] + last)
            self.known[word] = b"".join([self.id_bytes[t] for t in self.encode_symbols(symbols)])
            self.known_chars += len(word)

    def split(self, text: str) -> list[str]:
        """The words of a text that is composed, in lower case and with blanks for runs of white space.

        Where the Unicode tables matter the library does that; characters below U+0300 are composed
        already and each has a lower case of its own.
        """
        text = self.normalizer.normalize_str(text) if _HIGH.search(text) else self.vocabulary.space.sub(" ", text).lower()
        every, low = self.vocabulary.words
        return (every if _HIGH.search(text) else low).findall(text)

    def encode(self, text: str) -> bytes:
        parts = self.special.split(text) if self.special else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.vocabulary.added[part].to_bytes(4, "little"))
            elif part:
                words = self.split(part)
                self.learn(set(words))
                out += map(self.known.__getitem__, words)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of the ids with blanks between them, in UTF-8; numbers that are no id give nothing."""
        table, begin, size = self.vocabulary.surface
        ids = ids[(ids >= 0) & (ids < len(size))]
        sizes = size[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or not ends[-1]:
            return b""
        at = np.repeat(begin[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return table[at].tobytes()[:-1]


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for each vocabulary and worker."""
    if vocabulary.mark not in _encoders:
        _encoders[vocabulary.mark] = Encoder(vocabulary)
    return _encoders[vocabulary.mark]


ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32())), ("ids_sha256", pa.string()),
    ("decoded_sha256", pa.string()),
])


def _encode_batches(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            done = 0
            for texts in text_blocks(batch.column("text"), BLOCK_BYTES):
                lines = [encoder.encode(t or "") for t in texts]
                ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in lines]
                ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, len(texts)), pa.array(np.diff(ends).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                     pa.array([hashlib.sha256(x).hexdigest() for x in lines], pa.string()),
                     pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string())],
                    schema=ENCODED,
                )
                done += len(texts)

    return run


def _decode_batches(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = [
                None if ids is None else encoder.decode(np.array([-1 if i is None else i for i in ids], np.int64)).decode()
                for ids in batch.column("tokens").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, tokens, ids_sha256, decoded_sha256`` for every row of ``docs``.

    ``tokens`` are the ids that the tokenizer file gives the whole text, its added tokens standing
    for their strings and none put around it. ``ids_sha256`` is of the ids as little-endian unsigned
    32-bit integers, ``decoded_sha256`` of what they decode to. Null and empty texts have no
    tokens. Repeated rows each get a row; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_tokens long, tokens array<int>, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_encode_batches(Vocabulary.load(model)), schema)


def decode(tokens: DataFrame, model: str = MODEL, key: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of encoded rows; null tokens give null text, numbers that are no id (null too) give nothing.

    Repeated rows each get a row; other columns are ignored; an empty table gives no rows.
    """
    rows = tokens.select(F.col(key).cast("long").alias("doc_id"), "tokens")
    return rows.mapInArrow(_decode_batches(Vocabulary.load(model)), "doc_id long, text string")
