"""SentencePiece encoding and decoding with a batched Viterbi search."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import _R, _R_INV, _power, blocks, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the texts that are encoded together; many words of one length make a pass worth its while.
BLOCK_CHARS = 2 << 20
#: Encoded words kept between batches and the characters in them; all are dropped when there are more. Both change the
#: time only.
CACHE_WORDS, CACHE_CHARS = 200_000, 8 << 20
#: Longer words seldom have others of their length to advance with, and go alone. It changes the time only.
LONG_WORD = 64
#: Characters of a long word whose substrings are looked up together.
LONG_BLOCK = 1 << 16
#: Characters of all words that one Viterbi pass advances.
PASS_CHARS = 1 << 17
#: How much less than the worst piece a character without a piece scores.
UNKNOWN_PENALTY = 10.0
#: Leading bits of a piece's hash by which its place among the sorted keys is found.
BUCKET_BITS = 20
#: Entries that are no id: nothing, and a character written as bytes.
NONE, BYTES = -2, -1

_SPACED = re.compile(" +[^ ]*")
_LINES = re.compile("^[^\n]*|\n[^\n]*")


class Vocabulary:
    """Pieces with their scores, as arrays that can be sent to tasks.

    Spaces stand for themselves here instead of U+2581, so that character in a text
    is like any other: it has no piece and goes by its bytes, and comes back.
    """

    def __init__(self, pieces: list[str], scores: np.ndarray, kinds: np.ndarray):
        """``kinds``: 0 a piece, 1 a byte, 2 neither."""
        self.pieces, self.scores, self.kinds = pieces, scores, kinds

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = [1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) else 0 for i in ids]
        pieces = [model.id_to_piece(i).replace("▁", " ") for i in ids]
        return cls(pieces, np.array([model.get_score(i) for i in ids]), np.array(kinds))

    def __reduce__(self):
        return Vocabulary, (self.pieces, self.scores, self.kinds)

    @cached_property
    def byte_ids(self) -> np.ndarray:
        out = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == 1):
            out[int(self.pieces[i][3:5], 16)] = i
        return out

    @cached_property
    def surface(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that all ids stand for, end to end, and where each id's begin and how many they are."""
        parts = [
            bytes([int(p[3:5], 16)]) if k == 1 else p.encode() if k == 0 else b""
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        sizes = np.array([len(x) for x in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the pieces, with their ids and scores."""
        ids = np.flatnonzero((self.kinds == 0) & np.array([bool(p) for p in self.pieces]))
        keys = np.array([_hash_one(self.pieces[i]) for i in ids], np.uint64)
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces have the same text or hash")
        return keys, ids, self.scores[ids].astype(np.float64)

    @cached_property
    def buckets(self) -> tuple[np.ndarray, np.ndarray, int]:
        """By the leading bits of a hash: whether a piece has them, where such keys begin; the most keys that share them."""
        counts = np.bincount((self.table[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        return counts > 0, (np.cumsum(counts) - counts).astype(np.int32), int(counts.max())

    def find(self, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes belong to pieces, and their places among the sorted keys."""
        keys = self.table[0]
        taken, begin, most = self.buckets
        lead = probe >> np.uint64(64 - BUCKET_BITS)
        rows = np.flatnonzero(taken[lead])
        wanted, at = probe[rows], begin[lead[rows]]
        hit = keys[at] == wanted
        for k in range(1, most):
            missed = np.flatnonzero(~hit)
            after = np.minimum(at[missed] + k, len(keys) - 1)
            right = keys[after] == wanted[missed]
            at[missed[right]], hit[missed[right]] = after[right], True
        return rows[hit], at[hit]

    @cached_property
    def longest(self) -> int:
        return max(len(self.pieces[i]) for i in self.table[1])

    @cached_property
    def unknown(self) -> float:
        return float(self.table[2].min()) - UNKNOWN_PENALTY


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a column each."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.ascontiguousarray(flat.reshape(len(words), -1).T)


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    sums = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
    terms = mix(codes.astype(np.uint64) + np.uint64(1)) * _power("up", _R, codes.shape[0])[:, None]
    np.cumsum(terms, axis=0, out=sums[1:])
    return sums


def _hash_one(piece: str) -> int:
    return int(_prefix_sums(_codes([piece]))[-1, 0])


def viterbi(words: list[str], vocabulary: Vocabulary) -> list[bytes]:
    """The best segmentation of each word, all words being of one length: ids as little-endian int32.

    The words advance together, a character at a time: the hashes of the substrings that
    end there are looked up among the sorted piece keys, and the best sum over their starts
    is kept with a pointer back. Of equal sums the longest last piece wins. A character
    without a piece scores below all pieces and is written as its bytes.
    """
    _, ids, scores = vocabulary.table
    codes = _codes(words)
    length, n = codes.shape
    sums = _prefix_sums(codes)
    inverse = _power("down", _R_INV, length)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, n), np.int32)
    piece = np.full((length + 1, n), NONE, np.int32)
    for j in range(1, length + 1):
        best[j] = best[j - 1] + vocabulary.unknown
        back[j] = j - 1
        piece[j] = BYTES
        for i in range(max(0, j - vocabulary.longest), j):
            rows, at = vocabulary.find((sums[j] - sums[i]) * inverse[i])
            total = best[i][rows] + scores[at]
            # Single characters come last: a piece replaces the unknown character, a tie keeps the longer piece.
            better = (total > best[j][rows]) | ((total == best[j][rows]) & (piece[j][rows] == BYTES))
            rows, at = rows[better], at[better]
            best[j][rows], back[j][rows], piece[j][rows] = total[better], i, ids[at]
    # Back along the pointers, all words at once; the last row holds the last pieces.
    every, lines, ends = np.arange(n), [], []
    j = np.full(n, length)
    while j.any():
        lines.append(piece[j, every])
        ends.append(j)
        j = back[j, every]
    line = np.ascontiguousarray(np.stack(lines[::-1]).T)
    present = line != NONE
    data = line[present].astype("<i4").tobytes()
    cut = np.append(0, np.cumsum(4 * present.sum(axis=1))).tolist()
    out = [data[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    if (line == BYTES).any():
        ends = np.stack(ends[::-1]).T
        for r in np.flatnonzero((line == BYTES).any(axis=1)):
            parts = []
            for p, end in zip(line[r].tolist(), ends[r].tolist(), strict=True):
                if p == BYTES:
                    parts += vocabulary.byte_ids[list(words[r][end - 1].encode())].tolist()
                elif p != NONE:
                    parts.append(p)
            out[r] = np.array(parts, "<i4").tobytes()
    return out


def viterbi_long(word: str, vocabulary: Vocabulary) -> bytes:
    """The same segmentation as ``viterbi`` gives, for one word of any length.

    All substrings of a block are looked up at once, a length at a time, so a character costs the few pieces that
    start there and not a call for every length; beside the block 16 bytes per character are held.
    """
    _, ids, scores = vocabulary.table
    length, longest, unknown = len(word), vocabulary.longest, vocabulary.unknown
    best = array("d", [-np.inf]) * (length + 1)
    back = array("i", [0]) * (length + 1)
    piece = array("i", [NONE]) * (length + 1)
    best[0] = 0.0
    for a in range(0, length, LONG_BLOCK):
        n = min(LONG_BLOCK, length - a)
        sums = _prefix_sums(_codes([word[a : a + n + longest - 1]]))[:, 0]
        inverse = _power("down", _R_INV, len(sums))
        starts, sizes, places = [], [], []
        for size in range(1, min(longest, len(sums) - 1) + 1):
            begins = min(n, len(sums) - size)
            rows, at = vocabulary.find((sums[size : size + begins] - sums[:begins]) * inverse[:begins])
            starts.append(rows)
            sizes.append(np.full(len(rows), size))
            places.append(at)
        starts, places = np.concatenate(starts), np.concatenate(places)
        order = np.argsort(starts, kind="stable")
        cut = np.searchsorted(starts[order], np.arange(n + 1)).tolist()
        ends = (a + starts + np.concatenate(sizes))[order].tolist()
        found, worth = ids[places][order].tolist(), scores[places][order].tolist()
        # Pieces that end in one place come by ascending start, so a tie keeps the longest; a lone character comes last.
        for i in range(a, a + n):
            here = best[i]
            for m in range(cut[i - a], cut[i - a + 1]):
                end, total = ends[m], here + worth[m]
                if total > best[end]:
                    best[end], back[end], piece[end] = total, i, found[m]
            if here + unknown > best[i + 1]:
                best[i + 1], back[i + 1], piece[i + 1] = here + unknown, i, BYTES
    out, j = array("i"), length
    while j:
        i = back[j]
        if piece[j] == BYTES:
            out.extend(reversed(vocabulary.byte_ids[list(word[i:j].encode())].tolist()))
        else:
            out.append(piece[j])
        j = i
    out.reverse()
    return np.array(out, "<i4").tobytes()


def split_words(text: str, at_lines: bool = True) -> list[str]:
    """The words of a text with a space put before it, each without the space it starts with.

    No piece goes on from another character to a space, so words can be cut apart exactly;
    so can lines where no piece holds a line feed. A word that starts a line keeps its line
    feed and has no space to lose.
    """
    if "  " not in text and text[:1] != " ":
        return (text.replace("\n", " \n") if at_lines else text).split(" ")
    words = [w[1:] for w in _SPACED.findall(" " + text)]
    return [x for w in words for x in _LINES.findall(w) or [""]] if at_lines else words


class Encoder:
    """Encodes texts word by word; a word met before is not searched again."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.at_lines = not any("\n" in p for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True) if k == 0)
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def learn(self, words: Iterable[str]) -> None:
        by_length: dict[int, list[tuple[str, str]]] = {}
        for w in words:
            full = w if self.at_lines and w[:1] == "\n" else " " + w
            by_length.setdefault(len(full), []).append((w, full))
        for length, group in by_length.items():
            if length > LONG_WORD:
                self.known.update((w, viterbi_long(full, self.vocabulary)) for w, full in group)
                continue
            step = max(1, PASS_CHARS // length)
            for k in range(0, len(group), step):
                words, full = zip(*group[k : k + step], strict=True)
                self.known.update(zip(words, viterbi(full, self.vocabulary), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; an empty text has none, null stays null."""
        out: list[np.ndarray | None] = []
        for a, b in blocks([len(t or "") for t in texts], BLOCK_CHARS):
            split = [split_words(t, self.at_lines) if t else [] for t in texts[a:b]]
            here = set().union(*split)
            new = [w for w in here if w not in self.known]
            chars = sum(map(len, new))
            if new and (len(self.known) + len(new) > CACHE_WORDS or self.chars + chars > CACHE_CHARS):
                self.known.clear()
                new = list(here)
                self.chars, chars = 0, sum(map(len, new))
            self.learn(new)
            self.chars += chars
            look = {w: self.known[w] for w in here}.__getitem__
            for t, words in zip(texts[a:b], split, strict=True):
                out.append(None if t is None else np.frombuffer(b"".join(map(look, words)), "<i4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for, without the space put before it."""
        table, begin, size = self.vocabulary.surface
        sizes = size[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return ""
        at = np.repeat(begin[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return table[at].tobytes().decode("utf-8", "replace")[1:]


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for each vocabulary and worker, so that later batches know the words of earlier ones."""
    mark = hashlib.sha256("\n".join(vocabulary.pieces).encode() + vocabulary.scores.tobytes()).hexdigest()
    if mark not in _encoders:
        _encoders[mark] = Encoder(vocabulary)
    return _encoders[mark]


ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32())), ("decoded_sha256", pa.string()),
])


def _encode_batches(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            # A batch is never held as Python objects whole.
            column = batch.column("text")
            for a, b in blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), BLOCK_CHARS):
                lines = encoder.encode(column.slice(a, b - a).to_pylist())
                sizes = np.array([0 if x is None else len(x) for x in lines], np.int64)
                flat = np.concatenate([x for x in lines if x is not None] or [np.zeros(0, "<i4")])
                null = np.array([x is None for x in lines])
                tokens = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat), mask=pa.array(null)
                )
                digests = [
                    None if x is None else hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in lines
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes), tokens, pa.array(digests, pa.string())],
                    schema=ENCODED,
                )

    return run


def _decode_batches(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = [
                None if ids is None else encoder.decode(np.array(ids, np.int64)) for ids in batch.column("tokens").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, tokens, decoded_sha256`` for every row of ``docs``.

    ``tokens`` segments the whole text, a space put before it, into pieces with the
    greatest sum of scores; characters without a piece are written as bytes, so every text
    comes back exactly. ``decoded_sha256`` is the SHA-256 of what the tokens decode to. An
    empty text has no tokens; null text has null tokens and digest and ``n_tokens`` 0.
    Repeated rows each get a row; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_tokens long, tokens array<int>, decoded_sha256 string"
    return rows.mapInArrow(_encode_batches(Vocabulary.load(model)), schema)


def decode(tokens: DataFrame, model: str = MODEL, key: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of encoded rows; null tokens give null text."""
    rows = tokens.select(F.col(key).cast("long").alias("doc_id"), "tokens")
    return rows.mapInArrow(_decode_batches(Vocabulary.load(model)), "doc_id long, text string")
