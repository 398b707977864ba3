"""Text expressions: analysis into lexemes, term counts, query perturbation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.stemmer import stem

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
SPACE_PATTERN = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"

# The English stop word list of common full-text search set-ups.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now"
).split()


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``.

    A column used inside a lambda is evaluated again for every element; a lambda
    variable is not.
    """
    return F.transform(F.array(value), body).getItem(0)


def tokens(text: Column) -> Column:
    """Lowercase words and numbers in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_arrays(words: pd.Series) -> pd.Series:
    cached = lru_cache(maxsize=1 << 18)(stem)
    return words.map(lambda ws: None if ws is None else [cached(w) for w in ws])


@F.pandas_udf(T.StringType())
def stem_word(words: pd.Series) -> pd.Series:
    """The English stem of each word."""
    return words.map(stem, na_action="ignore")


def analyze(text: Column, language: str = "simple") -> Column:
    """Lexemes of ``text``: ``simple`` keeps every word, ``english`` drops stop words and stems, ``unstemmed`` only drops."""
    words = tokens(text)
    if language == "simple":
        return words
    if language == "unstemmed":
        return F.filter(words, lambda w: ~w.isin(ENGLISH_STOPWORDS))
    if language == "english":
        return _stem_arrays(F.filter(words, lambda w: ~w.isin(ENGLISH_STOPWORDS)))
    raise ValueError(f"unknown language {language!r}")


def analyze_placed(text: Column, language: str = "simple") -> Column:
    """array<struct<lexeme, pos>>: lexemes with their place among all words, from 1.

    Stop words are left out but still take up a place.
    """
    pairs = F.transform(tokens(text), lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("pos")))
    if language == "simple":
        return pairs
    kept = F.filter(pairs, lambda p: ~p["lexeme"].isin(ENGLISH_STOPWORDS))
    if language == "unstemmed":
        return kept
    if language == "english":
        return F.zip_with(
            _stem_arrays(kept["lexeme"]), kept["pos"], lambda w, p: F.struct(w.alias("lexeme"), p.alias("pos"))
        )
    raise ValueError(f"unknown language {language!r}")


def _runs(ordered: Column, lexeme_at, make) -> Column:
    """One value per run of equal lexemes in a sorted array; ``make(start, length)`` builds it."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(ordered) - 1),
        lambda i: (i == 0) | (lexeme_at(i) != lexeme_at(i - 1)),
    )
    return let(
        starts,
        lambda b: F.transform(
            b, lambda start, j: make(start, F.coalesce(F.get(b, j + 1), F.size(ordered)) - start)
        ),
    )


def term_counts(words: Column) -> Column:
    """array<struct<lexeme, tf>> of a token array, sorted by lexeme, worked out inside the row."""

    def counted(s):
        return _runs(
            s,
            lambda i: F.get(s, i),
            lambda start, n: F.struct(F.get(s, start).alias("lexeme"), n.alias("tf")),
        )

    none = F.expr("CAST(array() AS array<struct<lexeme:string,tf:int>>)")
    return F.when(F.size(words) > 0, let(F.sort_array(words), counted)).otherwise(none)


def term_positions(placed: Column) -> Column:
    """array<struct<lexeme, tf, positions>> of placed lexemes, sorted by lexeme, positions ascending."""

    def gathered(s):
        return _runs(
            s,
            lambda i: F.get(s, i)["lexeme"],
            lambda start, n: F.struct(
                F.get(s, start)["lexeme"].alias("lexeme"),
                n.alias("tf"),
                F.transform(F.slice(s, start + 1, n), lambda x: x["pos"]).alias("positions"),
            ),
        )

    none = F.expr("CAST(array() AS array<struct<lexeme:string,tf:int,positions:array<int>>>)")
    return F.when(F.size(placed) > 0, let(F.sort_array(placed), gathered)).otherwise(none)


#: Tokens that are grouped at once, about, and bytes of a token with what follows it.
_TOKENS_AT_ONCE = 1 << 18
_TOKEN_BYTES = 8
#: Rows whose lexemes' places are marked at once, a byte each.
_ROWS_MARKED = 4_096
#: Beside its terms a row can have: two hashes of all its lexemes, and the places in sixteen words of 64 bits that they take up.
SIGNATURE = ["x1", "x2", *[f"w{i}" for i in range(16)]]
_POINTS = 0x110000


@lru_cache(maxsize=1)
def _word_points(pattern: str, version: str) -> np.ndarray:
    """Bits of the code points that are part of words by ``pattern``, asked of the JVM so that both ways cut alike."""
    jvm = SparkContext._active_spark_context._jvm
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, _POINTS)]))
    kept = jvm.java.util.regex.Pattern.compile(pattern).matcher(points).replaceAll("")
    known = np.zeros(_POINTS, bool)
    known[np.frombuffer(kept.encode("utf-32-le"), "<u4")] = True
    return np.packbits(known)


def word_points() -> np.ndarray:
    return _word_points(f"[^{TOKEN_PATTERN[1:-2]}]", SparkContext._active_spark_context.version)


def cut_words(texts: pa.Array, known: np.ndarray) -> pa.ListArray:
    """The words of each text in reading order: runs of ``known`` code points. Texts must not be null."""
    count = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + count + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = np.append((known[:256] & (np.arange(256) < 128))[data], np.zeros(4, bool))
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.append(data, np.zeros(4, np.uint8))
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        point = (data[lead] & (0x7F >> size)).astype(np.int64)
        for i in (1, 2, 3):
            point = np.where(size > i, point << 6 | padded[lead + i] & 0x3F, point)
        word = known[np.minimum(point, _POINTS - 1)]
        for i in range(4):
            inside[lead[word & (size > i)] + i] = True
    inside = inside[: len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    begins[edge] |= inside[edge]
    at = np.flatnonzero(begins)
    kept = np.flatnonzero(inside)
    # What is kept lies in one piece: a word begins there where as many bytes were kept before it.
    ends = np.append(np.searchsorted(kept, at), len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data[kept]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds), pa.int32()), words)


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64 bits of each word, the same on every machine."""
    plain = words.to_numpy(zero_copy_only=False)
    return hash_array(plain, hash_key=f"lodestone-{seed:06d}", categorize=False) if len(plain) else np.zeros(0, np.uint64)


def _signed(terms: pa.ListArray) -> list[pa.Array]:
    """The columns of ``SIGNATURE`` for rows of distinct terms."""
    coded = terms.flatten().field("lexeme").dictionary_encode()
    codes = coded.indices.to_numpy()
    first, second = (word_hashes(coded.dictionary, seed) for seed in (0, 1))
    ends = terms.offsets.to_numpy()
    full = np.flatnonzero(np.diff(ends))
    # Of rows without terms nothing is added up: each sum runs up to the next row that has some.
    starts = ends[:-1][full]

    def over(rows, values):
        out = np.zeros(len(terms), np.uint64)
        if len(full):
            out[full] = rows.reduceat(values, starts)
        return pa.array(out.view(np.int64))

    hashes = [over(np.bitwise_xor, first[codes]), over(np.bitwise_xor, second[codes])]
    place, taken = (first & np.uint64(1023)).astype(np.int64)[codes], []
    for low in range(0, len(terms), _ROWS_MARKED):
        count = np.diff(ends[low : low + _ROWS_MARKED + 1])
        there = np.zeros((len(count), 1024), bool)
        there[np.repeat(np.arange(len(count)), count), place[ends[low] : ends[low + len(count)]]] = True
        taken.append(np.packbits(there, axis=1).view(np.int64))
    taken = np.concatenate(taken) if taken else np.zeros((0, 16), np.int64)
    return hashes + [pa.array(np.ascontiguousarray(taken[:, i])) for i in range(16)]


def _group(
    words: pa.ListArray, places: pa.ListArray | None, positions: bool, renamed: pa.Table | None
) -> tuple[pa.Array, pa.ListArray]:
    """Each row's number of words and its terms, sorted by lexeme; every row is sorted in one go with the others."""
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(row)) - first[row] + 1 if places is None else places.flatten().to_numpy()
    coded = words.flatten().dictionary_encode()
    codes, known = coded.indices.to_numpy(), coded.dictionary.cast(pa.string())
    if renamed is not None:
        entry = pc.index_in(known, value_set=renamed["word"].combine_chunks())
        lexemes = pc.if_else(entry.is_valid(), renamed["lexeme"].combine_chunks().take(entry), known).dictionary_encode()
        codes, known = lexemes.indices.fill_null(-1).to_numpy()[codes], lexemes.dictionary
        row, place, codes = row[codes >= 0], place[codes >= 0], codes[codes >= 0]
        lengths = np.bincount(row, minlength=len(lengths))
    order = pc.sort_indices(known).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = row * max(len(order), 1) + rank[codes]
    at = np.argsort(key, kind="stable")
    key = key[at]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(starts, len(key))
    fields = {
        "lexeme": known.take(pa.array(order[key[starts] % max(len(order), 1)])),
        "tf": pa.array(np.diff(ends), pa.int32()),
    }
    if positions:
        fields["positions"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[at], pa.int32()))
    rows = np.append(0, np.cumsum(np.bincount(row[at][starts], minlength=len(lengths))))
    terms = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    return pa.array(lengths, pa.int32()), terms


def with_terms(
    df: DataFrame, text: str, language: str = "simple", positions: bool = False, renamed: pa.Table | None = None,
    signed: bool = False,
) -> DataFrame:
    """``df`` with its text replaced by ``n_tokens`` and ``terms``: what ``term_counts`` or ``term_positions`` make of it.

    Words are told apart and grouped in tasks, many rows at once; all but ``simple`` are told apart by Spark. Texts must not be null. Words listed in
    ``renamed`` (word, lexeme) count as their lexeme; with none they are left out, but take up a place. ``signed`` adds ``SIGNATURE``.
    """
    others = [c for c in df.columns if c != text]
    placed = positions and language != "simple"
    plain = language == "simple"
    if plain:
        found = df.select(*others, F.lower(F.col(text)).alias("_words"))
    else:
        words = analyze_placed(F.col(text), language) if placed else analyze(F.col(text), language)
        found = df.select(*others, F.explode(F.array(words)).alias("_words"))
    if placed:
        found = found.select(*others, F.col("_words.lexeme").alias("_words"), F.col("_words.pos").alias("_places"))
    term = "lexeme string, tf int" + ", positions array<int>" * positions
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StructType.fromDDL(term)))])

    for name in SIGNATURE * signed:
        schema = schema.add(name, "long")
    at_once = _TOKENS_AT_ONCE
    context = df.sparkSession.sparkContext
    shared = context.broadcast((renamed, word_points() if plain else None))

    def run(batches):
        names, points = shared.value
        known = np.unpackbits(points).astype(bool) if plain else None
        for batch in batches:
            if plain:
                sizes = pc.binary_length(batch.column("_words")).to_numpy(zero_copy_only=False) // _TOKEN_BYTES
            else:
                sizes = pc.list_value_length(batch.column("_words")).to_numpy(zero_copy_only=False)
            part_of = np.cumsum(sizes, dtype=np.int64) // at_once
            cuts = [*np.flatnonzero(np.diff(part_of, prepend=-1)).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                rows = batch.slice(low, high - low)
                words = cut_words(rows.column("_words"), known) if plain else rows.column("_words")
                grouped = _group(words, rows.column("_places") if placed else None, positions, names)
                more = _signed(grouped[1]) if signed else []
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in others], *grouped, *more], names=[*others, "n_tokens", "terms", *SIGNATURE[: len(more)]])

    return found.mapInArrow(run, schema)


def words_of(text: Column) -> Column:
    """Split on runs of white space of any script; empty text has no words."""
    squeezed = F.trim(F.regexp_replace(text, SPACE_PATTERN, " "))
    return F.when(F.length(squeezed) > 0, F.split(squeezed, " ")).otherwise(
        F.expr("CAST(array() AS array<string>)")
    )


PERTURBATIONS = (
    "identity", "lower", "drop_first", "drop_last", "swap_adjacent", "typo", "truncate",
)


def perturbations(text: Column, row_id: Column, seed: int = 42) -> Column:
    """array<struct<perturbation, query_text>> of one text.

    Positions come from the row id and the seed, so a rerun gives the same queries.
    Variants whose condition does not hold are left out.
    """

    def variants(w):
        n_words = F.size(w)
        n = F.length(text)
        draw = row_id * 7919 + seed
        i = F.pmod(draw, F.greatest(n_words - 1, F.lit(1))).cast("int")
        p = (1 + F.pmod(draw, F.greatest(n - 2, F.lit(1)))).cast("int")
        swapped = F.concat(
            F.slice(w, F.lit(1), i),
            F.slice(w, i + 2, F.lit(1)),
            F.slice(w, i + 1, F.lit(1)),
            F.slice(w, i + 3, F.greatest(n_words - i - 2, F.lit(0))),
        )
        typo = F.concat(
            F.substring(text, F.lit(1), p),
            F.substring(text, p + 2, F.lit(1)),
            F.substring(text, p + 1, F.lit(1)),
            F.substring(text, p + 3, n),
        )
        half = F.greatest(F.lit(4), F.floor(n / 2).cast("int"))
        several, long_enough = n_words >= 2, n > 6
        made = [
            ("identity", None, text),
            ("lower", None, F.lower(text)),
            ("drop_first", several, F.array_join(F.slice(w, F.lit(2), F.greatest(n_words - 1, F.lit(0))), " ")),
            ("drop_last", several, F.array_join(F.slice(w, F.lit(1), F.greatest(n_words - 1, F.lit(0))), " ")),
            ("swap_adjacent", several, F.array_join(swapped, " ")),
            ("typo", long_enough, typo),
            ("truncate", long_enough, F.substring(text, F.lit(1), half)),
        ]
        return F.array_compact(
            F.array(
                *[
                    s if cond is None else F.when(cond, s)
                    for name, cond, q in made
                    for s in [F.struct(F.lit(name).alias("perturbation"), q.alias("query_text"))]
                ]
            )
        )

    return let(words_of(text), variants)
