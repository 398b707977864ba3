"""Personal data: fixed forms as seeds, and identifiers that the contexts of the seeds lead to."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import text_blocks
from lodestone.session import stage

KINDS = ("email", "ip", "card", "phone")
#: A pattern counts from so many different identifiers of a kind on, and from this confidence on.
LEAST_SUPPORT = 3
LEAST_CONFIDENCE = 0.9
#: What a token without a kind as yet counts against its patterns, where one with another kind counts 1. One in ten
#: arbitrary numbers passes for a card; with nine others for each, a pattern of those stays below the confidence.
UNSEEN = 0.02
#: Digits that a token needs to be taken for a possible identifier.
LEAST_DIGITS = 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is matched to its end, so no match can begin inside one.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])+")
_DIGITS = re.compile("[0-9]")
_SPACE = " \t\n\v\f\r"
_TRIM = ".,;:!?\"'()[]{}<>*#$%&"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: the local part is the run of its characters before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed forms, kind being a place in ``KINDS``; ends are exclusive."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        # Leading zeros go first: int() refuses numbers of thousands of digits.
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _token(text: str, start: int, end: int) -> tuple[int, int]:
    """The span widened to whole words, without outer punctuation."""
    while start > 0 and text[start - 1] not in _SPACE:
        start -= 1
    while end < len(text) and text[end] not in _SPACE:
        end += 1
    while start < end and text[start] in _TRIM:
        start += 1
    while end > start and text[end - 1] in _TRIM:
        end -= 1
    return start, end


def possible_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens outside the fixed forms that hold an ``@`` or enough digits to be an identifier."""
    found = {
        _token(text, m.start(), m.end()) for m in _NUMBER.finditer(text) if len(_DIGITS.findall(m[0])) >= LEAST_DIGITS
    }
    at = text.find("@")
    while at >= 0:
        a, b = _token(text, at, at + 1)
        if a < at < b - 1:
            found.add((a, b))
        at = text.find("@", max(at + 1, b))
    taken = [(s, e) for s, _, e in base]
    out, i = [], 0
    ends = 0
    for a, b in sorted(found):
        while i < len(taken) and taken[i][0] < b:
            ends = max(ends, taken[i][1])
            i += 1
        if a < b and ends <= a and (not out or out[-1][1] <= a):
            out.append((a, b))
    return out


def patterns(text: str, start: int, end: int, reach: int = 96) -> list[str]:
    """The lexical patterns of a span: the two words before it, and the words on both sides.

    Words longer than ``reach`` characters enter by the part next to the span.
    """
    left = [w.strip(_TRIM).lower() for w in text[max(0, start - reach) : start].split()[-2:]]
    right = [w.strip(_TRIM).lower() for w in text[end : end + reach].split()[:1]]
    out = []
    if len(left) == 2 and all(left):
        out.append(f"{left[0]} {left[1]} _")
    if left and right and left[-1] and right[0]:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


FOUND = pa.schema([
    ("row_key", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
    ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
    ("seen", pa.list_(pa.struct([
        ("instance", pa.string()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
        ("patterns", pa.list_(pa.string())),
    ]))),
])
FOUND_SCHEMA = (
    "row_key long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start: long, kind: int, end: long>>, "
    "seen array<struct<instance: string, kind: int, start: long, end: long, patterns: array<string>>>"
)


SPANS = "array<struct<start: bigint, kind: int, end: bigint>>"
BLOCK_BYTES = 1 << 20


def replace_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap are one, named after the first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += (text[at:start], f"[{KINDS[kind].upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def _redacted_column(texts: pa.Array, added: pa.Array) -> pa.Array:
    """Each text without its fixed forms and the spans added; null where there are none."""
    out, more = [], iter(added)
    for part in text_blocks(texts, BLOCK_BYTES):
        for text, extra in zip(part, more):
            spans = base_spans(text or "") + [(s["start"], s["kind"], s["end"]) for s in extra.as_py() or ()]
            out.append(replace_spans(text, spans) if text and spans else None)
    return pa.array(out, pa.string())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row_key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row_key", "doc_id", "text")), strict=True):
            base = base_spans(text)
            digest = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            seen = [(s, e, k) for s, k, e in base] + [(s, e, None) for s, e in possible_spans(text, base)]
            counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
            out.append((
                row_key, doc_id, *counts, hashlib.sha256(digest.encode()).hexdigest(),
                [{"start": s, "kind": k, "end": e} for s, k, e in base],
                [{"instance": text[s:e].lower(), "kind": k, "start": s, "end": e, "patterns": patterns(text, s, e)}
                 for s, e, k in seen],
            ))
        columns = zip(*out, strict=True) if out else [[]] * len(FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def discover(
    edges: DataFrame, seeds: DataFrame,
    least_support: int = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE, unseen: float = UNSEEN,
) -> DataFrame:
    """``instance, kind, score``: seeds, and instances that confident patterns lead to.

    ``edges`` has ``pattern, instance``, once each; ``seeds`` has ``instance, kind``. In each
    round a pattern's confidence for a kind is the sum of its instances' scores of that kind over
    the number of its instances of any kind, each one without a kind as yet counting ``unseen``.
    An instance without a kind gets that of the most confident of its patterns that have support,
    and its confidence as score, and keeps both. Rounds go on until one adds nothing. All of it
    is joins and partial sums over the graph, so a pattern or an identifier that fills a third of
    the corpus is aggregated where it is read.
    """
    sizes = stage(edges.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= least_support), "patterns")
    edges = stage(edges.join(sizes, "pattern"), "edges")
    scores = seeds.select("instance", "kind", F.lit(1.0).alias("score"))
    while True:
        kinds = edges.join(scores, "instance").groupBy("pattern", "size").agg(
            F.count("*").alias("known"),
            *(F.sum(F.when(F.col("kind") == i, F.col("score"))).alias(f"sum_{i}") for i in range(len(KINDS))),
            *(F.count(F.when(F.col("kind") == i, 1)).alias(f"support_{i}") for i in range(len(KINDS))),
        )
        weight = F.col("known") + F.lit(float(unseen)) * (F.col("size") - F.col("known"))
        best = F.greatest(*(
            F.when(
                F.col(f"support_{i}") >= least_support,
                F.struct((F.col(f"sum_{i}") / weight).alias("score"), F.lit(-i).alias("place")),
            )
            for i in range(len(KINDS))
        ))
        rated = kinds.select("pattern", best.alias("best")).where(F.col("best.score") >= least_confidence)
        led = edges.join(rated, "pattern").groupBy("instance").agg(F.max("best").alias("best"))
        led = led.select("instance", (-F.col("best.place")).alias("kind"), F.col("best.score").alias("score"))
        led = stage(led.join(scores.select("instance"), "instance", "left_anti"), "led")
        if led.isEmpty():
            return scores
        scores = stage(scores.unionByName(led), "scores")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, added, spans, row_key`` for every row of ``docs``.

    ``base`` has the fixed forms (leftmost, not overlapping within a kind), which the counts
    and ``base_sha256`` are of. They are the seeds: the words around them become patterns,
    the graph of patterns and tokens with an ``@`` or five digits is scored until nothing is added, and
    every occurrence of a token that a confident pattern led to is in ``added``, with the kind
    of the pattern. ``spans`` is the text of both, ``kind:start:end`` by start and kind,
    joined by commas; offsets are code points, ends exclusive. Null and empty texts have
    none. Repeated rows each get a row. Other columns are ignored; an empty table gives no
    rows. ``row_key`` is a hash of id and text.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")
    found = stage(rows.mapInArrow(_find, FOUND_SCHEMA), "found")
    seen = found.select("row_key", F.explode("seen").alias("s")).select("row_key", "s.*")
    instances = seen.withColumn("instance", F.xxhash64("instance"))
    edges = instances.select(F.explode("patterns").alias("pattern"), "instance").select(
        F.xxhash64("pattern").alias("pattern"), "instance"
    ).distinct()
    seeds = instances.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    scores = discover(edges, stage(seeds, "seeds"))
    fresh = instances.where("kind is null").select("row_key", "instance", "start", "end")
    added = (
        fresh.join(scores.select("instance", "kind"), "instance").select("row_key", F.struct("start", F.col("kind").cast("int"), "end").alias("a"))
        .distinct().groupBy("row_key").agg(F.sort_array(F.collect_list("a")).alias("added"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    both = found.drop("seen").join(added, "row_key", "left").withColumn(
        "added", F.coalesce(F.col("added").cast(SPANS), F.array().cast(SPANS))
    )
    spelled = F.transform(
        F.sort_array(F.concat("base", "added")),
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return both.withColumn("spans", F.array_join(spelled, ","))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span found replaced by its kind in brackets, and ``n_chars``, if there, counted anew.

    Spans that overlap are one, named after the first. Null texts stay null, empty ones empty. Repeated rows
    each get a row, other columns stay as they are, and an empty table gives no rows.
    """
    added = find_personal_data(docs, key, text).select("row_key", "added")
    # Fixed forms are read off the text once more, so that only what the patterns added is joined to the texts. Staged,
    # Spark sees how little that is; where it is much, the join deals the texts out once.
    added = stage(added.where(F.size("added") > 0).dropDuplicates(["row_key"]), "added")
    # The row goes as one value, so its columns can have any names.
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(text).alias("body"),
        F.xxhash64(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))).alias("key"),
    )
    joined = rows.join(added, rows["key"] == added["row_key"], "left")
    # One pass over the text in the worker; what has no spans does not come back from there.
    clean = F.arrow_udf(_redacted_column, "string")("body", F.col("added").cast(SPANS))
    out = joined.withColumn("clean", F.coalesce(clean, "body"))
    made = {text: F.col("clean")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
