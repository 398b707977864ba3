"""Fingerprints, substring dedup, near-duplicates, pieces and personal data against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import components, pieces, pii, simhash, spots, substrings
from tests.llm.conftest import ODD_TEXTS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# Fingerprints

def plain_signatures(text):
    """Chains as tuples of words: the same sets without hashes."""
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    content = [i for i, w in enumerate(words) if w not in spots.ANCHORS]
    out = set()
    for i, w in enumerate(words):
        after = [words[j] for j in content if j > i][: spots.CHAIN]
        if w in spots.ANCHORS and len(after) == spots.CHAIN:
            out.add((w, *after))
    return out or {text or ""}


def plain_jaccard(a, b):
    return len(a & b) / len(a | b)


def check_fingerprints(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    got = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert [r.doc_id for r in got] == [d[0] for d in docs]
    want = Counter()
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = (plain_signatures(t) for t in (text, edited, after))
        want[i, len(text), sha(edited), round(plain_jaccard(own, other), 6), round(plain_jaccard(own, following), 6)] += 1
    assert want == Counter(
        (r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 6), round(r.near_next, 6)) for r in rows
    )


def test_fingerprints_against_sets_of_words(small, texts):
    some = [i for i, t in texts.items() if len(t) < 6000]
    rows = spots.compare_with_next(small.where(F.col("doc_id").isin(some))).collect()
    check_fingerprints(rows, [(i, texts[i]) for i in some])
    by_print = {}
    for r in rows:
        by_print.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_print.values())


def test_fingerprints_of_odd_rows(odd):
    rows = spots.compare_with_next(odd.where("doc_id is null or doc_id != 9")).collect()
    check_fingerprints(rows, [(i, t or "") for i, t, _ in ODD_TEXTS if i != 9])
    assert spots.compare_with_next(odd.where("false")).collect() == []
    least = odd.limit(0).sparkSession.createDataFrame([(-(2**63), "z"), (2**63 - 1, "y"), (None, "a"), (0, "b")], "doc_id long, text string")
    edited = {r.doc_id: r.edited_sha256 for r in spots.compare_with_next(least).collect()}
    assert edited == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in ((2**63 - 1, "y"), (0, "b"), (-(2**63), "z"), (None, "a"))}
    alone = spots.compare_with_next(odd.where("doc_id = 1")).first()
    assert alone.near_next == 1.0


def test_near_duplicates_by_signatures(spark, odd):
    base = [f"the word{i} here{i} is new{i} and thing{i} of many{i} parts{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:58] + ["the other one is not here"])), (3, " ".join(base[:20])), (4, " ".join(base))]
    got = spots.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: plain_signatures(t) for i, t in rows}
    assert plain_jaccard(sets[1], sets[2]) >= 0.8 > plain_jaccard(sets[1], sets[3])
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 1}
    classes = {(r.doc_id, r.class_id) for r in spots.near_duplicates(odd).collect()}
    assert (2, 1) in classes and (4, 3) in classes and (8, 8) in classes
    assert spots.near_duplicates(odd.where("false")).collect() == []


# Substring dedup

def plain_repeats(docs, window):
    count = Counter()
    split = [(i, words_of(t)) for i, t in docs]
    for _, w in split:
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return out


@pytest.mark.parametrize("window", [35, 4])
def test_repeats_against_all_windows(spark, small, texts, odd, window):
    both = small.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = substrings.remove_repeats(both, window).collect()
    docs = [*texts.items(), *((i, t) for i, t, _ in ODD_TEXTS)]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == plain_repeats(docs, window)
    r = next(r for r in rows if r.doc_id == 9)
    assert sum(s.end - s.start for s in r.repeats) == r.n_removed and sha(r.kept) == r.kept_sha256
    assert substrings.remove_repeats(odd.where("false")).collect() == []


def test_repeats_with_many_groups_and_common_prefixes(spark, monkeypatch):
    """A line that starts many texts: its prefix is lengthened, and nothing is lost."""
    monkeypatch.setattr(substrings, "GROUP_WORDS", 64)
    monkeypatch.setattr(substrings, "HEAVY_LOCAL", 2)
    line = " ".join(f"line{i}" for i in range(30))
    docs = [(i, f"{line} {' '.join(f'own{i % 40}-{j}' for j in range(40))}") for i in range(120)]
    rows = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == plain_repeats(docs, 35)


# Near-duplicates by SimHash

def plain_fingerprint(text):
    words = [w.encode() for w in words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, reach):
    prints = np.array([p for _, p in points], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints) <= reach
    ids = np.array([2**62 if i is None else i for i, _ in points])
    while True:
        new = np.array([ids[near[k]].min() for k in range(len(ids))])
        if (new == ids).all():
            return [None if i == 2**62 else int(i) for i in ids]
        ids = new


def test_near_duplicates_against_all_pairs(small, texts, odd, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_SIZE", 4)
    both = small.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs = [*texts.items(), *((i, t) for i, t, _ in ODD_TEXTS)]
    points = [(i, plain_fingerprint(t)) for i, t in docs]
    for reach in (3, 20):
        rows = simhash.near_duplicates(both, reach=reach).collect()
        want = Counter((i, f"{p:016x}", c) for (i, p), c in zip(points, plain_components(points, reach), strict=True))
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want
    assert simhash.near_duplicates(odd.where("false")).collect() == []


def test_tree_search_finds_all_near_points():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (4000, 3)).astype(np.uint64)
    points = np.unique(centres[rng.integers(0, 40, 4000)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    tree = simhash.VantageTree(points, 16)
    found = set()
    for leaf, rows in tree.visit(points, 3):
        here = tree.leaves[leaf]
        i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[here]) <= 3)
        found |= set(zip(rows[i].tolist(), here[j].tolist(), strict=True))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= 3)
    assert found == set(zip(i.tolist(), j.tolist(), strict=True))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {(i, 100) for i in range(100, 161)} | {(i, 500) for i in range(500, 560)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


# Pieces

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def plain_best(word, vocabulary, table):
    best = [0.0] + [-np.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - vocabulary.longest), j):
            gain = table.get(word[i:j], vocabulary.unknown if j - i == 1 else None)
            if gain is not None:
                best[j] = max(best[j], best[i] + gain)
    return best[-1]


def test_best_segmentation(vocabulary, texts):
    table = {p: s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True) if k == 0}
    encoder = pieces.Encoder(vocabulary)
    encoder.encode(list(texts.values())[:30])
    for word, line in list(encoder.known.items())[:1500]:
        ids = np.frombuffer(line, "<i4")
        full = word if word[:1] == "\n" else " " + word
        if (vocabulary.kinds[ids] == 0).all():
            assert "".join(vocabulary.pieces[i] for i in ids) == full
            assert vocabulary.scores[ids].sum() == pytest.approx(plain_best(full, vocabulary, table))


def test_segmentation_of_whole_texts_equals_that_of_their_words(vocabulary):
    table = {p: s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True) if k == 0}
    for text in ("two  spaces   and\nlines \n here", "a \n\nb", "tabs\tand ;\r\n ends ", "the cat sat"):
        ids = pieces.Encoder(vocabulary).encode([text])[0]
        unknown = int((vocabulary.kinds[ids] == 1).sum())
        score = vocabulary.scores[ids][vocabulary.kinds[ids] == 0].sum() + unknown * vocabulary.unknown
        assert score == pytest.approx(plain_best(" " + text, vocabulary, table))


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_long_words_are_segmented_like_words_that_advance_together(vocabulary, block, monkeypatch):
    monkeypatch.setattr(pieces, "LONG_BLOCK", block)
    draw = random.Random(5)
    made = ["".join(draw.choices(letters, k=n)) for letters in ("etaoin", "aé漢😀▁", "=/+Zq9") for n in (1, 65, 700)]
    for word in [*made, "the" * 400, "漢字" * 300, " " + "=" * 500]:
        assert pieces.viterbi_long(word, vocabulary) == pieces.viterbi([word], vocabulary)[0]


def test_long_words_take_lookups_by_block_and_not_by_character(vocabulary, monkeypatch):
    calls = []
    find = vocabulary.find
    monkeypatch.setitem(vocabulary.__dict__, "find", lambda probe: calls.append(len(probe)) or find(probe))
    ids = pieces.Encoder(vocabulary).encode(["thequickbrown漢" * 20_000])[0]
    assert pieces.Encoder(vocabulary).decode(ids) == "thequickbrown漢" * 20_000
    assert len(calls) <= vocabulary.longest * (1 + 280_000 // pieces.LONG_BLOCK + 1)


def test_words_kept_are_bounded_in_characters(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHARS", 1000)
    encoder = pieces.Encoder(vocabulary)
    for i in range(30):
        encoder.encode([f"{i}" * 200])
        assert sum(map(len, encoder.known)) <= 1000 and encoder.chars == sum(map(len, encoder.known))


def test_pieces_come_back(odd, small, texts):
    encoded = pieces.encode(odd)
    rows = encoded.collect()
    want = Counter((i, None if t is None else sha(t)) for i, t, _ in ODD_TEXTS)
    assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == want
    assert all(r.n_tokens == len(r.tokens or []) for r in rows)
    assert next(r for r in rows if r.doc_id == 3).tokens == [] and next(r for r in rows if r.doc_id == 4).tokens is None
    back = pieces.decode(encoded).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t) for i, t, _ in ODD_TEXTS)
    assert {r.doc_id: r.decoded_sha256 for r in pieces.encode(small).collect()} == {i: sha(t) for i, t in texts.items()}
    assert pieces.encode(odd.where("false")).collect() == []


# Personal data

def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


HARD = (
    "a@b@c.com x@y.com@z.org q@w 1.2.3.4.5.6.7.8 999.1.1.1.2 0001.2.3.4 +1 (22) 333-4444. +12345678 "
    "4111 1111 1111 1111 0 4111-1111-1111-1111 +1...2 é@b.cd.1.2.3.4@1.2.3.4 ++49 30 1234567 5 5555555555554444"
)


def test_base_spans(texts):
    for text in [*texts.values(), HARD, *(t or "" for _, t, _ in ODD_TEXTS)]:
        assert pii.base_spans(text) == plain_spans(text)


def test_rows_of_personal_data(odd):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == len(ODD_TEXTS)
    for r in rows:
        text = next(t for i, t, _ in ODD_TEXTS if i == r.doc_id) or ""
        want = plain_spans(text)
        spelled = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == sha(spelled) and set(spelled.split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
    assert pii.find_personal_data(odd.where("false")).collect() == []


def test_contexts_of_seeds_lead_to_unseen_identifiers(spark):
    docs = [(i, f"some words, card number 4111 1111 1111 111{d} for") for i, d in enumerate("1111")]
    docs = [(i, f"please charge my card 40000000000000{i:02d} today thanks") for i in range(100)]
    docs.append((200, "please charge my card 12345678 today thanks"))  # of no fixed form, in the same place
    docs.append((201, "the order 12345678 was sent"))  # the same identifier elsewhere
    docs.append((202, "in the year 2024 there were 300000 people"))
    valid = [d for d in docs if plain_spans(d[1]) or d[0] >= 200]
    rows = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(valid, "doc_id long, text string")).collect()}
    a = docs[100][1].index("12345678")
    assert rows[200].spans == f"card:{a}:{a + 8}" and rows[200].n_card == 0
    assert rows[201].spans == "card:10:18" and rows[202].spans == ""


def found_in(spark, texts):
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r.spans.split(":")[0] for r in rows}


@pytest.mark.parametrize("seeds, unseen", [(5, 5), (3, 12), (20, 3)])
def test_unseen_identifiers_are_found_though_they_are_common(spark, seeds, unseen):
    texts = [f"or call me at +49 30 12345{i:02d} tonight" for i in range(seeds)]
    texts += [f"or call me at 555-01{i:02d} tonight" for i in range(unseen)]
    # A context of two kinds, and one of numbers of which one in ten passes for a card, lead to nothing.
    texts += [f"it came from {x} yesterday" for i in range(4) for x in (f"a{i}@b.cd", f"10.0.1.{i}", f"70000{i}")]
    texts += [f"the parcel {40000000000000 + i} left" for i in range(100)]
    kinds = found_in(spark, texts)
    for i, t in enumerate(texts):
        assert kinds[i] == ("phone" if "call" in t else pii.KINDS[plain_spans(t)[0][1]] if plain_spans(t) else "")


def test_contexts_lead_on_until_nothing_is_added(spark):
    hops = 5
    tokens = [[f"u{i}@hop.org" for i in range(3)]] + [[f"u{i}@hop{h}" for i in range(3)] for h in range(hops)]
    texts = [f"so go{h} by{h} {x} now{h}" for h in range(hops) for x in tokens[h] + tokens[h + 1]]
    assert set(found_in(spark, texts).values()) == {"email"}


def test_very_long_numbers_are_no_addresses(spark):
    digits = "7" * 5_000
    text = f"{digits}.1.1.1 and {'0' * 5_000}1.1.1.255 and 1.2.3.{digits}"
    spans = pii.base_spans(text)
    assert [(k, text[a:b].lstrip("0")) for a, k, b in spans if k == 1] == [(1, "1.1.1.255")]
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    assert pii.find_personal_data(docs).first().n_ip == 1 and "[IP]" in pii.redact(docs).first().text


def test_redaction_of_many_spans(spark):
    text = "".join(f"u{i}@mail.example and " for i in range(32_000))
    docs = spark.createDataFrame([(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, None, None)], "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.text, r.n_chars) for r in pii.redact(docs).collect())
    clean = "[EMAIL] and " * 32_000
    assert got == [(1, clean, len(clean))] * 2 + [(2, "", 0), (3, None, None)]
    assert pii.redact(docs.where("false")).collect() == []
    assert pii.replace_spans("abcdefgh", [(4, 0, 6), (1, 3, 3), (2, 1, 5)]) == "a[PHONE]gh"
    assert pii.replace_spans("abcdefgh", [(4, 1, 6), (1, 0, 2)]) == "a[EMAIL]cd[IP]gh"


def test_redaction(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    texts = Counter((r.doc_id, r.text) for r in rows)
    want = Counter()
    for i, t, _ in ODD_TEXTS:
        if t is not None:
            for a, k, b in sorted(plain_spans(t), reverse=True):
                t = t[:a] + f"[{pii.KINDS[k].upper()}]" + t[b:]
        want[i, t] += 1
    assert texts == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
