"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import math
import os
import random
import re
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import attention, components, decontamination, jaccard_join, license_scans, lm_scoring, packing, quality_classifier, quality_rules, substring_dedup, token_counts, url_filters
from cuemill.llm.common import prepare
from cuemill.llm.vocabularies import load_ranks, load_tokenizer, vocabulary
from tests.comparing import duck_rows, spark_rows

DOCS = "doc_id long, text string, score double, n_words long, start long"
BPE, WORDS, PIECES, RANKS = (vocabulary(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"))


def vocabulary_of(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(["ta", "ri", "mo", "né", "su", "lo", "ke"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = vocabulary_of(120, 1)
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    texts: dict[int, str | None] = {i: "\n".join(prose(rng.randint(5, 60)) for _ in range(rng.randint(1, 5))) for i in range(40)}
    for i in range(40, 60):  # near copies of many kinds
        own = texts[i - 40].split(" ")
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts[i] = " ".join(own)
    texts |= {60: None, 61: "", 62: " \n\t ", 63: texts[0].upper(), 64: prose(6000), 65: "one", 66: "two words", 67: "one", 68: "x" * 9000, 69: "a\x0bb\x0cc\rd e <|endoftext|> f  g\n\n h", 70: "*** !!! | <b> $ & %"}
    rows = [(i, t, 1.0, 7, 3) for i, t in texts.items()]
    return rows + [rows[5], (None, texts[7], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def key(row) -> tuple:
    return tuple((x is None, x) for x in row)


def test_token_counts(docs, none):
    tokenizer = load_tokenizer(BPE)
    expected = sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t, *_ in corpus()), key=key)
    for huge in (1 << 16, 500):
        got = token_counts.count_tokens(docs, BPE, huge_chars=huge, chunk_chars=200, overlap_chars=8)
        assert sorted(map(tuple, got.collect()), key=key) == expected
    assert token_counts.count_tokens(none, BPE).count() == 0


def test_spliced_counts_equal_those_of_whole_texts():
    """Runs of white space, joiners, special strings and bytes of all kinds at the cuts; overlaps too narrow to align."""
    tokenizer, rng = load_tokenizer(BPE), random.Random(5)
    bits = ["the", " ", "  ", "\n", "\n\n", "\t", "é", "人人", "123", "'s", "!", "\u00a0", "\u200b", "x" * 40, "<|endoftext|>", "\r\n", "𐍈", "\x0b"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 200)))
        assert token_counts.chunked_count(tokenizer, text, rng.randint(1, 60), rng.randint(1, 20)) == len(tokenizer.encode(text, add_special_tokens=False)), text


def test_packing(docs, none):
    tokenizer = load_tokenizer(WORDS)
    got = packing.pack(docs, WORDS, 256).collect()
    ids = {}
    for i, t, *_ in corpus():
        ids.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    pieces: dict = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["length"], r["doc_tokens"]))
    assert set(pieces) == set(ids)
    for i, found in pieces.items():
        assert Counter(x for _, own, _, _ in found for x in own) == Counter(x for one in ids[i] for x in one)
        assert all(len(own) == n for _, own, n, _ in found)
        if len(ids[i]) == 1:
            assert [x for _, own, _, _ in sorted(found) for x in own] == ids[i][0] and {s for *_, s in found} == {len(ids[i][0])}
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total, pad = sum(n for s in sequences.values() for _, n in s), sum(packing.padding(sum(n for _, n in s), 256) for s in sequences.values())
    assert pad < 0.1 * total
    assert packing.pack(none, WORDS).count() == 0


def test_best_cuts_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        places = sorted({0, *rng.sample(range(1, 60), 12), 60})
        penalties = [0] + [rng.choice([0, 3, 9]) for _ in places[1:]]
        if max(b - a for a, b in zip(places, places[1:])) > 16:
            continue
        cost = lambda cuts: sum(min(16 - (b - a), 16 if (b - a) not in (16, 8, 4) else 0) + penalties[places.index(b)] + packing.SEQUENCE_COST for a, b in zip(cuts, cuts[1:]))
        best = min(cost((0, *mid, 60)) for k in range(len(places) - 1) for mid in combinations(places[1:-1], k) if all(b - a <= 16 for a, b in zip((0, *mid), (*mid, 60))))
        assert cost(tuple(packing.best_cuts(places, penalties, 16))) == best


def shingles(text: str | None, width: int) -> set:
    ws = words_of(lower(text or ""))
    return {tuple(ws)} if 0 < len(ws) < width else {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_components(docs, none, width, percent):
    sets = {i: shingles(t, width) for i, t, *_ in corpus() if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    expected = sorted(((i, len(shingles(t, width)), None if i is None else root(i)) for i, t, *_ in corpus()), key=key)
    got = jaccard_join.jaccard_components(docs, width, percent)
    assert sorted(map(tuple, got.collect()), key=key) == expected
    assert jaccard_join.jaccard_components(none, width, percent).count() == 0


def test_crowded_buckets(spark, monkeypatch):
    """1,500 documents share half of their words, so that their buckets are open and large; 30 have a near copy. No link is lost, and pairs compared fall."""
    prepare(spark)
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 200_000)}"
    passage = [word() for _ in range(60)]
    texts = {i: passage + [word() for _ in range(60)] for i in range(1500)}
    for i in range(30):
        copy = list(texts[50 * i + 7])
        copy[-1] = "other"
        texts[2000 + i] = copy
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    compared = []
    inner = jaccard_join.open_buckets

    def watched(members, sets, percent):
        before = members.groupBy("k1").count().selectExpr("sum(count * count)").first()[0]
        out, tables = inner(members, sets, percent)
        compared.append((before, out.groupBy("k1").count().selectExpr("sum(count * count)").first()[0] or 0))
        return out, tables

    monkeypatch.setattr(jaccard_join, "open_buckets", watched)
    monkeypatch.setattr(jaccard_join, "CROWDED", 16)
    got = jaccard_join.jaccard_components(docs, 3, 80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: 50 * (i - 2000) + 7 if i >= 2000 else i for i in texts}
    assert compared[0][0] > 100 * len(texts) and compared[0][1] < 20 * len(texts), compared


@pytest.mark.parametrize("width,percent", [(3, 90), (1, 60)])
def test_jaccard_components_with_every_open_bucket_crowded(docs, none, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWDED", 0)
    monkeypatch.setattr(jaccard_join, "CHUNK", 2)
    test_jaccard_components(docs, none, width, percent)


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        bands, memo = jaccard_join.Bands(percent), {}
        for size in (1, 2, 5, 9, 10, 19, 20, 40, 60, 95, 100, 300):
            for _ in range(20):
                base = rng.integers(0, 2**63, size + 40, dtype=np.uint64)
                drop = int(rng.integers(0, size * (100 - percent) // 100 + 1))
                a, b = np.unique(base[:size]), np.unique(np.concatenate([base[drop:size], base[size : size + int(rng.integers(0, 3))]]))
                common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if len(b) and 100 * common >= percent * union:
                    assert np.intersect1d(jaccard_join.block_keys(a, bands, memo), jaccard_join.block_keys(b, bands, memo)).size
                differ = np.bitwise_count(jaccard_join.folded(jaccard_join.parity_sketch(a), 32) ^ jaccard_join.folded(jaccard_join.parity_sketch(b), 32)).sum()
                assert differ <= union - common


def test_connected_components(spark):
    prepare(spark)
    links = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (7, 7)] + [(200, x) for x in range(201, 230)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 70: 50, 100: 50, **dict.fromkeys(range(200, 230), 200)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_spans(words: list[re.Match], text: str, min_words: int, line_words: int) -> set[tuple[int, int]]:
    """Spans of word numbers, word by word."""
    gap = lambda k: text[words[k - 1].end() : words[k].start()]
    upper = lambda w: unicodedata.category(w[0]) == "Lu"
    opens = [k for k in range(len(words)) if k == 0 or words[k - 1][0][-1] in ".!?" or gap(k).count("\n") > 1 or upper(words[k][0])]
    ends = [*opens[1:], len(words)]
    out = {(a, next(e for e in ends if e - a >= min_words)) for a in opens if len(words) - a >= min_words}
    out |= {(max(a for a in opens if e - a >= min_words), e) for e in ends if e >= min_words}
    for least in (1, 2):
        first = [k for k in range(len(words)) if k == 0 or gap(k).count("\n") >= least]
        out |= {(a, e) for a, e in zip(first, [*first[1:], len(words)]) if e - a >= line_words}
    return out if words else set()


def naive_dedup(rows: set[tuple], min_words: int, line_words: int) -> dict[tuple, tuple[str | None, tuple]]:
    seen, out, space = {}, {}, "\t\n\x0b\x0c\r "
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        gone = set()
        for a, e in sorted(naive_spans(words, text, min_words, line_words)):
            content = tuple(lower(w[0]) for w in words[a:e])
            if content in seen:
                gone |= set(range(a, e))
            else:
                seen[content] = (i, a)
        left = text and text[: words[0].start() if words else len(text)] + "".join(text[w.start() : (words[k + 1].start() if k + 1 < len(words) else len(text))] for k, w in enumerate(words) if k not in gone)
        if words and len(words) - 1 in gone:
            left = left.rstrip(space)
        starts = [k for k in sorted(gone) if k - 1 not in gone]
        stops = [k for k in sorted(gone) if k + 1 not in gone]
        out[i, text] = (left, tuple((words[a].start(), words[b].end()) for a, b in zip(starts, stops)))
    return out


@pytest.mark.parametrize("min_words,line_words", [(20, 5), (6, 1), (3, 100)])
def test_substring_dedup(spark, docs, none, min_words, line_words):
    rng, words = random.Random(7), vocabulary_of(300, 2)
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + rng.choice(".!?")
    passages = [" ".join(sentence(rng.randint(3, 25)) for _ in range(rng.randint(2, 6))) for _ in range(6)]
    made = []
    for i in range(60):  # passages inside other text, wrapped, in other case, one after the other, at both ends
        own = [" ".join(sentence(rng.randint(1, 12)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            p = rng.choice([p, p.upper(), p.replace(" ", "\n", 3), p.replace(" ", "  ")])
            at = rng.randrange(len(own))
            cut = own[at].split(" ")
            cut.insert(rng.randint(0, len(cut)), p)
            own[at] = " ".join(cut)
        made.append((1000 + i, rng.choice(["\n", "\n\n", "\n \n\n"]).join(own), None, None, None))
    rows = corpus() + made + [(2000, (passages[0] + " ") * 3, 1.0, 7, 3), (2001, "É. " * 40, 1.0, 7, 3), (2002, " \n" + passages[1] + " \t", 1.0, 7, 3), (2003, passages[2] * 400, 1.0, 7, 3)]
    expected = naive_dedup({(r[0], r[1]) for r in rows}, min_words, line_words)
    table = spark.createDataFrame(rows, DOCS).repartition(5)
    got = substring_dedup.substring_dedup(table, min_words, line_words)
    assert got.columns == [*table.columns, "removed_units"]
    result = sorted(((r["doc_id"], r["text"], tuple(tuple(s) for s in r["removed_units"])) for r in got.collect()), key=key)
    assert result == sorted(((r[0], *expected[r[0], r[1]]) for r in rows), key=key)
    assert any(x[2] for x in result)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_dedup_in_more_ranges_than_partitions(spark, docs, none, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 4000)
    test_substring_dedup(spark, docs, none, 6, 2)


def test_substring_dedup_catches_passages_of_over_50_words(spark):
    """Passages set into the middle of other texts' sentences go from all but the first; the other words stay."""
    rng, words = random.Random(8), [w.lower() for w in vocabulary_of(900, 3)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    prose = lambda n: " ".join(sentence(rng.randint(2, 15)) for _ in range(n))
    passage = " ".join(sentence(n) for n in (9, 21, 14, 12))
    texts = []
    for _ in range(12):
        before, after = prose(6).split(" "), prose(6)
        texts.append(" ".join(before[: rng.randint(3, len(before))]) + " " + passage + " " + after)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(table).collect()}
    assert got == {i: t if i == 0 else t.replace(passage + " ", "") for i, t in enumerate(texts)}


def test_pipeline_cuts_short_lines_and_wrapped_paragraphs(spark):
    import corpus_pipeline

    passage = "one two three four five six seven eight nine ten eleven twelve".split()
    wrapped = lambda n: "\n".join(" ".join(passage[i : i + n]) for i in range(0, 12, n))
    texts = ["first\nA short line of six words\n\n" + wrapped(4), "second\na  short line of SIX words\n\n\nfirst", "third of its own\n\n" + wrapped(3), "First\n\n\n\nsecond", None, ""]
    table = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_units(spark, table, "").collect()}
    expected = {0: texts[0], 1: "second", 2: "third of its own", 4: None, 5: ""}
    assert got == {i: (t, None if t is None else len(t)) for i, t in expected.items()}


def test_decontamination(spark, docs, none):
    rng = random.Random(9)
    words = vocabulary_of(400, 5)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(15, 55)))) for k in range(12)] + [(90, None), (91, "")]
    planted, rows = set(), []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        if i % 3 == 0:
            k = i % 12
            at = rng.randrange(len(text))
            text[at:at] = [(w.upper() if w.isascii() else w) + "," for w in items[k][1].split()]
            planted.add((i, k))
        rows.append((i, " ".join(text)))
    table = spark.createDataFrame(rows + [(100, None), (101, ""), (None, items[0][1])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(table, benchmark).collect()
    assert planted <= {(r["doc_id"], r["item_id"]) for r in got}
    texts = dict(rows)
    for r in got:
        item = items[r["item_id"]][1].split()
        window = (texts[r["doc_id"]] if r["doc_id"] is not None else items[0][1]).lower().replace(",", "").split()
        assert decontamination.lcs_length(item, window) >= r["lcs"] >= decontamination.LCS_WITH_ANSWER * len(item)
    assert decontamination.decontaminate(none, benchmark).count() == 0 and decontamination.decontaminate(table, benchmark.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, docs, none, monkeypatch):
    """Blocks of two items, two of them in one pass over the documents, or one: all planted items are found."""
    monkeypatch.setattr(decontamination, "ITEMS", 2)
    for blocks in (2, 1):
        monkeypatch.setattr(decontamination, "BLOCKS", blocks)
        test_decontamination(spark, docs, none)


def test_decontamination_of_odd_tables(spark):
    """Ties, repeated rows, clashing columns, very long texts, items that repeat or have null ids."""
    rng = random.Random(2)
    words = vocabulary_of(300, 6)
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    item = " ".join(prose(40))
    long = prose(15000)
    long[9000:9000] = item.split()
    rows = [(1, item, 1, 0.5), (1, item, 1, 0.5), (2, f"{item} {' '.join(prose(300))} {item}", 2, None), (3, " ".join(long), 3, 0.1), (4, " ".join(prose(15000)), None, None), (None, item, 5, 0.2), (5, " \n ", 6, 0.3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, item_id long, cosine double")
    benchmark = spark.createDataFrame([(7, item, 1), (7, item, 2), (8, item, 3), (None, item, 4)], "item_id long, text string, doc_id long")
    got = decontamination.decontaminate(table, benchmark).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter({(i, k): 2 if i == 1 else 1 for i in (1, 2, 3, None) for k in (7, 8)})
    assert len({(r["start"], r["lcs"]) for r in got if r["doc_id"] == 2}) == 1 and {r["lcs"] for r in got} == {40}, "items of the same text have the same windows"


def brute_force_hits(rows, items) -> set[tuple[int, int]]:
    sizes = list(decontamination.WINDOW_SIZES)
    while sizes[-1] < max(len(x.split()) for _, x in items):
        sizes.append(2 * sizes[-1])
    hits = set()
    for (i, text), (k, item) in ((r, x) for r in rows for x in items):
        words, item = text.split(), item.split()
        for size in sizes:
            for first in range(0, max(1, len(words) - size // 2 + 1), size // 2):
                window = words[max(0, first - len(item)) : first + size + len(item)]
                common, answer = decontamination.lcs_length(item, window), decontamination.has_answer(item, window)
                if common >= decontamination.LCS_ALONE * len(item) or answer and common >= decontamination.LCS_WITH_ANSWER * len(item):
                    hits.add((i, k))
    return hits


def paraphrases():
    rng = random.Random(4)
    words = vocabulary_of(1500, 5)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(15, 58)))) for k in range(20)] + [(20, words[0]), (21, " ".join(words[:3]))]
    rows, planted = [], set()
    for i in range(120):
        text, k = [rng.choice(words) for _ in range(rng.randint(20, 300))], i % 20
        own = items[k][1].split()
        share = (0.2, 0.3, 0.4, 0.5)[i % 4]
        for at in rng.sample(range(len(own) - 4), min(len(own) - 4, int(share * len(own)))):
            own[at] = rng.choice(words)
        at = rng.randrange(len(text))
        text[at:at] = own
        planted.add((i, k))
        rows.append((i, " ".join(text)))
    return rows, items, planted


def test_decontamination_finds_paraphrases(spark):
    rows, items, planted = paraphrases()
    expected = brute_force_hits(rows, items)
    assert planted <= expected
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(expected)


def test_decontamination_tries_windows_after_the_best_one(spark):
    rng = random.Random(6)
    words = vocabulary_of(1500, 5)
    item = rng.sample(sorted(set(words)), 40)
    filler = [w for w in words if w not in item]
    prose = lambda n: [rng.choice(filler) for _ in range(n)]
    told = [rng.choice(filler) if i % 4 == 1 and i < 36 else w for i, w in enumerate(item)]
    text = [*prose(100), *item[::-1], *prose(400), *told, *prose(100)]  # the same words the other way round come first
    docs = [(0, " ".join(text)), *((i, " ".join(prose(200))) for i in range(1, 30))]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["answer"]) for r in got] == [(0, 7, True)] and got[0]["start"] > 300


def test_lcs():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontamination.lcs_length(a, b) == best[-1][-1]


def test_quality_rules(docs, none):
    def base(text):
        ws, text = words_of(text), text or ""
        triples = Counter(zip(ws, ws[1:], ws[2:]))
        again = {j for i in range(len(ws) - 2) if triples[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if words_of(x)]
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(ws) < 50 or 100 * len(again) > 50 * len(ws)

    got = quality_rules.quality_rules(docs, PIECES, RANKS)
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, rows), key=key) == sorted(((i, *base(t)) for i, t, *_ in corpus()), key=key)
    assert got.where("kept AND (base_failed OR reason IS NOT NULL)").count() == 0
    assert quality_rules.quality_rules(none, PIECES, RANKS).count() == 0
    assert quality_rules.script_of("мир") == "cyrillic" and quality_rules.script_of("123") == quality_rules.script_of("1 → €") == "none" and quality_rules.script_of("שלום") == "other" and quality_rules.script_of("né") == "latin"


def test_quality_rules_measure_as_naive_loops_do(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ranks, _ = load_ranks(RANKS)
    both = (lambda w: [model.id_to_piece(i).startswith("<0x") for i in model.encode(w)], lambda w: [len(x := ranks.decode_single_token_bytes(i)) == 1 and x[0] > 127 for i in ranks.encode_ordinary(" " + w)])
    ids = (model.encode, lambda w: ranks.encode_ordinary(" " + w))

    def naive(text):
        out = []
        for encode, bare in zip(ids, both):
            tokens = [i for w in words_of(text) for i in encode(w)]
            n = len(tokens)
            entropy = -sum(k / n * math.log2(k / n) for k in Counter(tokens).values())
            out += [sum(map(len, words_of(text))) / n, sum(x for w in words_of(text) for x in bare(w)) / n, entropy] if n else [None] * 3
        return out

    rows = [(200, "人人生而自由 在尊严和权利上一律平等 ① ⑳ 𐍈𐍈"), (201, "مساواة"), (202, "1 2 3 ½"), (203, "Ωμέγα ὦ ἄνθρωπε"), (204, "qxz " * 400), (205, "zqj-xv" * 60)]
    table = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS))
    columns = [f"{x}{end}" for end in ("", "_ranks") for x in ("chars_per_token", "fallback_share", "token_entropy")]
    texts = {i: t for i, t, *_ in corpus()} | dict(rows)
    for r in quality_rules.quality_rules(table, PIECES, RANKS).where("doc_id IS NOT NULL").collect():
        assert [r[c] for c in columns] == pytest.approx(naive(texts[r["doc_id"]])), r["doc_id"]
        assert (r["reason"] is None) == (not any(r[c] is not None and quality_rules.outside([r[x] for x in some], sum(len(e(w)) for w in words_of(texts[r["doc_id"]])), band) for some, e, band in zip((columns[:3], columns[3:]), ids, quality_rules.BANDS[r["script"]]) for c in some[:1]))


def test_quality_rules_keep_documents_that_labels_call_good(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules.query(spark, sf).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg({"*": "count", "reason": "count"}).collect()
    rejected = {r["quality"]: (r["count(reason)"], r["count(1)"]) for r in judged}
    assert rejected[1][0] == 0 and rejected[1][1] > 300 and rejected[0][0] > 0


def test_quality_classifier(spark):
    prepare(spark)
    rng = random.Random(4)
    words = vocabulary_of(200, 8)
    rows = []
    for i in range(600):
        good = i % 4 > 0
        ws = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        rows.append((i, " ".join(ws if good else [w.upper() + "!!" for w in ws]), int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.where("doc_id < 400").select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    weights, bias = quality_classifier.train(table, labels)
    assert (weights, bias)[1] == quality_classifier.train(table.repartition(5), labels)[1]
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(table, weights, bias).collect()}
    assert sum((got[i] >= 0.3) == bool(q) for i, _, q in rows[400:]) >= 195
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    scores = [r["score"] for r in quality_classifier.score(odd, weights, bias).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    assert quality_classifier.keep(table, weights, bias, 0.3).columns == table.columns


def test_classifier_scores_and_steps_as_naive_loops_do(spark, docs, none):
    buckets = 64
    features = lambda ws: [b for w in ws for b in quality_classifier.word_features(w.encode(), buckets)] + [buckets for a, b in zip(ws, ws[1:]) if a == b]
    weights = np.random.default_rng(1).standard_normal(buckets + 1)
    got = quality_classifier.score(docs, weights, 0.2)
    expected = []
    for i, t, *_ in corpus():
        found = features(words_of(t))
        expected.append((i, 1 / (1 + math.exp(-(sum(weights[b] for b in found) / (len(found) + quality_classifier.PRIOR) + 0.2)))))
    assert [x for r in sorted(map(tuple, got.collect()), key=key) for x in r if x is not None] == pytest.approx([x for r in sorted(expected, key=key) for x in r if x is not None])
    assert quality_classifier.score(none, weights, 0.2).count() == quality_classifier.keep(none, weights, 0.2, 0.5).count() == 0
    # one step for one text: the gradient of its loss, by differences
    counts = Counter(features("ta ri ri mo".split()))
    row = (np.array(sorted(counts), "<i4"), np.array([counts[b] for b in sorted(counts)], "<i4"), 1)
    rng = np.random.default_rng(7)
    vectors, out = rng.uniform(-1 / 3, 1 / 3, (buckets + 1, 3)).astype(np.float32), np.zeros((3, 2), np.float32)
    hidden = sum(n * vectors[b].astype(float) for b, n in counts.items()) / (sum(counts.values()) + quality_classifier.PRIOR)

    def loss(out, bias):
        z = hidden @ out + bias
        return math.log(sum(math.exp(x) for x in z)) - z[1]

    step = 1e-4
    grad = np.array([[(loss(out + step * e, np.zeros(2)) - loss(out - step * e, np.zeros(2))) / (2 * step) for e in (np.outer(np.eye(3)[i], np.eye(2)[j]) for j in (0, 1))] for i in range(3)])
    bias = np.array([(loss(out, step * np.eye(2)[j]) - loss(out, -step * np.eye(2)[j])) / (2 * step) for j in (0, 1)])
    moved, own = quality_classifier.fit([row], buckets, dim=3, epochs=1, rate=0.5)
    after = -0.5 * grad  # the map was zero, so the vectors do not move in the first step
    assert own == pytest.approx(-0.5 * (bias[1] - bias[0]), abs=1e-5) and moved == pytest.approx(vectors @ (after[:, 1] - after[:, 0]), abs=1e-5)


def test_classifier_training_takes_one_row_an_id(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 2)] + [(1, 1), (3, 0), (1, 1), (None, 1)], "doc_id long, quality int")
    weights, bias = quality_classifier.train(docs, labels)
    again = quality_classifier.train(docs.unionByName(docs).unionByName(docs), labels)
    assert bias == again[1] and (weights == again[0]).all()
    for table, some in ((none, labels), (docs, labels.limit(0))):
        weights, bias = quality_classifier.train(table, some)
        assert bias == 0 and all(abs(r["score"] - 0.5) < 0.1 for r in quality_classifier.score(docs, weights, bias).collect())
    kept = quality_classifier.keep(docs, weights, bias, 0.0)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=key) == sorted(map(tuple, docs.collect()), key=key)


def test_url_filters(spark):
    urls = ["http://a.example.net/en/x", "http://example.net/en", "http://EXAMPLE.com/de/", "http://x.org/fr/", "http://xorg/fr/", "http://net", "http://a.net/", "net/", None, "", "https://h.com/a/login/b?x=http://y", "http://casino-7.example.com/q", "http://h.com/robots.txt#a", "://:80/net/", "http://myexample.net/en/", "ftp://u@a.example.com:8/de/é"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string")
    rules = url_filters.BASE_RULES + url_filters.OWN_RULES

    def judged(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if re.match(url_filters.rule_regex(r.pattern), host + path)]
        best = max(fits, key=lambda r: (r.rank, len(r.pattern), r.pattern), default=None)
        return host, path, best and best.pattern, best and best.verdict

    expected = sorted(((i, *judged(u)) for i, u in map(tuple, pages.collect())), key=key)
    for inline in (True, False):
        got = url_filters.filter_urls(pages, rules, inline=inline).select("page_id", "host", "path", "rule", "verdict")
        assert sorted(map(tuple, got.collect()), key=key) == expected
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0


def test_url_filters_of_odd_tables(spark):
    """Clashing columns, null ids, repeated rows and very long urls."""
    urls = ["http://example.net/en/" + "casino/" * 20000, "http://" + "a." * 5000 + "net/x", "x" * 100000, "http://h.org/fr" + "?" * 50000, None]
    rows = [(i if i != 3 else None, u, "r", "v", "h", "t") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string, host string, token string")
    plain = url_filters.filter_urls(pages.select("page_id", "url"), url_filters.BASE_RULES + url_filters.OWN_RULES).select("page_id", "host", "path", "rule", "verdict")
    clashing = url_filters.filter_urls(pages, url_filters.BASE_RULES + url_filters.OWN_RULES).select("page_id", "host", "path", "rule", "verdict")
    found = sorted(map(tuple, clashing.collect()), key=key)
    assert found == sorted(map(tuple, plain.collect()), key=key) and len(found) == 10
    assert {(r[0], r[3], r[4]) for r in found if r[0] in (0, 1)} == {(0, "example.net/en/", "allow"), (1, "net/", "block")}


def test_license_scans(spark, none):
    texts = {
        1: "x CC BY y. General\npublic-license! cc by",
        2: "Licensed under the Apache License, Version 2.0.",
        3: "Released under the terms of the MIT License; and under the MIT license",
        4: "Licensed under CC BY-NC 4.0. Copyright (c) 2020 some body. All rights reserved.",
        5: "copyright a b c d e f g h all rights reserved",
        6: None,
        7: "",
        8: "under the terms of mit license",
        9: "accby by cc",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scans.scan_licenses(df).collect()}
    for i, t in texts.items():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        hits = sorted((k, label) for p, label in license_scans.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(hits), *((hits[0][0], hits[-1][0]) if hits else (None, None)))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert "apache-2.0" in got[2]["labels"] and got[3]["labels"] == "mit-named" and "cc-by-notice" in got[4]["labels"] and "copyright-reserved" in got[4]["labels"]
    assert "copyright-reserved" not in got[5]["labels"] and got[8]["labels"] == "" and got[9]["labels"] == ""
    assert license_scans.scan_licenses(none).count() == 0


def test_license_texts_match_whole_and_nothing_less(spark):
    filled = {k: re.sub(r"<<var:(\d+)>>", lambda m: "any " * int(m[1]), re.sub(r"<<optional>>|<<end>>", "", v)) for k, v in license_scans.TEMPLATES.items()}
    bare = {k: re.sub(r"<<var:\d+>>", "", re.sub(r"<<optional>>(?:(?!<<optional>>|<<end>>).)*<<end>>", "", re.sub(r"<<optional>>(?:(?!<<optional>>|<<end>>).)*<<end>>", "", v, flags=re.S), flags=re.S)) for k, v in license_scans.TEMPLATES.items()}
    rows = [(k, f"x {t.upper()} y\n{t}") for texts in (filled, bare) for k, t in texts.items()]
    rows += [(f"-{k}", " ".join(t.split()[:-1])) for k, t in filled.items() if k.endswith("-text")]
    got = license_scans.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), phrases={}).collect()
    for r in got:
        k = rows[r["doc_id"]][0]
        assert (k.removeprefix("-") in r["labels"].split(",")) == (not k.startswith("-")), k
        assert sum(x["label"] == k for x in r["places"]) == (0 if k.startswith("-") else 2)


def test_license_scans_equal_their_sql(spark, docs):
    """Null ids, repeated rows, clashing columns, very long texts, and wording cut, stretched and interleaved at random."""
    rng = random.Random(11)
    bits = [w for t in (*license_scans.TEMPLATES.values(), *license_scans.PHRASES) for w in [re.sub(r"<<[a-z:0-9]+>>", "", t)]]
    made = []
    for i in range(300):
        t = " ".join(rng.choice(bits) if rng.random() < 0.6 else rng.choice(["a b c", "all", "É", "copyright", "x" * 50]) for _ in range(rng.randint(1, 5))).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            t.insert(rng.randrange(len(t) + 1), rng.choice(["the", "cc", "2", "--", "license"]))
        made.append((1000 + i if rng.random() < 0.9 else None, " ".join(t[: rng.randint(1, len(t))]), None, None, None))
    made += [(5000, " ".join(["all rights reserved copyright cc by"] * 5000), 0.0, 1, 2), made[0], made[0]]
    table = docs.unionByName(spark.createDataFrame(made, DOCS))
    c = duckdb.connect()
    c.register("documents", table.select("doc_id", "text").toArrow())
    assert spark_rows(license_scans.scan_licenses(table).drop("places")) == duck_rows(c, license_scans.ORACLE_SQL)


def test_lm_scoring(docs, none):
    training = docs.where("doc_id % 5 <> 0")
    got = lm_scoring.score_documents(docs, training, WORDS).collect()
    counts: Counter = Counter()
    for i, t, *_ in corpus():
        if i is not None and i % 5:
            counts.update([*words_of(lower(t or "")), ""])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t, *_ in corpus():
        ws = [*words_of(lower(t or "")), ""]
        expected.append((i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)))
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=key) == sorted(expected, key=key)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.score_documents(none, none, WORDS).count() == 0


def test_lm_score_is_that_of_a_naive_loop(docs, monkeypatch):
    """The text's probability token by token: model, share of the id in its token, attachment and spelling; then word by word, mixed with the counts."""
    training = [(i, t) for i, t, *_ in corpus() if i is not None and i % 5]
    got, chosen, best = {}, [], lm_scoring.best_shares
    monkeypatch.setattr(lm_scoring, "best_shares", lambda *a: chosen.append(best(*a)) or chosen[-1])
    for r in lm_scoring.score_documents(docs, docs.where("doc_id % 5 <> 0"), WORDS).collect():
        got.setdefault(r["doc_id"], set()).add((round(r["model_score"], 2), round(r["score"], 2)))
    all_counts = Counter(w for _, t in training for w in [*words_of(lower(t or "")), ""])
    floor = math.log(sum(all_counts.values()) + 0.1 * (len(all_counts) + 1))
    tokenizer, counts = load_tokenizer(WORDS), Counter()
    for _, t in training:
        counts.update(words_of(lower(t or "")))
    ids_of = lambda w: tokenizer.encode(w, add_special_tokens=False).ids
    closes = {i for token, i in tokenizer.get_vocab(with_added_tokens=True).items() if token.endswith("</w>")}
    id_n, begins, attached, forms = Counter(), Counter(), Counter(), {}
    for w, n in counts.items():
        ids = ids_of(w)
        forms.setdefault(tuple(ids), []).append(n)
        for k, i in enumerate(ids):
            id_n[i] += n
            begins[i] += n * (k == 0)
            attached[i] += n * (k > 0 and ids[k - 1] in closes)
    size = tokenizer.get_vocab_size()
    table = np.zeros(size)
    table[list(id_n)] = list(id_n.values())
    tokens = lm_scoring.Tokens(table)
    n_docs = len(training)
    params = lm_scoring.fit(lm_scoring.id_and_text(docs.where("doc_id % 5 <> 0")), WORDS, tokens, n_docs)
    for doc, text, *_ in [r for r in corpus() if r[0] in (0, 9, 60, 61, 62, 63, 65, 66, 69, 70)]:
        words = words_of(lower(text or ""))
        ids = [i for w in words for i in ids_of(w)]
        if "<|" in (text or ""):
            continue  # special strings are ids of their own
        sequence = [*tokens.token[ids].tolist(), lm_scoring._END]
        by_token = []
        for k, target in enumerate(sequence):  # one place at a time, from the window of its block and the one before
            begin = max(0, (k // attention.BLOCK - 1) * attention.BLOCK)
            x = attention.blocks_of([np.array(sequence[begin : k + 1], np.int32)], tokens.kinds, lm_scoring.KINDS - 1)
            if begin:
                x[0][0, 0] = tokens.kinds[sequence[begin - 1]]
            by_token.append(float(attention.log_probabilities(params, x[0], x[1], x[2])[x[3]][-1]))
        mixed, whole, at = 0.0, 0.0, 0
        for place, w in enumerate([*words, ""]):
            own = ids_of(w) if w else []
            total = sum(by_token[at : at + len(own)]) + sum(float(tokens.inside[i]) for i in own) if w else by_token[-1]
            at += len(own)
            for k, i in enumerate(own):
                if k == 0 or own[k - 1] in closes:
                    total += math.log(((begins if k == 0 else attached)[i] + 0.1) / (begins[i] + attached[i] + 0.2))
            known = forms.get(tuple(own), [])
            total += math.log((counts[w] + 0.1) / (sum(known) + 0.1 * (len(known) + 1))) if w else 0.0
            share = chosen[0][0, max(g for g, least in enumerate(lm_scoring.GATES) if place >= least)]
            counted = math.log(all_counts[w] + 0.1) - floor + (0.0 if all_counts[w] else total)
            mixed += np.logaddexp(math.log(share) + counted, math.log1p(-share) + total)
            whole += total
        near = lambda x, y: abs(x / math.log(10) - y) < 0.02 + 1e-4 * abs(y)
        assert any(near(whole, x) and near(mixed, y) for x, y in got[doc]), (doc, whole / math.log(10), mixed / math.log(10), got[doc])


def test_lm_shares_are_the_best_and_words_beyond_the_head_count_as_others(docs, monkeypatch):
    training, held, frequent, best = docs.where("doc_id % 5 <> 0"), [], lm_scoring.frequent_words, lm_scoring.best_shares

    def kept_shares(scored, rest, shares):
        sums = np.array([r["mixed"] for r in lm_scoring._mixed(scored.select("row", "mixed").join(rest.select("row", "mixed_rest"), "row", "left")).collect()]).sum(0)
        out = best(scored, rest, shares)
        sums = sums.reshape(shares.shape)
        assert all(sums[list(shares[:, g]).index(out[0, g]), g] >= sums[:, g].max() - 1e-5 for g in range(shares.shape[1]))
        held.append(out.tolist())
        return out

    monkeypatch.setattr(lm_scoring, "best_shares", kept_shares)
    of = lambda: sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 4), round(r["model_score"], 3), round(r["score"], 3)) for r in lm_scoring.score_documents(docs, training, WORDS).collect())
    whole = of()
    monkeypatch.setattr(lm_scoring, "frequent_words", lambda counts: frequent(counts, 12))
    small = of()
    assert held[0] == held[1] and len(whole) == len(small)
    assert all(a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=0.01) for a, b in zip(whole, small))


@pytest.mark.parametrize("sf", ["0.01", pytest.param("0.1", marks=pytest.mark.skipif("LM_WHOLE" not in os.environ, reason="takes minutes: set LM_WHOLE"))])
def test_lm_beats_its_base_on_documents_held_out(spark, sf):
    sums = {r["held_out"]: r for r in lm_scoring.query(spark, f"/root/testdata/sf{sf}").groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).collect()}
    assert all(r["score"] > r["base"] for r in sums.values()), sums


def test_lm_of_an_empty_training_table_and_odd_texts(spark, docs, none):
    got = lm_scoring.score_documents(docs, none, WORDS).collect()
    assert len(got) == docs.count() and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    odd = spark.createDataFrame([(1, "<|endoftext|> One two <|startoftext|>three"), (2, " ".join(["one two three four"] * 40_000)), (3, "\u00a0\u2003 x \u200b"), (None, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(odd, docs, WORDS).collect()}
    assert {k: r["n_tokens"] for k, r in rows.items()} == {1: 5, 2: 160_001, 3: 4, None: 1}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows.values())


def test_lm_scores_do_not_hang_on_partitions(docs):
    one, many = ({r["doc_id"]: round(r["score"], 3) for r in lm_scoring.score_documents(x, x.where("doc_id % 5 <> 0"), WORDS).where("doc_id < 70").collect()} for x in (docs.coalesce(1), docs.repartition(7)))
    assert one == many


def test_lm_training_takes_whole_texts(docs):
    from cuemill.llm.vocabularies import lowered

    tokens = lm_scoring.Tokens(lm_scoring.id_counts(lm_scoring.word_counts(lm_scoring.id_and_text(docs)), WORDS, load_tokenizer(WORDS).get_vocab_size())[0])
    known, texts = lm_scoring.word_ids(WORDS), [t or "" for _, t, *_ in corpus()]
    texts.append(" ".join(texts[64].split() * 40))  # more than is held at a time
    expected = []
    for text in texts:
        words = lowered(text.encode()).split()
        known.learn(set(words))
        expected += [*tokens.token[known.ids(known.places(words))].tolist(), lm_scoring._END]
    batch = lm_scoring.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(lm_scoring.whole_windows(iter([batch]), WORDS, tokens))
    assert len(parts) > 1 and all(len(x) <= lm_scoring.HELD_WINDOWS and all(0 < len(w) <= lm_scoring.WINDOW for w in x) for x in parts)
    assert [t for x in parts for w in x for t in w.tolist()] == expected

    def trained(rows):  # words far from the start of a text, beyond one window, change the weights
        return lm_scoring.fit(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"), WORDS, tokens, len(rows))

    before = [(i, " ".join(["one two three"] * 400)) for i in range(4)]
    a, b = (trained([(i, t + tail) for i, t in before]) for tail in (" one two three " * 400, " mo ta ri su lo ke " * 400))
    assert (a["slot"] != b["slot"]).any()


def test_lm_shards_are_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_DOCS", 40)
    dealt, shards = lm_scoring._dealt(spark.range(800).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), 800)
    assert shards == 20
    for k in range(lm_scoring.ROUNDS):
        tasks = lm_scoring._round(dealt, shards, k).groupBy(F.spark_partition_id()).agg(F.count_distinct("shard").alias("shards"), F.count(F.lit(1)).alias("rows")).collect()
        assert len(tasks) == shards and all(r["shards"] == 1 for r in tasks)
        assert sum(r["rows"] for r in tasks) == dealt.where(F.col("shard") % lm_scoring.ROUNDS == k).count()


def test_lm_counts_are_looked_up_once_a_word():
    """For each word that a worker remembers, not for each place; anew once the memory was emptied."""
    from cuemill.llm.vocabularies import WordIds

    class Counted(dict):
        asked: Counter = Counter()

        def get(self, word, none=None):
            self.asked[word] += 1
            return super().get(word, none)

    words = WordIds(lambda ws: [[len(w)] for w in ws], most=8)
    logs = Counted({b"a": -1.0, b"bb": -2.0})
    of_place = lm_scoring._OfPlaces(words, logs, {b"a": -0.5})
    for text, expected in ((b"a bb a ccc a", [-1, -2, -1, None, -1]), (b"bb bb dddd", [-2, -2, None]), (b"a a", [-1, -1])):
        counted, spelled = of_place(words.learned(text.split()))
        assert [None if math.isnan(x) else x for x in counted.tolist()] == expected
        assert spelled.tolist() == [-0.5 if w == b"a" else 0.0 for w in text.split()]
    assert logs.asked == {b"a": 1, b"bb": 1, b"ccc": 1, b"dddd": 1}
    counted, _ = of_place(words.learned([b"x%d" % i for i in range(4)] + [b"a"]))  # more than is remembered
    assert math.isnan(counted[0]) and counted[4] == -1 and logs.asked[b"a"] == 2


def test_lm_scores_of_texts_do_not_hang_on_their_batch(spark, docs):
    """Special strings, empty texts and words beyond the head, beside others or alone."""
    texts = ["one two three", "", "<|endoftext|> One two <|startoftext|>three", None, "\u00c9 mo " * 700, "one", " \n ", "zzz <| yyy"]
    table = lm_scoring.id_and_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    counts = lm_scoring.id_counts(lm_scoring.word_counts(lm_scoring.id_and_text(docs)), WORDS, load_tokenizer(WORDS).get_vocab_size())
    tokens, shares = lm_scoring.Tokens(counts[0]), np.repeat(np.array([[0.1], [0.7]]), len(lm_scoring.GATES), 1)
    params, most = attention.init(lm_scoring.KINDS), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    try:
        for rows in ("1", "256"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            scored = lm_scoring.score_texts(table, params, WORDS, tokens, lm_scoring.attachment(counts), {b"": (9, 0.0), b"one": (5, -0.1), b"mo": (3, 0.0)}, 100, 20, shares)
            got.append([(r["doc_id"], r["n_tokens"], r["known"], [(bytes(w["word"]), w["key"], w["gate"]) for w in r["rest"]], [r["base"], r["model"], *r["mixed"]]) for r in scored.orderBy("row").collect()])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert [r[:4] for r in got[0]] == [r[:4] for r in got[1]] and all(np.allclose(a[4], b[4], rtol=1e-5, atol=1e-4) for a, b in zip(*got))
    assert [(r[1], r[2], len(r[3])) for r in got[0]] == [(4, 2, 2), (1, 1, 0), (5, 2, 3), (1, 1, 0), (1401, 701, 700), (2, 2, 0), (1, 1, 0), (4, 1, 3)]


def test_attention_gradient_and_blocks():
    rng = np.random.default_rng(0)
    params, kinds = attention.init(50), rng.integers(0, 49, attention.CLASSES * attention.SLOTS).astype(np.int32)
    sequences = [rng.integers(0, len(kinds), n).astype(np.int32) for n in (40, 16, 5)]
    inputs, targets, first, used = attention.blocks_of(sequences, kinds, 49)
    loss, gradient = attention.loss_and_gradient(params, inputs, targets, first, used)
    together = attention.log_probabilities(params, inputs, targets, first)[used]
    assert abs(loss + together.mean()) < 1e-4
    alone = np.concatenate([attention.log_probabilities(params, *(b := attention.blocks_of([x], kinds, 49))[:3])[b[3]] for x in sequences])
    assert np.allclose(together, alone, atol=1e-4)  # windows don't see other sequences
    changed = [x.copy() for x in sequences]
    changed[0][30] = (changed[0][30] + 1) % len(kinds)
    i2, t2, f2, u2 = attention.blocks_of(changed, kinds, 49)
    assert np.allclose(attention.log_probabilities(params, i2, t2, f2)[u2][:30], together[:30], atol=1e-5)  # nor later tokens
    for name, g in gradient.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, diffs = params[name][at], []
        for e in (1e-2, -1e-2):
            params[name][at] = old + e
            diffs.append(attention.loss_and_gradient(params, inputs, targets, first, used)[0])
        params[name][at] = old
        assert abs((diffs[0] - diffs[1]) / 2e-2 - g[at]) < 2e-4 + 0.05 * abs(g[at])


def test_pipeline_stages_of_odd_tables(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, clashing columns, no rows."""
    import corpus_pipeline

    sf, rng = "/root/testdata/sf0.001", random.Random(8)
    words = vocabulary_of(200, 2)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same, long = prose(80), prose(15000)
    texts = [(1, same), (2, same), (None, same), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, long), (6, long), (7, "word"), (8, "word"), (9, prose(60))]
    table = spark.createDataFrame([(i, t, "en", "web", 1, 2, 3, "x", "y") for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, component_id long, start long, fp string, removed string")
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), sf).count() == 0
        kept = stage(spark, table, sf)
        if name != "packing":
            assert kept.columns == table.columns
        left = ids(kept if name != "packing" else kept.select("doc_id").distinct())
        if name == "ngram_jaccard_join":
            assert left == Counter([1, None, None, 3, 4, 5, 6, 6, 7, 9])
        if name == "substring_dedup":  # a null id ranks first; of the same words in later documents nothing is left
            assert left == Counter([None, None, 3, 4, 5, 6, 6, 7, 9])
        if name == "decontamination":
            assert left == Counter(i for i, _ in texts)
        if name == "packing":
            assert set(left) == {i for i, _ in texts}


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert set(after) <= set(before) and len(after) > 0.3 * len(before)
        if name == "ngram_jaccard_join":
            sets = {i: shingles(t, 5) for i, t in after.items()}
            assert not [1 for a, b in combinations(after, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        docs = kept
    ids = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().collect()} == ids


def test_known_words_are_looked_up_once():
    """Only new words are learnt; when the memory is full, all words of the call are learnt anew, and places stay right."""
    from cuemill.llm.vocabularies import WordIds

    asked = []
    words = WordIds(lambda ws: asked.append(sorted(ws)) or [[len(w), w[0]] for w in ws], most=12)
    ids = lambda ws: words.ids(words.learned(ws)).tolist()
    expected = lambda ws: [i for w in ws for i in (len(w), w[0])]
    for text in (b"a bb a", b"bb ccc bb a", b"a bb ccc", b"", b"d e f g a bb", b"a d"):
        assert ids(text.split()) == expected(text.split())
    assert asked[:2] == [[b"a", b"bb"], [b"ccc"]] and len(asked) == 3 and sorted(asked[2]) == [b"d", b"e", b"f", b"g"]
    assert ids(b"x y z a".split()) == expected(b"x y z a".split()) and asked[3] == [b"a", b"x", b"y", b"z"]
