"""Phrase mining, whitening and packing against brute force and round trips."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle_check import compare, connect
from test_corpus import HOSTILE, frame

from tabscale.llm import packing, phrases, queries, whitening

SF = "/root/testdata/sf0.001"


# ---- phrases


def brute_counts(rows):
    found, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for k in (1, 2, 3):
                found.update((lang, " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    return found, totals


def brute_mine(rows):
    f, totals = brute_counts(rows)
    kept = {}
    candidates = {key for key, a in f.items() if " " in key[1] and a >= 10}
    for lang, p in candidates:
        a, w = f[lang, p], p.split(" ")
        cuts = [(10**6 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        kept[lang, p] = (a, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], s)
    for lang, p in candidates:
        w = p.split(" ")
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner = (lang, " ".join(w[i:i + k]))
                if inner in f and 100 * f[lang, p] >= 50 * f[inner]:
                    kept.pop(inner, None)
    out = set()
    for lang in totals:
        own = sorted(((-v[3], -v[0], p.encode(), v) for (g, p), v in kept.items() if g == lang))[:2000]
        out |= {(lang, i + 1, p.decode(), *v[:3], totals[lang], v[3]) for i, (_, _, p, v) in enumerate(own)}
    return out


def test_phrases_match_sql(spark):
    assert compare(queries.QUERIES["op11_phrases"](spark, SF), connect(SF), phrases.SQL) == ""


@pytest.mark.parametrize("shard_words", [7, 1000, phrases.SHARD_WORDS])
def test_phrases_brute_force(spark, shard_words):
    rng = np.random.default_rng(5)
    vocabulary = ["a", "B", "über", "c-d", "漢字", "x\x0by"]
    rows = [(i, " ".join(rng.choice(vocabulary, 30)) + ". " + "New York City hall, " * (i % 3), ("en", None, "de")[i % 3], "s") for i in range(60)]
    rows += [r for r in HOSTILE if r[0] != 7] + [(7, "word " * 3000, "en", "a")]
    found = {tuple(r) for r in phrases.mine(frame(spark, rows), shard_words).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert found == brute_mine(rows) and len(found) > 20


def test_ranking_in_parts_changes_nothing(spark):
    rows = [("en", f"a{i} b", i % 7 + 10, 20, 30, 1, i % 13) for i in range(900)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a bigint, l bigint, r bigint, k int, score bigint")
    a, b = ({tuple(r) for r in phrases.ranked(df, 50, n).collect()} for n in (100_000, 200))
    assert a == b and len(a) == 50


def test_index_extends_both_ways():
    words = np.array([1, 2, 1, 2, 3, 2, 1, 2, 1])
    first = np.array([1, 0, 0, 0, 0, 1, 0, 0, 0], bool)
    index = phrases.Index(words, first)
    grams = {tuple(p): int(n) for patterns, counts in index.grams() for p, n in zip(patterns.tolist(), counts)}
    pieces = ([1, 2, 1, 2, 3], [2, 1, 2, 1])
    wanted = Counter(tuple(p[i:i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
    assert grams == dict(wanted)
    patterns, low, high = index.level_one()
    runs, counts = index.extend_right(low, high, 1)
    assert {(*patterns[i].tolist(), int(w)): int(n) for (i, w), n in zip(runs, counts)} == {k: n for k, n in wanted.items() if len(k) == 2}


def test_no_phrases_without_text(spark):
    assert phrases.mine(frame(spark, HOSTILE).limit(0)).collect() == []
    assert phrases.mine(frame(spark, [(1, None, None), (2, " .,", "en")])).collect() == []


# ---- whitening

VECTORS = "vec_id bigint, embedding array<float>, x string, index bigint, n string, d string, w string"


def vectors(spark, data):
    return spark.createDataFrame([(i, v, "x", 5, "n", "d", "w") for i, v in data], VECTORS).repartition(4)


def test_whitening_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
    monkeypatch.setattr(whitening, "BLOCK_COLS", 8)
    rng = np.random.default_rng(2)
    mixing = rng.normal(size=(11, 11))
    data = [(i, (rng.normal(size=11) @ mixing).astype(np.float32).tolist()) for i in range(150)]
    good = data + [(3, data[3][1]), (None, data[4][1])]
    bad = [(200, None), (201, [float("nan")] * 11), (202, [1.0] * 10 + [float("inf")]), (203, [1.0] * 10 + [None]), (204, []), (205, [1.0] * 4)]
    rows = whitening.whiten(vectors(spark, good + bad)).collect()
    x = np.floor(1024 * np.array([v for _, v in good], np.float64)).astype(np.int64) + 100_000
    n = len(x)
    s = x.sum(axis=0)
    deviation = Counter((i, int(((n * a - s) ** 2).sum())) for (i, _), a in zip(good, x))
    assert Counter((r.vec_id, r.deviation) for r in rows if r.component == 1) == deviation
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    for c in range(1, 9):
        wanted = centred @ axes[:, -c] / math.sqrt(values[-c])
        own = [r for r in rows if r.component == c]
        assert len(own) == n and own[0].n == n and own[0].explained == pytest.approx(values[-c] / values.sum(), rel=1e-9)
        got, wanted = (np.sort(v) for v in ([r.whitened for r in own], wanted))
        assert np.allclose(got, wanted, atol=1e-8) or np.allclose(got, np.sort(-wanted), atol=1e-8)
    assert max(r.identity_error for r in rows) < 1e-9


@pytest.mark.parametrize("data", [[], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(9)], [(1, None)], [(1, [])]])
def test_whitening_without_variance(spark, data):
    assert whitening.whiten(vectors(spark, data)).collect() == []


def test_whitening_leaves_flat_directions_out(spark):
    rows = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)])).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 20 and rows[0].explained == pytest.approx(1)


# ---- packing


def plain_cheapest(at, cost, length):
    best = {at[0]: (0, None)}
    for j in range(1, len(at)):
        best[at[j]] = min((best[at[i]][0] + length - (at[j] - at[i]) + cost[j], at[i]) for i in range(j) if at[j] - at[i] <= length)
    return best[at[-1]][0]


def test_queue_finds_the_cheapest_cuts():
    rng = np.random.default_rng(1)
    for _ in range(60):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, rng.integers(1, 60)))]).tolist()
        cost = rng.choice([0, 2, 9], len(at)).tolist()
        cuts = packing.cheapest(at, cost, 20)
        price = dict(zip(at, cost))
        assert cuts[0] == 0 and cuts[-1] == at[-1] and all(b - a <= 20 for a, b in zip(cuts, cuts[1:]))
        assert sum(20 - (b - a) + price[b] for a, b in zip(cuts, cuts[1:])) == plain_cheapest(at, cost, 20)


def check_pieces(rows, texts, length):
    tokenizer = packing._whole_tokenizer()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            if hasattr(r, "ids"):
                assert r.ids == ids[at:at + r.length].tolist()
            at += r.length
        assert at == len(ids)
    assert not by_doc
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / total


@pytest.mark.parametrize("length, swept", [(1024, 1 << 19), (64, 500)])
def test_packing_round_trip(spark, length, swept):
    docs = queries.table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, length, with_ids=True, swept=swept).collect()
    padding = check_pieces(rows, texts, length)
    assert padding < (0.01 if length == 1024 else 0.15)
    assert all(r.length > 0 for r in rows)


def test_packing_hostile(spark):
    rows = [r for r in HOSTILE if r[0] not in (1, None)] + [(50, "a <|endoftext|> b", "en", "a"), (51, "no end " * 400, None, None), (52, "!" * 5000, None, None)]
    texts = {r[0]: r[1] for r in rows}
    check_pieces(packing.pack(frame(spark, rows, 2)).collect(), texts, 1024)
    repeated = packing.pack(frame(spark, HOSTILE, 2)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id for r in repeated} == {r[0] for r in HOSTILE}
    assert packing.pack(frame(spark, HOSTILE).limit(0)).collect() == []


def test_tail_needs_little_padding():
    for size in range(1, 1025):
        parts = packing.tail(size)
        assert sum(parts) == size and (parts == [size] or all(p & (p - 1) == 0 for p in parts))
