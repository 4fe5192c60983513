"""The other corpus operators against brute force, exact round trips and held-out accuracy."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle_check import compare, connect

from tabscale.llm import chat, decontaminate, exact_dup, langid, licenses, mixing, pseudo_lm, queries, shards, toxicity
from tabscale.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, norm string, key string, words string, slot bigint, score string, sha string"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those that operators use."""
    full = [(r + (None, None))[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r[:4], len(r[1] or ""), "norm", "key", "words", 7, "score", "sha") for r in full], SCHEMA).repartition(parts)


HOSTILE = [
    (1, "Plain text of a few words.", "en", "a"), (1, "Plain text of a few words.", "en", "a"), (2, None, None, None), (3, "", "en", None),
    (4, " \n\t ", None, "b"), (None, "Plain text of a few words.", "en", "a"), (5, "12345 ... !!!", "de", "b"), (6, "é ü ß 漢字 🙂", "fr", "c"),
    (7, "word " * 60_000, "en", "a"), (8, "x" * 300_000, "en", "c"), (None, None, None, None), (-9, "Plain text\nof a few words.", "en", "a"),
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- exact duplicates


def test_exact_matches_sql(spark):
    assert compare(queries.QUERIES["op2_exact_dedup"](spark, SF), connect(SF), exact_dup.SQL) == ""


@pytest.mark.parametrize("capacity", [1, 3, 65_536])
def test_exact_brute_force(spark, capacity):
    rows = [*HOSTILE, *((100 + i, f"t{i % 7}" + " " * (i % 3)) for i in range(40))]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0]))
    wanted = Counter()
    for members in groups.values():
        named = [m for m in members if m[1] is not None]
        keep = min(named)[1] if named else None
        for _, i in members:
            wanted[i, keep if len(members) > 1 else i, len(members), True if (keep if len(members) > 1 else i) is None else i == keep] += 1
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dup.dedup(frame(spark, rows), capacity).collect())
    assert got == wanted


def test_exact_empty(spark):
    assert rows_of(exact_dup.dedup(frame(spark, HOSTILE).limit(0))) == []


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id) AS key")
    slots, bits = exact_dup.directory(keys, 100)
    sizes = keys.selectExpr(f"shiftrightunsigned(key, {64 - bits}) AS slot").join(slots, "slot").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) <= 100


# ---- mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["en", "en", "de"]), rng.choice("aaab")) for i in range(600)]
    goal = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.3, "de": 0.7}}
    out = mixing.mix(frame(spark, rows), goal, budget=0.2).toPandas()
    mass = out.n_tokens * out.weight / out.n_tokens.sum()
    assert np.allclose(mass.groupby(out.source).sum()[["a", "b"]], [0.5, 0.5], atol=1e-6)
    assert np.allclose(mass.groupby(out.lang).sum()[["en", "de"]], [0.3, 0.7], atol=1e-6)
    assert np.isclose((out.n_tokens * out.probability).sum(), 0.2 * out.n_tokens.sum(), rtol=1e-6)


def test_mixing_brute_force(spark):
    docs = table(spark, SF, "documents")
    out = mixing.mix(docs).toPandas()
    cells = out.groupby(["source", "lang", "topic"]).n_tokens.sum().reset_index()
    w = np.ones(len(cells))
    goals = {}
    for name in ("source", "lang", "topic"):
        held = cells.groupby(name).n_tokens.sum()
        wish = (held / held.sum()) ** mixing.POWERS[name]
        goals[name] = wish / wish.sum()
    for _ in range(200):
        for name in ("lang", "topic", "source"):
            now = (w * cells.n_tokens).groupby(cells[name]).sum()
            w = w * (goals[name] / now).reindex(cells[name]).to_numpy()
    cells["expected"] = w * cells.n_tokens.sum()
    both = out.merge(cells.drop(columns="n_tokens"), on=["source", "lang", "topic"])
    # The table is small, so some cells are empty and the raking is not over after a few sweeps.
    assert np.allclose(both.weight, both.expected, rtol=0.02, atol=0.02)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", text[i])) for i, n in zip(out.doc_id, out.n_tokens, strict=True))


def test_mixing_hostile(spark):
    out = rows_of(mixing.mix(frame(spark, HOSTILE)))
    assert len(out) == len(HOSTILE) and all(0 <= r[6] <= 1 for r in out)
    assert {r[1] for r in out if r[0] == 2} == {"none"}
    assert rows_of(mixing.mix(frame(spark, HOSTILE).limit(0))) == []
    assert all(r[6] == 0 for r in rows_of(mixing.mix(frame(spark, [(1, None), (2, "")]))))


# ---- language identification


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == 1000 and (held.lang == held.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()


def test_language_hostile(spark):
    model = langid.fit(frame(spark, [(i, f"the cat {i}" if i % 2 else f"le chat {i}", "en" if i % 2 else "fr") for i in range(80)]))
    out = langid.predict(frame(spark, HOSTILE), model).collect()
    assert len(out) == len(HOSTILE)
    for r in out:
        if r["doc_id"] in (2, 3, 4, 5) or r["text"] is None:
            assert r["lang_pred"] == "und" and r["rejected"] and r["doc_id"] != 6
        elif r["doc_id"] in (1, 6, 7, 8, -9):
            assert r["lang_pred"] in ("en", "fr")
    assert langid.predict(frame(spark, HOSTILE).limit(0), model).collect() == []
    assert langid.fit(frame(spark, HOSTILE).limit(0)).langs == ["und"]


# ---- chats


def brute_cost(roles):
    """The least cost over all role sequences of the turns, merges and insertions."""
    best = np.inf
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        total, prior = 0.0, chat.START
        for role, x in zip(roles, states, strict=True):
            cost = chat.step_matrix(role)[0][prior, x]
            total += cost
            prior = x
        best = min(best, total + chat.END[prior])
    return best


def legal(text):
    marks = re.findall(r"<\|(system|user|assistant)\|>", text)
    body = marks[1:] if marks[0] == "system" else marks
    return "system" not in body and body == ["user", "assistant"] * (len(body) // 2) and text.endswith("<|end|>\n")


def cost_of(pieces):
    total = 0.0
    for original, role, action, inserted in pieces:
        total += chat.INSERT * len([x for x in inserted.split(",") if x])
        total += chat.MERGE if action.startswith("merge") else 0
        if "relabel" in action:
            total += chat.UNKNOWN if chat.role_of(original) == 0 else chat.RELABEL
    return total


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_chat_costs_are_least(spark, parts):
    rng = random.Random(4)
    names = ["user", "assistant", "system", "User ", "bot", "narrator", None]
    turns = [(c, t, rng.choice(names), f"text {c} {t}") for c in range(25) for t in range(rng.randrange(1, 6))]
    turns += [(99, t, names[t % 3], "x") for t in range(60)]
    df = spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, part string, tie bigint")
    out = chat.format_chats(df, partitions=parts).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["conv_id"], r["turn"])):
        by[r["conv_id"]].append(r)
    original = {(c, t): role for c, t, role, _ in turns}
    for c, mine in by.items():
        assert legal("".join(r["rendered"] for r in mine)), mine
        for r in mine:
            assert f"text {c} {r['turn']}" in r["rendered"] or c == 99
        if c != 99:
            roles = [chat.role_of(original[c, r["turn"]]) for r in mine]
            got = cost_of([(original[c, r["turn"]], r["role"], r["action"], r["inserted"]) for r in mine])
            assert got == brute_cost(roles)


def test_chat_does_not_depend_on_partitions(spark):
    df = table(spark, SF, "conversations")
    one, many = (sorted(map(tuple, chat.format_chats(df, partitions=p).collect()), key=repr) for p in (1, 13))
    assert one == many and len(one) == df.count()


def test_chat_hostile(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "same"), (1, 0, "user", "same"), (2, 0, "", ""), (3, 1, "assistant", "y" * 200_000)]
    out = chat.format_chats(spark.createDataFrame(rows, schema), partitions=3).collect()
    assert len(out) == 6
    assert [r["action"] for r in out if r["conv_id"] == 1] == ["keep", "merge"]
    assert chat.format_chats(spark.createDataFrame([], schema)).collect() == []


# ---- shards


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        got = shards.slots(np.arange(n), n)
        assert sorted(got.tolist()) == list(range(n))
    assert (shards.slots(np.arange(1000), 1000) != shards.slots(np.arange(1000), 1000, key=5)).any()


def test_tokens_follow_the_vocabularys_pattern():
    import tiktoken

    own = shards.tokens(shards.RANKS)
    plain = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    other = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=own.encoding._mergeable_ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab", "É", "7", ".", "'s", "'", " ", "  ", "\n", "\t ", "漢", "🙂", "x1"]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    assert [np.frombuffer(b, "<u2").tolist() for b in own.encode_batch(texts)] == [other.encode_ordinary(t) for t in texts]


def test_tokens_at_every_kind_of_white_space():
    own = shards.tokens(shards.RANKS)
    white = [*map(chr, [9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])]
    texts = [before + a + b + after for a in white for b in ["", *white] for before in ("", "ab", "7", ".") for after in ("", "c", "'ll", "!")]
    assert [np.frombuffer(b, "<u2").tolist() for b in own.encode_batch(texts)] == [own.encoding.encode_ordinary(t) for t in texts]


def stored_frame(spark, rows, tmp_path):
    path = str(tmp_path / "docs")
    frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


def test_shards_round_trip(spark, tmp_path):
    rows = [*HOSTILE, *[(100 + i, t) for i, t in enumerate(["a  b \n c", "it's 3.5\n\nend ", " lead", "tab\tx y"])]]
    docs = stored_frame(spark, rows, tmp_path)
    path = str(tmp_path / "shards")
    manifest = shards.write(docs, path, length=32, shard_slots=64)
    got = shards.read(spark, path).collect()
    assert sorted(r["slot"] for r in got) == list(range(manifest["sequences"]))
    assert all(r["place"] == r["slot"] % 64 and r["shard"] == r["slot"] // 64 for r in got)
    texts = defaultdict(list)
    for r in sorted(got, key=lambda r: (repr(r["doc_id"]), r["seq"])):
        texts[r["doc_id"]].append(r)
    encoding = shards.tokens(shards.RANKS).encoding
    for i, t in [(r[0], r[1]) for r in rows if r[0] not in (None, 1)]:
        ids = [x for r in texts[i] for x in r["ids"]]
        assert ids == [*encoding.encode_ordinary(t or ""), shards.END] and encoding.decode(ids[:-1]) == (t or "")
        assert all(r["n_tokens"] == 32 for r in texts[i][:-1])
    assert len(texts[1]) == 2 and len(texts[None]) == 2
    later = shards.read(spark, path, 70, 90).collect()
    assert sorted(r["slot"] for r in later) == list(range(70, 90))
    import glob
    import os

    for file in glob.glob(f"{path}/shards/shard=*/part-*"):
        assert os.path.getsize(file) % manifest["stride"] == 0


def test_shards_empty(spark, tmp_path):
    docs = stored_frame(spark, HOSTILE, tmp_path).where("doc_id = 12345")
    assert shards.write(docs, str(tmp_path / "none"))["sequences"] == 0
    assert shards.read(spark, str(tmp_path / "none")).collect() == []


# ---- decontamination


def edits_brute(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_is_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        assert decontaminate.myers(decontaminate.masks(item), len(item), text)[0] == edits_brute(item, text)


def test_contaminated_brute_force(spark):
    rng = random.Random(3)
    words = [f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.choice('lmnr')}{i}" for i in range(80)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(12)) for i in range(6)] + [(6, "short"), (7, None)]
    rows = list(HOSTILE)
    for k in range(40):
        item = items[k % 6][1]
        chars = list(item)
        for _ in range(k // 6):
            at = rng.randrange(len(chars))
            if rng.random() < 0.4:
                del chars[at]
            else:
                chars[at] = rng.choice("xyz")
        rows.append((200 + k, f"{say(20)}. {''.join(chars).upper() if k % 2 else ''.join(chars)}!\n{say(20)}"))
    benchmark = spark.createDataFrame([(*i, "clash") for i in items], "item_id bigint, text string, doc_id string")
    got = Counter((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated(frame(spark, rows), benchmark).collect())
    wanted = Counter()
    for r in rows:
        text = decontaminate.normalise(r[1])
        if len(text) > 10_000:
            continue
        for i, t in items[:6]:
            item = decontaminate.normalise(t)
            edits = edits_brute(item, text)
            if edits <= decontaminate.budget(item):
                wanted[r[0], i, edits] += 1
    assert got == wanted and len(wanted) > 15
    kept = {r["doc_id"] for r in decontaminate.decontaminate(frame(spark, rows), benchmark).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _, _ in wanted}


def test_short_items_are_whole_words(spark):
    benchmark = spark.createDataFrame([(1, "What is 7*8?"), (2, "E=mc^2"), (3, "?!"), (4, "Paris")], "item_id bigint, text string")
    rows = [(1, "So: what IS 7 * 8 then"), (2, "what is 7*81"), (3, "somewhat is 7 8"), (4, "e = MC 2"), (5, "comparison"), (6, "paris"),
            (7, "what is 7 9"), (8, "comparisons, Paris"), (9, "?!"), (10, "xparis paris parisx")]
    got = {(r["doc_id"], r["item_id"], r["edits"], r["end"]) for r in decontaminate.contaminated(frame(spark, rows), benchmark).collect()}
    assert got == {(1, 1, 0, 14), (4, 2, 0, 6), (6, 4, 0, 5), (8, 4, 0, 17), (10, 4, 0, 12)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(frame(spark, rows), benchmark).collect()} == {2, 3, 5, 7, 9}


def test_items_of_any_length_have_their_budget(spark):
    items = ["abcdefghij klmnopqrs", "abcdefghij klmnopqrst uvwxyz", "abcdefghij klmnopqr"]
    assert [decontaminate.budget(t) for t in items] == [1, 1, 0]
    texts = [*items, *[t.replace("h", "x") for t in items], *[f"q{t}q" for t in items], items[0].replace("ab", "xy")]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontaminate.contaminated(frame(spark, list(enumerate(texts))), benchmark).collect()
    want = set()
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            allowed = decontaminate.budget(item)
            if (edits_brute(item, text) <= allowed) if allowed else f" {item} " in f" {text} ":
                want.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and {(3, 0), (4, 1), (6, 0)} <= want


def test_contaminated_empty(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(frame(spark, HOSTILE), empty).collect() == []
    assert decontaminate.decontaminate(frame(spark, HOSTILE), empty).count() == len(HOSTILE)


# ---- licenses


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def license_brute(text):
    words = words_of(text)
    joined = " " + " ".join(words) + " "
    found = []
    for rule, label, priority, keywords, pattern, base in licenses.rules():
        if any(k in joined for k in keywords):
            for m in re.finditer(f" (?:{pattern})(?= )", joined):
                first = joined[: m.start()].count(" ")
                found.append((first, first + m.group().count(" "), priority, rule, label, base))
    kept = []
    ordered = sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3]))
    for k, d in enumerate(ordered):
        if d[5] or not any(e[1] >= d[1] and e[2] >= d[2] for e in ordered[:k]):
            kept.append(d)
    base = [d for d in found if d[5]]
    return (len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
            ",".join(sorted({d[4] for d in base})), ",".join(sorted({d[4] for d in kept})), max((licenses.SURE[d[2]] for d in kept), default=0.0))


LICENSED = [
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
    "CC BY-NC 4.0 and cc-by! CC\nBY", "All rights reserved. all RIGHTS reserved", "SPDX-License-Identifier: GPL-2.0-or-later", "Accby cc byx general public licenses",
    "Copyright (c) 2020 Some Body Else", "in the public domain, no rights reserved", "K cc by", "all rights reserved " * 50, "İ all rights reserved",
]


def test_licenses_brute_force(spark):
    rows = [*HOSTILE, *[(300 + i, t) for i, t in enumerate(LICENSED)]]
    got = Counter(tuple(r) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == Counter((r[0], *license_brute(r[1])) for r in rows)
    assert licenses.scan(frame(spark, rows).limit(0)).collect() == []


def test_licenses_on_documents(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op8_license_scan"](spark, SF).collect()}
    assert got == {r["doc_id"]: license_brute(r["text"]) for r in table(spark, SF, "documents").collect()}


def test_rules_pass_their_own_gate():
    triggers = re.compile("(?i)" + "|".join(licenses._TRIGGERS))
    found = licenses.rules()
    assert len(found) > 200
    for _, _, _, keywords, pattern, _ in found:
        assert keywords and all(k and triggers.search(k) for k in keywords), (keywords, pattern)


# ---- toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op9_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    held = out[out.held_out]
    bad, good = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert len(bad) and ((bad[:, None] > good[None, :]) + 0.5 * (bad[:, None] == good[None, :])).mean() > 0.9


def test_toxicity_hostile(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(None, 1, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [(i, "you total idiot scum" if i % 2 else "a kind word for all") for i in range(200)])
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.predict(frame(spark, [*HOSTILE, (900, "what an idiot you are"), (901, "fine words")]), model).collect()}
    assert out[900]["predicted"] == 1 and out[901]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in out.values())
    assert toxicity.predict(frame(spark, HOSTILE).limit(0), model).collect() == []
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.predict(frame(spark, HOSTILE), none).collect()} == {0.0}


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500).round(1)
    y = (rng.random(500) < 1 / (1 + np.exp(-raw))).astype(float)
    knots, levels = toxicity.isotonic(raw, y)
    assert (np.diff(levels) >= 0).all() and np.isclose(np.interp(raw, knots, levels).mean(), y.mean())


# ---- masked pseudo-likelihood


def test_scores_sum_log_probs(spark):
    docs = table(spark, SF, "documents")
    model = pseudo_lm.fit(docs)
    (words, flat) = model
    p = pseudo_lm.unpack(flat)
    got = {r["doc_id"]: r for r in pseudo_lm.score(docs, model).collect()}
    from tabscale.llm.common import hash_words, utf8
    import pyarrow as pa

    for r in docs.limit(12).collect():
        hashes, _ = hash_words(*utf8(pa.array([r["text"]])))
        ids = pseudo_lm.numbered(hashes, words)
        total = 0.0
        for i, x in enumerate(ids):
            around = np.array([[ids[i + o] if 0 <= i + o < len(ids) else pseudo_lm.PAD] for o in pseudo_lm.OFFSETS])
            h = np.tanh(p["hidden"] + sum(p["tables"][k][around[k, 0]] for k in range(4)))
            soft = lambda z: z - np.log(np.exp(z - z.max()).sum()) - z.max()
            c = x // pseudo_lm.CLASS
            total += soft(h @ p["to_class"] + p["class_bias"])[c] + soft(h @ p["to_word"][c] + p["word_bias"][c])[x % pseudo_lm.CLASS]
        assert got[r["doc_id"]]["n_tokens"] == len(ids) and np.isclose(got[r["doc_id"]]["log_prob"], total, rtol=1e-4)


def test_training_beats_word_frequencies(spark):
    docs = frame(spark, [(i, "one two three four five six seven " * 40) for i in range(200)])
    (words, flat), start = pseudo_lm.fit(docs), None
    counts = np.zeros(pseudo_lm.IDS)
    counts[:7] = 8000
    start = pseudo_lm.first_parameters(counts)
    mean = lambda m: np.mean([r["mean_log_prob"] for r in pseudo_lm.score(docs, (words, m)).collect()])
    assert mean(flat) > mean(start) + 1


def test_bucketed_words_get_their_own_share(spark):
    from tabscale.llm.common import hash_words, utf8
    import pyarrow as pa

    # Two words on a place: one of a kind, and one that occurs ten times; both fall outside the vocabulary.
    filler = [(i, f"w{i} " * 12) for i in range(pseudo_lm.known_words(40_000) + 500)]
    filler += [(-i, f"ten{i} " * 10) for i in range(1, 200)] + [(-1000 - i, f"once{i}") for i in range(1, 8000)]
    docs = frame(spark, filler)
    words, flat = pseudo_lm.fit(docs)
    flat = np.zeros_like(flat)  # all words of the network alike: what differs is the share
    texts = frame(spark, [(1, "ten1"), (2, "once1"), (3, "neverseen"), (4, "once1 ten1 once1")])
    got = {r["doc_id"]: r["log_prob"] for r in pseudo_lm.score(texts, (words, flat)).collect()}
    counts = Counter()
    known = set(words.hashes.tolist())
    hashes, _ = hash_words(*utf8(pa.array([r[1] for r in filler])))
    for x in hashes[~np.isin(hashes, words.hashes)].tolist():
        counts[x] += 1
    held = Counter()
    for x, n in counts.items():
        held[(x >> 17) % pseudo_lm.OTHERS] += n

    def alone(word):
        x = int(hash_words(*utf8(pa.array([word])))[0][0])
        assert x not in known
        return -np.log(words.first + pseudo_lm.OTHERS) + np.log(counts.get(x, pseudo_lm.UNSEEN)) - np.log(held[(x >> 17) % pseudo_lm.OTHERS] + pseudo_lm.UNSEEN)

    for i, text in ((1, ["ten1"]), (2, ["once1"]), (3, ["neverseen"]), (4, ["once1", "ten1", "once1"])):
        assert np.isclose(got[i], sum(map(alone, text)), rtol=1e-5), text


def test_vocabulary_grows():
    sizes = [pseudo_lm.known_words(n) for n in (0, 10_000, 400_000, 10**7, 10**10)]
    assert sizes == sorted(set(sizes)) and all((n + pseudo_lm.OTHERS) % pseudo_lm.CLASS == 0 for n in sizes)


def test_every_position_is_a_target(spark):
    begin = np.array([0, 1, 1, 4, 40, 41])  # texts of 1, 0, 3, 36 and 1 words
    seen = np.concatenate([pseudo_lm.targets(begin, turn, pseudo_lm.ROUNDS) for turn in range(pseudo_lm.ROUNDS)])
    assert sorted(seen.tolist()) == list(range(41))
    # What the tasks saw adds up to all words of all texts, short ones too.
    docs = frame(spark, [(i, "a b c d e f g h i j k l m n o p q r s"[: 2 * (i % 19) + 1]) for i in range(100)])
    words, counts = pseudo_lm.vocabulary(docs)
    fixed = spark.sparkContext.broadcast((words._replace(counts=None), pseudo_lm.first_parameters(counts)))
    total = 0
    for turn in range(pseudo_lm.ROUNDS):
        rows = docs.select("text").mapInArrow(pseudo_lm._trained(fixed, turn, pseudo_lm.ROUNDS), "part bigint, block bigint, seen double, numbers binary")
        total += sum(r["seen"] for r in rows.where("block = 0").collect())
    assert total == sum(i % 19 + 1 for i in range(100))


def test_scores_hostile(spark):
    model = pseudo_lm.fit(frame(spark, HOSTILE))
    out = pseudo_lm.score(frame(spark, HOSTILE), model).collect()
    assert len(out) == len(HOSTILE)
    for r in out:
        assert (r["mean_log_prob"] is None) == (r["n_tokens"] == 0) and np.isfinite(r["log_prob"])
    empty = frame(spark, HOSTILE).limit(0)
    assert pseudo_lm.score(empty, pseudo_lm.fit(empty)).collect() == []
