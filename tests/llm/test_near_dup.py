"""Near duplicates and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabscale.llm import components, near_dup

SCHEMA = "doc_id bigint, text string, items string, component string, a string, n string"


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if i is None or j is None or i >= j or not a or not b:
                    continue
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    low = min(label[i], label[j])
                    if label[i] != low or label[j] != low:
                        label[i] = label[j] = low
                        changed = True
    return sorted(((i, len(s), label.get(i), True if i is None else label[i] == i) for i, s in sets), key=repr)


def corpus(seed, groups=6, size=9, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "Straße", "naïve"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, next_id = [], 0
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words + 7 * g)]
        if g % 2:
            base = passage + base
        current = base
        for k in range(size):
            copy = list(current if k % 3 == 0 else base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            current = copy
            text = rng.choice([" ", "\n", " \t"]).join(copy)
            rows.append((next_id, text.upper() if k == 4 else text))
            next_id += 1
    rows += [(next_id, None), (next_id + 1, ""), (next_id + 2, " \n"), (next_id + 3, "three Words only"), (next_id + 4, "THREE words only"),
             (None, rows[0][1]), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", None) for i, t in rows], SCHEMA).repartition(3)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_short_lists(spark, seed):
    rows = corpus(seed)
    assert result(near_dup.dedup(frame(spark, rows))) == brute(rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LONG_LIST", 2)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    rows = corpus(3, groups=4, size=14)
    assert result(near_dup.dedup(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert near_dup.dedup(frame(spark, [(1, "a")]).limit(0)).collect() == []


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    out = {r["doc_id"]: r for r in near_dup.dedup(frame(spark, [(1, long), (2, long + " end"), (3, "x" * 3_000_000), (4, "y " * 50)])).collect()}
    assert out[1]["n_shingles"] == 299_996 and out[2]["component_id"] == 1 and out[3]["n_shingles"] == 1 and out[4]["n_shingles"] == 1


def test_block_links_match_all_pairs():
    rng = random.Random(5)
    base = [f"w{rng.randrange(50)}" for _ in range(80)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(80)] = f"v{rng.randrange(99)}"
        texts.append(" ".join(copy))
    import pandas as pd

    sides = [i % 2 for i in range(40)]
    got = near_dup.block_links(pd.DataFrame({"doc": range(40), "side": sides, "text": texts}))
    sets = [shingles(t) for t in texts]
    linked = {(i, j) for i in range(40) for j in range(40) if i < j and sides[i] != sides[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert set(zip(got["a"], got["b"], strict=True)) <= linked

    def parts(edges):
        root = list(range(40))
        for _ in range(40):
            for x, y in edges:
                root[x] = root[y] = min(root[x], root[y])
        return root

    assert parts(linked) == parts(list(zip(got["a"], got["b"], strict=True)))


def test_words_do_not_depend_on_windows(monkeypatch):
    from tabscale.llm import common

    text = pa.array(["Ab cd\tÉf", None, "", " x ", "Z" * 50, "a b" * 40])
    data, at = common.utf8(text)
    whole = common.hash_words(data, at)
    pieces = [common.hash_words(data, at)]
    monkeypatch.setattr(common, "windows", lambda d, a: iter([(lo, hi) for lo, hi in common_windows(d, a)]))
    pieces.append(common.hash_words(data, at))
    for words, begin in pieces:
        assert (words == whole[0]).all() and (begin == whole[1]).all()
    assert np.diff(whole[1]).tolist() == [3, 0, 0, 1, 1, 41]


def common_windows(data, at, size=8):
    from tabscale.llm import common

    lo, end = 0, len(data)
    while lo < end:
        hi = min(end, lo + size)
        while hi < end and hi not in at and not common._SPACE[data[hi]]:
            hi += 1
        yield lo, hi
        lo = hi


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {k: v for k, v in label.items() if k in linked}
