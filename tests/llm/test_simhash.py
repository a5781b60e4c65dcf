import random

import numpy as np
import pytest
import xxhash

from pagewright.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string, component_id long"


def plain_fingerprint(text, shingle=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    runs = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(fps, d):
    """fps: list of (doc_id, fp) -> component ids by all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= d:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(fps))]


def texts(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "eps", "zeta", "eta", "θ", "É", "nu"]
    out = [None, "", " \t\n", "one", "one two", "One TWO", "a b c", "É b", "é b"]
    for _ in range(25):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", "  "]).join(copy))
    return out + [out[-1]] * 5 + ["long " * 60000]


@pytest.mark.parametrize("small", [64, 1])
def test_against_all_pairs(spark, small):
    rows = [(i if i % 17 else None, t, "x", i) for i, t in enumerate(texts(1))] + [(5, texts(1)[9], "x", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), small=small).collect()
    want = [(r[0], plain_fingerprint(r[1])) for r in rows]
    ids = plain_components(want, 2)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(want, ids)), key=key)


@pytest.mark.parametrize("d", [1, 2, 3])
@pytest.mark.parametrize("small", [64, 1])
def test_links_join_what_all_pairs_join(spark, d, small):
    rng = np.random.default_rng(d)
    fps = set()
    for _ in range(20):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    found = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, d, small).collect()}
    assert all(bin(a ^ b).count("1") <= d for a, b in found)
    index = {x: i for i, x in enumerate(fps)}
    from_links = plain_links([(index[a], index[b]) for a, b in found], len(fps))
    assert from_links == plain_components(list(enumerate(fps)), d)


def plain_links(pairs, n):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
