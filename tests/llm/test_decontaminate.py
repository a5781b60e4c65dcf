import itertools
import random
import re

import pytest

from pagewright.llm import decontaminate as D


def test_masks_find_every_tolerated_window():
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in D.MASKS]
    for subs in itertools.combinations(range(D.WINDOW), D.WINDOW - D.LEAST):
        assert any(all(o + p not in subs for p in m) for m in masks for o in range(D.WINDOW - m[-1]))


def plain(docs, items):
    tok = lambda t: re.findall(r"\w+", (t or "").lower())
    out = []
    for d, text in docs:
        h = tok(text)
        for i, item in {(i, t) for i, t in items}:
            b = tok(item)
            n = len(b)
            if n < D.LEAST_TOKENS:
                continue
            w, need = (D.WINDOW, D.LEAST) if n >= D.WINDOW else (n, n)
            best = None
            for o in range(-n, len(h)):
                e = [0 <= k + o < len(h) and h[k + o] == b[k] for k in range(n)]
                inside = set()
                for k in range(n - w + 1):
                    if sum(e[k : k + w]) >= need:
                        inside.update(range(k, k + w))
                on = [k for k in sorted(inside) if e[k]]
                if on and (best is None or len(on) > best[0]):
                    best = (len(on), on[0] + o, on[-1] + o + 1)
            if best:
                out.append((d, i, *best))
    return out


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"] + [f"w{k}" for k in range(40)])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 6, 8, 12, 13, 14, 20, 30, 45])]
    items += [(90, None), (91, ""), (92, "  ! "), items[5]]
    docs = [(None, items[7][1]), (1, None), (2, ""), (3, "--"), (4, " ".join(word() for _ in range(20000)))]
    for d in range(10, 70):
        words = re.findall(r"\w+", rng.choice(items[:10])[1])
        a = rng.randrange(0, max(1, len(words) - 12))
        words = words[a : rng.choice([len(words), a + 13, a + 12])]
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = word()
        docs.append((d, ", ".join([word() for _ in range(rng.randrange(0, 20))] + [w.upper() for w in words] + [word() for _ in range(rng.randrange(0, 20))])))
    docs.append(docs[-1])
    return docs, items


@pytest.mark.parametrize("block_chars", [D.BLOCK_CHARS, 200])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_diagonals(spark, seed, block_chars):
    docs, items = case(seed)
    df = spark.createDataFrame([(d, t, 1, "x", 7) for d, t in docs], "doc_id long, text string, item_id int, hits string, start int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in D.links(df, bench, block_chars).collect()]
    want = plain(docs, items)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert len(want) > 20 and sorted(got, key=key) == sorted(want, key=key)
    kept = D.clean(df, bench, block_chars)
    assert kept.columns == df.columns
    hit = {r[0] for r in want}
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((d or -1) for d, _ in docs if d not in hit)


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.links(docs, bench).collect() == []
    assert D.clean(spark.createDataFrame([(1, "a")], "doc_id long, text string"), bench).count() == 1
