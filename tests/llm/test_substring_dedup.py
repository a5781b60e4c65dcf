import hashlib
import random
import re

import pytest

from pagewright.llm import substring_dedup

SCHEMA = "doc_id long, text string, pos int, id string, shared array<int>"


def plain(rows, window):
    """rows: (doc_id, text); a dictionary of every window's earliest start."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = lambda i: -(2**63) if i is None else i
    order = sorted(range(len(rows)), key=lambda r: low(rows[r][0]))
    first = {}
    for r in order:
        for p in range(len(words[r]) - window + 1):
            first.setdefault(tuple(words[r][p : p + window]), (low(rows[r][0]), p))
    out = []
    for r, (i, _) in enumerate(rows):
        gone = set()
        for p in range(len(words[r]) - window + 1):
            if first[tuple(words[r][p : p + window])] < (low(i), p):
                gone.update(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(words[r]) if p not in gone)
        out.append((i, len(words[r]), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + str(rng.randrange(60))
    passages = [[word() for _ in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(6)]
    rows = [(None, "x y z"), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r"), (6, "é ü short"), (7, "same " * (2 * window)), (8, "same " * window)]
    for i in range(10, 60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(1, 40))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(60, rows[-1][1]), (61, rows[-1][1]), (None, rows[-2][1])]
    rows.append((62, " ".join(word() for _ in range(50000)) + " " + rows[20][1]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("window", [14, 20])
def test_against_all_windows(spark, seed, window):
    rows = corpus(seed, window)
    got = substring_dedup.remove_repeats(spark.createDataFrame([(i, t, 1, "a", [2]) for i, t in rows], SCHEMA), window).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    want = plain(rows, window)
    assert sum(r[2] for r in want) > 100
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.remove_repeats(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
