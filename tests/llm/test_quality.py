import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import quality as Q

FW = "the of and to in a is that for it".split()
INSULTS = ["nitwit", "dolt", "oaf", "cad", "churl", "knave"]


def document(rng, junk=None, toxic=False):
    words = [rng.choice(FW) if rng.random() < 0.4 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(40, 160))]
    if toxic:
        for w in rng.sample(INSULTS, 3):
            words.insert(rng.randrange(len(words)), w)
    words = [w + rng.choice([",", "."]) if rng.random() < 0.15 else w for w in words]
    if junk == "symbols":
        words = [w + rng.choice(["###", "$$$", "&&&"]) for w in words]
    elif junk == "bars":
        return " | ".join(w for w in words if w not in FW)
    elif junk == "capitals":
        words = [w.upper() + "!!" for w in words]
    elif junk == "stutter":
        words = [w for w in words[:10] for _ in range(12)]
    return " ".join(words)


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        junk = rng.choice(["symbols", "bars", "capitals", "stutter"]) if rng.random() < 0.2 else None
        toxic = rng.random() < 0.15
        rows.append((i, document(rng, junk, toxic), int(toxic), int(junk is None)))
    return rows


def test_held_out_accuracy(spark):
    train, held = corpus(900, 1), corpus(300, 2)
    df = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    model = Q.fit(df, spark.createDataFrame([(i, t) for i, _, t, _ in train if i % 2], "doc_id long, toxic int"))
    out = spark.createDataFrame([r[:2] for r in held], "doc_id long, text string").select("doc_id", Q.scorer(spark, model)("text").alias("s")).collect()
    by = {r.doc_id: r.s for r in out}
    junk = np.array([(by[i].junk >= 0.5) == (q == 0) for i, _, _, q in held])
    toxic = np.array([(by[i].toxic >= 0.5) == (t == 1) for i, _, t, _ in held])
    assert junk.mean() > 0.97 and toxic.mean() > 0.97


def plain_em(votes, rounds=3000):
    """Row by row, without a prior: (posterior, P(bad vote | class), share)."""
    silent = ~(votes == -1).any(axis=0)
    bad = np.where((votes == 1).any(axis=1), 0.9, 0.03)
    for _ in range(rounds):
        rate = []
        for p in (1 - bad, bad):
            rate.append([(p[v == 1].sum() + 1e-9) / (p.sum() if s else p[v != 0].sum()) for v, s in zip(votes.T, silent)])
        like = [np.full(len(votes), 1 - bad.mean()), np.full(len(votes), bad.mean())]
        for c in (0, 1):
            for v, s, r in zip(votes.T, silent, rate[c]):
                like[c] = like[c] * np.where(v == 1, r, 1 - r if s else np.where(v == -1, 1 - r, 1.0))
        new = like[1] / (like[0] + like[1])
        moved, bad = np.abs(new - bad).max(), new
        if moved < 1e-8:
            break
    return bad, np.array(rate).T, bad.mean()


def found(votes):
    patterns, where = np.unique(votes, axis=0, return_inverse=True)
    posterior, rate, share = Q.em(patterns, np.bincount(where.ravel()).astype(float))
    return posterior[where.ravel()], rate, share


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    n, share, good, bad = 40000, 0.2, np.array([0.05, 0.1, 0.02, 0.3]), np.array([0.9, 0.8, 0.6, 0.7])
    y = rng.random(n) < share
    votes = np.where(rng.random((n, 4)) < np.where(y[:, None], bad, good), 1, -1)
    posterior, rate, s = found(votes)
    assert abs(s - share) < 0.01
    assert np.abs(rate[:, 1] - bad).max() < 0.03 and np.abs(rate[:, 0] - good).max() < 0.03
    assert ((posterior > 0.5) == y).mean() > 0.96
    plain, plain_rate, plain_share = plain_em(votes)
    assert np.abs(plain - posterior).max() < 0.01 and np.abs(plain_rate - rate).max() < 0.01 and abs(plain_share - s) < 0.005


def test_em_learns_that_a_labeller_is_worth_nothing():
    """Three good labellers and one that says bad on a tenth at random and is silent else."""
    rng = np.random.default_rng(0)
    y = rng.random(50_000) < 0.15
    votes = np.stack([np.where(rng.random(len(y)) < np.where(y, 0.9, 0.05), 1, -1) for _ in range(3)] + [np.where(rng.random(len(y)) < 0.1, 1, 0)], axis=1)
    posterior, rate, share = found(votes)
    assert abs(share - 0.15) < 0.03 and np.abs(rate[3] - 0.1).max() < 0.01
    alone = (votes == [-1, -1, -1, 1]).all(axis=1)
    assert alone.any() and posterior[alone].max() < 0.1
    one = (votes == [1, -1, -1, 0]).all(axis=1)
    assert posterior[one].max() < 0.15
    assert np.abs(plain_em(votes)[0] - posterior).max() < 0.01


def test_em_with_exclusive_kinds():
    """Each labeller sees one kind of junk alone; two that can vote good see several."""
    rng = np.random.default_rng(3)
    kind = np.where(rng.random(30_000) < 0.16, rng.integers(0, 4, 30_000), -1)
    votes = np.stack([np.where(rng.random(len(kind)) < np.where(kind == k, 0.9, 0.001), 1, 0) for k in range(4)] + [np.where(rng.random(len(kind)) < 0.1, 0, np.where(rng.random(len(kind)) < np.where((kind == a) | (kind == a + 1), 0.8, 0.01), 1, -1)) for a in (0, 2)], axis=1)
    posterior, rate, share = found(votes)
    assert abs(share - 0.16) < 0.03 and ((posterior > 0.5) == (kind >= 0)).mean() > 0.98


def test_vote_counts_against_brute_force(spark):
    rows = [r[:2] for r in corpus(200, 5)] + [(None, None), (None, ""), (None, "")]
    lists = tuple(np.sort(np.array([xxhash.xxh64_intdigest(w) for w in INSULTS[i::3]], np.uint64)) for i in range(3))
    want = {}
    for _, text in rows:
        own = {w.lower().strip(Q.STRIP) for w in (text or "").split()}
        p = "".join("-0+"[v + 1] for v in Q.view(text).votes) + "".join("+" if own & set(INSULTS[i::3]) else "0" for i in range(3))
        want[p] = want.get(p, 0) + 1
    assert dict(Q.vote_counts(spark.createDataFrame(rows, "doc_id long, text string"), lists)) == want


def test_model_depends_on_rows_alone(spark):
    rows = [(i % 90, t, x) for i, t, x, _ in corpus(150, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    a = Q.fit(df.repartition(7), df.select("doc_id", "toxic"), 60, 40)
    b = Q.fit(df.orderBy(F.desc("text")).coalesce(1), df.select("doc_id", "toxic").orderBy("toxic").coalesce(1), 60, 40)
    assert (a.junk == b.junk).all() and (a.toxic == b.toxic).all() and all((x == y).all() for x, y in zip(a.lists, b.lists))


@pytest.mark.parametrize("labels", [True, False])
def test_every_case(spark, labels):
    long = " ".join(f"word{i}, the" for i in range(60000))
    rows = [(None, "a b"), (1, None), (2, ""), (3, "the dog. " * 5), (3, "the dog. " * 5), (4, long), (5, "### $$$ " * 40), (6, "😀 é")]
    df = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, junk string, keep int, s double")
    lab = spark.createDataFrame([(1, 1), (3, None), (None, 1), (3, 0), (99, 1)], "doc_id long, toxic int") if labels else None
    out = Q.score(df, lab).collect()
    assert len(out) == len(rows) and all(0 <= r.junk <= 1 and 0 <= r.toxic <= 1 for r in out)
    assert len({(r.junk, r.toxic) for r in out if r.doc_id == 3}) == 1
    kept = Q.kept(df, lab)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.keep)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.score(df, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []
    assert Q.kept(df).collect() == []


def test_training_is_not_done_by_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in corpus(120, 4)], "doc_id long, text string")
    want = Q.fit(docs)

    driver, train = os.getpid(), Q._train

    def elsewhere(*args):
        assert os.getpid() != driver
        return train(*args)

    monkeypatch.setattr(Q, "_train", elsewhere)
    got = Q.fit(docs)
    assert (got.junk == want.junk).all() and (got.toxic == want.toxic).all() and got.junk.any()
    assert not Q.fit(docs.limit(0)).junk.any()
