import random

import pytest

import corpus_pipeline
from pagewright.llm import decontaminate, pieces, pii, quality, simhash
from tests.llm.test_quality import corpus
from tests.llm.test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(rows):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


def test_keep_one_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        base = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randrange(5, 200))]
        rows.append((100 - i, " ".join(base)))
        if i % 3 == 0:
            rows.append((200 + i, " ".join(base)))
        if i % 4 == 0:
            rows.append((None, " ".join(base)))
    rows += [(300, None), (301, ""), (None, " "), (None, "alone here now then"), (None, "alone here now then"), rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, fp string, th int, root int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    label = plain_components([(k, fp) for k, (_, fp) in enumerate(fps)], 2)
    groups = {}
    for k, (i, _) in zip(label, rows):
        groups.setdefault(k, []).append(i)
    want = sorted((min((i for i in g if i is not None), default=-1)) for g in groups.values())
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == want


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    made = corpus(700, 9)
    rows = [(i, t) for i, t, _, _ in made]
    item = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    clean = [i for i, t, tox, good in made if good and not tox]
    copied, leaking, personal = clean[0], clean[1], clean[2]
    by = dict(rows)
    rows += [(1000, by[copied]), (1001, by[copied]), (1002, None), (1003, "")]
    rows = [(i, t + " " + item if i == leaking else t + " write to jo.doe@mail.example.org now" if i == personal else t) for i, t in rows]
    spark.createDataFrame(documents(rows), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, g, x) for i, _, x, g in made if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, made, copied, leaking, personal


def test_stages_take_effect(spark, sf_dir):
    d, made, copied, leaking, personal = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns and docs.dtypes == seen[0].dtypes, name
        seen.append(docs)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    bad = {i for i, _, tox, good in made if tox or not good}
    assert len(bad & ids[1]) < 0.05 * len(bad) and len(ids[1]) > 0.95 * (len(made) - len(bad))
    assert copied in ids[2] and not {1000, 1001} & ids[2]
    assert leaking in ids[2] and leaking not in ids[3] and ids[3] == ids[4] == ids[2] - {leaking}
    text = seen[4].filter(f"doc_id = {personal}").first()
    assert "jo.doe" not in text.text and " now" in text.text and text.n_chars == len(text.text)
    unchanged = {r.doc_id: r.text for r in seen[3].collect() if r.doc_id != personal}
    assert {r.doc_id: r.text for r in seen[4].collect() if r.doc_id != personal} == unchanged
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    back = {r.doc_id: r.text for r in pieces.decode(last, pieces.Vocabulary.load(corpus_pipeline.PIECES)).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == ids[4]


def test_near_copies_by_fingerprint_and_by_shingles_are_one_group(spark):
    """1 and 2 have near fingerprints and unlike shingles, 2 and 3 equal shingles and unlike fingerprints."""
    phrase = "one red bird sat on my roof "
    tail = lambda c: " ".join(f"{c}{i}" for i in range(20))
    rows = documents([(1, phrase * 50 + tail("x")), (2, phrase * 50 + tail("y")), (3, phrase * 2 + tail("y")), (4, tail("z")), (None, phrase * 2 + tail("y")), (5, None), (6, "")])
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    assert bin(prints[0] ^ prints[1]).count("1") <= 2 < bin(prints[1] ^ prints[2]).count("1")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [1, 4, 5]


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir[0])
        assert docs.collect() == []


def test_modules_are_the_ones_of_the_stages():
    assert all(m.__name__.startswith("pagewright.llm.") for m in (decontaminate, pieces, pii, quality, simhash))
