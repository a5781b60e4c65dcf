import re

import pytest
from pyspark.sql import functions as F

from pagewright.llm import pii

TEXTS = {
    1: "mail The.72@mail3.example.com and the.72@mail3.example.com### or +1 (017) 555-7713, card 4111 1111 1111 1111 or 4111111111111111 or 4952935900253052.",
    2: 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ip 240.56.125.154. SSN 123-45-6789 IBAN DE89370400440532013000',
    3: "Mr. John Smith met Mrs. Anna SMITH and Dr. Smith; г-н Иван Петров, г-жа Анна Петрова, κα Ελένη Παππά, Señora García",
    4: None,
    5: "",
    6: 'TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF" call +1 (017) 555-7713 or +1-017-555-7713 from 240.56.125.154',
    7: "No personal data: 3.14, 10.5, 2024-01-02, version 1.2.3, The 12 Mr jokes; 99 % of A and B.",
    8: "###152.143.123.131###jo@a.example.org$$$",
}


def run(spark, rows, key="k", schema="doc_id long, text string, mention string, kind string, _moved int"):
    df = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], schema)
    out = pii.replace(df, key)
    assert out.columns == df.columns
    return {r.doc_id: r.text for r in out.collect()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_formats_and_coreference(spark):
    out = run(spark, TEXTS.items())
    assert out[4] is None and out[5] == "" and out[7] == TEXTS[7]
    for i in (1, 2, 3, 6, 8):
        for found in re.findall(r"\S+@\S+?\.(?:com|org)|\d{3}-\d{4}|\d{16}|\d+\.\d+\.\d+\.\d+|[0-9a-fA-F]{40}|John|Smith|SMITH|Иван|Петров|Ελένη|Παππά|García|Anna ", TEXTS[i]):
            assert found not in out[i], found
    a, b = re.findall(r"\S+@[\w.]+", out[1])
    assert a != b and a.lower() == b.lower() and re.fullmatch(r"[A-Z][a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a)
    spaced, solid, other = re.search(r"card ([\d ]+) or (\d+) or (\d+)\.", out[1]).groups()
    assert spaced.replace(" ", "") == solid and luhn(solid) and len(solid) == 16 and re.fullmatch(r"(\d{4} ){3}\d{4}", spaced) and len(other) == 16
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[1])[0]
    assert phone in out[6] and re.sub(r"\D", "", phone) == re.sub(r"\D", "", re.search(r"\+1-\d{3}-\d{3}-\d{4}", out[6])[0])
    ip = re.search(r"ip ([\d.]+)\. SSN \d{3}-\d\d-\d{4} IBAN DE\d{20}", out[2])[1]
    assert ip in out[6] and all(0 < int(x) < 256 for x in ip.split("."))
    secret = re.search(r'token = "([0-9a-f]{40})"', out[2])[1]
    assert re.search(r'TOKEN = "([0-9A-F]{40})"', out[6])[1] == secret.upper() or secret.lower() != TEXTS[2][9:49]
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Dr\. (\w+); г-н (\w+) (\w+), г-жа (\w+) (\w+), κα (\w+) (\w+), Señora (\w+)", out[3]).groups()
    assert names[1] == names[4] == names[3].capitalize() and names[3].isupper()
    for name, group in ((names[0], ("latin", "m")), (names[2], ("latin", "f")), (names[5], ("cyrillic", "m")), (names[7], ("cyrillic", "f")), (names[9], ("greek", "f"))):
        assert name in pii.GIVEN[group].split() or "-" in name
    assert re.fullmatch("[а-яА-Я]+", names[6]) and re.fullmatch("[α-ωΑ-Ω]+", names[10])
    assert run(spark, TEXTS.items()) == out != run(spark, TEXTS.items(), "other")


def plain_renamed(before, after):
    """Names of titled persons, put to the text that is left once the titled mentions are marked."""
    titles = "|".join(re.escape(t) for k in "fmu" for t in pii.TITLES[k])
    person = rf"\b(?:{titles}) [A-Z]\w+(?: [A-Z]\w+)?"
    old, new = re.findall(person, before), re.findall(person, after)
    to = {}
    for a, b in zip(old, new):
        a, b = a.split(" ")[1:], b.split(" ")[1:]
        to.setdefault(" ".join(a), " ".join(b))
        to.setdefault(a[-1], b[-1])
    rest = re.split(person, before)
    find = r"(?<![\w'-])(?:" + "|".join(sorted(to, key=lambda k: (-len(k), k))) + r")(?!\w|['-][^\W\d])"
    rest = [re.sub(find, lambda m: to[m[0]], p) for p in rest]
    return "".join(p + n for p, n in zip(rest, [*new, ""]))


def test_names_without_title_take_the_same_surrogate(spark):
    texts = [
        "Mr. John Smith said. Smith, John Smith and Smiths went; O'Smith and Smith-Jones did not. John alone stays.",
        "Smith came first, then Dr. Smith and Mrs. Anna Brown, and Brown's hat.",
        "Mr. Ivan Stone met Mr. Paul Ivan; Ivan and Stone and Paul Ivan.",
        "Nobody Smith here.",
    ]
    out = run(spark, list(enumerate(texts)))
    assert out[3] == texts[3]
    for i, t in enumerate(texts[:3]):
        assert out[i] == plain_renamed(t, out[i]) and out[i] != t
    words = re.findall(r"\w+", out[0])
    assert "John alone stays" in out[0] and "Smiths went; O'Smith and Smith-Jones" in out[0] and not re.search(r"(?<!')\bSmith\b(?!-)", out[0])
    assert words[2] == words[4] == words[6]


def test_collisions_are_resolved(spark):
    """Few short forms: first surrogates collide, results do not, and none is an entity of the corpus."""
    mails = [f"{c}@x.example" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"{c}@y.example" for c in "abcdef"]
    names = [f"Mr. {a} Stone" for a in ("Al", "Bob", "Cy", "Dan", "Ed", "Flo", "Gus", "Hal", "Ian", "Jo", "Ken", "Lu", "Max", "Ned", "Oz", "Pip", "Quin", "Ray", "Sid", "Ted", "Una", "Vic", "Wes", "Xan", "Yul", "Zed")]
    rows = [(i, f"{m} and {m}") for i, m in enumerate(mails + names)] + [(None, mails[0]), (500, " ".join(mails)), (501, " / ".join(names)), (501, " / ".join(names))]
    out = run(spark, rows)
    new = [out[i] for i in range(len(mails + names))]
    assert all(x.split(" and ")[0] == x.split(" and ")[1] for x in new)
    single = [x.split(" and ")[0] for x in new]
    assert len(set(single)) == len(single) and not set(single) & set(mails + names)
    assert out[500] == " ".join(single[: len(mails)]) and out[501] == " / ".join(single[len(mails) :])
    assert out[None] == single[0]


def test_every_case(spark):
    assert run(spark, []) == {}
    long = "word " * 200000 + "x@y.example " + "word " * 10
    out = run(spark, [(1, long)])
    assert "x@y.example" not in out[1] and len(out[1].split()) == 200011
    nothing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert pii.replace(nothing, "k").collect()[0].text is None


@pytest.mark.parametrize("text, kinds", [(TEXTS[1], "email email phone card card card"), (TEXTS[2], "secret ip ssn iban"), (TEXTS[3], "person person person person person person person"), (TEXTS[8], "ip email")])
def test_kinds(spark, text, kinds):
    row = spark.range(1).select(F.transform(pii.entities(F.lit(text)), pii.kind).alias("k")).first()
    assert " ".join(row.k) == kinds


def test_native(spark):
    df = spark.createDataFrame([(1, TEXTS[1])], "doc_id long, text string")
    plan = pii.replace(df, "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
