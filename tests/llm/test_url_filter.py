import datetime as dt
import random
import re

from pagewright.llm import url_filter as U

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)


def plain_listed(entries, lst, value, day):
    """Walk the value's days in order."""
    days = {}
    for e in entries:
        if None not in e and e[0] == lst and e[1].strip().lower() == value and e[3] <= day:
            days.setdefault(e[3], []).append(e[2].lower() == "add")
    return all(days[max(days)]) if days else False


def plain_keys(url):
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    if not m:
        return set()
    h = re.sub(r"^www\.|\.$", "", m[1].lower())
    labels = h.split(".")
    out = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))}
    p = re.match(r"[^/]*//[^/?#]*(/[^?#]*)", url)
    parts = [x for x in (p[1] if p else "").split("/") if x]
    return out | {h + "/" + "/".join(parts[: i + 1]) + "/" for i in range(len(parts))}


def test_against_a_walk_through_the_entries(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "www.x.org", "single"]
    values = ["example.com", "a.example.com", "X.org ", "x.org/p/", "a.example.com/p/q/", "single", "com"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(values), rng.choice(["add", "ADD", "remove"]), D(rng.randrange(60))) for _ in range(80)] + [("l1", None, "add", D(1)), (None, "x.org", "add", D(1)), ("l1", "x.org", None, D(2)), ("l1", "x.org", "add", None)]
    urls = [f"{s}//{rng.choice(['', 'u:p@'])}{h.upper() if rng.random() < 0.2 else h}{rng.choice(['', ':80', '.'])}{rng.choice(['', '/', '/p', '/p/q/r?x=/z/', '/p//q/#f'])}" for s in ("http:", "https:", "") for h in hosts for _ in range(3)]
    captures = [(i, u, D(rng.randrange(-2, 62))) for i, u in enumerate(urls)] + [(None, urls[0], D(30)), (900, None, D(3)), (901, "no url", D(3)), (902, urls[1], None), (903, "http://" + "a." * 3000 + "example.com/" + "p/" * 3000, D(30)), (0, urls[0], captures_day := D(20)), (0, urls[0], captures_day)]
    df = spark.createDataFrame([(*c, "x", "y", "z") for c in captures], "page_id long, url string, day date, list string, value string, row string")
    en = spark.createDataFrame([(*e, 1) for e in entries], "list string, value string, action string, day date, page_id int")
    got = sorted(U.judged(df, en).collect(), key=str)
    want = []
    pairs = {(e[0], e[1].strip().lower()) for e in entries if None not in e}
    for i, u, day in set(captures):
        hit = [(lst, v) for lst, v in pairs if day and v in plain_keys(u) and plain_listed(entries, lst, v, day)]
        want.append((i, day, len(hit), ",".join(sorted({h[0] for h in hit})), not hit))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 5 < sum(w[2] > 0 for w in want) < len(want)


def test_intervals_are_disjoint(spark):
    en = spark.createDataFrame([("l", "v", a, D(d)) for a, d in (("add", 1), ("add", 3), ("remove", 5), ("remove", 6), ("add", 9), ("remove", 9), ("add", 10))], "list string, value string, action string, day date")
    rows = {(r.since, r.until) for r in U.intervals(en).collect()}
    assert rows == {(D(1), D(5)), (D(10), None)}


def test_empty(spark):
    c = spark.createDataFrame([], "page_id long, url string, day date")
    e = spark.createDataFrame([], "list string, value string, action string, day date")
    assert U.judged(c, e).collect() == []
    one = spark.createDataFrame([(1, "http://x.org/", D(1))], "page_id long, url string, day date")
    assert [tuple(r) for r in U.judged(one, e).collect()] == [(1, D(1), 0, "", True)]
