import random
import re

from pagewright.llm import licenses as L


def clean(x):
    x = re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    for pattern, name in L.NAMES:
        x = re.sub(pattern, name, x)
    return x


def plain(rows, gap):
    back = {v: k for k, v in L.SENTENCES.items()}
    out = set()
    for i, text in set(rows):
        paragraphs, lines = [[]], (text or "").replace("\r", "").split("\n")
        for k, line in enumerate(lines):  # blank lines between others end a paragraph
            if 0 < k < len(lines) - 1 and not re.search("[A-Za-z0-9]", line):
                paragraphs.append([])
            else:
                paragraphs[-1].append(line)
        parts = [x for p in paragraphs for x in re.split(r"(?<=[.;:!?])[ \t\n]+", "\n".join(p)) if re.search("[A-Za-z0-9]", x)]
        seq = []
        for k, x in enumerate(parts):
            seq += [(k, j, back[clean(y)]) for j, y in enumerate([x, *x.split("\n")] if "\n" in x else [x]) if clean(y) in back]
        least = {}
        for rule, (licence, ids) in L.RULES.items():
            for head in seq:
                at = {head} if head[2] == ids[0] else set()
                for name in ids[1:]:
                    at = {h for h in seq if h[2] == name and any(h[:2] > r[:2] and h[0] - r[0] <= gap + 1 for r in at)}
                if at:
                    key = (i, licence, rule, head[0])
                    least[key] = min([least.get(key, 1 << 30), *(h[0] for h in at)])
        hits = [(*k, v) for k, v in least.items()]
        hits = [h for h in hits if not any(o[3] <= h[3] and o[4] >= h[4] and o[4] - o[3] > h[4] - h[3] for o in hits) and not (h[2] == "proprietary" and any(o[2] != "proprietary" for o in hits))]
        out |= set(hits)
    return list(out)


def test_rules_know_their_sentences():
    assert all(s in L.SENTENCES for _, ids in L.RULES.values() for s in ids)
    assert all(clean(v) == v for v in L.SENTENCES.values())
    assert len(set(L.SENTENCES.values())) == len(L.SENTENCES) and len(L.RULES) >= 95


def test_against_a_plain_scan(spark):
    rng = random.Random(2)
    names = list(L.SENTENCES)
    rows = [(None, "All rights reserved."), (1, None), (2, ""), (3, " .\n;; "), (4, "word. " * 50000 + "Released under the MIT License.")]
    for i in range(10, 120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.7:
                ids = list(rng.choice(list(L.RULES.values()))[1])
                for s in ids:
                    parts += ["Something else"] * (rng.random() < 0.2) * rng.randrange(1, 3) + [L.SENTENCES[s].replace(" and or ", " and/or ").capitalize()]
            else:
                parts.append(L.SENTENCES[rng.choice(names)].upper())
        rows.append((i, "".join(p + rng.choice([".\n", ". ", ";\n\n", ":  ", "\n"]) for p in parts)))
    rows += [rows[-1], (119, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(i, t, "x", 1, []) for i, t in rows], "doc_id long, text string, rule string, place int, s array<string>")
    for gap in (0, 1):
        want = plain(rows, gap)
        assert len(want) > 80
        assert sorted(map(tuple, L.scan(df, gap).collect()), key=str) == sorted(want, key=str)


def test_any_known_sentence_in_any_gap(spark):
    rows, want = [], []
    for rule, (licence, ids) in L.RULES.items():
        for gap in range(1, len(ids)):
            for name in L.SENTENCES.values():
                parts = [L.SENTENCES[s] for s in ids]
                rows.append((len(rows), ". ".join([*parts[:gap], name, *parts[gap:]]) + "."))
                want.append((len(rows) - 1, rule))
    got = {(r.doc_id, r.rule) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    longer = {"mit": "mit titled", "bsd-2-clause": "bsd-2-clause full", "bsd-3-clause": "bsd-3-clause full", "isc": "isc full"}
    assert len(rows) > 4000 and all(w in got or (w[0], longer.get(w[1])) in got for w in want)


MIT = """Copyright (c) 2020 A. Person
All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

All rights reserved.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_wrapped_and_commented_texts(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this\n  list of conditions and the following disclaimer.\n* Redistributions in binary form must reproduce the above copyright notice,\n  this list of conditions and the following disclaimer in the documentation\n  and/or other materials provided with the distribution.\n* Neither the name of Example Corp. nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.\n"
    bsd = bsd.replace("Corp.", "Corp")
    hashes = "".join(f"# {x}\r\n" for x in MIT.splitlines())
    stars = "/*\n" + "".join(f" * {x}\n" for x in MIT.splitlines()) + " */\nint main() { return 0; }\n"
    rows = [(1, MIT), (2, hashes), (3, stars), (4, bsd), (5, "// SPDX-License-Identifier: Apache-2.0\nimport x"), (6, "A line\nReleased under the MIT License\nanother line"), (7, "All rights reserved.")]
    got = {}
    for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.licence, r.rule))
    mit = {("MIT", "mit")}
    assert got == {1: mit, 2: mit, 3: mit, 4: {("BSD-3-Clause", "bsd-3-clause")}, 5: {("Apache-2.0", "spdx Apache-2.0")}, 6: {("MIT", "mit released")}, 7: {("Proprietary", "proprietary")}}


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
