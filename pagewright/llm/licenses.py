"""License scans by sentence rules (operator 3).

A text's sentences are normalised and looked up among known licence sentences;
what remains is a short sequence of sentence identifiers with their places.
Rules are ordered sequences of identifiers: one matches where its identifiers
follow each other, with no more than GAP other sentences between two, known or
not. A match within a longer one is not reported, and "all rights reserved" is
Proprietary only in a text where nothing else matches.

Licence texts come wrapped and behind comment marks, so a line end alone ends no
sentence; a line is looked up by itself too, since short notices stand on lines
without a full stop. Marks vanish in the normalisation.

Sentences and rules are fixed lists of this module, so their broadcast has a
fixed size; texts are never shuffled, only the few sentences that are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Other sentences allowed between two of a rule.
GAP = 1
#: Ends a sentence in the prepared text.
STOP = "\x01"
#: Patterns of text that stands for a sentence end (lines without letters and digits count as blank), for Java and RE2 alike.
BLANK, END = r"\n(?:[^A-Za-z0-9\n]*\n)+", r"([.;:!?])[ \t\n]+"
#: Names that vary in a normalised sentence; pattern, what is put there.
NAMES = (
    (r"^neither the names? of .{1,120}? may be used to endorse or promote products", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    (r"^in no event shall .{1,120}? be liable for any direct", "in no event shall the copyright holder or contributors be liable for any direct"),
    (r"^this software is provided by .{1,120}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
)
#: Known sentences, as they are after normalisation.
SENTENCES = {
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-may": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl3-may": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-may": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "rights": "all rights reserved",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-disclaimer": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "lgpl21-may": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-may": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-free": "this library is free software",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "agpl3-may": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-held": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "wtfpl-do": "you just do what the fuck you want to",
    "spdx-tag": "spdx license identifier",
}
#: Rules in order of their names; a licence, and the sentences that stand for it.
RULES = {
    "apache-2.0 header": ("Apache-2.0", ["apache-grant", "apache-may", "apache-copy", "apache-unless"]),
    "apache-2.0 short": ("Apache-2.0", ["apache-short"]),
    "bsd-2-clause": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    "bsd-3-clause": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "cc-by": ("CC-BY-4.0", ["cc-by-4"]),
    "cc-by-nc": ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    "cc-by-sa": ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    "cc0": ("CC0-1.0", ["cc0"]),
    "gpl-2.0 header": ("GPL-2.0-or-later", ["gpl-free", "gpl2-may", "gpl-hope"]),
    "gpl-3.0 header": ("GPL-3.0-or-later", ["gpl-free", "gpl3-may", "gpl-hope"]),
    "gpl-3.0 short": ("GPL-3.0", ["gpl3-short"]),
    "isc": ("ISC", ["isc-grant"]),
    "mit": ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    "mit licensed": ("MIT", ["mit-licensed"]),
    "mit released": ("MIT", ["mit-released"]),
    "mit titled": ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    "mpl-2.0": ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    "proprietary": ("Proprietary", ["rights"]),
    "unlicense": ("Unlicense", ["unlicense"]),
    "agpl-3.0 header": ("AGPL-3.0-or-later", ["gpl-free", "agpl3-may", "gpl-hope"]),
    "bsd-2-clause full": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer"]),
    "bsd-3-clause full": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer"]),
    "bsd-4-clause": ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    "bsl": ("BSL-1.0", ["bsl-grant"]),
    "epl-2.0 header": ("EPL-2.0", ["epl2-terms"]),
    "isc full": ("ISC", ["isc-grant", "isc-disclaimer"]),
    "lgpl-2.1 header": ("LGPL-2.1-or-later", ["lgpl-free", "lgpl21-may", "lgpl-hope"]),
    "lgpl-3.0 header": ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-may", "lgpl-hope"]),
    "wtfpl": ("WTFPL", ["wtfpl-do"]),
    "zlib": ("Zlib", ["zlib-warranty", "zlib-held", "zlib-grant"]),
}
#: Licences by their public identifiers, and a title that notices use.
TITLES = {
    "AFL-3.0": "academic free license 3 0",
    "AGPL-3.0": "gnu affero general public license version 3",
    "Apache-1.1": "apache license version 1 1",
    "Apache-2.0": "apache license 2 0",
    "Artistic-2.0": "artistic license 2 0",
    "BSD-2-Clause": "bsd 2 clause license",
    "BSD-3-Clause": "bsd 3 clause license",
    "BSL-1.0": "boost software license 1 0",
    "CC-BY-4.0": "creative commons attribution 4 0 international license",
    "CC-BY-NC-4.0": "creative commons attribution noncommercial 4 0 international license",
    "CC-BY-SA-4.0": "creative commons attribution sharealike 4 0 international license",
    "CDDL-1.0": "common development and distribution license",
    "EPL-2.0": "eclipse public license 2 0",
    "EUPL-1.2": "european union public licence 1 2",
    "GPL-2.0": "gnu general public license version 2",
    "GPL-3.0": "gnu general public license version 3",
    "ISC": "isc license",
    "LGPL-2.1": "gnu lesser general public license version 2 1",
    "LGPL-3.0": "gnu lesser general public license version 3",
    "MIT": "mit license",
    "MPL-2.0": "mozilla public license 2 0",
    "MS-PL": "microsoft public license",
    "OFL-1.1": "sil open font license 1 1",
    "PostgreSQL": "postgresql license",
    "Unlicense": "unlicense",
    "Zlib": "zlib license",
}
#: Forms of a notice, by title.
FORMS = {"licensed": "licensed under the {}", "released": "released under the {}", "work": "this work is licensed under the {}", "project": "this project is licensed under the {}"}


def _add_titles() -> None:
    """Sentences and rules of each title's forms, and of its identifier behind the tag for it; listed ones stay as they are."""
    listed = set(SENTENCES.values())
    for spdx, title in TITLES.items():
        for form, words in FORMS.items():
            name = f"{spdx} {form}".lower()
            if words.format(title) not in listed:
                SENTENCES[name] = words.format(title)
                RULES[name] = (spdx, [name])
        SENTENCES[f"spdx {spdx}"] = spdx.lower().replace("-", " ").replace(".", " ")
        RULES[f"spdx {spdx}"] = (spdx, ["spdx-tag", f"spdx {spdx}"])


_add_titles()


def normalised(sentence: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    for pattern, name in NAMES:
        s = F.when(s.startswith(name[:16]), F.regexp_replace(s, pattern, name)).otherwise(s)
    return s


def sentences(text: Column) -> Column:
    """Split at blank lines and behind . ; : ! ? and white space; line ends stay inside."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r", ""), BLANK, STOP)
    return F.split(F.regexp_replace(plain, END, "$1" + STOP), STOP)


def known(docs: DataFrame) -> DataFrame:
    """doc_id, rid, place (number of the sentence in its text, from 0, blank ones left out), part (0: the whole sentence, else a line of it), sentence (identifier)."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(v, k) for k, v in SENTENCES.items()], "norm string, sentence string")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("rid"), F.filter(sentences(text), lambda s: s.rlike("[A-Za-z0-9]")).alias("s"))
    each = rows.select("doc_id", "rid", F.posexplode("s").alias("place", "whole"))
    parts = F.when(F.instr("whole", "\n") > 0, F.concat(F.array(F.col("whole")), F.split("whole", "\n"))).otherwise(F.array(F.col("whole")))
    lines = each.select("doc_id", "rid", "place", F.posexplode(parts).alias("part", "line")).select("doc_id", "rid", "place", "part", normalised(F.col("line")).alias("norm"))
    return lines.join(F.broadcast(names), "norm").select("doc_id", "rid", "place", "part", "sentence")


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, licence, ids[0], ids[1:]) for k, (licence, ids) in RULES.items()], "rule string, licence string, head string, ids array<string>")


def scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """doc_id, licence, rule, first, last (numbers of sentences): a row for each place where a rule begins to match, with the nearest end.

    Null and empty texts have none. Null doc_ids stay. Rows that repeat a doc_id
    and its text are one; rows that share a doc_id with another text are
    scanned each. Other columns are ignored. Empty table: empty result.
    """
    found = known(docs).distinct()
    seq = found.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_list(F.struct("place", "part", "sentence"))).alias("s"))
    at = seq.select("doc_id", "rid", "s", F.explode("s").alias("x")).withColumn("head", F.col("x.sentence"))
    tried = at.join(F.broadcast(_rules(docs.sparkSession)), "head")
    order = lambda h: F.struct(h["place"], h["part"])
    follows = lambda h, r: (order(h) > order(r)) & (h["place"] - r["place"] <= gap + 1)
    # the known sentences at which the rule's part so far can end
    ends = F.aggregate("ids", F.array(F.col("x")), lambda acc, name: F.filter("s", lambda h: (h["sentence"] == name) & F.exists(acc, lambda r: follows(h, r))))
    hit = tried.withColumn("last", F.array_min(F.transform(ends, lambda r: r["place"]))).filter("last is not null")
    hit = hit.select("doc_id", "rid", "licence", "rule", F.col("x.place").alias("first"), "last").distinct()
    each = hit.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("licence", "rule", "first", "last")).alias("h"))
    longer = lambda a, b: (b["first"] <= a["first"]) & (b["last"] >= a["last"]) & (b["last"] - b["first"] > a["last"] - a["first"])
    weak = lambda a: (a["rule"] == "proprietary") & F.exists("h", lambda b: b["rule"] != "proprietary")
    best = F.filter("h", lambda a: ~F.exists("h", lambda b: longer(a, b)) & ~weak(a))
    return each.select("doc_id", F.explode(best).alias("m")).select("doc_id", "m.*")
