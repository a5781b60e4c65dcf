"""Surrogates for personal data (operator 7), in DataFrame functions only.

Each entity of a text is replaced by a keyed surrogate of its own kind and
format: digits by digits, letters by letters of the same case and script, given
names by given names of the same gender and script. The surrogate depends on
the key and the entity's canonical form alone, so that equal entities get equal
surrogates in all texts (coreference), without any shuffle of texts.

Collision check: over the distinct entities of the corpus, a surrogate must not
belong to two entities and must not be an entity itself. Entities that lose are
given the surrogate of their next attempt, until none is left. These exceptions
alone, keyed by the text's digest, are joined to the texts that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written

#: Alphabets by script, given names by script and gender, titles by gender.
LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Flora Helga Irene Julia Karin Laura Maria Nina Olga Petra Rosa Sofia Tina Vera",
    ("latin", "m"): "Adam Boris David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Oskar Paul Robert Simon Tomas Viktor",
    ("latin", "u"): "Alex Andrea Charlie Chris Dana Jamie Jordan Kim Lou Noel Pat Robin Sam Sascha Toni",
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Нина Ольга Софья Татьяна",
    ("cyrillic", "m"): "Антон Борис Виктор Иван Максим Николай Олег Павел Роман Сергей",
    ("cyrillic", "u"): "Саша Женя Валя Слава Шура",
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία",
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος",
    ("greek", "u"): "Αλέξης Χάρις Φώτης",
}
TITLES = {"f": ["Mrs.", "Ms.", "Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Mlle", "г-жа", "κα"], "m": ["Mr.", "Mr", "Herr", "Herrn", "Señor", "Monsieur", "г-н", "κ."], "u": ["Dr.", "Prof."]}
#: What counts as an entity, in the order in which kinds are tried at a place.
PATTERNS = {
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_\-/+]{16,}",
    "email": r"[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|(?<!\d)\d{2,4}[ .-])\d{3}[ .-]?\d{4}(?!\d)|\+\d{8,15}(?!\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b(?=\b)",
    "person": r"\b(?:" + "|".join(t.replace(".", r"\.") for k in "fmu" for t in TITLES[k]) + r") \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?",
}
ENTITY = "|".join(p.replace(r"\1", r"\k<sep>").replace("([ -]?)", "(?<sep>[ -]?)") for p in PATTERNS.values())
#: A quick look whether a text can hold an entity at all.
HINT = r"[@0-9]|(?i:token|secret|passw|api.?key)|\b(?:" + "|".join(t.replace(".", r"\.") for k in "fmu" for t in TITLES[k]) + r") \p{Lu}"
ATTEMPTS = 64
#: A person's mention.
TITLED = r"\A(?:" + "|".join(t.replace(".", r"\.") for k in "fmu" for t in TITLES[k]) + r") \p{Lu}"
#: What is dropped from numbers that are written in several ways.
PLAIN = r"[\s().-]"


def _let(value: Column, fn) -> Column:
    """fn(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def kind(e: Column) -> Column:
    whole = lambda k: e.rlike(rf"\A(?:{PATTERNS[k]})\z")
    out = F.lit("person")
    for k in reversed(list(PATTERNS)[:-1]):
        out = F.when(whole(k), k).otherwise(out)
    return out


def _secret_parts(e: Column) -> tuple[Column, Column]:
    return F.regexp_extract(e, r"\A(.*?[=:]\s{0,3}[\"']?)[A-Za-z0-9_\-/+]{16,}\z", 1), F.regexp_extract(e, r"[A-Za-z0-9_\-/+]{16,}\z", 0)


def canonical(k: Column, e: Column) -> Column:
    """What makes two mentions the same entity: case does not count, nor does punctuation of numbers, nor a secret's label."""

    def made(e):
        number = F.upper(F.regexp_replace(e, PLAIN, ""))
        return F.when(k.isin("card", "phone", "ssn", "iban"), number).when(k == "secret", _secret_parts(e)[1]).otherwise(F.lower(e))

    return _let(e, made)


def _bytes(key: str, salt: str, canon: Column, attempt: Column) -> Column:
    """256 hex digits that depend on key, salt, entity and attempt."""
    seed = F.concat(F.lit(f"{key}\x1f{salt}\x1f"), canon, F.lit("\x1f"), attempt.cast("string"), F.lit("\x1f"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(str(b))), 256) for b in range(4)])


def _byte(h: Column, i: Column) -> Column:
    """A number below 65536 for position i (from 0)."""
    return F.conv(F.substr(h, i % 64 * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, v: Column) -> Column:
    return F.substr(F.lit(letters), v % len(letters) + 1, F.lit(1))


def _letter(c: Column, v: Column) -> Column:
    out = F.when(c.rlike("[0-9]"), (v % 10).cast("string"))
    for script, letters in (("IsCyrillic", LOWER["cyrillic"]), ("IsGreek", LOWER["greek"]), ("L", LOWER["latin"])):
        out = out.when(c.rlike(rf"\p{{{script}}}") & (c != F.lower(c)), _pick(letters.upper(), v)).when(c.rlike(rf"\p{{{script}}}"), _pick(letters, v))
    return out.otherwise(c)


def _scramble(e: Column, hexes: Column, keep: int = 0) -> Column:
    """e with every digit and letter after the first keep characters replaced by one of its class; the n-th of these by the n-th number.

    Punctuation takes no number, so that two ways to write one number agree.
    """
    chars = F.filter(F.split(e, ""), lambda c: c != "")

    def step(h):
        def add(acc, c):
            solid = c.rlike(r"[\p{L}\p{N}]")
            n = acc["n"] + solid.cast("int")
            return F.struct(F.concat(acc["s"], F.when(solid & (n > keep), _letter(c, _byte(h, n))).otherwise(c)).alias("s"), n.alias("n"))

        return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), add, lambda acc: acc["s"])

    return _let(hexes, step)


def _secret(value: Column, hexes: Column) -> Column:
    """Hexadecimal values stay so."""
    rest = LOWER["latin"][6:]
    narrow = lambda x: F.translate(x, rest + rest.upper(), ("abcdef" * 4)[: len(rest)] + ("ABCDEF" * 4)[: len(rest)])
    return _let(_scramble(value, hexes), lambda x: F.when(value.rlike(r"\A[0-9a-fA-F]+\z"), narrow(x)).otherwise(x))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum; the last digit counts once, the one before it doubled."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(e: Column, hexes: Column) -> Column:
    """Digits scrambled; a valid check digit stays valid."""
    plain = lambda x: F.regexp_replace(x, r"[ -]", "")

    def mend(s):
        zero = F.concat(F.substr(s, F.lit(1), F.length(s) - 1), F.lit("0"))
        return F.when(_let(plain(e), _luhn_sum) % 10 == 0, _let(zero, lambda z: F.concat(F.substr(z, F.lit(1), F.length(z) - 1), ((10 - _let(plain(z), _luhn_sum) % 10) % 10).cast("string")))).otherwise(s)

    return _let(_scramble(e, hexes), mend)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _names(gender: Column, first: Column) -> Column:
    """The given names of the gender and of first's script, other than first."""
    script = _script(first)
    out = F.array().cast("array<string>")
    for (s, g), names in GIVEN.items():
        out = F.when((script == s) & (gender == g), F.array(*map(F.lit, names.split()))).otherwise(out)
    return F.array_remove(out, F.initcap(first))


def _cased(new: Column, old: Column) -> Column:
    return _let(new, lambda x: F.when((old == F.upper(old)) & (F.length(old) > 1), F.upper(x)).otherwise(x))


def _person(key: str, e: Column, attempt: Column) -> Column:
    """Title kept; a lone name and the last of two are surnames, so that mentions with and without given name agree.

    Further attempts change the given name, and lengthen it; a lone name keeps
    its surname unless that is taken.
    """

    def whole(parts):
        title, last = parts[0], F.element_at(parts, -1)
        alone = F.size(parts) == 2
        gender = F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("u")
        surname = _let(_bytes(key, "surname", F.lower(last), F.when(alone, attempt).otherwise(0)), lambda h: _scramble(last, h))
        name = lambda x, h, i: F.element_at(x, _byte(h, F.lit(i)) % F.size(x) + 1)

        def given(x):
            def made(h):
                more = F.when(attempt > 0, F.concat(F.lit("-"), name(x, h, 1))).otherwise("")
                return _cased(F.concat(name(x, h, 0), more, F.when(attempt > 2, F.concat(F.lit("-"), _scramble(parts[1], h))).otherwise("")), parts[1])

            return _let(_bytes(key, "given", F.lower(e), attempt), made)

        return F.concat_ws(" ", title, F.when(~alone, _let(_names(gender, parts[1]), given)), surname)

    return _let(F.slice(F.split(e, " "), 1, 3), whole)


def surrogate(key: str, k: Column, e: Column, attempt: Column | None = None) -> Column:
    """The surrogate of a mention e of kind k."""
    attempt = F.lit(0) if attempt is None else attempt

    def mail(h):
        local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
        # after some attempts a short name gets longer: there may be no other left
        more = F.when(attempt > 3, F.substr(F.sha2(F.concat(F.lit(key), F.lower(e), attempt.cast("string")), 256), F.lit(1), F.least(attempt, F.lit(8)))).otherwise("")
        host = F.regexp_extract(domain, r"\A(.*\.)[^.]*\z", 1)
        hosted = _let(_bytes(key, "domain", F.lower(domain), F.lit(0)), lambda g: _scramble(host, g))
        return F.concat(_scramble(F.concat(local, more), h), F.lit("@"), hosted, F.substring_index(domain, ".", -1))

    def made(h):
        octets = [(1 + _byte(h, F.lit(i)) % 223).cast("string") for i in range(4)]
        # a number's country code stays: "+" and its digits, or the IBAN's two letters
        lead = F.when(k == "phone", F.regexp_extract(e, r"\A(?:\+\d{1,3}(?=[ .(-])|\+\d)?", 0)).when(k == "iban", F.substring(e, 1, 2)).when(k == "secret", _secret_parts(e)[0]).otherwise("")
        rest = _let(lead, lambda x: F.concat(x, _scramble(F.substr(e, F.length(x) + 1), h)))
        return F.when(k == "email", mail(h)).when(k == "ip", F.concat_ws(".", *octets)).when(k == "card", _card(e, h)).when(k == "secret", _let(lead, lambda x: F.concat(x, _secret(F.substr(e, F.length(x) + 1), h)))).otherwise(rest)

    hexes = _bytes(key, "entity", F.concat(k, F.lit("\x1f"), canonical(k, e)), attempt)
    return F.when(k == "person", _person(key, e, attempt)).otherwise(_let(hexes, made))


def entities(text: Column) -> Column:
    """The mentions of a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _exceptions(found: DataFrame, key: str) -> DataFrame | None:
    """found: distinct kind, canon, sample mention -> canon, attempt of those whose first surrogate is taken; None if there is none."""
    open_ = found.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    for attempt in range(1, ATTEMPTS):
        made = open_.withColumn("new", canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("mention"), F.col("attempt"))))
        taken = found.select("kind", F.col("canon").alias("new"), F.lit(True).alias("real"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "new", F.lit(True).alias("real")))
        least = made.groupBy("kind", "new").agg(F.min("canon").alias("keeper"))
        judged = made.join(least, ["kind", "new"]).join(taken.distinct(), ["kind", "new"], "left").withColumn("lost", F.col("real").isNotNull() | (F.col("canon") != F.col("keeper")))
        judged = written(judged.select("kind", "canon", "mention", "attempt", "new", "lost"), "surrogates")
        won = judged.filter("not lost").drop("lost")
        settled = won if settled is None else settled.unionByName(won)
        if judged.filter("lost").isEmpty():
            again = settled.filter("attempt > 0").select("kind", "canon", "attempt")
            return None if attempt == 1 else again
        open_ = judged.filter("lost").select("kind", "canon", "mention", F.lit(attempt).alias("attempt"))
    raise RuntimeError("no surrogates left for some entities")


def _again(pairs: Column) -> Column:
    """Of the persons (old, new) of a text: struct<find, to>, a pattern of their names without title and a map to the surrogates' names. Of several surrogates of a name the first counts."""
    def forms(m):
        a, b = F.slice(F.split(m["old"], " "), 2, 2), F.slice(F.split(m["new"], " "), 2, 2)
        last = F.struct(F.element_at(a, -1).alias("key"), F.element_at(b, -1).alias("value"))
        both = F.struct(F.array_join(a, " ").alias("key"), F.array_join(b, " ").alias("value"))
        return F.array(both, last)

    def made(every):
        keys = F.array_distinct(F.transform(every, lambda e: e["key"]))
        first = F.transform(keys, lambda k: F.struct(k.alias("key"), F.get(F.filter(every, lambda e: e["key"] == k), 0)["value"].alias("value")))
        ordered = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))  # whole names first
        find = F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])(?:"), F.array_join(F.transform(ordered, lambda o: o["k"]), "|"), F.lit(r")(?![\p{L}\p{N}]|['’-]\p{L})"))
        return F.struct(find.alias("find"), F.map_from_entries(first).alias("to"))

    return _let(F.flatten(F.transform(pairs, forms)), made)


def _renamed(part: Column, again: Column) -> Column:
    rest, names = F.split(part, again["find"], -1), F.regexp_extract_all(part, again["find"], F.lit(0))
    return F.array_join(F.flatten(F.zip_with(rest, names, lambda p, n: F.array(p, F.coalesce(F.try_element_at(again["to"], n), F.lit(""))))), "")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with its text column's entities replaced; all columns and rows stay, the order of columns too.

    A person named behind a title is the same person where the surname, or both
    names, stand in the text without it. Null and empty texts stay as they are; so do rows with other nulls, repeated
    rows and columns of any name. Two rows with equal texts get equal results.
    Empty table: empty result.
    """
    text = F.col("text").cast("string")
    mentions = docs.select(F.explode(entities(text)).alias("mention")).withColumn("kind", kind(F.col("mention")))
    found = mentions.groupBy("kind", canonical(F.col("kind"), F.col("mention")).alias("canon")).agg(F.min("mention").alias("mention"))
    again = _exceptions(written(found, "entities"), key)
    names = docs.columns
    own = "_moved"
    while own.lower() in {n.lower() for n in names}:
        own += "_"
    if again is None:
        moved = docs.withColumn(own, F.lit(None).cast("map<string,int>"))
    else:
        each = docs.select(F.md5(text).alias("digest"), F.explode(F.array_distinct(entities(text))).alias("mention")).distinct().withColumn("kind", kind(F.col("mention")))
        each = each.withColumn("canon", canonical(F.col("kind"), F.col("mention")))
        each = salted_join(each, again, ["kind", "canon"], "digest")
        maps = each.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("mention", "attempt"))).alias(own)).withColumnRenamed("digest", own + "#")
        moved = docs.join(maps.hint("merge"), F.md5(text) == F.col(own + "#"), "left").drop(own + "#")

    def new(e):
        attempt = F.coalesce(F.try_element_at(F.col(own), e), F.lit(0))
        return _let(F.struct(kind(e).alias("k"), attempt.alias("a")), lambda x: surrogate(key, x["k"], e, x["a"]))

    def put(x):
        pairs = F.filter(F.arrays_zip(x["old"], x["new"]), lambda m: m["old"].rlike(TITLED))
        named = F.when(F.size(pairs) > 0, _let(pairs, lambda m: _let(_again(m), lambda a: F.transform(x["parts"], lambda p: _renamed(p, a))))).otherwise(x["parts"])
        return F.array_join(F.flatten(F.zip_with(named, x["new"], lambda p, e: F.array(p, F.coalesce(e, F.lit(""))))), "")

    mentions = entities(text)
    whole = _let(F.struct(F.split(text, ENTITY, -1).alias("parts"), mentions.alias("old"), F.transform(mentions, new).alias("new")), put)
    out = F.when(text.rlike(HINT) & text.rlike(ENTITY), whole).otherwise(text)
    return moved.select(*[out.alias("text") if c == "text" else F.col(f"`{c}`") for c in names])


def counts(text: Column) -> Column:
    return F.size(entities(text))
