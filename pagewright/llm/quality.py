"""Quality classifier from weak labels (operator 4).

Overlapping heuristic labellers vote bad (1), good (-1) or abstain (0) on every
document; some judge junk, some toxic language. Expectation-maximisation over
the counts of vote patterns estimates each labeller's accuracy without any true
label, and gives each pattern a posterior: a labeller that says bad at random is
found to be worth nothing where others vote good on the same documents. Kinds of
junk exclude each other, which two classes of independent votes cannot say (they
lock on to one kind). So the bad class is a mixture: a kind for each labeller
that never votes good, and a general one. Such a labeller has rates of its own in
every kind and speaks by its silence too. A labeller that can vote good has one
rate for all of the bad class, and its abstention is a missing vote. The junk
labellers here never vote good (usual words are no witness against stutter), so
each kind is looked for by two or more: how their votes fall together is what EM
learns from. Labellers that vote good can be passed to em() beside them.
The posteriors of a bounded sample train a hashed linear scorer, which then
judges every document by its words and by coarse statistics.

The toxic labellers are word lists: words that tell toxic documents among a
bounded sample of labelled ones, dealt to three lists by hash, so that no word
votes twice.

Sizes: vote patterns are a few thousand at most, whatever the corpus. The two
samples are bounded by SAMPLE and LABELLED documents; of these, hashes of words
reach the driver, not texts. Weights are a fixed 2 ** DIMENSION numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many documents train the scorer, and so many labelled ones give the word lists.
SAMPLE, LABELLED = 8_000, 20_000
DIMENSION = 18
#: Documents that each labeller is taken to have judged beforehand, by class and vote (bad, not bad): heuristics are rarely wrong on good ones. A few, so that many documents overrule them.
PRIOR = ((0.05, 2.0), (0.5, 0.5))
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset("the of and to in a is that for it as was with be by on not he his from are at this have or an they which one de la le et les des en un du une que est pour qui dans au sur par pas der die und das den von zu mit sich ist im dem nicht ein eine auf für auch es el y los del se las con su al lo como más".split())
STRIP = "#$%&*.,;:!?|\"'()[]{}<>-_=+~^`"
JUNK = ("symbols", "bars", "capitals", "stutter", "repeated_lines", "function_words", "shouting", "punctuation", "few_words", "bare_marks")
TOXIC = ("list_a", "list_b", "list_c")
LISTS = tuple(np.empty(0, np.uint64) for _ in TOXIC)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


@dataclass
class View:
    """What is looked at of a document: its junk votes, statistics in steps, and the hashes of its different words."""

    votes: list[int]
    steps: list[int]
    words: np.ndarray


def view(text: str | None) -> View:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n = max(1, len(words))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    symbols = sum(map(text.count, "#$%&*")) / n
    bars = text.count("|") / n
    capitals = upper / max(1, letters)
    stutter = sum(a == b for a, b in zip(words, words[1:])) / n
    lines = [x.strip() for x in text.replace(". ", "\n").split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    folded = [w.lower().strip(STRIP) for w in words]
    plain = [w.lower().rstrip(".,;:") for w in words]  # words with other marks on them are no function words
    function = sum(map(FUNCTION_WORDS.__contains__, plain)) / n
    shouting = text.count("!!") / n
    punctuation = sum(w[-1] in ".,;:" for w in words) / n
    variety = len(set(folded)) / n
    marks = folded.count("") / n  # words of marks alone
    enough = len(words) >= 20
    votes = [
        1 if symbols > 0.5 else 0,
        1 if bars > 0.15 else 0,
        1 if capitals > 0.35 and letters >= 20 else 0,
        1 if stutter > 0.15 and enough else 0,
        1 if repeated > 0.35 and len(lines) >= 4 else 0,
        1 if function < 0.04 and enough else 0,
        1 if shouting > 0.2 else 0,
        1 if punctuation < 0.01 and enough else 0,
        1 if variety < 0.35 and 20 <= len(words) <= 2000 else 0,
        1 if marks > 0.12 and enough else 0,
    ]
    steps = [min(9, int(x * k)) for x, k in ((symbols, 6), (bars, 10), (capitals, 12), (stutter, 10), (repeated, 8), (function, 30), (shouting, 10), (punctuation, 30), (variety, 10), (marks, 10))]
    h = xxhash.xxh64_intdigest
    own = {w for w in folded if w}
    return View(votes, steps, np.fromiter((h(w.encode("utf-8", "surrogatepass")) for w in own), dtype=np.uint64, count=len(own)))


def _toxic_votes(words: np.ndarray, lists: tuple[np.ndarray, ...]) -> list[int]:
    """A list votes bad on a text with a word of it."""
    return [int(len(x) > 0 and bool((x[np.minimum(np.searchsorted(x, words), len(x) - 1)] == words).any())) for x in lists]


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of bad for each pattern, P(bad vote | class) as [labeller, good or bad], share of bad).

    PRIOR apart, this is maximum likelihood. Starts from "any bad vote", which
    also says which class is the bad one, and which kind is whose.
    """
    k = patterns.shape[1]
    if not len(patterns):
        return np.empty(0), np.full((k, 2), 0.5), 0.1
    two_sided = (patterns == -1).any(axis=0)
    alone = np.flatnonzero(~two_sided)
    yes = (patterns == 1).astype(float)
    no = np.where(two_sided, patterns == -1, patterns != 1).astype(float)
    # good, the general kind, and a kind for each labeller in ``alone``
    first = np.concatenate([yes[:, two_sided].any(axis=1, keepdims=True), yes[:, alone]], axis=1)
    any_bad = first.any(axis=1)
    first = 0.9 * first / np.maximum(1, first.sum(axis=1, keepdims=True)) + 0.03 * ~any_bad[:, None] / first.shape[1]
    like = np.concatenate([1 - first.sum(axis=1, keepdims=True), first], axis=1)
    rate = np.empty((k, like.shape[1]))
    for _ in range(rounds):
        mass = like * counts[:, None]
        size = mass.sum(axis=0) + np.array([9.0, *np.full(like.shape[1] - 1, 1 / (like.shape[1] - 1))])
        a, b = yes.T @ mass, no.T @ mass
        for x in (a, b):  # what can vote good judges all of the bad class alike
            x[two_sided, 1:] = x[two_sided, 1:].sum(axis=1, keepdims=True)
        prior = np.array([PRIOR[0], *[PRIOR[1]] * (like.shape[1] - 1)])
        a, b = a + prior[:, 0], b + prior[:, 1]
        rate = a / (a + b)
        odds = yes @ np.log(rate) + no @ np.log(1 - rate) + np.log(size / size.sum())
        odds -= odds.max(axis=1, keepdims=True)
        new = np.exp(odds)
        new /= new.sum(axis=1, keepdims=True)
        moved, like = np.abs(new - like).max(), new
        if moved < 1e-7:
            break
    kinds = size[1:] / size[1:].sum()
    return 1 - like[:, 0], np.stack([rate[:, 0], rate[:, 1:] @ kinds], axis=1), float(size[1:].sum() / size.sum())


def _features(v: View, toxic: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of a document's different words, and of its statistics' steps and its votes on words."""
    own = [f"{name}={s}" for name, s in zip(JUNK, v.steps)] + [f"{name}={x}" for name, x in zip(TOXIC, toxic)]
    own = np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in own], np.uint64)
    return tuple(np.unique((x >> np.uint64(64 - DIMENSION)).astype(np.int32)) for x in (v.words, own))


def _values(words: np.ndarray, own: np.ndarray, average: bool) -> np.ndarray:
    """Each word counts one, or (average) by the root of their number: junk is a matter of the whole text, an insult is not."""
    return np.concatenate([np.full(len(words), 1 / np.sqrt(max(1, len(words))) if average else 1.0), np.ones(len(own))])


def _train(rows: list[tuple], target: np.ndarray, average: bool, rounds: int = 150, least: int = 5, l2: float = 2.0) -> np.ndarray:
    """Logistic regression (Adam, full batch) on feature ids that at least ``least`` rows have; the last weight is the bias."""
    size = 1 << DIMENSION
    w = np.zeros(size + 1)
    if not rows:
        return w
    lengths = np.array([len(a) + len(b) for a, b in rows])
    row, ids = np.repeat(np.arange(len(rows), dtype=np.int32), lengths), np.concatenate([x for r in rows for x in r])
    value = np.concatenate([_values(a, b, average).astype(np.float32) for a, b in rows])
    used = np.bincount(ids, minlength=size) >= least
    keep = used[ids]
    row, ids, value = row[keep], ids[keep], value[keep]
    names, ids = np.unique(ids, return_inverse=True)
    x, m, s = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    x[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=x[ids] * value, minlength=len(rows)) + x[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(ids, weights=err[row] * value, minlength=len(names)) + l2 * x[:-1], err.sum()) / len(rows)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    w[names], w[-1] = x[:-1], x[-1]
    return w


def _word_lists(rows: list[tuple[np.ndarray, int]], least: int = 3, evidence: float = 16.0) -> tuple[np.ndarray, ...]:
    """Words that tell toxic documents, by the log-likelihood ratio of document frequencies, dealt to the lists by hash."""
    toxic = [w for w, t in rows if t]
    other = [w for w, t in rows if not t]
    if not toxic or not other:
        return LISTS
    words, a = np.unique(np.concatenate(toxic), return_counts=True)
    words, a = words[a >= least], a[a >= least]
    if not len(words):
        return LISTS
    b = np.zeros(len(words), np.int64)
    for own in other:  # one after the other: only counts of the words in question are kept
        at = np.minimum(np.searchsorted(words, own), len(words) - 1)
        b[at[words[at] == own]] += 1  # a document's words are different
    n, k = len(toxic), len(other)
    p, q, r = (a + 0.5) / (n + 1), (b + 0.5) / (k + 1), (a + b + 0.5) / (n + k + 1)
    term = lambda x, m, u: x * np.log(u) + (m - x) * np.log(np.maximum(1 - u, 1e-9))
    ratio = 2 * (term(a, n, p) + term(b, k, q) - term(a, n, r) - term(b, k, r))
    telling = words[(a >= least) & (p > 20 * q) & (ratio > evidence)]
    return tuple(telling[telling % len(TOXIC) == i] for i in range(len(TOXIC)))


@dataclass
class Model:
    lists: tuple[np.ndarray, ...]
    junk: np.ndarray
    toxic: np.ndarray
    accuracy: dict[str, tuple[float, float]]  # of each labeller: P(bad vote | bad), P(no bad vote | good); of one that can vote good, where it votes


VIEW = "struct<junk:string,toxic:string,words:binary,steps:array<int>>"


def _viewed(lists):
    """Votes as strings of '-', '0', '+'; words and steps."""
    kind = pa.struct([("junk", pa.string()), ("toxic", pa.string()), ("words", pa.binary()), ("steps", pa.list_(pa.int32()))])
    sign = lambda votes: "".join("-0+"[v + 1] for v in votes)

    @F.arrow_udf(VIEW)
    def viewed(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            v = view(t)
            out.append({"junk": sign(v.votes), "toxic": sign(_toxic_votes(v.words, lists)), "words": v.words.tobytes(), "steps": v.steps})
        return pa.array(out, kind)

    return viewed


def _voted(lists):
    sign = lambda votes: "".join("-0+"[v + 1] for v in votes)

    @F.arrow_udf("string")
    def voted(text: pa.Array) -> pa.Array:
        return pa.array([sign(v.votes) + sign(_toxic_votes(v.words, lists)) for v in map(view, text.to_pylist())], pa.string())

    return voted


def _sampled(rows: DataFrame, bound: int, total: int, *by: str) -> DataFrame:
    """At most bound rows, those with the smallest hashes of the columns ``by``; a filter by hash comes first, so that few rows are sorted. Rows that are equal in all of them are alike."""
    h = F.xxhash64(*by)
    part = min(1.0, 2 * bound / max(1, total))
    return rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < int(part * (1 << 20)) + 1).orderBy(F.pmod("h", F.lit(1 << 20)), "h", *by[:1]).limit(bound)


def vote_counts(docs: DataFrame, lists: tuple[np.ndarray, ...] = LISTS) -> list[tuple[str, int]]:
    """(pattern of votes, documents) over all rows of docs; patterns are 3 ** labellers at most, and few in practice."""
    return [(r.p, r.n) for r in docs.select(_voted(lists)(F.col("text").cast("string")).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()]


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, labelled: int = LABELLED) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (1 or 0); without them, or without toxic ones, the toxic labellers abstain.

    Of several labels of a doc_id the highest counts, of several texts with a
    labelled doc_id the one with the smallest hash. Nulls in labels are left
    out. The samples are the rows with the smallest hashes, so a model depends
    on the rows alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = LISTS
    if labels is not None:
        labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        few = _sampled(labels, labelled, labels.count(), "doc_id").select("doc_id", "toxic")  # at most ``labelled`` rows: small enough to broadcast
        seen = docs.filter("text is not null").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        seen = seen.select("doc_id", "toxic", _viewed(LISTS)("text")["words"].alias("words"))
        lists = _word_lists([(np.frombuffer(r.words, np.uint64), r.toxic) for r in seen.toLocalIterator()])
    counted = vote_counts(docs, lists)
    patterns = sorted(counted)
    counts = np.array([n for _, n in patterns], float)
    votes = np.array([["-0+".index(c) - 1 for c in p] for p, _ in patterns], int).reshape(-1, len(JUNK) + len(TOXIC))
    split = len(JUNK)
    posterior, accuracy = [], {}
    for names, part in ((JUNK, votes[:, :split]), (TOXIC, votes[:, split:])):
        own, where = np.unique(part, axis=0, return_inverse=True)
        bad, table, _ = em(own, np.bincount(where.ravel(), weights=counts, minlength=len(own)) if len(own) else counts)
        posterior.append(dict(zip(("".join("-0+"[v + 1] for v in p) for p in own), bad)))
        accuracy |= {x: (float(t[1]), float(1 - t[0])) for x, t in zip(names, table)}
    chosen = _sampled(docs, sample, int(counts.sum()), "doc_id", "text").select("h", _viewed(lists)("text").alias("v")).select("h", "v.*")
    weights = chosen.repartition(1).mapInArrow(_trained(posterior, any(map(len, lists))), "junk binary, toxic binary").collect()
    junk, toxic = (np.frombuffer(x, np.float32) for x in weights[0]) if weights else (np.zeros((1 << DIMENSION) + 1, np.float32) for _ in range(2))
    return Model(lists, junk, toxic, accuracy)


def _trained(posterior: list[dict], listed: bool):
    """Trains on the sample (h, junk, toxic, words, steps) in one task, so that neither its words nor the training take the driver's memory; gives both weights in a row."""

    def run(it):
        rows, junk, toxic = [], [], []
        sample = pa.Table.from_batches([b for b in it if b.num_rows] or [pa.RecordBatch.from_pylist([])])
        if not sample.num_rows:
            return
        for r in sorted(sample.to_pylist(), key=lambda r: (r["h"], r["junk"])):
            v = View([], r["steps"], np.frombuffer(r["words"], np.uint64))
            rows.append(_features(v, ["-0+".index(c) - 1 for c in r["toxic"]]))
            junk.append(posterior[0].get(r["junk"], 0.0))
            toxic.append(posterior[1].get(r["toxic"], 0.0) if listed else 0.0)
        weights = [_train(rows, np.array(target), average).astype(np.float32).tobytes() for target, average in ((junk, True), (toxic, False))]
        yield pa.RecordBatch.from_arrays([pa.array([w], pa.binary()) for w in weights], names=["junk", "toxic"])

    return run


SCORE = "struct<junk:double,toxic:double>"


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to struct<junk, toxic>: two probabilities."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("junk", pa.float64()), ("toxic", pa.float64())])

    @F.arrow_udf(SCORE)
    def scored(text: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for t in text.to_pylist():
            v = view(t)
            ids = _features(v, _toxic_votes(v.words, m.lists))
            every = np.concatenate(ids)
            z = [float((w[every] * _values(*ids, average)).sum() + w[-1]) for w, average in ((m.junk, True), (m.toxic, False))]
            out.append({k: 1 / (1 + np.exp(-np.clip(x, -30, 30))) for k, x in zip(("junk", "toxic"), z)})
        return pa.array(out, kind)

    return scored


def score(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, junk, toxic (probabilities to 6 digits), keep (both under 0.5): a row for each row of docs.

    Null and empty texts get the score of a text without words. Null doc_ids
    stay, repeated rows are repeated and have equal scores. Other columns are
    ignored. Empty table: empty result.
    """
    s = scorer(docs.sparkSession, fit(docs, labels))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), s(F.col("text").cast("string")).alias("s"))
    return found.select("doc_id", F.round("s.junk", 6).alias("junk"), F.round("s.toxic", 6).alias("toxic"), ((F.col("s.junk") < 0.5) & (F.col("s.toxic") < 0.5)).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, that score() keeps: nulls, empty texts and repeated rows as there. Empty table: empty result."""
    s = scorer(docs.sparkSession, fit(docs, labels))(F.col("text").cast("string"))
    return docs.filter(F.greatest(s["junk"], s["toxic"]) < 0.5)
