"""SentencePiece N-best encoding and decoding (operator 1).

A text is normalised as the model says (spaces become a mark, one mark in
front), and its pieces span a lattice. Viterbi scores from the front are the
exact cost to go of a search from the back: A* with them pops the N best
segmentations one after the other, and expands nothing that does not lie on one
of them (ties apart).

No piece of the vocabularies at hand crosses from a word into the next mark,
line end or punctuation (this is looked up in the vocabulary; if one did, texts
would not be cut there). So the lattice of a text is a chain of small lattices: each is
searched once while its cache lasts, and the N best of the chain are the N
smallest sums of their gaps, found in the lattices with the smallest gaps.

The vocabulary goes to the executors by broadcast; its size is that of the
file. Models of the BPE kind have merge ranks for scores; the score of such a
piece is minus the logarithm of its rank (Zipf's law).
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Scores are sums of whole multiples of 1 / SCALE, so that equal ones are equal on every path.
SCALE = 1 << 20
#: The gap of a lattice with one segmentation.
NONE = 1 << 62
#: Where the trie has no piece: a score below all others, no id, nothing further.
NOTHING = -2 * NONE, None, None
#: Lattices that each Python worker keeps: so many new ones, and as many of before; longer blocks are not kept. About 0.35 kB each.
CACHE, LONGEST = 100_000, 64
#: Texts that show whether a model's normaliser leaves characters and spaces alone.
PROBES = (" a  b ", "\ufb01\uff21 e\u0301\u00e9", "a\u00a0b\tc")


class Vocabulary:
    """pieces: id -> text; prefixes: every prefix of a piece -> (id, score * SCALE), or () where it is no piece itself."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], unknown: int, byte_ids: list[int] | None):
        self.pieces, self.scores, self.unknown, self.byte_ids = pieces, scores, unknown, byte_ids
        self.bytes_of = {i: b for b, i in enumerate(byte_ids or ())}
        self.special = special
        plain = [(p, i) for i, p in enumerate(pieces) if i not in special and i not in self.bytes_of]
        self.prefixes: dict[str, tuple] = {}
        for p, i in plain:
            for k in range(1, len(p)):
                self.prefixes.setdefault(p[:k], ())
        self.prefixes.update({p: (i, round(scores[i] * SCALE)) for p, i in plain})
        self.suffixes: dict[str, tuple] = {}
        for p, _ in plain:
            for k in range(1, len(p)):
                self.suffixes.setdefault(p[k:], ())
        self.suffixes.update({p: (i, round(scores[i] * SCALE)) for p, i in plain})
        self._trie: dict[str, tuple] | None = None
        # for decode(): the pieces as an Arrow column, ASCII bytes too, and which of them are not simply their text
        text = list(pieces)
        for b, i in enumerate((byte_ids or ())[:128]):
            text[i] = chr(b)
        self.texts = pa.array(text, pa.large_string())
        self.odd = np.zeros(len(pieces), bool)
        self.odd[[*special, unknown, *(byte_ids or ())[128:]]] = True
        self.low = round((min((scores[i] for _, i in plain), default=0.0) - UNKNOWN_PENALTY) * SCALE)
        crossing = any(re.search(rf"[^{MARK}]{MARK}", p) for p, _ in plain)
        lines = any("\n" in p and p != "\n" for p, _ in plain)
        word = rf"{MARK}*[^{MARK}\n]+|{MARK}+" if not lines else rf"{MARK}*[^{MARK}]+|{MARK}+"
        # punctuation that no piece has behind a letter
        ends = "".join(re.escape(c) for c in ".,;:!?#$%&*|" if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for p, _ in plain))
        if ends and not lines:
            word = rf"{MARK}*[^{MARK}\n{ends}]*[^\W\d_{MARK}](?=[{ends}])|" + word
        self.by_words = not crossing
        self.cut = re.compile(r"(?s).+" if crossing else (word if lines else word + r"|\n"))

    @classmethod
    def load(cls, path: str, zipf: bool | None = None) -> Vocabulary:
        """path: a model file, whose normaliser must leave texts as they are but for spaces and one mark in front. zipf: take scores as minus ranks; by default if they are whole numbers, as merge ranks are."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(m.normalize(t) != normalised(t) for t in PROBES):
            raise ValueError(f"{path}: its normaliser changes texts, which encode() does not do")
        n = m.get_piece_size()
        scores = [m.get_score(i) for i in range(n)]
        if zipf is None:
            zipf = all(s == int(s) for s in scores)
        if zipf:
            scores = [-math.log(2 - min(0.0, s)) for s in scores]
        special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        bytes_ = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([m.id_to_piece(i) for i in range(n)], scores, special, m.unk_id(), bytes_ if all(map(m.is_byte, bytes_)) else None)

    def trie(self) -> dict[str, tuple]:
        """character -> (score * SCALE, id, the same for the next character or None); NOTHING's score and id for what is no piece. Made where it is first asked for, not broadcast."""
        if self._trie is None:
            under: dict[str, dict] = {"": {}}
            for p, own in sorted(self.prefixes.items(), reverse=True):  # what goes on comes before what it goes on from
                i, s = own or (None, NOTHING[0])
                under.setdefault(p[:-1], {})[p[-1]] = s, i, under.pop(p, None)
            self._trie = under[""]
        return self._trie

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def decode(self, ids) -> str:
        """Text with its mark in front; bytes that are no UTF-8 become U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append("⁇" if i == self.unknown else "" if i in self.special else self.pieces[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)


def _utf8(run: bytearray) -> str:
    try:
        return bytes(run).decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return bytes(run).decode("utf-8", "replace")


def normalised(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _forward(block: str, v: Vocabulary) -> list[int]:
    """Viterbi: the best score of each part of the block from its front on."""
    size, get, low = len(block), v.prefixes.get, v.low
    best = [(size + 1) * min(0, low) - 1] * (size + 1)
    best[0] = 0
    for i in range(size):
        here, j = best[i], i + 1
        p = get(block[i])
        s = here + (p[1] if p else low)  # no piece of one character: an unknown one
        if s > best[j]:
            best[j] = s
        while p is not None and j < size:
            j += 1
            p = get(block[i:j])
            if p:
                s = here + p[1]
                if s > best[j]:
                    best[j] = s
    return best


def _ending(block: str, at: int, v: Vocabulary) -> list[tuple[int, int, int]]:
    """(start, id, score) of the pieces that end at a place, the longest first; id -1: the unknown character."""
    get, found = v.suffixes.get, []
    p = get(block[at - 1])
    found.append((at - 1, *p) if p else (at - 1, -1, v.low))
    start = at - 1
    while p is not None and start:
        start -= 1
        p = get(block[start:at])
        if p:
            found.append((start, *p))
    found.reverse()
    return found


def nearest(block: str, v: Vocabulary) -> tuple[int, list[int], int]:
    """(score * SCALE, ids, gap to the second best) of the best segmentation.

    One pass from the front keeps, for each place, the best and the second best
    way to come there over best ways to where its last piece starts; of equal
    ones the longest last piece counts. The second best segmentation leaves the
    best one at the place where that costs least, read from the back.
    """
    size, get, low = len(block), v.trie().get, v.low
    best, second, back = [-NONE] * (size + 1), [-NONE] * (size + 1), [None] * (size + 1)
    best[0] = 0
    for i, char in enumerate(block):
        here, j = best[i], i + 1
        s, x, further = get(char) or NOTHING
        s, x = (here + low, -1) if x is None else (here + s, x)  # no piece of one character: an unknown one
        if s > best[j]:
            second[j], best[j], back[j] = best[j], s, (i, x)
        elif s > second[j]:
            second[j] = s
        if further is None:
            continue
        for char in block[j:]:
            edge = further.get(char)
            if edge is None:
                break
            j += 1
            s, x, further = edge
            s += here
            if s > second[j]:
                if s > best[j]:
                    second[j], best[j], back[j] = best[j], s, (i, x)
                else:
                    second[j] = s
            if further is None:
                break
    gap, ids, at = NONE, [], size
    while at:
        if second[at] > -NONE and best[at] - second[at] < gap:
            gap = best[at] - second[at]
        at, x = back[at]
        if x >= 0:
            ids.append(x)
        else:
            ids += reversed(v.unknown_ids(block[at]))
    ids.reverse()
    return best[size], ids, gap


def lattice(block: str, v: Vocabulary, n: int) -> list[tuple[int, list[int]]]:
    """The n best segmentations, best first: (score * SCALE, ids)."""
    best, size, ending = _forward(block, v), len(block), {}
    heap, found, count = [(-best[size], size, 0, 0, None)], [], 0  # of equal ones, the one nearest to the front first
    pop, push = heapq.heappop, heapq.heappush
    while heap and len(found) < n:
        f, at, _, g, tail = pop(heap)
        while at:  # some predecessor is as good as the state itself, so it would be popped next: go on with it
            states = ending.get(at)
            if states is None:
                states = ending[at] = _ending(block, at, v)
            follow = None
            for start, i, s in states:
                h = g + s + best[start]
                if follow is None and h == -f:
                    follow = start, i, s
                else:
                    count += 1
                    push(heap, (-h, start, count, g + s, (start, i, tail)))
            at, i, s = follow
            g, tail = g + s, (at, i, tail)
        ids = []
        while tail is not None:
            start, i, tail = tail
            if i >= 0:
                ids.append(i)
            else:
                ids += v.unknown_ids(block[start])
        found.append((g, ids))
    return found


class Encoder:
    """Caches the best segmentations of blocks; n best of whole texts."""

    def __init__(self, v: Vocabulary, n: int, size: int = CACHE):
        self.v, self.n, self.size, self.cache, self.old, self.more = v, n, size, {}, {}, {}

    def _block(self, block: str):
        """(score, ids as int32 bytes, gap to the second best)."""
        entry = self.old.get(block)
        if entry is None:
            score, ids, gap = nearest(block, self.v)
            entry = score, array("i", ids).tobytes(), gap
        if len(block) <= LONGEST:
            if len(self.cache) >= self.size:
                self.old = dict(self.cache)
                self.cache.clear()  # in place: encode() holds on to it
            self.cache[block] = entry
        return entry

    def _rest(self, block: str):
        """(gap, ids as int32 bytes) of the second best segmentation and the following ones."""
        entry = self.more.get(block)
        if entry is None:
            (top, _), *rest = lattice(block, self.v, self.n)
            entry = [(top - s, array("i", x).tobytes()) for s, x in rest]
            if len(block) <= LONGEST:
                if len(self.more) >= self.size // 8:
                    self.more.clear()
                self.more[block] = entry
        return entry

    def encode(self, text: str | None):
        """The n best as (score, ids as int32 bytes)."""
        make, get = self._block, self.cache.get
        blocks = self.v.cut.findall(normalised(text or ""))
        entries = [get(b) or make(b) for b in blocks]
        if not entries:
            return [(0.0, b"")]
        scores, ids, gaps = zip(*entries)
        score = sum(scores)
        out = [(score / SCALE, b"".join(ids))]
        if self.n > 1:
            k = min(self.n - 1, len(gaps))
            near = np.argpartition(np.array(gaps), k - 1)[:k].tolist() if k < len(gaps) else range(len(gaps))
            near = sorted(near, key=lambda i: (gaps[i], i))
            rest = [self._rest(blocks[i]) if gaps[i] != NONE else [] for i in near]
            for gap, choice in _sums([[0, *(g for g, _ in r)] for r in rest], self.n)[1:]:
                swapped = list(ids)
                for i, r, c in zip(near, rest, choice):
                    if c:
                        swapped[i] = r[c - 1][1]
                out.append(((score - gap) / SCALE, b"".join(swapped)))
        return out


def _sums(lists: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n smallest sums of one number of each (ascending) list, with the indices chosen."""
    first = (0,) * len(lists)
    heap, seen, out = [(sum(x[0] for x in lists), first)], {first}, []
    while heap and len(out) < n:
        total, at = heapq.heappop(heap)
        out.append((total, at))
        for k, i in enumerate(at):
            nxt = (*at[:k], i + 1, *at[k + 1 :])
            if i + 1 < len(lists[k]) and nxt not in seen:
                seen.add(nxt)
                heapq.heappush(heap, (total - lists[k][i] + lists[k][i + 1], nxt))
    return out


_LAST: list = []


def _encoder(v: Vocabulary, n: int, size: int) -> Encoder:
    """The encoder of this Python worker; its cache serves one task after the other."""
    if not _LAST or _LAST[0].v is not v or (_LAST[0].n, _LAST[0].size) != (n, size):
        _LAST[:] = [Encoder(v, n, size)]
    return _LAST[0]


#: Bytes of ids, or about so many of text, after which a batch is given.
BATCH = 1 << 22


def _coded(shared, n: int, cache: int, it):
    """For each few texts of the Arrow batches: (doc_ids, texts, text of each segmentation, ranks, scores, ids as an Arrow list)."""
    encoder = _encoder(shared.value, n, cache)
    for batch in it:
        names, texts, owner, rank, scores, ids, size = [], [], [], [], [], [], 0
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py()
            for k, (score, x) in enumerate(encoder.encode(text)):
                owner.append(len(names))
                rank.append(k)
                scores.append(score)
                ids.append(x)
                size += len(x)
            names.append(batch.column("doc_id")[i].as_py())
            texts.append(text)
            if size > BATCH or i + 1 == batch.num_rows:
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield names, texts, np.array(owner), rank, scores, ids, lists
                names, texts, owner, rank, scores, ids, size = [], [], [], [], [], [], 0


def _on(docs: DataFrame, run, schema: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _positive(n: int) -> None:
    if n < 1:
        raise ValueError("n must be at least 1")


def encode(docs: DataFrame, v: Vocabulary, n: int = 1, cache: int = CACHE) -> DataFrame:
    """doc_id, rank (0: best), score, ids: up to n rows for each row of docs.

    Null and empty texts: one segmentation, without ids, score 0. Of equal
    scores the one found first counts, the same on every run. Null doc_ids and
    repeated rows stay; other columns are ignored. Empty table: empty result.
    """
    _positive(n)
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(it):
        for names, _, owner, rank, scores, _, lists in _coded(shared, n, cache, it):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()).take(pa.array(owner)), pa.array(rank, pa.int32()), pa.array(scores, pa.float64()), lists], names=["doc_id", "rank", "score", "ids"])

    return _on(docs, run, "doc_id long, rank int, score double, ids array<int>")


def decoded(ids: pa.ListArray, v: Vocabulary) -> pa.Array:
    """The texts of lists of ids; null for null."""
    flat = ids.flatten()
    parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]), pa.int32()), pc.take(v.texts, flat))
    text = pc.replace_substring(pc.binary_join(parts, pa.scalar("", pa.large_string())), MARK, " ")
    text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
    odd = v.odd[flat.to_numpy()]
    if odd.any():  # bytes and unknown pieces: one after the other
        ends = parts.offsets.to_numpy()
        sums = np.concatenate([[0], np.cumsum(odd)])
        lists = pa.array((sums[ends[1:]] > sums[ends[:-1]]))
        plain = [v.decode(x).removeprefix(MARK).replace(MARK, " ") for x in ids.filter(lists).to_pylist()]
        text = pc.replace_with_mask(text, lists, pa.array(plain, pa.large_string()))
    return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.large_string()))


def decode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """rows with column ids -> the same rows with text in its place. Null ids: null."""
    shared = rows.sparkSession.sparkContext.broadcast(v)

    @F.arrow_udf("string")
    def one(ids: pa.Array) -> pa.Array:
        return decoded(ids, shared.value).cast(pa.string())

    return rows.select(*[one(F.col("ids").cast("array<int>")).alias("text") if c == "ids" else F.col(f"`{c}`") for c in rows.columns])


def segmentations(docs: DataFrame, v: Vocabulary, n: int, cache: int = CACHE) -> DataFrame:
    """doc_id, rank, score, n_pieces, ids_sha256 (little-endian int32), round_trip (the ids decode to the text): a row for each row of encode().

    Encoded, decoded and compared in one pass, so that neither ids nor texts go
    back to the JVM; cases as encode() has them (a null text is an empty one).
    """
    _positive(n)
    shared = docs.sparkSession.sparkContext.broadcast(v)
    schema = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(it):
        for names, texts, owner, rank, scores, ids, lists in _coded(shared, n, cache, it):
            at = pa.array(owner)
            same = pc.equal(decoded(lists, shared.value), pa.array([t or "" for t in texts], pa.large_string()).take(at))
            digests = [hashlib.sha256(x).hexdigest() for x in ids]
            columns = [pa.array(names, pa.int64()).take(at), rank, [round(s, 6) + 0.0 for s in scores], [len(x) // 4 for x in ids], digests, same]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return _on(docs, run, "doc_id long, rank int, score double, n_pieces long, ids_sha256 string, round_trip boolean")
