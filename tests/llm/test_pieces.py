import hashlib
import math
import random
import struct

import pyarrow as pa
import pytest
import sentencepiece

from pagewright.llm import pieces as P
from pagewright.llm import queries

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load(MODEL)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram(v, normalizer=b"\x0a\x08identity" + b"\x18\x01" + b"\x20\x00" + b"\x28\x01"):
    """The library's own unigram model with the same pieces and scores."""
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    kind = lambda i: 2 if m.is_unknown(i) else 3 if m.is_control(i) else 6 if m.is_byte(i) else 1
    out = b""
    for i, p in enumerate(v.pieces):
        body = b"\x0a" + varint(len(p.encode())) + p.encode() + b"\x15" + struct.pack("<f", v.scores[i]) + b"\x18" + varint(kind(i))
        out += b"\x0a" + varint(len(body)) + body
    # model type unigram, byte fallback
    trainer = b"\x18" + varint(1) + varint(35 << 3) + b"\x01"
    out += b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(normalizer)) + normalizer
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def every(block, v):
    """All segmentations, by brute force."""
    if not block:
        return [(0, [])]
    out = []
    for j in range(1, len(block) + 1):
        p = v.prefixes.get(block[:j])
        if p:
            out += [(p[1] + s, [p[0], *ids]) for s, ids in every(block[j:], v)]
        elif j == 1:
            out += [(v.low + s, v.unknown_ids(block[0]) + ids) for s, ids in every(block[1:], v)]
    return out


def score(ids, v):
    return sum(v.scores[i] for i in ids)


@pytest.mark.parametrize("block", ["▁theheat", "▁réeuxment", "\n", "▁▁▁", "▁a😀b", "▁ñllcocij", "xyzzy"])
def test_lattice_against_all_segmentations(vocabulary, block):
    want = sorted((-s for s, _ in every(block, vocabulary)))
    got = P.lattice(block, vocabulary, 12)
    assert [-s for s, _ in got] == want[:12]
    assert len({tuple(ids) for _, ids in got}) == len(got)
    assert all(vocabulary.decode(ids) == block for _, ids in got)


def test_chain_is_the_lattice_of_the_whole_text(vocabulary):
    rng = random.Random(3)
    for text in ["the heat of it", "a\nb  c", "Éan Éan", "word. word.\nNext, word", "▁ a", "a\n b", "".join(rng.choice("ab é\n") for _ in range(14)), " lead and trail "]:
        whole = P.lattice(P.normalised(text), vocabulary, 9)
        got = P.Encoder(vocabulary, 9).encode(text)
        assert [s * P.SCALE for s, _ in got] == [s for s, _ in whole] and len({ids for _, ids in got}) == len(got)
        score, ids, gap = P.nearest(P.normalised(text), vocabulary)
        assert (score, score - gap) == (whole[0][0], whole[1][0]) and ids == whole[0][1]


def test_against_the_library(vocabulary):
    library = unigram(vocabulary)
    for text in ["Hello world, this is a test.", "The heat of the night", "réeuxment de la", "a b  c", "x"]:
        want = library.nbest_encode_as_ids(text, 5)
        got = P.Encoder(vocabulary, 5).encode(text)
        assert [round(score(i, vocabulary), 3) for i in want] == [round(s, 3) for s, _ in got]
        assert want[0] == list(struct.unpack(f"<{len(got[0][1]) // 4}i", got[0][1]))


def test_frames(spark, vocabulary):
    rows = [(1, "the heat of it"), (2, None), (3, ""), (None, "a\nb"), (1, "the heat of it"), (4, "word " * 60000), (5, "x" * 5000), (6, "😀  \t é")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, rank int")
    coded = P.encode(df, vocabulary, 3)
    back = P.decode(coded, vocabulary)
    assert back.columns == ["doc_id", "rank", "score", "text"]
    texts = {}
    for r in back.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    assert texts == {1: {"the heat of it"}, 2: {""}, 3: {""}, None: {"a\nb"}, 4: {rows[5][1]}, 5: {"x" * 5000}, 6: {rows[7][1]}}
    out = P.segmentations(df, vocabulary, 3).collect()
    assert all(r.round_trip for r in out) and sorted(str((r.doc_id, r.rank)) for r in out) == sorted(str((r.doc_id, r.rank)) for r in coded.collect())
    assert [(r.rank, r.n_pieces, r.score) for r in out if r.doc_id in (2, 3)] == [(0, 0, 0.0)] * 2
    assert P.segmentations(df.limit(0), vocabulary, 2).collect() == [] and P.encode(df.limit(0), vocabulary).collect() == []


def test_one_unbroken_text(vocabulary):
    text = "réeuxment" * 30_000
    encoder = P.Encoder(vocabulary, 3)
    best = encoder.encode(text)
    assert len(best) == 3 and not encoder.cache and not encoder.more
    assert all(vocabulary.decode(struct.unpack(f"<{len(x) // 4}i", x)) == P.MARK + text for _, x in best)


def test_decoded_as_decode(vocabulary):
    rng = random.Random(2)
    lists = [[rng.randrange(len(vocabulary.pieces)) for _ in range(rng.randrange(9))] for _ in range(300)] + [[], None, [5], vocabulary.unknown_ids("😀"), vocabulary.unknown_ids("😀")[:2]]
    want = [None if x is None else vocabulary.decode(x).removeprefix(P.MARK).replace(P.MARK, " ") for x in lists]
    assert P.decoded(pa.array(lists, pa.list_(pa.int32())), vocabulary).to_pylist() == want


def test_other_normalisers_are_refused(vocabulary, tmp_path):
    m = tmp_path / "nfkc.model"
    m.write_bytes(unigram(vocabulary, b"\x0a\x04nfkc" + b"\x18\x01" + b"\x20\x01" + b"\x28\x01").serialized_model_proto())
    with pytest.raises(ValueError):
        P.Vocabulary.load(str(m))


def test_scores_are_zipf(vocabulary):
    assert vocabulary.scores[1000] == -math.log(2 + 741)


def test_query_returns_every_rank(spark, vocabulary, tmp_path):
    texts = {1: "the heat of it", 2: None, 3: "", 4: "word. word.\nNext, word", 5: " a  b", 6: "x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.queries()["op1_sentencepiece"](spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in out)
    for i, text in texts.items():
        rows = sorted((r.rank, r.score) for r in out if r.doc_id == i)
        whole = P.lattice(P.normalised(text), vocabulary, queries.N_BEST) if text else [(0, [])]
        assert rows == [(k, pytest.approx(s / P.SCALE, abs=1e-6)) for k, (s, _) in enumerate(whole)]
        best = next(r for r in out if r.doc_id == i and r.rank == 0)
        assert best.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(whole[0][1])}i", *whole[0][1])).hexdigest() and best.n_pieces == len(whole[0][1])
        assert len({r.ids_sha256 for r in out if r.doc_id == i}) == len(rows)


def test_best_and_gap_come_from_one_pass_from_the_front():
    v = P.Vocabulary(["<unk>", "a", "aa", "ab", "b", "ba", "bab", "cab"], [0.0, -1.0, -2.0, -1.5, -1.0, -2.5, -2.0, -1.0], {0}, 0, None)
    v.suffixes = None  # nothing is looked up from the back
    rng = random.Random(11)
    for block in ["a", "c", "cab", "aaaa", *("".join(rng.choice("aabbc") for _ in range(rng.randrange(1, 10))) for _ in range(200))]:
        scores = sorted((s for s, _ in every(block, v)), reverse=True)
        total, ids, gap = P.nearest(block, v)
        assert (total, gap) == (scores[0], scores[0] - scores[1] if len(scores) > 1 else P.NONE), block
        assert (total, ids) in every(block, v)
