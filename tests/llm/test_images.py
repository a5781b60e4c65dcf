import struct
import zlib

import numpy as np
import pytest

from pagewright.llm import images as I


def test_png_round_trip_and_foreign_filters():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (13, 17)).astype(np.uint8)
    assert (I.pixels(I.png(a)) == a).all()
    rgb = rng.integers(0, 256, (5, 4, 3)).astype(np.int64)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    for kind in range(5):
        raw, before = b"", np.zeros(12, np.int64)
        for row in rgb.reshape(5, 12):
            out = []
            for x in range(12):
                p, u, q = (row[x - 3] if x > 2 else 0), before[x], (before[x - 3] if x > 2 else 0)
                e = p + u - q
                paeth = min(((abs(e - p), 0, p), (abs(e - u), 1, u), (abs(e - q), 2, q)))[2]
                out.append((row[x] - (0, p, u, (p + u) // 2, paeth)[kind]) & 255)
            raw, before = raw + bytes([kind]) + bytes(int(x) for x in out), row
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        assert np.allclose(I.pixels(data), rgb @ np.array([0.299, 0.587, 0.114]), atol=0.01)
    assert (I.pixels(b"P5\n17 13\n255\n" + a.tobytes()) == a).all()
    for bad in (None, b"", b"x", b"\x89PNG\r\n\x1a\n", I.png(a)[:40], b"P5 3 3 255 a"):
        assert I.pixels(bad) is None


def embeddings(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=64).tolist()) for i in range(n)]


def plain(rows, distance, agree):
    """Every pair of corners of every pair of images; the same cells."""
    out = {}
    place = lambda d: (round(d[0] * 8) / 8, round(d[1] * 8) / 8, d[2], np.floor(np.mod(d[3], 2 * np.pi) * 65536 / (2 * np.pi)) * 2 * np.pi / 65536)
    described = {i: [(*place(d), d[4]) for d in I.described(I.pixels(b))] for i, b in rows}
    for q in (i for i in described if i % 20 == 0):
        for i in described:
            cells = {}
            for a in described[q] if i != q else ():
                for b in described[i]:
                    if bin(a[4] ^ b[4]).count("1") > distance:
                        continue
                    t = np.mod(b[3] - a[3], 2 * np.pi)
                    z = a[2] / b[2]
                    dx, dy = b[0] - z * (np.cos(t) * a[0] - np.sin(t) * a[1]), b[1] - z * (np.sin(t) * a[0] + np.cos(t) * a[1])
                    for k, (u, v) in enumerate(((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5))):
                        key = (int(np.floor(t / (np.pi / 6) + 0.5)) % 12, float(np.round(np.log2(z) * 2)), k, int(np.floor(dx / 12 + u)), int(np.floor(dy / 12 + v)))
                        cells.setdefault(key, set()).add(((round(a[0] * 8) << 20 | round(a[1] * 8)) << 20) >> 22)
            n = max(map(len, cells.values()), default=0)
            if n >= agree:
                out[q, i] = n
    return out


@pytest.mark.parametrize("distance", [1, 2])
def test_against_all_pairs_and_planted_copies(spark, distance):
    df = spark.createDataFrame(embeddings(120), "vec_id long, embedding array<double>")
    drawn = I.drawn(df).cache()
    rows = [(r.image_id, bytes(r.image)) for r in drawn.collect()]
    got = {(r.class_id, r.match_id): r.agreeing for r in I.copies(drawn, distance=distance).collect() if r.match_id is not None}
    want = plain(rows, distance, I.AGREE)
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.9 * len(want)
    planted = {(i, i + k) for i in range(0, 120, 20) for k in (1, 2, 3)}
    assert len(planted & set(got)) >= 0.9 * len(planted)
    assert len(set(got) - planted) <= 2
    found = I.descriptors(drawn).cache()
    asked = found.filter("image_id % 20 = 0")
    crowded = {(r.query_id, r.image_id): r.agreeing for r in I.matches(asked, found, distance, crowd=6).collect()}
    assert set(crowded.items()) <= set(want.items()) and len(crowded) >= 0.9 * len(want)


def test_every_case(spark):
    blank = I.png(np.full((64, 64), 9, np.uint8))
    picture = I.png(I.drawing(np.arange(64.0)))
    rows = [(0, picture), (20, picture), (7, picture), (None, picture), (0, picture), (40, None), (41, None), (60, b""), (80, b"no image"), (100, blank), (120, I.png(np.zeros((1, 1), np.uint8))), (8, I.png(I.drawing(np.arange(64.0), 2)))]
    df = spark.createDataFrame([(i, b, "x", 3) for i, b in rows], "image_id long, image binary, hash string, class_id int")
    out = I.copies(df).collect()
    members = [r for r in out if r.match_id is None]
    assert len(members) == len(rows) and {r.class_id for r in members if r.image_id in (0, 20, 7, None)} == {0}
    assert [r.class_id for r in members if r.image_id in (40, 41)] == [40, 40]
    assert {(r.class_id, r.match_id) for r in out if r.match_id is not None} == {(0, 8)}
    assert I.copies(df.limit(0)).collect() == []


def edited(base, seed):
    """Another edit of a picture: light, noise, and for some a cut edge or a quarter turn."""
    rng = np.random.default_rng(seed)
    img = np.clip(base.astype(float) * rng.uniform(0.85, 1.1) + rng.uniform(-10, 10) + rng.normal(0, 1.0, base.shape), 0, 255)
    if seed % 3 == 1:
        img = img[int(rng.integers(0, 6)) :, int(rng.integers(0, 6)) :]
    return np.ascontiguousarray((np.rot90(img) if seed % 7 == 2 else img).astype(np.uint8))


@pytest.mark.parametrize("size", [33, 80, 300])
def test_many_edits_of_one_picture(spark, size):
    base = I.drawing(np.arange(64.0))
    rows = [(i, bytearray(I.png(edited(base, i)))) for i in range(size)] + [(1000 + i, bytearray(I.png(I.drawing(v)))) for i, v in embeddings(40, 5)]
    found = I.descriptors(spark.createDataFrame(rows, "image_id long, image binary")).cache()
    asked = found.filter("image_id % 20 = 0")
    got = {(r.query_id, r.image_id) for r in I.matches(asked, found).collect()}
    every = {(r.query_id, r.image_id) for r in I.matches(asked, found, crowd=1 << 40).collect()}
    planted = {(q, i) for q in range(0, size, 20) for i in range(size) if i != q}
    assert got <= every and len(got) >= 0.9 * len(every)
    assert len(planted & got) >= 0.9 * len(planted) and len(got - planted) <= 2


@pytest.mark.parametrize("crowd", [1, I.CROWD])
def test_corners_that_are_alike_in_all_pictures_lose_no_link(spark, monkeypatch, crowd):
    """Pictures of the same few tiles in other places: no corner tells one from another."""
    rng = np.random.default_rng(3)
    tiles = [I.drawing(v)[20:44, 20:44] for _, v in embeddings(9, 7)]
    rows = []
    for i in range(60):
        order = rng.permutation(9)
        rows.append((i, I.png(np.concatenate([np.concatenate([tiles[k] for k in order[3 * r : 3 * r + 3]], axis=1) for r in range(3)]))))
    want = plain(rows, I.DISTANCE, I.AGREE)
    assert len(want) > 20
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "image_id long, image binary")
    found = I.descriptors(df).cache()
    monkeypatch.setattr(I, "CHUNK", 500)  # images that go on from batch to batch
    monkeypatch.setattr(I, "BLOCK", 60)  # several blocks of queries
    got = I.matches(found.filter("image_id % 20 = 0"), found, crowd=crowd).collect()
    assert {(r.query_id, r.image_id): r.agreeing for r in got} == want and len(got) == len(want)


def test_common_corners_without_common_neighbours(spark):
    """Two images agree in four corners that 40 others have too; what stands beside them differs."""
    rng = np.random.default_rng(11)
    bits = [int(b) for b in rng.integers(-(1 << 63), (1 << 63) - 1, 28)]
    corners = [(20.0, 20.0), (20.0, 220.0), (220.0, 20.0), (220.0, 220.0)]
    rows = []
    for i in (0, 1):
        for k, (x, y) in enumerate(corners):
            rows.append((i, x, y, 1.0, 0.5, bits[k]))
            rows += [(i, x + 2 + 2 * j, y + 3 * j, 1.0, 0.5, bits[4 + 12 * i + 3 * k + j]) for j in range(3)]
    for i in range(101, 141):
        rows += [(i, float(x), float(y), 1.0, 0.5, b) for (x, y), b in zip(rng.integers(10, 1000, (28, 2)), bits)]
    found = spark.createDataFrame(rows, "image_id long, x double, y double, scale double, angle double, bits long")
    got = {(r.query_id, r.image_id): r.agreeing for r in I.matches(found.filter("image_id = 0"), found).collect()}
    assert got == {(0, 1): 4}


def test_strong_crops_of_larger_pictures(spark):
    """A ninth and a quarter of pictures of 432 pixels square."""
    rows, planted = [], set()
    for k in range(6):
        tiles = [I.drawing(v) for _, v in embeddings(36, 50 + k)]
        big = np.concatenate([np.concatenate(tiles[6 * r : 6 * r + 6], axis=1) for r in range(6)])
        rows += [(20 * k, big), (20 * k + 1, big[150:294, 130:274]), (20 * k + 2, big[100:316, 200:416])]
        planted |= {(20 * k, 20 * k + 1), (20 * k, 20 * k + 2)}
    df = spark.createDataFrame([(i, bytearray(I.png(np.ascontiguousarray(p)))) for i, p in rows], "image_id long, image binary")
    got = {(r.class_id, r.match_id) for r in I.copies(df).collect() if r.match_id is not None}
    assert got == planted
