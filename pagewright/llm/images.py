"""Local image descriptors find cropped and edited copies (operator 6).

Corners of each image are found at several scales, turned to the direction of
their patch's centre of brightness, and described by 64 binary tests between
points of the patch. Descriptors meet in Hamming tables: the bits are parted in
d + 3 bands, and of descriptors with at most d differing bits three bands at
least are equal; each three are a key. Pairs of corners that pass the full
Hamming check vote for a similarity transform; images match where enough
different corners agree on one (geometric consensus).

Many corners look alike in very many pictures, so pairs of corners grow with the
square of the pictures and are not written out as rows. The tables of a block of
queries go to all tasks, which look up the corners of the index, count the pairs
of corners of two images for each turn and zoom, and give those that can still
agree; only these vote. Nothing is capped: the result is that of all pairs of
corners (tests hold it against them).

Images with equal bytes are one class; the search runs between classes, so that
thousands of equal pictures are one in every table.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written

#: Parameters: scales of the pyramid, corners kept a scale in a picture of AREA pixels (with the root of the area in larger ones), patch radius, tests.
SCALES, CORNERS, AREA, RADIUS, TESTS = (1.0, 0.7071, 0.5), 25, 72 * 72, 7, 64
#: Differing bits allowed, corners that must agree, and pairs of corners that a task holds at once (about 100 bytes each).
DISTANCE, AGREE, CROWD = 1, 4, 1 << 20
#: Corners in a block of queries (a broadcast of 24 bytes each), and corners of the index that meet it at once.
BLOCK, CHUNK = 1 << 18, 1 << 17


def _tests() -> np.ndarray:
    """TESTS pairs of points of a disc, the same in every process."""
    rng = np.random.default_rng(7)
    points = rng.normal(0, RADIUS / 2.5, (TESTS * 4, 2, 2))
    inside = (np.hypot(points[..., 0], points[..., 1]) < RADIUS - 0.5).all(axis=1)
    return points[inside][:TESTS]


_PAIRS = _tests()


def png(pixels: np.ndarray) -> bytes:
    """Grey 8-bit PNG."""
    h, w = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def _undone(kind: int, line: list[int], above: list[int], bands: int) -> list[int]:
    """A PNG line without the filters that look to the left: average (3) or Paeth (4)."""
    left, corner = [0] * bands + line, [0] * bands + above
    for x, b in enumerate(above):
        a, c = left[x], corner[x]
        if kind == 3:
            p = (a + b) // 2
        else:
            q = a + b - c
            near, up, across = abs(q - a), abs(q - b), abs(q - c)
            p = a if near <= up and near <= across else b if up <= across else c
        left[x + bands] = (line[x] + p) & 255
    return left[bands:]


def pixels(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of a PNG (8 bits, grey, grey with alpha, RGB, RGBA; not interlaced) or PGM (P5); None for anything else."""
    try:
        if data and data[:2] == b"P5":
            m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", data)
            return np.frombuffer(data[m.end() :], np.uint8).reshape(int(m[2]), int(m[1])).astype(np.float32) if m else None
        if not data or data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, idat = 8, b""
        w = h = depth = colour = interlace = 0
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                idat += body
            at += 12 + n
        bands = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
        if depth != 8 or interlace or not bands or w * h > 1 << 26:
            return None
        raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * bands)
        out = np.zeros((h, w * bands), np.uint8)
        before = np.zeros(w * bands, np.int64)
        for y in range(h):
            line = raw[y, 1:].astype(np.int64)
            kind = raw[y, 0]
            if kind == 2:
                line = line + before
            elif kind == 1:
                line = np.cumsum(line.reshape(-1, bands), axis=0).ravel()
            elif kind in (3, 4):
                line = np.array(_undone(kind, line.tolist(), before.tolist(), bands))
            before = line & 255
            out[y] = before
        img = out.reshape(h, w, bands).astype(np.float32)
        return img[..., 0] if bands < 3 else img[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)
    except (ValueError, struct.error, zlib.error, IndexError):
        return None


def _box(a: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(a, r, mode="edge")
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)) / (2 * r + 1) ** 2


def _resized(img: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return img
    h, w = max(1, int(img.shape[0] * scale)), max(1, int(img.shape[1] * scale))
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    return _sampled(_box(img, 1), *np.meshgrid(y, x, indexing="ij"))


def _sampled(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear."""
    y, x = np.clip(y, 0, img.shape[0] - 1.001), np.clip(x, 0, img.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    i2, j2 = np.minimum(i + 1, img.shape[0] - 1), np.minimum(j + 1, img.shape[1] - 1)
    fy, fx = y - i, x - j
    return (img[i, j] * (1 - fx) + img[i, j2] * fx) * (1 - fy) + (img[i2, j] * (1 - fx) + img[i2, j2] * fx) * fy


def described(img: np.ndarray) -> list[tuple[float, float, float, float, int]]:
    """(x, y, scale, angle, 64 bits) of an image's corners, in its own coordinates."""
    out = []
    r = RADIUS
    yy, xx = np.mgrid[-r : r + 1, -r : r + 1]
    disc = (xx**2 + yy**2 <= r * r).astype(np.float32)
    for scale in SCALES:
        a = _resized(img, scale)
        if min(a.shape) < 2 * r + 5:
            continue
        smooth = _box(a, 1)
        gy, gx = np.gradient(smooth)
        xx2, yy2, xy2 = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        score = xx2 * yy2 - xy2 * xy2 - 0.05 * (xx2 + yy2) ** 2
        p = np.pad(score, 1, constant_values=-np.inf)
        peak = score >= np.max([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0)
        peak &= score > max(1.0, 0.005 * float(score.max()))
        peak[: r + 1], peak[-r - 1 :], peak[:, : r + 1], peak[:, -r - 1 :] = False, False, False, False
        y, x = np.nonzero(peak)
        if not len(y):
            continue
        best = np.argsort(-score[y, x], kind="stable")[: round(CORNERS * max(1.0, (img.size / AREA) ** 0.5))]
        y, x = y[best], x[best]
        patch = smooth[y[:, None, None] + yy, x[:, None, None] + xx] * disc
        angle = np.arctan2((patch * yy).sum((1, 2)), (patch * xx).sum((1, 2)))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px, py = _PAIRS[None, ..., 0], _PAIRS[None, ..., 1]
        v = _sampled(smooth, y[:, None, None] + s * px + c * py, x[:, None, None] + c * px - s * py)
        bits = np.packbits(v[..., 0] < v[..., 1], axis=1).view(">u8").ravel()
        out += [(float(i / scale), float(j / scale), scale, float(t), int(b)) for i, j, t, b in zip(x, y, angle, bits)]
    return out


def descriptors(images: DataFrame) -> DataFrame:
    """image_id, x, y, scale, angle, bits: a row for each corner of images (image_id, image). Null or unreadable images have none."""
    schema = pa.schema([("image_id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("scale", pa.float64()), ("angle", pa.float64()), ("bits", pa.int64())])

    def run(it):
        for batch in it:
            rows = []
            for i, data in zip(batch.column("image_id").to_pylist(), batch.column("image").to_pylist()):
                img = pixels(data)
                if img is not None and img.size:
                    rows += [(i, x, y, s, t, b - (1 << 64) if b >> 63 else b) for x, y, s, t, b in described(img)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return images.select(F.col("image_id").cast("long").alias("image_id"), F.col("image").cast("binary").alias("image")).mapInArrow(run, "image_id long, x double, y double, scale double, angle double, bits long")


def _masks(bits: list[int], n: int) -> list[int]:
    """n masks that part the given bit positions evenly."""
    return [sum(1 << b for b in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def _place():
    """x, y, scale and angle in one number."""
    return (F.round(F.col("x") * 8).cast("long") * (1 << 20) + F.round(F.col("y") * 8).cast("long")) * (1 << 20) + F.array_position(F.array(*[F.lit(s) for s in SCALES]), F.col("scale")) * (1 << 16) + F.floor(F.pmod(F.col("angle"), F.lit(2 * np.pi)) * (65536 / (2 * np.pi)))


def _placed(p) -> dict:
    """x, y, scale, angle of a place."""
    scale = F.element_at(F.array(*[F.lit(s) for s in SCALES]), F.shiftright(p, 16).bitwiseAND(15).cast("int"))
    return {"x": F.shiftright(p, 40) / 8.0, "y": F.shiftright(p, 20).bitwiseAND((1 << 20) - 1) / 8.0, "scale": scale, "angle": p.bitwiseAND(65535) * (2 * np.pi / 65536)}


def _agreeing(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, at, image_id, place) -> query_id, image_id, agreeing: the most corners of the query that agree on one transform."""
    # each pair of corners says how the query must be turned, scaled and moved; four overlapping grids of coarse cells
    a, b = _placed(F.col("at")), _placed(F.col("place"))
    turn, zoom = F.pmod(b["angle"] - a["angle"], F.lit(2 * np.pi)), a["scale"] / b["scale"]
    c, s = F.cos(turn), F.sin(turn)
    dx, dy = b["x"] - zoom * (c * a["x"] - s * a["y"]), b["y"] - zoom * (s * a["x"] + c * a["y"])
    grids = F.array(*[F.struct(F.lit(k).alias("grid"), F.floor(dx / 12 + u).alias("u"), F.floor(dy / 12 + v).alias("v")) for k, (u, v) in enumerate(((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)))])
    # corners at one place at several scales are one witness
    voted = pairs.select("query_id", "image_id", F.shiftright("at", 22).alias("corner"), F.pmod(F.floor(turn / (np.pi / 6) + 0.5), F.lit(12)).alias("t"), F.round(F.log2(zoom) * 2).alias("z"), F.explode(grids).alias("p"))
    cells = voted.distinct().groupBy("query_id", "image_id", "t", "z", "p").agg(F.count("*").alias("n"))
    return cells.groupBy("query_id", "image_id").agg(F.max("n").alias("agreeing"))


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start[row] + 0, 1, ... n[row] - 1) of every row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) + np.repeat(start - np.cumsum(n) + n, n)


def _parts(sizes: np.ndarray, most: int):
    """(from, to) of consecutive rows whose sizes add up to ``most`` at most, or of one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), "right")))
        yield a, b
        a = b


class _Tables:
    """Hamming tables of the corners of a block of queries."""

    def __init__(self, image: np.ndarray, place: np.ndarray, bits: np.ndarray, distance: int):
        order = np.argsort(image, kind="stable")
        self.ids, self.image = np.unique(image[order], return_inverse=True)
        self.place, self.distance = place[order], distance
        self.values, where, self.n = np.unique(bits[order].view(np.uint64), return_inverse=True, return_counts=True)
        self.corners = np.argsort(where, kind="stable")  # of each value, one after the other
        self.first = np.cumsum(self.n) - self.n
        bands = _masks(list(range(64)), distance + 3)
        self.masks = [np.uint64(a | b | c) for a, b, c in combinations(bands, 3)]
        self.tables = []
        for m in self.masks:
            own = np.argsort(self.values & m)
            self.tables.append((own, (self.values & m)[own]))

    def close(self, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in self.values, place in values) of all that differ in ``distance`` bits at most."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for k, (m, (own, keys)) in enumerate(zip(self.masks, self.tables)):
            lo = np.searchsorted(keys, values & m)
            n = np.searchsorted(keys, values & m, "right") - lo
            for a, b in _parts(n, most):
                v, u = _ranges(lo[a:b], n[a:b])
                u, v = own[u], v + a
                x = self.values[u] ^ values[v]
                good = np.bitwise_count(x) <= self.distance
                for before in self.masks[:k]:  # found by that key already
                    good &= (x & before) != 0
                out.append((u[good], v[good]))
        u, v = zip(*out)
        return np.concatenate(u), np.concatenate(v)

    def voters(self, image: np.ndarray, place: np.ndarray, bits: np.ndarray, agree: int, most: int):
        """(query_id, at, image_id, place) of all close corners of two images of which ``agree`` or more have one turn and zoom."""
        ids, image = np.unique(image, return_inverse=True)
        values, where, count = np.unique(bits.view(np.uint64), return_inverse=True, return_counts=True)
        corners, first = np.argsort(where, kind="stable"), np.cumsum(count) - count
        u, v = self.close(values, most)
        row, q = _ranges(self.first[u], self.n[u])
        q, v = self.corners[q], v[row]
        order = np.argsort(q)  # corners stand by their images
        q, v = q[order], v[order]
        asked, size = np.unique(self.image[q], return_counts=True)
        start, rank = np.cumsum(size) - size, np.repeat(np.arange(len(asked)), size)
        if not len(asked):
            return
        # so many images of queries at once that pairs of corners and of images are bounded
        load = np.maximum(np.add.reduceat(count[v], start), len(ids))
        for a, b in _parts(load, most):
            part = slice(start[a], start[b - 1] + size[b - 1])
            row, c = _ranges(first[v[part]], count[v[part]])
            c, p = corners[c], q[part][row]
            pair = (rank[part] - a)[row] * len(ids) + image[c]
            enough = np.bincount(pair)[pair] >= agree
            c, p, pair = c[enough], p[enough], pair[enough]
            cell = (pair * 12 + _turn(self.place[p], place[c])) * (2 * len(SCALES) ** 2) + _zoom(self.place[p], place[c])
            _, at, n = np.unique(cell, return_inverse=True, return_counts=True)
            enough = (n[at] >= agree) & (self.ids[self.image[p]] != ids[image[c]])
            c, p = c[enough], p[enough]
            yield self.ids[self.image[p]], self.place[p], ids[image[c]], place[c]


def _turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The turn between two places as _agreeing() rounds it, by the same steps."""
    whole = 2 * np.pi
    turn = np.fmod((b & 65535) * (whole / 65536) - (a & 65535) * (whole / 65536), whole)
    turn = np.where(turn < 0, np.fmod(turn + whole, whole), turn)
    return np.mod(np.floor(turn / (np.pi / 6) + 0.5).astype(np.int64), 12)


def _zoom(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for the zoom between two places as _agreeing() rounds it."""
    scales = np.array(SCALES)
    steps = np.round(np.log2(scales[:, None] / scales[None, :]) * 2).astype(np.int64)
    return (steps - steps.min())[((a >> 16) & 15) - 1, ((b >> 16) & 15) - 1]


def _columns(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _voters(block: DataFrame, index: DataFrame, distance: int, agree: int, crowd: int) -> DataFrame:
    """query_id, at, image_id, place: the pairs of corners of block (bounded) and index (image_id, place, bits; each image in one partition, by image_id) that may agree."""
    own = block.toArrow()
    tables = index.sparkSession.sparkContext.broadcast([c.to_numpy() for c in own.columns])
    names = ["query_id", "at", "image_id", "place"]

    def run(it):
        held, size, built = [], 0, _Tables(*tables.value, distance)

        def given(rows):
            for found in built.voters(*rows, agree, crowd):
                for i in range(0, len(found[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in found], names=names)

        for batch in it:
            held.append(_columns(batch, "image_id", "place", "bits"))
            size += batch.num_rows
            if size >= CHUNK:
                rows = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last image may go on
                yield from given([x[:cut] for x in rows])
                held, size = [[x[cut:] for x in rows]], size - cut
        if size:
            yield from given([np.concatenate(x) for x in zip(*held)])

    return index.mapInArrow(run, "query_id long, at long, image_id long, place long")


def matches(queries: DataFrame, index: DataFrame, distance: int = DISTANCE, agree: int = AGREE, crowd: int = CROWD) -> DataFrame:
    """query_id, image_id, agreeing: all pairs of different images of which ``agree`` corners or more agree on one transform. Both: as descriptors(). crowd: pairs of corners that a task holds at once, whatever the result."""
    rows = lambda d: d.filter("image_id is not null").select("image_id", _place().alias("place"), "bits")
    asked = written(rows(queries).distinct(), "asked")
    blocks, parts = max(1, -(-asked.count() // BLOCK)), max(index.sparkSession.sparkContext.defaultParallelism, -(-index.count() // CHUNK))
    every = rows(index).repartition(parts, "image_id").distinct().sortWithinPartitions("image_id")
    found = []
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("image_id"), F.lit(blocks)) == k)
        found.append(_agreeing(written(_voters(block, every, distance, agree, crowd), "voters")).filter(F.col("agreeing") >= agree))
    return reduce(DataFrame.unionByName, found)


def copies(images: DataFrame, every: int = 20, distance: int = DISTANCE, agree: int = AGREE) -> DataFrame:
    """image_id, class_id, match_id, agreeing: membership (match_id null) of every row, and links of classes.

    images: image_id, image (binary). Rows of equal bytes are a class, named by
    its smallest id (null where it has no other). Classes that hold an id
    divisible by ``every`` are looked up among all classes; a link row carries
    the class as image_id and class_id. Null, empty and unreadable images, and
    images without corners, are members and have no links. Repeated rows are
    repeated in the membership. Other columns are ignored. Empty table: empty
    result.
    """
    data = F.col("image").cast("binary")
    rows = images.select(F.col("image_id").cast("long").alias("image_id"), data.alias("image"), F.sha2(F.coalesce(data, F.lit(b"")), 256).alias("hash"), data.isNull().alias("none"))
    hashed = written(rows.drop("image"), "hashes")  # images may be costly to read: they are read here and for their corners
    classes = hashed.groupBy("hash", "none").agg(F.min("image_id").alias("class_id"), F.max(F.coalesce(F.pmod("image_id", F.lit(every)) == 0, F.lit(False))).alias("asked"))
    named = written(salted_join(hashed, classes, ["hash", "none"], "image_id").select("image_id", "class_id", "asked"), "classes")
    kept = rows.join(classes.select(F.col("class_id").alias("image_id"), "hash"), ["image_id", "hash"], "left_semi").filter("not none")
    found = written(descriptors(kept), "descriptors")
    asked = named.filter("asked").select(F.col("class_id").alias("image_id")).distinct()
    links = matches(found.join(asked, "image_id", "left_semi"), found, distance, agree)
    members = named.select("image_id", "class_id", F.lit(None).cast("long").alias("match_id"), F.lit(None).cast("long").alias("agreeing"))
    return members.unionByName(links.select(F.col("query_id").alias("image_id"), F.col("query_id").alias("class_id"), F.col("image_id").alias("match_id"), "agreeing"))


SIZE = 72


def drawing(vector, kind: int = 0) -> np.ndarray:
    """A picture of SIZE pixels square, of blocks and discs, light and grain drawn by a vector; kind 1: cropped, 2: brighter, with noise, 3: turned by a quarter."""
    v = np.nan_to_num(np.asarray(vector, np.float64))
    seed = zlib.crc32(np.round(v, 4).astype(np.float32).tobytes())
    rng = np.random.default_rng(seed)
    img = np.full((SIZE, SIZE), 120.0)
    y, x = np.mgrid[0:SIZE, 0:SIZE]
    for k in range(26):
        cx, cy, r = rng.uniform(0, SIZE, 2).tolist() + [rng.uniform(3, 11)]
        level = rng.uniform(10, 245)
        inside = (np.abs(x - cx) < r) & (np.abs(y - cy) < r * rng.uniform(0.4, 1.2)) if k % 3 else np.hypot(x - cx, y - cy) < r
        img[inside] = level
    for cells, height in ((9, 16.0), (24, 12.0)):  # uneven light and grain, as pictures have; plain areas would make corners alike
        at = np.linspace(0, cells - 1, SIZE)
        img = img + height * _sampled(rng.normal(0, 1, (cells, cells)), *np.meshgrid(at, at, indexing="ij"))
    img = np.clip(img, 0, 255)
    if kind == 1:
        img = img[6 : SIZE - 4, 8 : SIZE - 2]
    elif kind == 2:
        img = np.clip(img * 0.9 + 20 + np.random.default_rng(seed + 1).normal(0, 1.5, img.shape), 0, 255)
    elif kind == 3:
        img = np.rot90(img)
    return np.ascontiguousarray(img.astype(np.uint8))


def drawn(embeddings: DataFrame) -> DataFrame:
    """image_id, image: a PNG for each row of embeddings (vec_id, embedding).

    Ids of the form 20 k + 1, 2 and 3 show a cropped, a brighter and a turned
    copy of the picture of 20 k, where that row exists; all others a picture of
    their own.
    """
    e = embeddings.select(F.col("vec_id").cast("long").alias("image_id"), "embedding").withColumn("kind", F.when(F.pmod("image_id", F.lit(20)).isin(1, 2, 3), F.pmod("image_id", F.lit(20)).cast("int")).otherwise(0))
    base = e.filter("image_id % 20 = 0").select(F.col("image_id").alias("base"), F.col("embedding").alias("original"))
    both = e.withColumn("base", F.col("image_id") - F.col("kind")).join(base, "base", "left")

    @F.arrow_udf("binary")
    def draw(vector: pa.Array, original: pa.Array, kind: pa.Array) -> pa.Array:
        out = []
        for v, o, k in zip(vector.to_pylist(), original.to_pylist(), kind.to_pylist()):
            out.append(None if v is None else png(drawing(o, k) if k and o is not None else drawing(v)))
        return pa.array(out, pa.binary())

    return both.select("image_id", draw("embedding", "original", "kind").alias("image"))
