"""Cropped or edited copies of images, by local descriptors.

An image's corners are found at several scales: all local maxima of the Harris
response within `APART` pixels. That rule is local, so a crop keeps the corners
inside it, whatever the image's size, and their number grows with the area. Each
gets an orientation, that of the intensity centroid of its patch, and a binary
descriptor: `BITS` comparisons of smoothed intensities at a fixed random pattern,
turned by the orientation. Changes of brightness or contrast keep the order of
intensities, hence the bits.

Descriptors are cut into `TABLES` chunks; two that differ in fewer bits than
that agree in a chunk, so images are joined on (chunk, bits) tables. (Copies that
differ more share other corners' chunks; the tests measure the recall.) Two images
that share a key are verified: descriptors are matched by their whole Hamming
distance, and by geometric consensus each match proposes a turn, a scale and a
shift, with which at least `LEAST` places must agree. Under keys of few images
all pairs are named, and each is verified once; under keys of many, as of a
common logo, each image is verified with one of them, and if that doesn't join
them, all pairs are, in cells of bounded size.
Verified pairs go to `components`, so classes are what all such links reach.

Images are bytes in PGM or PPM (P5, P6). Equal bytes are one image, so copies
meet once. Defined cases: bytes that are null, empty or no such image have no
corners and are a class of their own each; so are plain images; null ids pass
through; repeated rows give repeated results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import PAIRS, bounded_batches, runs, written
from siftline.llm.components import components, joined

BITS, TABLES, LEAST, SCALES, PATCH, APART = 256, 4, 6, (1.0, 1.5, 2.0), 7, 4
#: most bits in which the descriptors of a match differ
RADIUS = 48
_PATTERN = np.random.default_rng(11).integers(-PATCH, PATCH + 1, (BITS, 4))
# the orientation says which side is brighter, so tests along it would tell little
_PATTERN[:, 2] = np.clip(_PATTERN[:, 0] + _PATTERN[:, 2] % 3 - 1, -PATCH, PATCH)
_HEADER = re.compile(rb"(P[56])(?:\s+(?:#[^\n]*\n\s*)*)(\d+)\s+(\d+)\s+(\d+)\s")


def decoded(data: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM or PPM image of 8 bits; None for anything else."""
    m = _HEADER.match(data) if data else None
    if not m:
        return None
    w, h, most, channels = int(m[2]), int(m[3]), int(m[4]), 3 if m[1] == b"P6" else 1
    body = np.frombuffer(data, np.uint8, offset=m.end())
    if not w or not h or most > 255 or len(body) < w * h * channels:
        return None
    pixels = body[: w * h * channels].reshape(h, w, channels).astype(np.float64)
    return pixels @ np.array([0.299, 0.587, 0.114]) if channels == 3 else pixels[:, :, 0]


def encoded(grey: np.ndarray) -> bytes:
    """PGM of grey values."""
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2 r + 1, edges repeated."""
    p = np.pad(a, r + 1, mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (p[n:-1, n:-1] - p[: -n - 1, n:-1] - p[n:-1, : -n - 1] + p[: -n - 1, : -n - 1]) / n**2


def _scaled(a: np.ndarray, by: float) -> np.ndarray:
    """Smaller by a factor, bilinear after smoothing."""
    if by == 1:
        return a
    a = _box(a, 1)
    y, x = np.arange(0, a.shape[0] - 1, by), np.arange(0, a.shape[1] - 1, by)
    i, j = y.astype(int), x.astype(int)
    v, u = (y - i)[:, None], (x - j)[None]
    return (1 - v) * ((1 - u) * a[np.ix_(i, j)] + u * a[np.ix_(i, j + 1)]) + v * ((1 - u) * a[np.ix_(i + 1, j)] + u * a[np.ix_(i + 1, j + 1)])


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """Whether each value is the highest within squares of 2 r + 1."""
    p = np.pad(a, r, constant_values=-np.inf)
    rows = np.lib.stride_tricks.sliding_window_view(p, 2 * r + 1, axis=0).max(axis=-1)
    return a >= np.lib.stride_tricks.sliding_window_view(rows, 2 * r + 1, axis=1).max(axis=-1)


def features(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y, scale, angle) and descriptors (rows of bytes) of an image's corners at each scale."""
    places, bits_ = [], []
    reach = int(np.ceil(PATCH * 2**0.5)) + 1
    for scale in SCALES:
        a = _scaled(grey, scale)
        if min(a.shape) <= 2 * reach + 1:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy**2 - 0.05 * (xx + yy) ** 2
        y, x = np.nonzero(((response > 1e-6) & _highest(response, APART))[reach:-reach, reach:-reach])
        y, x = y + reach, x + reach
        if not len(x):
            continue
        smooth = _box(a, 1)
        d = np.arange(-PATCH, PATCH + 1)
        disc = d[:, None] ** 2 + d[None] ** 2 <= PATCH**2
        patch = smooth[y[:, None, None] + d[None, :, None], x[:, None, None] + d[None, None, :]] * disc
        angle = np.arctan2((patch * d[:, None]).sum((1, 2)), (patch * d[None]).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        at = lambda px, py: smooth[np.rint(y[:, None] + sin * px + cos * py).astype(int), np.rint(x[:, None] + cos * px - sin * py).astype(int)]  # noqa: B023, E731
        bits = at(_PATTERN[:, 0], _PATTERN[:, 1]) < at(_PATTERN[:, 2], _PATTERN[:, 3])
        bits_.append(np.packbits(bits, axis=1))
        places.append(np.stack([x * scale, y * scale, np.full(len(x), scale), angle], axis=1))
    if not places:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(bits_)


def packed(places: np.ndarray) -> np.ndarray:
    """Places in 64 bits each: x and y in sixteenths of a pixel (22 bits each), the scale's number (4), the angle (16)."""
    x, y = (np.rint(places[:, i] * 16).astype(np.uint64) & np.uint64((1 << 22) - 1) for i in (0, 1))
    scale = np.searchsorted(SCALES, places[:, 2] - 1e-6).astype(np.uint64)
    angle = np.rint((places[:, 3] + np.pi) / (2 * np.pi) * 65535).astype(np.uint64)
    return (x << np.uint64(42) | y << np.uint64(20) | scale << np.uint64(16) | angle).view(np.int64)


def unpacked(at: np.ndarray) -> np.ndarray:
    p, few = at.view(np.uint64), np.uint64((1 << 22) - 1)
    angle = (p & np.uint64(65535)) / 65535 * 2 * np.pi - np.pi
    return np.stack([(p >> np.uint64(42)) / 16, ((p >> np.uint64(20)) & few) / 16, np.array(SCALES)[((p >> np.uint64(16)) & np.uint64(15)).astype(int)], angle], axis=1)


def consensus(a: np.ndarray, b: np.ndarray, tolerance: float = 4.0) -> int:
    """Of matches between places of two images, how many agree with one turn, scale and shift."""
    both = np.unique(np.round(np.concatenate([a, b], axis=1), 3), axis=0)
    a, b = both[:, :4], both[:, 4:]
    turn, scale = b[:, 3] - a[:, 3], b[:, 2] / a[:, 2]
    best = 0
    for i in range(len(a)):
        c, s = scale[i] * np.cos(turn[i]), scale[i] * np.sin(turn[i])
        d = a[:, :2] - a[i, :2]
        moved = np.stack([c * d[:, 0] - s * d[:, 1], s * d[:, 0] + c * d[:, 1]], axis=1) + b[i, :2]
        near = (np.abs(moved - b[:, :2]) <= tolerance).all(axis=1) & (np.abs(np.log(scale / scale[i])) < 0.3) & (np.cos(turn - turn[i]) > 0.9)
        # several descriptors of one place count once
        best = max(best, len(np.unique(np.round(a[near, :2]), axis=0)))
    return best


def corners(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and descriptors (rows of 64-bit words) of what `copies` holds of an image."""
    n = len(data) // (8 + BITS // 8)
    return unpacked(np.frombuffer(data, np.int64, n)), np.frombuffer(data, np.uint64, offset=8 * n).reshape(n, -1)


def keys_of(bits: np.ndarray) -> np.ndarray:
    """The keys of an image's descriptors (rows of bytes), each once: a hash of a chunk and its number."""
    size = BITS // 8 // TABLES
    chunks = np.pad(bits.reshape(len(bits), TABLES, size), ((0, 0), (0, 0), (0, 8 - size))).view("<u8")[:, :, 0]
    x = (chunks + np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of each descriptor of `a` and its nearest of `b`, if that is near enough."""
    at, to = [], []
    for i in range(0, len(a), 256):  # bounded memory, whatever the number of corners
        far = np.bitwise_count(a[i : i + 256, None, :] ^ b[None]).sum(axis=2, dtype=np.int32)
        best = far.argmin(axis=1)
        near = np.flatnonzero(far[np.arange(len(best)), best] <= RADIUS)
        at.append(near + i)
        to.append(best[near])
    return np.concatenate(at), np.concatenate(to)


def same(a: tuple[np.ndarray, np.ndarray], data: bytes) -> bool:
    """Whether matches of two images agree on one geometry."""
    b = corners(data)
    if not len(a[0]) or not len(b[0]):
        return False
    i, j = matches(a[1], b[1])
    return len(i) >= LEAST and consensus(a[0][i], b[0][j]) >= LEAST


def _forest(data: list[bytes], label: np.ndarray) -> Iterator[tuple[int, int]]:
    label, of = label.copy(), [corners(d) for d in data]
    for i in range(len(data) - 1):
        for j in range(i + 1, len(data)):
            if label[i] != label[j] and same(of[i], data[j]):
                yield i, j
                label[label == label[j]] = label[i]


def copies(rows: DataFrame, most: int = 256, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """A row for each image: id, n_corners, class_id (smallest id of the images that links reach, itself included)."""
    bounded_batches(rows.sparkSession)
    given = rows.select(rows[id_col].alias("id"), rows[image_col].alias("image"))
    kind = given.schema["id"].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n, held = [], [], []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grey = decoded(data)
                # what can't be read is alike to nothing: told apart by its row's id
                own.append(xxhash.xxh64_intdigest(data, 42) if grey is not None else xxhash.xxh64_intdigest(f"no image {i}", 43))
                places, bits = features(grey) if grey is not None else (np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))
                n.append(len(places))
                held.append(packed(places).tobytes() + bits.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(held, pa.binary())], names=["id", "h", "n_corners", "data"])

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # a task files an image once as far as it remembers
        for batch in batches:
            for h, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data and h not in done:
                    done = set() if len(done) > 1_000_000 else done
                    done.add(h)
                    n = len(data) // (8 + BITS // 8)
                    key = keys_of(np.frombuffer(data, np.uint8, offset=8 * n).reshape(n, -1))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), h))], names=["k", "h"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(null, u, v) for each pair under keys of few images; (k, u, v), v being the key's first, under others."""
        many = None
        for k, h in runs(batches, 1, PAIRS):
            if many is None or many[0] != k[0]:
                many = (k[0], h[0]) if len(h) > PAIRS else None
            if many is not None:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(h), pa.array(np.full(len(h), many[1]))], names=["k", "u", "v"])
            elif len(h := np.unique(h)) > 1:
                i, j = np.triu_indices(len(h), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(h[i]), pa.array(h[j])], names=["k", "u", "v"])

    seen = written(given.mapInArrow(described, f"id {kind}, h bigint, n_corners bigint, data binary"), "images")
    keys = seen.select("h", "data").mapInArrow(filed, "k bigint, h bigint").repartition("k").sortWithinPartitions("k", "h")
    found = written(keys.mapInArrow(met, "k bigint, u bigint, v bigint").distinct(), "met")
    held = seen.groupBy(F.col("h").alias("id")).agg(F.min("data").alias("data"))
    links = joined(found, held, most, corners, same, _forest)
    roots = components(links).select(F.col("node").alias("h"), "root")
    single = seen.groupBy("h").agg(F.min("id").alias("least"), F.max("n_corners").alias("n_corners"))
    rooted = single.join(roots, "h", "left").select("h", "least", "n_corners", F.coalesce("root", "h").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    return seen.select("id", "h").join(rooted.join(named, "root").drop("root", "least"), "h").select("id", "n_corners", "class_id")


def rendered(rows: DataFrame, size: int = 96, every: int = 25, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Images for a table of vectors, as the tables at hand have none: id, image.

    A vector seeds a texture, so equal vectors have equal images. The id decides on
    an edit: of each `every` ids the sixth shows a crop of the texture of the id
    before it, the eleventh that one darker and flatter. `sources` says the same.
    """
    narrow = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast("array<float>").alias("v"))
    lead = narrow.select((F.col("id") + 1).alias("id"), F.col("v").alias("before")).dropDuplicates(["id"])
    edited = narrow.filter(F.pmod("id", F.lit(every)).isin(5, 10)).join(lead, "id", "left").select("id", F.coalesce("before", "v").alias("v"), F.col("before").isNotNull().alias("copy"))
    all_ = narrow.filter(~F.pmod("id", F.lit(every)).isin(5, 10) | F.col("id").isNull()).select("id", "v", F.lit(False).alias("copy")).unionByName(edited)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v, copy in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if v is None:
                    out.append(None)
                    continue
                rng = np.random.default_rng(xxhash.xxh64_intdigest(np.array([0 if x is None else x for x in v], "<f4").tobytes(), 42))
                coarse = np.kron(rng.uniform(0, 255, (size // 8, size // 8)), np.ones((8, 8)))
                grey = 0.5 * _box(coarse, 2) + 0.5 * _box(rng.uniform(0, 255, (size, size)), 1)
                if copy and i % every == 5:
                    grey = grey[size // 8 : size - size // 16, size // 6 : size - size // 12]
                elif copy:
                    grey = 20 + 0.7 * grey
                out.append(encoded(grey))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "image"])

    return all_.mapInArrow(drawn, "id bigint, image binary")
