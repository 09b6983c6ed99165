"""Edited and cropped copies of images, by local descriptors.

Corners (Harris response, local maxima) are taken at scales half an octave apart, down to the smallest that
has room for a descriptor. In each cell of CELL x CELL pixels of a level the PER_CELL strongest are
kept (of equal ones the first by row, then column), so that their number grows with the area and
every part of a picture has its own. Each is turned to the direction of its intensity centroid and
described by BITS binary comparisons of smoothed pixels; binary_tests.json holds the places, chosen from 4096 random
ones for even outcomes and little correlation over textures and noise.

Copies that are equal byte for byte make one class, described once. Descriptors of classes are joined on Hamming tables: a key is made of
bits picked at random, as many as the collection's descriptors ask for (key_bits), so that chance meetings
don't grow with its square, and with longer keys there are more tables. Two corners meet where their keys
differ in no bit, or in one outside the bits that name a cell, and 64 more bits in at most SKETCH_FAR: at distance
REACH with a chance of CHANCE in some table at any size of the collection, nearer more often, further less (meeting_chance). Cells of a table that hold more than a task should are parted by
image and paired part by part. Class pairs with MIN_VOTES meeting corners or more are verified: best
mutual matches over all bits within MAX_DISTANCE, and every match proposes a
similarity transform (from the places, scales and directions of its corners) that others agree
with or not. Pairs with MIN_INLIERS agreeing matches are copies.

Defined results: a null image, one that isn't a PGM or PPM file (P5 or P6, 8 bits), one too small or
without corners has no descriptors and matches nothing but, if it has bytes, its equals; rows with a null
image_id take part in nothing; equal rows of an id count once, different images under one id
are told apart and not compared with each other; their groups are one. An empty table has no pairs. Other
columns are not looked at, whatever their names.

No table of the test data holds pictures. `drawn` renders the embeddings table's vectors as
pictures (a fixed linear map to textures), so that near copies among the vectors become
edited copies of a picture.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import lean
from .links import AT_ONCE, block_keys, block_of, group_of_parts, layout, linked, linked_rows, own_partitions, pairs_within, settled
from .textvec import mix

BITS, LEAST_KEY_BITS, REACH, CHANCE = 256, 26, 40, 0.42
SKETCH, SKETCH_FAR = 64, 15
#: Key bits that name a cell, at least, and descriptors of a cell, or of several, that a task takes.
CELL_BITS, TASK_ROWS = 4, 4_000_000
CELL, PER_CELL = 16, 4
#: Descriptors, and distances of descriptors, that are worked on at a time.
_CHUNK, _BLOCK = 4096, 4_000_000
RADIUS = 12
MIN_VOTES, MAX_DISTANCE, MIN_INLIERS = 2, 64, 8
_ANGLES = 36

_TESTS = np.array(json.loads((Path(__file__).parent / "binary_tests.json").read_text()), np.float64).reshape(BITS, 2, 2)
_turns = np.arange(_ANGLES) * 2 * np.pi / _ANGLES
_ROTATED = np.round(np.stack([_TESTS[..., 0] * np.cos(a) - _TESTS[..., 1] * np.sin(a) for a in _turns])).astype(np.int32), np.round(
    np.stack([_TESTS[..., 0] * np.sin(a) + _TESTS[..., 1] * np.cos(a) for a in _turns])
).astype(np.int32)
_DISC = np.array([(x, y) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])
_MARGIN = int(np.ceil(RADIUS * 2**0.5)) + 1


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM or PPM file; None for anything else."""
    m = re.match(rb"(P[56])(?:\s+(?:#[^\n]*\n)?)+(\d+)\s+(\d+)\s+255\s", raw) if raw else None
    if not m:
        return None
    wide, high, layers = int(m.group(2)), int(m.group(3)), 1 if m.group(1) == b"P5" else 3
    if len(raw) - m.end() < wide * high * layers or not wide * high:
        return None
    pixels = np.frombuffer(raw, np.uint8, wide * high * layers, m.end()).reshape(high, wide, layers)
    return pixels[..., 0] if layers == 1 else (pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % pixels.shape[::-1] + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r+1, per image."""
    x = x.astype(np.float32, copy=False)
    for axis in (1, 2):
        pad, n = [(0, 0)] * 3, x.shape[axis]
        if r <= 4:
            pad[axis] = (r, r)
            wide = np.pad(x, pad, mode="edge")
            some: list[slice] = [slice(None)] * 3
            some[axis] = slice(0, n)
            total = wide[tuple(some)].copy()
            for k in range(1, 2 * r + 1):
                some[axis] = slice(k, k + n)
                total += wide[tuple(some)]
            x = total * np.float32(1 / (2 * r + 1))
        else:
            pad[axis] = (r + 1, r)
            s = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
            x = ((np.take(s, range(2 * r + 1, 2 * r + 1 + n), axis=axis) - np.take(s, range(n), axis=axis)) / (2 * r + 1)).astype(np.float32)
    return x


def _highest(x: np.ndarray, r: int) -> np.ndarray:
    """Maximum over squares of side 2r+1, per image."""
    for axis in (1, 2):
        pad, n = [(0, 0)] * 3, x.shape[axis]
        pad[axis] = (r, r)
        wide = np.pad(x, pad, constant_values=-np.inf)
        some: list[slice] = [slice(None)] * 3
        some[axis] = slice(0, n)
        x = wide[tuple(some)].copy()
        for k in range(1, 2 * r + 1):
            some[axis] = slice(k, k + n)
            np.maximum(x, wide[tuple(some)], out=x)
    return x


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    at = [np.minimum((np.arange(max(1, int(n * scale))) + 0.5) / scale - 0.5, n - 1.001).clip(0) for n in x.shape[1:]]
    for axis, place in zip((1, 2), at):
        low = place.astype(int)
        part = (place - low).reshape([-1 if k == axis else 1 for k in range(3)]).astype(np.float32)
        x = np.take(x, low, axis=axis) * (1 - part) + np.take(x, np.minimum(low + 1, x.shape[axis] - 1), axis=axis) * part
    return x


def scales(high: int, wide: int) -> list[float]:
    """Of the levels of a picture: half an octave apart, as long as a corner's surroundings fit."""
    found: list[float] = []
    while min(int(high * (scale := 2 ** (-len(found) / 2))), int(wide * scale)) > 2 * _MARGIN:
        found.append(scale)
    return found


def _strongest(peak: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the PER_CELL highest finite values in each cell of each image, by image."""
    image, y, x = np.nonzero(peak > -np.inf)
    across = -(-peak.shape[2] // CELL)
    cell = (image * -(-peak.shape[1] // CELL) + y // CELL) * across + x // CELL
    order = np.lexsort((-peak[image, y, x], cell))
    cell = cell[order]
    new = np.flatnonzero(np.diff(cell, prepend=-1))
    rank = np.arange(len(cell)) - np.repeat(new, np.diff(np.append(new, len(cell))))
    keep = order[rank < PER_CELL]
    return image[keep], y[keep], x[keep]


def describe(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(corners as [x, y, scale, angle], descriptors as BITS / 8 bytes) of each image of one shape."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in images]
    full = images.astype(np.float32)
    for scale in scales(*images.shape[1:]):
        level = _resize(_box(full, max(1, round((1 / scale - 1) / 2))) if scale < 1 else full, scale)
        smooth = _box(level, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inside = response[:, _MARGIN:-_MARGIN, _MARGIN:-_MARGIN]
        image, y, x = _strongest(np.where((inside >= _highest(inside, 2)) & (inside > 1.0), inside, -np.inf))
        if not len(image):
            continue
        y, x = y + _MARGIN, x + _MARGIN
        wider = _box(level, 2)
        angles, made = [], []
        for at in range(0, len(image), _CHUNK):
            i_, y_, x_ = (v[at : at + _CHUNK] for v in (image, y, x))
            around = smooth[i_[:, None], y_[:, None] + _DISC[:, 1], x_[:, None] + _DISC[:, 0]]
            angle = np.arctan2((around * _DISC[:, 1]).sum(1), (around * _DISC[:, 0]).sum(1))
            turn = np.round(angle / (2 * np.pi / _ANGLES)).astype(int) % _ANGLES
            px, py = _ROTATED[0][turn], _ROTATED[1][turn]
            value = wider[i_[:, None, None], y_[:, None, None] + py, x_[:, None, None] + px]
            angles.append(angle)
            made.append(np.packbits(value[..., 0] < value[..., 1], axis=1))
        angle, bits = np.concatenate(angles), np.concatenate(made)
        corners = np.stack(((x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), 1 / scale), angle), 1).astype(np.float32)
        cuts = np.searchsorted(image, np.arange(len(images) + 1))
        for i in range(len(images)):
            if cuts[i + 1] > cuts[i]:
                found[i].append((corners[cuts[i] : cuts[i + 1]], bits[cuts[i] : cuts[i + 1]]))
    empty = (np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8))
    return [(np.concatenate([c for c, _ in f]), np.concatenate([b for _, b in f])) if f else empty for f in found]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of each two descriptors."""
    x, y = a.view("<u8"), b.view("<u8")
    far = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.int16)
    for k in range(1, x.shape[1]):
        far += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return far


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest of b for each of a, its distance, nearest of a for each of b); ties: the first."""
    j, far = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    i, least = np.zeros(len(b), np.int64), np.full(len(b), BITS + 1)
    step = max(1, _BLOCK // max(1, len(b)))
    for at in range(0, len(a), step):
        d = distances(a[at : at + step], b)
        j[at : at + step], far[at : at + step] = d.argmin(axis=1), d.min(axis=1)
        here, low = d.argmin(axis=0), d.min(axis=0)
        better = low < least
        i[better], least[better] = here[better] + at, low[better]
    return j, far, i


def consensus(corners_a, bits_a, corners_b, bits_b, least: int = 1) -> tuple[int, int, tuple[float, float, float, float]] | None:
    """(matches, inliers, (scale, rotation, dx, dy) of b against a) of the best transform, or None with fewer than `least` matches."""
    j, far, back = nearest(bits_a, bits_b)
    i = np.flatnonzero((back[j] == np.arange(len(j))) & (far <= MAX_DISTANCE))
    if len(i) < least:
        return None
    a, b = corners_a[i].astype(np.float64), corners_b[j[i]].astype(np.float64)
    turn, scale = b[:, 3] - a[:, 3], b[:, 2] / a[:, 2]
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    rate = scale * np.exp(1j * turn)
    shift = zb - rate * za

    def agreeing(some: slice) -> np.ndarray:
        away = np.abs(rate[some, None] * za[None, :] + shift[some, None] - zb[None, :])
        alike = np.abs(np.angle(np.exp(1j * (turn[some, None] - turn[None, :])))) < 0.45
        return (away < 5 * np.maximum(1, scale[some])[:, None]) & alike

    step = max(1, _BLOCK // len(i))
    best = int(np.concatenate([agreeing(slice(at, at + step)).sum(axis=1) for at in range(0, len(i), step)]).argmax())
    k = np.flatnonzero(agreeing(slice(best, best + 1))[0])
    if len(k) > 1:  # least squares over the agreeing matches, and those that agree with that
        ca, cb = za[k].mean(), zb[k].mean()
        spread = (np.abs(za[k] - ca) ** 2).sum()
        if spread > 0:
            rate_ = ((zb[k] - cb) * np.conj(za[k] - ca)).sum() / spread
            shift_ = cb - rate_ * ca
            n = int((np.abs(rate_ * za + shift_ - zb) < 4 * max(1.0, abs(rate_))).sum())
            if n >= len(k):
                return len(i), n, (abs(rate_), float(np.angle(rate_)), shift_.real, shift_.imag)
    return len(i), len(k), (float(scale[best]), float(turn[best]), shift[best].real, shift[best].imag)


# ---- classes of equal images, with their descriptors ----

_CORNER = np.dtype([("x", "<u4"), ("y", "<u4"), ("level", "u1"), ("angle", "<f2")])
_FEATURES = "image_id bigint, digest binary, place bigint, n bigint, corners binary, bits binary"


def _packed(corners: np.ndarray) -> bytes:
    made = np.zeros(len(corners), _CORNER)
    made["level"] = np.round(2 * np.log2(corners[:, 2]))
    grid = 2.0 ** (-made["level"].astype(np.float64) / 2)
    made["x"], made["y"] = np.round(corners[:, 0] * grid - 0.5), np.round(corners[:, 1] * grid - 0.5)
    made["angle"] = corners[:, 3]
    return made.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    made = np.frombuffer(raw, _CORNER)
    scale = 2.0 ** (made["level"].astype(np.float64) / 2)
    return np.stack(((made["x"] + 0.5) * scale, (made["y"] + 0.5) * scale, scale, made["angle"].astype(np.float64)), 1)


def features(images: DataFrame) -> DataFrame:
    """image_id, digest of the file, place (partition and row), n, corners, bits of every image; n is 0 where nothing can be described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                some = batch.slice(first, 64)
                by_shape: dict[tuple, list[tuple[int, np.ndarray]]] = {}
                for k, raw in enumerate(some.column(2).to_pylist()):
                    pixels = decode(raw)
                    if pixels is not None:
                        by_shape.setdefault(pixels.shape, []).append((k, pixels))
                counts, corners, bits = [0] * some.num_rows, [b""] * some.num_rows, [b""] * some.num_rows
                for group in by_shape.values():
                    step = max(1, 1_000_000 // group[0][1].size)
                    for at in range(0, len(group), step):
                        part = group[at : at + step]
                        for (k, _), (c, b) in zip(part, describe(np.stack([p for _, p in part]))):
                            counts[k], corners[k], bits[k] = len(c), _packed(c), b.tobytes()
                places = pa.array(np.arange(place, place + some.num_rows))
                place += some.num_rows
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), places, pa.array(counts, pa.int64()), pa.array(corners, pa.binary()), pa.array(bits, pa.binary())], names=["image_id", "digest", "place", "n", "corners", "bits"])

    source = images.select(F.col("image_id").cast("long").alias("image_id"), F.unhex(F.md5(F.col("image").cast("binary"))).alias("digest"), F.col("image").cast("binary").alias("image"))
    return source.filter("image_id is not null and image is not null").mapInArrow(lean(run), _FEATURES)


#: Bytes of places, 8 each, up to which the copies to leave out are sent to every executor.
BROADCAST_BYTES = 64 << 20


def classes(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class of every image; class, image_id, n, corners, bits: one row for equal images). The class is the place of its smallest id."""
    made = settled(features(images))
    first = made.groupBy("digest").agg(F.min(F.struct("image_id", "place")).alias("least"))
    placed = made.select("image_id", "digest", "place").join(first.select("digest", F.col("least.place").alias("class")), "digest")
    members = placed.select(F.col("image_id").alias("id"), "class").distinct()
    extra = placed.filter("place != class").select("place")
    if extra.count() * 8 <= BROADCAST_BYTES:
        extra = F.broadcast(extra)
    return members, made.filter("n > 0").join(extra, "place", "left_anti").select(F.col("place").alias("class"), "image_id", "n", "corners", "bits")


# ---- Hamming tables ----


def key_bits(descriptors: int) -> int:
    """More than tell the descriptors apart by chance, as bits that differ in one place meet too."""
    return min(48, max(LEAST_KEY_BITS, math.ceil(math.log2(max(descriptors, 1))) + 4))


def cell_bits(descriptors: int, most: int) -> int:
    return max(CELL_BITS, math.ceil(math.log2(max(1, descriptors / most))) + 3)


def meeting_chance(far: int, length: int, cells: int) -> float:
    """That two descriptors that differ in `far` bits meet in a table."""
    chance = 0.0
    for wrong, ways in ((0, 1), (1, length - cells)):
        keys = ways * math.prod((BITS - far - i) / (BITS - i) for i in range(length - wrong)) * (far / (BITS - length + 1)) ** wrong
        left, rest = BITS - length, far - wrong
        chance += keys * sum(math.comb(rest, i) * math.comb(left - rest, SKETCH - i) for i in range(SKETCH_FAR + 1)) / math.comb(left, SKETCH)
    return chance


@functools.cache
def tables(length: int, cells: int) -> int:
    """So many that corners at REACH meet in one with CHANCE."""
    return math.ceil(math.log(1 - CHANCE) / math.log(1 - meeting_chance(REACH, length, cells)))


@functools.cache
def _weights(length: int, cells: int) -> list[np.ndarray]:
    """Powers of two, a column a table, for the bits of its key and of both halves of its sketch."""
    rng, count = np.random.default_rng(16), tables(length, cells)
    made = [np.zeros((BITS, count)) for _ in range(3)]
    for t in range(count):
        bits = rng.permutation(BITS)
        for k, (first, last) in enumerate(((0, length), (length, length + 32), (length + 32, length + 64))):
            made[k][bits[first:last], t] = 2.0 ** np.arange(last - first - 1, -1, -1)
    return made


def keys_of(bits: np.ndarray, length: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, sketch) of each descriptor in each table; a key's highest bits name its cell."""
    every = np.unpackbits(bits, axis=1).astype(np.float64)
    key, high, low = ((every @ w).astype(np.uint64) for w in _weights(length, cells))
    return key.astype(np.int64), high << np.uint64(32) | low


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(class, corner, bits) of each descriptor, some thousands at a time."""
    names, corners, bits, held = [], [], [], 0
    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            every = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
            for first in range(0, len(every), _CHUNK):
                some = every[first : first + _CHUNK]
                names.append(np.full(len(some), name, np.int64))
                corners.append(np.arange(first, first + len(some)))
                bits.append(some)
                held += len(some)
                if held >= 3 * _CHUNK:
                    yield np.concatenate(names), np.concatenate(corners), np.concatenate(bits)
                    names, corners, bits, held = [], [], [], 0
    if held:
        yield np.concatenate(names), np.concatenate(corners), np.concatenate(bits)


def _cells(length: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((tables(length, cells), 1 << cells), np.int64)
        for _, _, bits in _described(batches):
            keys = keys_of(bits, length, cells)[0] >> (length - cells)
            for t in range(keys.shape[1]):
                total[t] += np.bincount(keys[:, t], minlength=1 << cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    return run


_POSTINGS = "group int, part bigint, whole boolean, names binary, counts binary, corners binary, keys binary, sketches binary"


def _least_bytes(x: np.ndarray) -> bytes:
    """In 1, 2, 4 or 8 bytes each, after one byte that says so; many equal or small ones are compressed by the shuffle."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(x) or int(x.max()) < 1 << 8 * s)
    return bytes([size]) + np.ascontiguousarray(x, f"<u{size}").tobytes()


def _from_least(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences within runs that begin where new is true."""
    return np.where(new, x, np.diff(x, prepend=0))


def _sums(steps: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    return total - np.repeat(total[starts] - steps[starts], counts)


def _cut(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _whole(raw: bytes, size: int) -> np.ndarray:
    x = np.zeros((len(raw) // size, 8), np.uint8)
    x[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return x.view("<i8").ravel()


def _postings(length: int, cells: int, shared):
    size = -(-length // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, parts, own_keys = shared.value
        for names, corners, bits in _described(batches):
            rows: list[tuple] = []
            keys, sketches = keys_of(bits, length, cells)

            def add(group: int, part: int, whole: bool, at: np.ndarray, t: int) -> None:
                own, c = names[at], corners[at]
                new = np.concatenate(([True], own[1:] != own[:-1]))
                starts = np.flatnonzero(new)
                rows.append((int(own_keys[group]), part, whole, own[starts].tobytes(), _least_bytes(np.diff(np.append(starts, len(at)))), _least_bytes(_steps(c, new)), _cut(keys[at, t], size), sketches[at, t].tobytes()))

            for t in range(keys.shape[1]):
                cell = keys[:, t] >> (length - cells)
                groups, split = base[t, cell], parts[t, cell]
                plain = np.flatnonzero(split == 1)
                order = plain[np.argsort(groups[plain], kind="stable")]
                for at in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
                    if len(at):
                        add(int(groups[at[0]]), 0, True, at, t)
                large = np.flatnonzero(split > 1)
                for c in np.unique(cell[large]):  # group (i, j) of the parts i <= j pairs them, or one with itself
                    inside = large[cell[large] == c]
                    n, first = int(parts[t, c]), int(base[t, c])
                    part = mix(names[inside].astype(np.uint64)) % np.uint64(n)
                    for p in np.unique(part).tolist():
                        at = inside[part == p]
                        for other in range(n):
                            add(group_of_parts(first, n, p, other), p, p == other, at, t)
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["group", "part", "whole", "names", "counts", "corners", "keys", "sketches"])

    return run


_MEETINGS = "block int, names binary, partners binary, counts binary, seconds binary, corners binary"


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _first_of_pairs(code: np.ndarray, wide: int, most: int) -> np.ndarray:
    """Of the sorted distinct codes pair * wide + corner: the first `most` of each pair."""
    pair = code // wide
    starts = _runs(pair)
    rank = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
    return code[rank < most]


def near_keys(key: np.ndarray, free: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of keys that are equal, or differ in one of the lowest `free` bits, each pair once and in bounded slices."""
    order = np.argsort(key)
    starts = _runs(key[order])
    for i, j in pairs_within(starts, np.diff(np.append(starts, len(key)))):
        yield order[i], order[j]
    for bit in range(free):
        one = key >> bit & 1
        order = np.argsort((key ^ one << bit) << 1 | one)
        masked = key[order] & ~(1 << bit)
        starts = _runs(masked)
        sizes = np.diff(np.append(starts, len(key)))
        ones = np.add.reduceat(one[order], starts) if len(starts) else sizes
        zeros = sizes - ones
        some = np.flatnonzero(ones * zeros)
        starts, ones, zeros = starts[some], ones[some], zeros[some]
        ends = np.cumsum(ones * zeros)
        for first in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
            at = np.arange(first, min(first + AT_ONCE, int(ends[-1])))
            run = np.searchsorted(ends, at, "right")
            at -= ends[run] - ones[run] * zeros[run]
            yield order[starts[run] + at // ones[run]], order[starts[run] + zeros[run] + at % ones[run]]


def _meetings(length: int, cells: int, blocks: int, block_ids: np.ndarray, min_votes: int):
    size = -(-length // 8)

    def run(group: pa.Table) -> pa.Table:
        names, counts, corners, keys, sketches, parts = [], [], [], [], [], []
        whole = group.column("whole")[0].as_py()
        for part, n, c, corner, key, sketch in zip(*(group.column(x).to_pylist() for x in ("part", "names", "counts", "corners", "keys", "sketches"))):
            own = np.frombuffer(n, "<i8")
            count = _from_least(c)
            names.append(own)
            counts.append(count)
            corners.append(_sums(_from_least(corner), np.cumsum(count) - count, count).astype(np.int32))
            keys.append(_whole(key, size))
            sketches.append(np.frombuffer(sketch, "<u8"))
            parts.append(np.full(len(sketches[-1]), part, np.int32))
        name, local = np.unique(np.concatenate(names), return_inverse=True)
        picture = np.repeat(local, np.concatenate(counts)).astype(np.int32)
        key, corner, sketch, part = map(np.concatenate, (keys, corners, sketches, parts))
        del names, counts, corners, keys, sketches, parts
        wide, many = int(corner.max()) + 1, len(name)
        found, held, waiting = np.zeros(0, np.int64), [], 0
        for i, j in near_keys(key, length - cells):
            ok = np.bitwise_count(sketch[i] ^ sketch[j]) <= SKETCH_FAR
            i, j = i[ok], j[ok]
            ok = picture[i] != picture[j]
            if not whole:
                ok &= part[i] != part[j]
            i, j = i[ok], j[ok]
            swap = picture[i] > picture[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            held.append(np.unique((picture[i].astype(np.int64) * many + picture[j]) * wide + corner[i]))
            waiting += len(held[-1])
            if waiting > 4 * AT_ONCE:
                found, held, waiting = _first_of_pairs(np.unique(np.concatenate([found, *held])), wide, min_votes), [], 0
        found = _first_of_pairs(np.unique(np.concatenate([found, *held])), wide, min_votes)
        pair, corner = found // wide, found % wide
        a, b = pair // many, pair % many
        x, y = ((mix(v.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64) for v in (name[a], name[b]))
        block = block_of(x, y, blocks, block_ids)
        order = np.argsort(block, kind="stable")
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if len(at):
                own, partner = a[at], b[at]
                starts = _runs(own)
                others, index = np.unique(partner, return_inverse=True)
                rows.append((int(block[at[0]]), name[own[starts]].tobytes(), name[others].tobytes(), _least_bytes(np.diff(np.append(starts, len(at)))), _least_bytes(index), _least_bytes(corner[at])))
        kinds = (pa.int32(), *[pa.binary()] * 5)
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("block", "names", "partners", "counts", "seconds", "corners"), columns, kinds)})

    return run


_WANTED = "class bigint, block int, pairs binary"


def _candidates(min_votes: int):
    """A row with the candidate pairs of a block pair (class null), and one for each class that they need."""

    def run(group: pa.Table) -> pa.Table:
        a, b, corner = [], [], []
        for n, p, c, s, k in zip(*(group.column(x).to_pylist() for x in ("names", "partners", "counts", "seconds", "corners"))):
            a.append(np.repeat(np.frombuffer(n, "<i8"), _from_least(c)))
            b.append(np.frombuffer(p, "<i8")[_from_least(s)])
            corner.append(_from_least(k))
        a, b, corner = map(np.concatenate, (a, b, corner))
        name, local = np.unique(np.concatenate((a, b)), return_inverse=True)
        many, wide = len(name), int(corner.max()) + 1
        code = np.unique((local[: len(a)] * many + local[len(a) :]) * wide + corner)
        pair = code // wide
        starts = _runs(pair)
        pair = pair[starts][np.diff(np.append(starts, len(pair))) >= min_votes]
        pairs = np.stack((name[pair // many], name[pair % many]), 1)
        block = group.column("block")[0].as_py()
        needed = np.unique(pairs)
        return pa.table({"class": pa.array([None, *needed.tolist()], pa.int64()), "block": pa.array([block] * (len(needed) + 1), pa.int32()), "pairs": pa.array([pairs.tobytes(), *[None] * len(needed)], pa.binary())})

    return run


_PAIRS = "image_a bigint, image_b bigint, matches int, inliers int, scale double, rotation double, dx double, dy double"
_LINKS = "class bigint, other bigint, links bigint"


def _verified(min_inliers: int, pairwise: bool):
    """Each pair with its transform; or their spanning forest, and how many images each class is linked with."""

    def run(group: pa.Table) -> pa.Table:
        known: dict[int, tuple] = {}
        pairs = []
        for name, image, copies_, c, b, p in zip(*(group.column(x).to_pylist() for x in ("class", "image_id", "copies", "corners", "bits", "pairs"))):
            if p is not None:
                pairs.append(np.frombuffer(p, "<i8").reshape(-1, 2))
            elif b is not None:
                known[name] = image, copies_, _unpacked(c), np.frombuffer(b, np.uint8).reshape(-1, BITS // 8)
        rows, joined = [], []
        for a, b in np.concatenate(pairs).tolist() if pairs else ():
            if known[a][0] > known[b][0]:
                a, b = b, a
            (image_a, _, *described_a), (image_b, _, *described_b) = known[a], known[b]
            made = consensus(*described_a, *described_b, least=min_inliers) if image_a != image_b else None
            if made and made[1] >= min_inliers:
                joined.append((a, b))
                if pairwise:
                    rows.append((image_a, image_b, made[0], made[1], *made[2]))
        if pairwise:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4)
            columns = list(zip(*rows)) if rows else [[]] * 8
            return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("image_a", "image_b", "matches", "inliers", "scale", "rotation", "dx", "dy"), columns, kinds)})
        return linked_rows(np.array(joined, np.int64).reshape(-1, 2), {k: v[1] for k, v in known.items()})

    return run


def _joined(members: DataFrame, made: DataFrame, min_votes: int, min_inliers: int, pairwise: bool, most: int) -> DataFrame:
    """The verified pairs of classes, as _verified says."""
    images, descriptors = made.agg(F.count("class"), F.coalesce(F.sum("n"), F.lit(0))).first()
    length, cells = key_bits(descriptors), cell_bits(descriptors, most)
    bits = made.select("class", "bits")
    counts = np.zeros((tables(length, cells), 1 << cells), np.int64)
    if descriptors > most:  # else every table is one group, however its keys lie
        for cell, n in bits.mapInArrow(lean(_cells(length, cells)), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
            counts.flat[cell] = n
    base, parts = layout(counts, most)
    groups = int((base + parts * (parts + 1) // 2).max())
    shared = made.sparkSession.sparkContext.broadcast((base, parts, own_partitions(groups)))
    blocks = max(6, math.ceil(math.sqrt(images / 2000)))
    block_ids, parted = block_keys(blocks)
    postings = bits.mapInArrow(lean(_postings(length, cells, shared)), _POSTINGS)
    meetings = postings.repartition(groups, "group").groupBy("group").applyInArrow(lean(_meetings(length, cells, blocks, block_ids, min_votes)), _MEETINGS)
    wanted = meetings.repartition(parted, "block").groupBy("block").applyInArrow(lean(_candidates(min_votes)), _WANTED).persist(StorageLevel.DISK_ONLY)
    weights = members.groupBy("class").agg(F.count("id").alias("copies"))
    sets = wanted.filter("class is not null").select("class", "block").join(made.join(weights, "class"), "class")
    nothing = F.lit(None)
    together = sets.select("block", "class", "image_id", "copies", "corners", "bits", nothing.cast("binary").alias("pairs")).union(
        wanted.filter("class is null").select("block", "class", *[nothing.cast(k).alias(n) for n, k in (("image_id", "bigint"), ("copies", "bigint"), ("corners", "binary"), ("bits", "binary"))], "pairs")
    )
    return together.repartition(parted, "block").groupBy("block").applyInArrow(lean(_verified(min_inliers, pairwise)), _PAIRS if pairwise else _LINKS)


def copies(images: DataFrame, min_votes: int = MIN_VOTES, min_inliers: int = MIN_INLIERS, most: int = TASK_ROWS) -> DataFrame:
    """image_a < image_b, matches, inliers and the transform of b against a, for every pair of different images that show the same.

    Equal files are one image here, under their smallest id; membership() has the others.
    """
    return _joined(*classes(images), min_votes, min_inliers, True, most)


def membership(images: DataFrame) -> DataFrame:
    """image_id, first_id: the smallest id of the images that are equal to it."""
    members, _ = classes(images)
    return members.join(members.groupBy("class").agg(F.min("id").alias("first_id")), "class").select(F.col("id").alias("image_id"), "first_id")


def linked_images(images: DataFrame, min_votes: int = MIN_VOTES, min_inliers: int = MIN_INLIERS, most: int = TASK_ROWS) -> DataFrame:
    """image_id, class_id, n_links: one row for each image that has a copy.

    class_id is the smallest image_id of all that links lead to, and n_links how many images show the same as this one,
    equal ones included.
    """
    members, made = classes(images)
    return linked(members, settled(_joined(members, made, min_votes, min_inliers, False, most))).withColumnRenamed("id", "image_id")


# ---- pictures of vectors ----

SIDE = 96


@functools.cache
def textures(count: int, side: int = SIDE) -> np.ndarray:
    """count fixed band-limited pictures, of mean 0 and deviation 1."""
    noise = np.random.default_rng(96).normal(size=(count, side, side)).astype(np.float32)
    bands = _box(_box(noise, 1), 1) - _box(_box(noise, 4), 4)
    return ((bands - bands.mean((1, 2), keepdims=True)) / bands.std((1, 2), keepdims=True)).reshape(count, -1)


def draw(vectors: np.ndarray) -> np.ndarray:
    """A picture for each vector: the textures, weighted by its coordinates."""
    mixed = vectors.astype(np.float32) @ textures(vectors.shape[1])
    mixed /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return np.clip(128 + 45 * mixed, 0, 255).astype(np.uint8).reshape(-1, SIDE, SIDE)


def drawn(embeddings: DataFrame) -> DataFrame:
    """image_id, image: a picture of each vector; null for a null vector, or one with a null in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                vectors = some.column(1).to_pylist()
                out: list[bytes | None] = [None] * len(vectors)
                by_size: dict[int, list[int]] = {}
                for k, v in enumerate(vectors):
                    if v and None not in v:
                        by_size.setdefault(len(v), []).append(k)
                for rows in by_size.values():
                    for k, pixels in zip(rows, draw(np.array([vectors[k] for k in rows]))):
                        out[k] = encode(pixels)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.binary())], names=["image_id", "image"])

    return embeddings.select(F.col("vec_id").cast("long").alias("image_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(lean(run), "image_id bigint, image binary")
