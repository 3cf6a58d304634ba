"""Cropped and edited copies of images by local descriptors.

Corners are found at several scales; around each, binary tests, turned to the
patch's orientation, give 128 bits.  The bits are cut into bands: descriptors
that differ in fewer than twice as many bits as there are bands differ in one bit
at most of some band, so the images' bands, looked up among the queries' bands and
all their neighbours of one other bit, give all near matches.  Matches vote for the
similarity transform that they imply; images whose best transform has enough
votes are copies.

Corners of all images would be larger than the images' source, so only those of the
queries are written, as blocks of an index in the shared folder.  The task that
finds an image's corners looks them up and counts the votes.

Images of equal pixels form one class, which takes part once.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import shared_dir, small_batches, write_shared

#: Bits of a descriptor, bands that it is cut into, and half the side of a patch.
BITS, BANDS, RADIUS = 128, 4, 12
#: A corner is the strongest within so many pixels.
APART = 4
#: Rows of a strip (even), and rows around it that its corners depend on.
STRIP, MARGIN = 768, RADIUS + APART + 4
#: Orientations for which the tests are laid out.
TURNS = 24
#: Largest number of bits in which matching descriptors differ; below 2 * BANDS, the join finds every such pair.
NEAR = 2 * BANDS - 1
#: Corners of queries in a block of the index, and pairs of corners that are held at once.
BLOCK, PAIRS = 1 << 18, 1 << 20
#: Columns of a descriptor's words.
WORDS = [f"b{i}" for i in range(BITS // 64)]


def decode(data: bytes | bytearray) -> np.ndarray:
    """Grey pixels (rows, columns) of a binary PGM or PPM, or of an 8-bit PNG that isn't interlaced.

    Anything else, and a damaged file, gives an empty array.
    """
    data = bytes(data)
    try:
        if data[:2] in (b"P5", b"P6"):
            head = re.match(rb"P[56]\s+(\d+)\s+(\d+)\s+(\d+)\s", data)
            if head is None:
                return np.zeros((0, 0), np.float32)
            w, h, at = int(head[1]), int(head[2]), head.end()
            deep = 3 if data[:2] == b"P6" else 1
            pixels = np.frombuffer(data, np.uint8, w * h * deep, at).reshape(h, w, deep)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            pixels = _png(data)
        else:
            return np.zeros((0, 0), np.float32)
        return pixels[..., :3].mean(axis=2).astype(np.float32) if pixels.shape[2] > 2 else pixels[..., 0].astype(np.float32)
    except (ValueError, IndexError, KeyError, zlib.error, struct.error):
        return np.zeros((0, 0), np.float32)


def _png(data: bytes) -> np.ndarray:
    at, packed, head = 8, b"", None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        packed += body if kind == b"IDAT" else b""
        at += size + 12
    if head is None:
        raise ValueError("no header")
    w, h, depth, color, *_, interlaced = head
    deep = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit images that aren't interlaced")
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, w * deep + 1)
    out = np.zeros((h, w * deep), np.uint8)
    above = np.zeros(w * deep, np.int32)
    for y in range(h):
        way, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if way in (1, 3, 4):
            for x in range(w * deep):
                a = line[x - deep] if x >= deep else 0
                b, c = above[x], above[x - deep] if x >= deep else 0
                if way == 4:
                    p = a + b - c
                    a = min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v)))
                line[x] = (line[x] + (a if way != 3 else (a + b) // 2)) & 255
        elif way == 2:
            line = (line + above) & 255
        out[y], above = line, line
    return out.reshape(h, w, deep)


def _layout() -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the BITS pairs of pixels, for each of TURNS orientations."""
    rng = np.random.default_rng(42)
    pairs = rng.normal(0, RADIUS / 2.5, (BITS, 2, 2)).clip(-RADIUS * 0.7, RADIUS * 0.7)
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], -1), np.stack([np.sin(angle), np.cos(angle)], -1)], 1)
    turned = np.rint(np.einsum("tij,bpj->tbpi", turn, pairs)).astype(int)
    return turned[..., 0], turned[..., 1]


DX, DY = _layout()
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_MOMENTS = np.stack([np.where(_Y**2 + _X**2 <= RADIUS**2, side, 0).ravel() for side in (_Y, _X)], 1).astype(np.float32)


def _blur(values: np.ndarray) -> np.ndarray:
    """Mean over 3 x 3 values; beyond the edge stands the edge."""
    rows = np.empty_like(values)
    np.add(values[:-2], values[1:-1], out=rows[1:-1])
    rows[1:-1] += values[2:]
    rows[0], rows[-1] = 2 * values[0] + values[1], 2 * values[-1] + values[-2]
    out, flat = np.empty_like(values), rows.ravel()
    inner = out.ravel()[1:-1]  # whole rows at once, and then the first and last columns by themselves
    np.add(flat[:-2], flat[1:-1], out=inner)
    inner += flat[2:]
    out[:, 0], out[:, -1] = 2 * rows[:, 0] + rows[:, 1], 2 * rows[:, -1] + rows[:, -2]
    return np.divide(out, np.float32(9), out=out)


def _around(values: np.ndarray, reach: int) -> np.ndarray:
    """Largest value within ``reach`` rows and columns of each one that is as far from the sides, where a row runs on into the next."""
    beyond = np.full(reach * (values.shape[1] + 1), -np.inf, values.dtype)
    flat = np.concatenate([beyond, values.ravel(), beyond])
    for step in (values.shape[1], 1):
        n = 1
        while n < 2 * reach + 1:  # flat[i] is the largest of n values from i on
            more = min(n, 2 * reach + 1 - n)
            n, flat = n + more, np.maximum(flat[: -more * step], flat[more * step :])
    return flat.reshape(values.shape)


#: What is known of each corner: picture, place, size of a pixel there, orientation and bits.
POINT = np.dtype([("image", "i8"), ("x", "i4"), ("y", "i4"), ("scale", "i4"), ("turn", "i4"), ("bits", "i8", len(WORDS))])


def corners(images: list[np.ndarray], levels: int = 3) -> np.ndarray:
    """POINT rows of all corners of each level of the images' pyramids that are the strongest within APART pixels, image by image.

    Whether a corner is taken depends on its surroundings alone, so a crop keeps
    those of its part of the whole.  Images are laid one below the other on sheets
    of their width and about STRIP rows, and a tall one is cut into strips: beside
    the pixels, memory is that of a sheet.
    """
    found = []
    level = {i: image for i, image in enumerate(images)}
    for k in range(levels):
        level = {i: image for i, image in level.items() if min(image.shape) >= 2 * RADIUS + 3}
        halves = {i: [] for i in level}
        sheet, rows, width = [], 0, 0
        # (image, first and last row, first and last row with margin)
        for i in sorted(level, key=lambda i: (level[i].shape[1], i)):
            h, w = level[i].shape
            for top in range(0, h, STRIP):
                bottom = min(h, top + STRIP)
                part = (i, top, bottom, max(0, top - MARGIN), min(h, bottom + MARGIN))
                if sheet and (w != width or rows + bottom - top > STRIP):
                    found += _sheet(level, sheet, halves, k)
                    sheet, rows = [], 0
                sheet, rows, width = [*sheet, part], rows + bottom - top, w
        if sheet:
            found += _sheet(level, sheet, halves, k)
        level = {i: np.concatenate(parts) for i, parts in halves.items()}
    out = np.concatenate(found) if found else np.empty(0, POINT)
    return out[np.argsort(out["image"], kind="stable")]


def _sheet(level: dict[int, np.ndarray], parts: list[tuple[int, ...]], halves: dict[int, list[np.ndarray]], k: int) -> Iterator[np.ndarray]:
    """The corners of one sheet of level k; ``halves`` receives its parts at half the size."""
    # above and below each part stands its outermost row again, as beyond an edge
    sheet = np.concatenate([level[i][rows] for i, _, _, start, end in parts for rows in (slice(start, start + 1), slice(start, end), slice(end - 1, end))], dtype=np.float32)
    smooth = _blur(sheet)
    image_of, first = np.zeros(len(sheet), np.int64), np.zeros(len(sheet), np.int64)
    own, at = np.zeros(len(sheet), bool), 1
    for i, top, bottom, start, end in parts:
        zero = at - start  # the sheet's row of the image's row 0
        low, high = max(top, RADIUS + 1) + zero, min(bottom, len(level[i]) - RADIUS - 1) + zero
        if high > low:
            own[low:high], image_of[low:high], first[low:high] = True, i, zero
        rows = smooth[top + zero : top + zero + (bottom - top) // 2 * 2, : sheet.shape[1] // 2 * 2]
        pairs = rows[::2] + rows[1::2]
        halves[i].append((pairs[:, ::2] + pairs[:, 1::2]) * np.float32(0.25))
        at += end - start + 2
    for ys, xs, turn, bits in _corners(smooth, own):
        out = np.empty(len(ys), POINT)
        out["image"], out["x"], out["y"], out["scale"], out["turn"] = image_of[ys], xs << k, (ys - first[ys]) << k, 1 << k, turn
        out["bits"] = bits.view(">i8")
        yield out


def _corners(smooth: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, columns, turns, descriptors) of the corners in the rows marked in ``own``, all of which lie further from any edge than what they depend on."""
    edge, w = RADIUS + 1, smooth.shape[1]
    pixels = smooth.ravel()
    gx, gy = np.empty_like(smooth), np.empty_like(smooth)  # twice the slopes, so strength is 16 times as large
    np.subtract(pixels[2:], pixels[:-2], out=gx.ravel()[1:-1])
    gx[:, 0] = gx[:, -1] = gy[0] = gy[-1] = 0
    np.subtract(smooth[2:], smooth[:-2], out=gy[1:-1])
    a, b = _blur(gx * gx), _blur(gy * gy)
    gx *= gy
    c = _blur(gx)
    strength = a * b
    c *= c
    strength -= c
    a += b
    a *= a
    a *= np.float32(0.05)
    strength -= a
    peak = (strength > 16.0) & (strength >= _around(strength, APART)) & own[:, None]
    peak[:, :edge], peak[:, w - edge :] = False, False
    flat, sure = strength.ravel(), np.flatnonzero(peak)
    for dy in (-1, 0, 1):  # of equal neighbours the last one counts
        for dx in (-1, 0, 1):
            if (dy, dx) > (0, 0):
                sure = sure[flat[sure] > flat[sure + dy * w + dx]]
    patches = np.lib.stride_tricks.sliding_window_view(smooth, (2 * RADIUS + 1, 2 * RADIUS + 1))
    pairs = np.concatenate([DY[..., k] * w + DX[..., k] for k in (0, 1)], axis=1)
    for part in range(0, len(sure), 250):  # so that a sheet's patches aren't held at once
        at = sure[part : part + 250]
        moments = patches[at // w - RADIUS, at % w - RADIUS].reshape(len(at), -1) @ _MOMENTS
        turn = np.rint(np.arctan2(moments[:, 0], moments[:, 1]) / (2 * np.pi) * TURNS).astype(int) % TURNS
        points = pixels.take(at[:, None] + pairs[turn])
        yield at // w, at % w, turn, np.packbits(points[:, :BITS] < points[:, BITS:], axis=1)


def keypoints(image: np.ndarray, levels: int = 3) -> list[tuple[int, int, int, int, bytes]]:
    """(x, y, scale, turn, descriptor) of each of the image's corners."""
    return [(p["x"].item(), p["y"].item(), p["scale"].item(), p["turn"].item(), p["bits"].astype(">i8").tobytes()) for p in corners([image], levels)]


def _read(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, classes, POINT rows by number of the image) of some readable images at a time.

    Of equal images among them only the first has corners.
    """
    import xxhash

    def found(ids: list, images: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        c = np.array([xxhash.xxh3_64_intdigest(repr(i.shape).encode() + i.tobytes()) for i in images], np.uint64).astype(np.int64)
        first = set(np.unique(c, return_index=True)[1].tolist())
        return pa.concat_arrays(ids), c, corners([image if i in first else image[:0] for i, image in enumerate(images)])

    for batch in batches:
        ids, images, size = [], [], 0
        for i, data in enumerate(batch.column("data")):
            image = read(data.as_py())
            if image.size:
                ids.append(batch.column("id").slice(i, 1))
                images.append(image)
                size += image.size
            if size > 1 << 23:
                yield found(ids, images)
                ids, images, size = [], [], 0
        if images:
            yield found(ids, images)


def _lists(numbers: np.ndarray, n: int, fields: dict[str, np.ndarray]) -> pa.ListArray:
    """The fields as a list of structs for each of n images; ``numbers``, in order, tells whose each one is."""
    ends = np.searchsorted(numbers, np.arange(n + 1)).astype(np.int32)
    arrays = [pa.array(np.ascontiguousarray(v)) for v in fields.values()]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, list(fields)))


def _own(images: DataFrame, id_col: str, data_col: str) -> DataFrame:
    small_batches(images.sparkSession)
    empty = F.lit("").cast(images.schema[data_col].dataType)
    return images.select(F.col(id_col).alias("id"), F.coalesce(F.col(data_col), empty).alias("data"))


def index(images: DataFrame, id_col: str, data_col: str, read=decode) -> DataFrame:
    """(id, c, points): the class of each readable image's pixels, and its corners.

    Of equal images that a task meets in one batch only the first carries corners.
    """
    kind = images.schema[id_col].dataType.simpleString()
    point = ", ".join(["x: int", "y: int", "scale: int", "turn: int", *(f"{b}: bigint" for b in WORDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, c, points in _read(batches, read):
            fields = {k: points[k] for k in ("x", "y", "scale", "turn")} | {b: points["bits"][:, i] for i, b in enumerate(WORDS)}
            yield pa.RecordBatch.from_arrays([ids, pa.array(c), _lists(points["image"], len(c), fields)], ["id", "c", "points"])

    return _own(images, id_col, data_col).mapInArrow(run, f"id {kind}, c bigint, points array<struct<{point}>>")


def _bands(bits: np.ndarray) -> np.ndarray:
    """(BANDS, rows) values of the bands of 32 bits of descriptors."""
    halves = bits.view(np.uint64).reshape(len(bits), len(WORDS))
    return np.stack([(halves[:, b // 2] >> np.uint64(32 * (1 - b % 2))).astype(np.uint32) for b in range(BANDS)])


#: What a band's value is changed by to give itself and its neighbours of one other bit.
FLIPS = np.array([0, *(1 << i for i in range(32))], np.uint32)
#: Hash of each bit of a band's value; a value's hash is the sum modulo 2 of its bits'.
_KEYS = np.random.default_rng(7).integers(1 << 32, size=(4, 8), dtype=np.uint32)
_TABLES = np.array([[np.bitwise_xor.reduce(keys[[k for k in range(8) if byte >> k & 1]], initial=0) for byte in range(256)] for keys in _KEYS], np.uint32)


def _hash(values: np.ndarray) -> np.ndarray:
    """Hashes of which _hash(a ^ b) == _hash(a) ^ _hash(b) holds."""
    return _TABLES[0][values & 255] ^ _TABLES[1][values >> 8 & 255] ^ _TABLES[2][values >> 16 & 255] ^ _TABLES[3][values >> 24]


def _places(hashes: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """A filter's word (of 2 ** power), and the two bits in it, that stand for each hash."""
    other = hashes * np.uint32(0x85EBCA77) >> np.uint32(20)
    return hashes >> np.uint32(32 - power), np.uint64(1) << (other & np.uint32(63)).astype(np.uint64) | np.uint64(1) << (other >> np.uint32(6)).astype(np.uint64)


def _parts(n: int) -> list[tuple[np.dtype, tuple[int, ...]]]:
    """What a block of n points has: filter of all hashes near each band's, used slots, slots' starts, the points by hash of each band, points."""
    near, slots = (min(28, (n * k).bit_length()) for k in (3, 8))
    one = np.dtype(np.uint32)
    return [(np.dtype(np.uint64), (BANDS, 1 << near)), (np.dtype(bool), (BANDS, 1 << slots)), (one, (BANDS, (1 << slots) + 2)), (POINT, (n,)), (one, (BANDS, n))]


def _write_block(points: np.ndarray, path: str) -> None:
    parts = [np.zeros(shape, kind) for kind, shape in _parts(len(points))]
    near, used, starts, parts[3], order = *parts[:3], points, parts[4]
    power, slots = near.shape[1].bit_length() - 1, used.shape[1].bit_length() - 1
    for b, hashes in enumerate(_hash(_bands(np.ascontiguousarray(points["bits"])))):
        for flip in _hash(FLIPS):
            np.bitwise_or.at(near[b], *_places(hashes ^ flip, power))
        count = np.bincount(hashes >> np.uint32(32 - slots), minlength=1 << slots)
        used[b], starts[b, 1:-1], order[b] = count > 0, np.cumsum(count), np.argsort(hashes, kind="stable")
    files, place = pa.fs.FileSystem.from_uri(path)
    with files.open_output_stream(place) as out:
        for part in (np.array([len(points)]), *parts):
            out.write(np.ascontiguousarray(part).tobytes())


def _read_block(path: str) -> list[np.ndarray]:
    """The parts of a block; its file is mapped where the folder is a mounted one."""
    files, place = pa.fs.FileSystem.from_uri(path)
    if isinstance(files, pa.fs.LocalFileSystem):
        data = pa.memory_map(place).read_buffer()
    else:
        with files.open_input_file(place) as file:
            data = file.read_buffer()
    at, out = 8, []
    for kind, shape in _parts(np.frombuffer(data, np.int64, 1).item()):
        size = int(np.prod(shape))
        out.append(np.frombuffer(data, kind, size, at).reshape(shape))
        at += size * kind.itemsize
    return out


def _write_blocks(queries: DataFrame, folder: str) -> list[str]:
    """Paths of the blocks of the index of (c, points) rows; all points of a class are in one block."""
    pyarrow.fs.FileSystem.from_uri(shared_dir(queries.sparkSession))[0].create_dir(pyarrow.fs.FileSystem.from_uri(folder)[1])
    total = queries.agg(F.sum(F.size("points"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}"
            _write_block(np.concatenate(held), path)
            return pa.RecordBatch.from_pydict({"path": [path]})

        held, size = [], 0
        for row, c in ((batch.column("points").slice(i, 1).flatten(), c) for batch in batches for i, c in enumerate(batch.column("c").to_pylist())):
            own = np.empty(len(row), POINT)
            own["image"] = c
            for k in ("x", "y", "scale", "turn"):
                own[k] = row.field(k).to_numpy()
            for i, b in enumerate(WORDS):
                own["bits"][:, i] = row.field(b).to_numpy()
            held, size = [*held, own], size + len(own)
            if size >= 2 * BLOCK:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return [r["path"] for r in queries.select("c", "points").repartition(-(-total // BLOCK) or 1).mapInArrow(run, "path string").collect()]


def _candidates(hashes: np.ndarray, block: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(corner, band, first, number), by corner: slots of a band's hashes that hold all queries' values which differ from a corner's in one bit at most."""
    near, used, starts, _, _ = block
    power, shift, out = near.shape[1].bit_length() - 1, np.uint32(33 - used.shape[1].bit_length()), []
    flips = _hash(FLIPS) >> shift
    for b, own in enumerate(hashes):
        # beside what is near, the filter lets a few others through
        for part in range(0, len(own), 1 << 15):
            word, bits = _places(own[part : part + (1 << 15)], power)
            maybe = np.flatnonzero(near[b].take(word) & bits == bits) + part
            slot = ((own[maybe] >> shift)[:, None] ^ flips).ravel()
            met = np.flatnonzero(used[b].take(slot))
            slot = slot[met].astype(np.int64)
            first = starts[b].take(slot).astype(np.int64)
            out.append((maybe[met // len(FLIPS)], np.full(len(met), b), first, starts[b].take(slot + 1) - first))
    runs = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4
    order = np.argsort(runs[0], kind="stable")
    return tuple(x[order] for x in runs)


def _pairs(points: np.ndarray, c: np.ndarray, block: list[np.ndarray], runs: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(corner, query's corner) pairs that differ in NEAR bits at most, of different classes, of about PAIRS candidates at a time."""
    *_, asked, order = block
    corner, band, first, number = runs
    ends = np.cumsum(number)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + PAIRS if len(ends) else 0, PAIRS))).tolist()
    for start, end in zip(cuts, [*cuts[1:], len(ends)]):
        n = number[start:end]
        at = np.arange(n.sum()) + np.repeat(band[start:end] * len(asked) + first[start:end] - (np.cumsum(n) - n), n)
        p, q = np.repeat(corner[start:end], n), order.ravel().take(at).astype(np.int64)
        apart = np.zeros(len(p), np.uint8)
        for i in range(len(WORDS)):
            apart += np.bitwise_count((points["bits"][:, i].take(p) ^ asked["bits"][:, i].take(q)).view(np.uint64))
            near = np.flatnonzero(apart <= NEAR)
            p, q, apart = p[near], q[near], apart[near]
        near = c[points["image"][p]] != asked["image"][q]
        yield p[near], q[near]


def _cells(points: np.ndarray, asked: np.ndarray, p: np.ndarray, q: np.ndarray, cell: float) -> Iterator[np.ndarray]:
    """The cells of turn, scale and shift that the pairs vote for; by half a cell also the neighbours, so no cluster is cut."""
    p, q = points[p], asked[q]
    turned, ratio = (p["turn"] - q["turn"]) % TURNS, p["scale"] / q["scale"]
    angle = turned * (2 * np.pi / TURNS)
    cos, sin = np.cos(angle), np.sin(angle)
    dx, dy = p["x"] - ratio * (cos * q["x"] - sin * q["y"]), p["y"] - ratio * (cos * q["y"] + sin * q["x"])
    way = turned.astype(np.int64) * 8 + np.rint(np.log2(ratio)).astype(np.int64) + 4
    for i in (0, 1):
        for j in (0, 1):
            cx, cy = np.floor(dx / cell + i / 2).astype(np.int64), np.floor(dy / cell + j / 2).astype(np.int64)
            yield ((way * 4 + 2 * i + j) << 48) + ((cx + (1 << 23)) << 24) + cy + (1 << 23)


def _votes(points: np.ndarray, c: np.ndarray, block: list[np.ndarray], runs: tuple[np.ndarray, ...], votes: int, cell: float) -> np.ndarray:
    """(image, query's class, votes) rows with enough votes; where pairs are very many, cells are counted part by part."""
    asked, best = block[3], {}
    parts = -(-int(runs[3].sum()) // (4 * PAIRS))
    for part in range(parts):
        keys, pairs = [], _pairs(points, c, block, runs)
        if parts == 1:  # few pairs of images have enough pairs of corners at all
            p, q = (np.concatenate(x) for x in zip(*pairs))
            order = np.lexsort((asked["image"][q], points["image"][p]))
            p, q = p[order], q[order]
            image, qc = points["image"][p], asked["image"][q]
            starts = np.flatnonzero(np.r_[True, (image[1:] != image[:-1]) | (qc[1:] != qc[:-1])][: len(p)])
            n = np.diff(np.r_[starts, len(p)])
            enough = np.repeat(n >= votes, n)
            pairs = [(p[enough], q[enough])]
        for p, q in pairs:
            for at in _cells(points, asked, p, q, cell):
                mine = slice(None) if parts == 1 else (at ^ at >> 24) * 0x9E3779B1 % 1000003 % parts == part
                keys.append((points["image"][p[mine]], asked["image"][q[mine]], at[mine], q[mine]))
        image, qc, at, q = (np.concatenate(x) for x in zip(*keys)) if keys else (np.empty(0, np.int64),) * 4
        order = np.lexsort((q, at, qc, image))
        image, qc, at, q = image[order], qc[order], at[order], q[order]
        if not len(q):
            continue
        new = np.r_[True, (image[1:] != image[:-1]) | (qc[1:] != qc[:-1]) | (at[1:] != at[:-1])]
        voter = new | np.r_[True, q[1:] != q[:-1]]
        starts = np.flatnonzero(new)
        n = np.add.reduceat(voter.astype(np.int64), starts)
        for k in np.flatnonzero(n >= votes):
            key = image[starts[k]].item(), qc[starts[k]].item()
            best[key] = max(best.get(key, 0), n[k].item())
    return np.array(sorted((i, qc, n) for (i, qc), n in best.items()), np.int64).reshape(-1, 3)


def _hits(points: np.ndarray, c: np.ndarray, paths: list[str], votes: int, cell: float) -> np.ndarray:
    """(image, query's class, votes) rows of all blocks, by image; images are taken together up to PAIRS candidates."""
    hashes, out = _hash(_bands(np.ascontiguousarray(points["bits"]))), [np.empty((0, 3), np.int64)]
    for path in paths:
        block = _read_block(path)
        runs = _candidates(hashes, block)
        image = points["image"][runs[0]]
        ends = np.flatnonzero(np.r_[image[1:] != image[:-1], True]) + 1 if len(image) else []
        before, start, sums = 0, 0, np.cumsum(runs[3])
        for end, following in zip(ends, [*ends[1:], None]):
            if following is None or sums[following - 1] - before > PAIRS:
                out.append(_votes(points, c, block, tuple(x[start:end] for x in runs), votes, cell))
                start, before = end, sums[end - 1]
    out = np.concatenate(out)
    return out[np.argsort(out[:, 0], kind="stable")]


def find_copies(images: DataFrame, queries: DataFrame, *, id_col: str = "id", data_col: str = "data", votes: int = 8, cell: float = 24.0, read=decode) -> DataFrame:
    """(query, id, votes, is_same): images that are copies of the queries (ids), cropped, shifted, turned or edited in parts.

    ``votes``: keypoints of the query that agree on turn, scale and shift (to
    ``cell`` pixels).  Images of equal pixels are copies with ``is_same`` true.
    Null, empty and unreadable images match nothing; equal rows are one image; an
    empty table gives an empty result; other columns are not read.  ``read`` makes
    grey pixels of a cell of ``data_col``.
    """
    ids = queries.select(F.col(id_col).alias("id")).distinct()
    few = images.select(F.col(id_col).alias("id"), F.col(data_col).alias("data")).join(F.broadcast(ids), "id", "left_semi")
    few = write_shared(index(few, "id", "data", read), "media-queries")
    folder = f"{shared_dir(images.sparkSession)}/media-index-{uuid.uuid4().hex}"
    paths = _write_blocks(few.filter(F.size("points") > 0).dropDuplicates(["c"]), folder)
    kind = images.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, c, points in _read(batches, read):
            hits = _hits(points, c, paths, votes, cell)
            yield pa.RecordBatch.from_arrays([own, pa.array(c), _lists(hits[:, 0], len(c), {"qc": hits[:, 1], "votes": hits[:, 2]})], ["id", "c", "hits"])

    own = write_shared(_own(images, id_col, data_col).mapInArrow(run, f"id {kind}, c bigint, hits array<struct<qc: bigint, votes: bigint>>"), "media")
    files, place = pyarrow.fs.FileSystem.from_uri(folder)
    files.delete_dir(place)
    classes = own.select("id", "c").distinct()
    asked = few.select("id", "c").distinct()
    # a class may bring its votes once for each batch that holds it
    best = own.select("c", F.explode("hits").alias("h")).select("c", "h.qc", "h.votes").distinct()
    copies = best.join(asked.select(F.col("id").alias("query"), F.col("c").alias("qc")), "qc").join(classes, "c").select("query", "id", "votes", F.lit(False).alias("is_same"))
    same = asked.select(F.col("id").alias("query"), "c").join(classes, "c").filter("query != id").select("query", "id", F.lit(None).cast("long").alias("votes"), F.lit(True).alias("is_same"))
    return copies.unionByName(same).distinct()


def draw(text: str, columns: int = 24) -> np.ndarray:
    """A picture of a text: every word fills a tile with a pattern of its own."""
    words = " ".join(text.split()).encode().split()
    rows = max(1, -(-len(words) // columns))
    seeds = np.zeros(rows * columns, np.uint64)
    seeds[: len(words)] = list(map(zlib.crc32, words))
    seeds[: len(words)] |= np.uint64(1 << 32)
    shades = (seeds[:, None] * np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64) >> np.uint64(13)) & np.uint64(255)
    tiles = np.where(seeds[:, None] > 0, shades, 255).astype(np.uint8).reshape(rows, columns, 2, 2)
    return tiles.transpose(0, 2, 1, 3).reshape(2 * rows, 2 * columns).repeat(4, 1).repeat(4, 0)


def page_text(html: str = "html"):
    """What a page shows, as a Column: without tags, scripts, styles and navigation."""
    return F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<(script|style|nav|head)\b.*?</\1>|<[^>]*>", " ")
