import struct
import zlib

import numpy as np

from quillspark.llm.media import TURNS, decode, draw, find_copies, keypoints, page_text


def pgm(image):
    return b"P5 %d %d 255\n" % image.shape[::-1] + image.astype(np.uint8).tobytes()


def png(image):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    h, w = image.shape
    raw = b"".join(b"\x02" + (row - above).astype(np.uint8).tobytes() for row, above in zip(image.astype(int), np.vstack([np.zeros((1, w), int), image[:-1].astype(int)])))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed, h=160, w=200):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (h // 8, w // 8)).repeat(8, 0).repeat(8, 1).astype(np.uint8)


def test_decode():
    image = picture(1)
    assert np.array_equal(decode(pgm(image)), image) and np.array_equal(decode(png(image)), image)
    assert decode(b"").size == decode(b"P5 9").size == decode(b"\x89PNG\r\n\x1a\njunk").size == 0
    assert keypoints(decode(b"P5 4 4 255\n" + b"\0" * 16)) == []


def test_copies(spark):
    rows = [(i, pgm(picture(i))) for i in range(1, 40)]
    base = picture(0)
    edited = base.copy()
    edited[40:90, 50:120] = 0
    rows += [(0, pgm(base)), (1000, pgm(base[16:, 24:])), (1001, pgm(base[:120, :150])), (1002, pgm(edited)), (1003, png(base)), (1004, None), (1005, b"junk"), (1006, pgm(np.rot90(base))), (1007, pgm(np.clip(base * 0.8 + 20, 0, 255))), (0, pgm(base))]
    images = spark.createDataFrame(rows, "id long, data binary").repartition(4)
    got = {r["id"]: r for r in find_copies(images, images.filter("id = 0")).collect()}
    assert {1000, 1001, 1002, 1003, 1007} <= got.keys() <= {1000, 1001, 1002, 1003, 1006, 1007}
    assert got[1003]["is_same"] and not got[1000]["is_same"]


def test_empty_and_pages(spark):
    none = spark.createDataFrame([], "id long, data binary")
    assert find_copies(none, none).count() == 0
    words = " ".join(f"w{i}" for i in range(300))
    pages = spark.createDataFrame([(0, f"<p>{words}</p>"), (1, f"<html><p>{words}</p> more words here"), (2, f"<p>{' '.join(f'v{i}' for i in range(300))}"), (3, None), (4, "")], "page_id long, html string")
    pages = pages.select("page_id", page_text().alias("shown"))
    got = {(r["query"], r["id"]) for r in find_copies(pages, pages.filter("page_id = 0"), id_col="page_id", data_col="shown", read=draw).collect()}
    assert got == {(0, 1)}


def brute_copies(images, queries, near=7, votes=8, cell=24.0):
    """{(query, id)} by comparing every descriptor with every other one."""
    points = {i: keypoints(decode(data)) for i, data in images.items()}
    bits = {i: np.unpackbits(np.frombuffer(b"".join(p[4] for p in own), np.uint8).reshape(-1, 16), axis=1).astype(np.float32) for i, own in points.items() if own}
    out = set()
    for q in queries:
        for i in bits:
            if images[i] == images[q]:
                continue
            apart = bits[q] @ (1 - bits[i]).T + (1 - bits[q]) @ bits[i].T
            cells = {}
            for a, b in zip(*np.nonzero(apart <= near)):
                (qx, qy, qs, qt, _), (x, y, s, t, _) = points[q][a], points[i][b]
                turned, ratio = (t - qt) % TURNS, s / qs
                angle = turned * 2 * np.pi / TURNS
                dx, dy = x - ratio * (np.cos(angle) * qx - np.sin(angle) * qy), y - ratio * (np.cos(angle) * qy + np.sin(angle) * qx)
                for j in (0, 1):
                    for k in (0, 1):
                        at = (turned, ratio, j, k, np.floor(dx / cell + j / 2), np.floor(dy / cell + k / 2))
                        cells.setdefault(at, set()).add((qx, qy, qs))
            if max(map(len, cells.values()), default=0) >= votes:
                out.add((q, i))
    return out


def turned(image, degrees):
    """The picture turned by any angle, between pixels by the mean of four, on a larger grey ground."""
    h, w = image.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    height, width = int(abs(h * c) + abs(w * s)), int(abs(w * c) + abs(h * s))
    y, x = np.mgrid[:height, :width]
    y, x = y - height / 2, x - width / 2
    sx, sy = c * x + s * y + w / 2 - 0.5, c * y - s * x + h / 2 - 0.5
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < w - 1) & (y0 < h - 1)
    fx, fy, x0, y0 = sx - x0, sy - y0, x0.clip(0, w - 2), y0.clip(0, h - 2)
    at = lambda a, b: image[y0 + a, x0 + b].astype(float)
    value = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.where(inside, value, 128)


def altered():
    """Pictures 0 to 11, and a cropped, a noisy, a halved, a turned and an edited copy of each: id 100 * k + picture."""
    rng = np.random.default_rng(5)
    images = {}
    for i in range(12):
        base = picture(i, 240, 304)
        noisy = np.clip(base + rng.normal(0, 60, base.shape), 0, 255)
        halved = base.reshape(120, 2, 152, 2).mean((1, 3)) + rng.normal(0, 40, (120, 152))
        images |= {i: pgm(base), 100 + i: pgm(base[51:181, 37:207]), 200 + i: pgm(noisy), 300 + i: pgm(np.clip(halved, 0, 255))}
        edited = base.copy()
        edited[60:150, 80 : 90 + 10 * i] = 0
        images |= {400 + i: pgm(np.clip(turned(base, 30 * i + 5.6 + i), 0, 255)), 500 + i: pgm(edited)}
    return images


def test_recall_of_altered_copies(spark):
    images = altered()
    frame = spark.createDataFrame([(i, bytes(d)) for i, d in images.items()], "id long, data binary").repartition(4)
    got = {(r["query"], r["id"]) for r in find_copies(frame, frame.filter("id < 100")).collect()}
    assert got == brute_copies(images, range(12))
    for kind in (1, 2, 3, 4, 5):
        assert sum((i, 100 * kind + i) in got for i in range(12)) >= 0.9 * 12


def test_strips_give_what_the_whole_gives(monkeypatch):
    from quillspark.llm import media

    whole = keypoints(picture(3, 1000, 192))
    monkeypatch.setattr(media, "STRIP", 64)
    assert sorted(keypoints(picture(3, 1000, 192))) == sorted(whole) and len(whole) > 1000


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(0, pgm(picture(0)), "x"), (0, pgm(picture(0)), "x"), (7, pgm(picture(0)), "y"), (None, pgm(picture(0)[16:, 24:]), "z"), (None, None, None), (8, pgm(np.zeros((80, 80))), "w"), (9, pgm(np.zeros((80, 80))), "w")]
    images = spark.createDataFrame(rows, "id long, data binary, votes string").repartition(3)
    got = find_copies(images, images.filter("id IN (0, 8)")).collect()
    assert sorted(map(str, ((r["query"], r["id"], r["is_same"]) for r in got))) == sorted(map(str, [(0, 7, True), (0, None, False), (8, 9, True)]))


def test_corners_are_as_dense_in_a_large_picture():
    strong = [len(keypoints(picture(3, h, 192).astype(np.float32))) for h in (400, 4000)]
    assert strong[1] > 9 * strong[0]


def test_a_small_crop_of_a_very_tall_page(spark):
    words = [f"{w}{i % 977}" for i, w in enumerate(["alpha", "beta", "gamma", "delta", "eps"] * 1034)][:5169]
    whole = draw(" ".join(words))
    assert whole.shape == (1728, 192)
    crops = {k + 1: whole[y : y + 172] for k, y in enumerate(range(3, 1500, 187))}
    crops[20] = whole[801:880, 31:161]
    rows = [(i, pgm(p)) for i, p in {0: whole, 99: picture(8, 1728, 192), **crops}.items()]
    images = spark.createDataFrame(rows, "id long, data binary").repartition(4)
    got = {(r["query"], r["id"]) for r in find_copies(images, images.filter("id != 99")).collect()}
    assert {(0, i) for i in crops} | {(i, 0) for i in crops} <= got and not any(99 in pair for pair in got)


def test_pictures_of_a_sheet_give_what_each_gives_alone():
    from quillspark.llm.media import corners

    images = [picture(k, h, w) for k, (h, w) in enumerate([(160, 200), (40, 192), (2200, 192), (26, 26), (90, 192), (27, 200), (160, 200)])]
    images = [*images[:4], np.zeros((0, 0), np.uint8), *images[4:]]
    together = corners(images)
    assert np.all(np.diff(together["image"]) >= 0)
    for i, image in enumerate(images):
        assert sorted(together[together["image"] == i][["x", "y", "scale", "turn"]].tolist()) == sorted(p[:4] for p in keypoints(image))


def test_what_is_written_follows_the_queries(spark, tmp_path):
    from pathlib import Path

    from quillspark.llm import media
    from quillspark.llm.common import shared_dir

    written = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file://")).rglob("*") if p.is_file())
    images = {i: pgm(picture(i)) for i in range(60)} | {100: pgm(picture(0)[16:, 24:])}
    frame, before = spark.createDataFrame([(i, bytes(d)) for i, d in images.items()], "id long, data binary").repartition(4), written()
    assert [(r["query"], r["id"]) for r in find_copies(frame, frame.filter("id = 0")).collect()] == [(0, 100)]
    points = media.corners([decode(d) for d in images.values()])
    assert written() - before < 8 * len(points)
    media._write_block(points, f"{tmp_path}/block")
    assert Path(tmp_path, "block").stat().st_size < 700 * len(points)


def test_blocks_and_parts_give_what_brute_force_gives(monkeypatch, tmp_path):
    from quillspark.llm import media

    images = dict(sorted(altered().items()))
    points = media.corners([decode(d) for d in images.values()])
    c = 1 - np.array(list(images)) * 10**15
    asked = points[points["image"] < 12]
    asked["image"] = c[asked["image"]]
    media._write_block(asked, f"{tmp_path}/all")
    bits, block = media._hash(media._bands(np.ascontiguousarray(points["bits"]))), media._read_block(f"{tmp_path}/all")
    got = {pair for p, q in media._pairs(points, c, block, media._candidates(bits, block)) for pair in zip(p.tolist(), q.tolist())}
    spread = [np.unpackbits(np.ascontiguousarray(x["bits"]).view(np.uint8), axis=1).astype(np.float32) for x in (points, asked)]
    apart = spread[0] @ (1 - spread[1]).T + (1 - spread[0]) @ spread[1].T
    want = (apart <= media.NEAR) & (c[points["image"]][:, None] != asked["image"])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(want)))) and len(got) > 10000

    whole = media._hits(points, c, [f"{tmp_path}/all"], 8, 24.0)
    half = asked["image"] > c[6]
    for name, part in (("a", asked[half]), ("b", asked[~half])):
        media._write_block(part, f"{tmp_path}/{name}")
    monkeypatch.setattr(media, "PAIRS", 500)
    for paths in (["all"], ["a", "b"]):
        hits = media._hits(points, c, [f"{tmp_path}/{name}" for name in paths], 8, 24.0)
        assert sorted(hits.tolist()) == sorted(whole.tolist()) and len(whole) >= 0.9 * 60
    assert not len(media._hits(points[:0], c, [f"{tmp_path}/all"], 8, 24.0)) and not len(media._hits(points, c, [], 8, 24.0))
