"""The PNG codec against plain definitions, crops against slices of pixels, assets in the bundle."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import png
from folio.operators import figures, state
from folio.plans import flows
from folio.schemas import PAGES
from folio.sources import trees

RNG = np.random.default_rng(5)


def image(colour, rows, width, palette=None, depth=8, interlace=0):
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, interlace)
    return png.SIGNATURE + part(b"IHDR", head) + (part(b"PLTE", palette) if palette else b"") + part(b"tEXt", b"a\0b") + part(b"IDAT", zlib.compress(b"".join(rows))[:7]) + part(b"IDAT", zlib.compress(b"".join(rows))[7:]) + part(b"IEND", b"")


def plain(raw, width, samples):
    """Rows with their filter undone, byte by byte as the format defines it."""
    out, above = [], [0] * (width * samples)
    for line in raw:
        kind, row = line[0], list(line[1:])
        for i in range(len(row)):
            a = row[i - samples] if i >= samples else 0
            b, c = above[i], above[i - samples] if i >= samples else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[i] = (row[i] + (0, a, b, (a + b) // 2, near)[kind]) % 256
        out.append(row)
        above = row
    return np.array(out, np.uint8).reshape(len(raw), width, samples)


@pytest.mark.parametrize("colour", sorted(png.SAMPLES))
def test_every_filter_and_colour_type_is_read(colour):
    width, samples = 13, png.SAMPLES[colour]
    raw = [bytes([k % 5]) + RNG.integers(0, 256, width * samples, dtype=np.uint8).tobytes() for k in range(17)]
    expected = plain(raw, width, samples)
    palette = RNG.integers(0, 256, 768, dtype=np.uint8)
    got = png.decode(image(colour, raw, width, palette.tobytes()))
    if colour == png.PALETTE:
        expected = palette.reshape(-1, 3)[expected[:, :, 0]]
    elif samples < 3:
        expected = np.repeat(expected[:, :, :1], 3, axis=2)
    assert (got == expected[:, :, :3]).all()


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 0, 3, 1, 2)])
def test_what_is_written_is_read(filters):
    for shape in ((1, 1, 3), (1, 9, 3), (9, 1, 3), (31, 20, 3)):
        pixels = RNG.integers(0, 256, shape, dtype=np.uint8)
        assert (png.decode(png.encode(pixels, filters)) == pixels).all()


def test_damage_is_an_error():
    good = png.encode(RNG.integers(0, 256, (4, 4, 3), dtype=np.uint8))
    for bad in (b"", good[:-20], b"x" + good, good[:30] + bytes([good[30] ^ 1]) + good[31:], image(png.GREY, [b"\x05aa"], 2), image(png.GREY, [b"\0a"], 2), image(png.GREY, [b"\0a"], 1, depth=16), image(png.GREY, [b"\0a"], 1, interlace=1), image(png.PALETTE, [b"\0a"], 1)):
        with pytest.raises((ValueError, zlib.error)):
            png.decode(bad)


def test_crops_are_slices_and_reach_the_bundle(spark, tmp_path):
    pixels = RNG.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    figure = lambda box: ("figure", None, None, None, "C", None, False, False, box, None, None, None)
    blocks = [figure((0.1, 0.25, 0.5, 0.75)), figure(None), figure((0.9, 0.9, 0.2, 0.1)), figure((0.3, 0.3, 0.3, 0.9)), figure((0.1, 0.25, 0.5, 0.75))]
    rows = [("a", 0, "body", None, None, None, [], blocks), ("a", 1, "body", None, None, None, [], [figure((0.0, 0.0, 1.0, 1.0))]), ("a", 2, "body", None, None, None, [], [figure((0.0, 0.0, 1.0, 1.0))])]
    pages = state.with_block_ids(spark.createDataFrame(rows, PAGES))
    rasters = spark.createDataFrame([("a", 0, png.encode(pixels, (4, 3))), ("a", 1, b"not a picture at all, really"), ("b", 0, b"")], "book_id string, page_index int, image binary")
    cut = {(r.page_index, r.pos): r for r in figures.crops(pages, rasters).collect()}
    assert {k: r.problem for k, r in cut.items()} == {(0, 0): None, (0, 2): None, (0, 3): "degenerate-crop", (0, 4): None, (1, 0): "unreadable-raster"}
    assert (png.decode(cut[0, 0].content) == pixels[10:30, 5:25]).all() and (png.decode(cut[0, 2].content) == pixels[4:36, 10:45]).all()
    assert all(r.sha256 == hashlib.sha256(r.content).hexdigest() for r in cut.values() if r.content)
    done = figures.attached(pages, figures.crops(pages, rasters))
    assert [[b.asset_sha256 for b in r.blocks] for r in done.orderBy("page_index").collect()] == [[cut[0, 0].sha256, None, cut[0, 2].sha256, None, cut[0, 0].sha256], [None], [None]]
    assets = figures.crops(pages, rasters).filter("content IS NOT NULL").select("book_id", "sha256", "content")
    tree = flows.publish_trees(done, str(tmp_path / "out"), assets)[0].first().tree
    for sha in {cut[0, 0].sha256, cut[0, 2].sha256}:
        assert hashlib.sha256((tmp_path / "out/a" / tree / f"assets/{sha}.png").read_bytes()).hexdigest() == sha
    assert trees.problems(trees.books_below(spark, str(tmp_path / "out")), str(tmp_path / "out")).count() == 0
