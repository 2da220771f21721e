"""Figures cut out of their pages' rasters: assets named by hash, attached to their blocks.

Figures with a box are joined with the raster of their page; a task decodes one page at a time and
cuts all of its figures. A box that covers no pixel, or a raster that cannot be read, gives a row
with a problem instead of a picture. Figures without a box stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import png

CROPS = "book_id string, page_index int, pos int, sha256 string, content binary, problem string"


def _side(image: Column, at: int) -> Column:
    """A side of a PNG image in pixels, from its header."""
    return F.conv(F.hex(F.substring(image, at, 4)), 16, 10).cast("int")


def crops(pages: DataFrame, rasters: DataFrame) -> DataFrame:
    """CROPS: one row per figure with a box whose page has a raster (book_id, page_index, image: PNG)."""
    at = F.transform("blocks", lambda b, i: F.struct(i.alias("pos"), b["kind"].alias("kind"), b["bbox"].alias("bbox")))
    boxed = F.filter(at, lambda x: (x["kind"] == "figure") & x["bbox"].isNotNull())
    wanted = pages.select("book_id", "page_index", boxed.alias("figures")).filter(F.size("figures") > 0).join(rasters.select("book_id", "page_index", "image"), ["book_id", "page_index"])
    sized = wanted.withColumns({"_w": _side(F.col("image"), 17), "_h": _side(F.col("image"), 21)})
    cut = F.transform("figures", lambda x: F.struct(x["pos"].alias("pos"), G.crop(G.pixels(x["bbox"], F.col("_w"), F.col("_h")), F.col("_w"), F.col("_h")).alias("r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                book, page, image, figures = (batch.column(k)[row].as_py() for k in range(4))
                out = []
                try:
                    pixels = png.decode(image)
                except Exception:  # noqa: BLE001  a damaged raster is a row, whatever the decoder met
                    pixels = None
                for figure in figures:
                    r = figure["r"]
                    if pixels is None or r is None:
                        out.append((book, page, figure["pos"], None, None, "unreadable-raster" if pixels is None else "degenerate-crop"))
                        continue
                    content = png.encode(pixels[r["y0"] : r["y1"], r["x0"] : r["x1"]])
                    out.append((book, page, figure["pos"], hashlib.sha256(content).hexdigest(), content, None))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CROPS.split(", ")])

    return sized.select("book_id", "page_index", "image", cut.alias("cuts")).mapInArrow(run, CROPS)


def attached(pages: DataFrame, cut: DataFrame) -> DataFrame:
    """Pages whose figures name the assets that were cut for them."""
    names = cut.filter("sha256 IS NOT NULL").groupBy("book_id", "page_index").agg(F.map_from_entries(F.collect_list(F.struct("pos", "sha256"))).alias("_assets"))
    named = F.transform("blocks", lambda b, i: b.withField("asset_sha256", F.coalesce(F.try_element_at(F.col("_assets"), i), b["asset_sha256"])))
    return pages.join(names, ["book_id", "page_index"], "left").withColumn("blocks", F.when(F.col("_assets").isNull(), F.col("blocks")).otherwise(named)).drop("_assets")
