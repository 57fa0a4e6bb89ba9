"""Searchable PDF: the source's pages with the invisible text layer appended. Needs pikepdf."""

from __future__ import annotations

import importlib.util
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import layered_pages, text_layer


def is_available() -> bool:
    return importlib.util.find_spec("pikepdf") is not None


def problem(path: str | None, pages: DataFrame) -> str:
    """Why no PDF can be written, or ''."""
    if not is_available():
        return "--pdf-out needs pikepdf"
    head = b""
    if path:
        with open(path, "rb") as f:
            head = f.read(4)
    if head != b"%PDF":
        return "--pdf-out appends a text layer to a source PDF; the input must be a PDF"
    boxed = pages.filter(F.exists("lines", lambda x: x["box"].isNotNull())).limit(1).count()
    return "" if boxed else "--pdf-out: recognizer returned no boxes; skipping"


def streams(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(document_id, page_ord, stream) for sizes (document_id, page_ord, width_px, height_px, page_width, page_height)."""
    both = layered_pages(pages).join(sizes, ["document_id", "page_ord"])
    stream = text_layer(F.col("layer"), F.col("page_height"), F.col("page_width") / F.col("width_px"), F.col("page_height") / F.col("height_px"))
    return both.select("document_id", "page_ord", stream.alias("stream"))


def write_if_possible(path: str, source: str | None, pages: DataFrame) -> None:
    """One document's PDF, or a message why not. Boxes are taken to be in the largest image's pixels of each page."""
    if why := problem(source, pages):
        print(why, file=sys.stderr)
        return
    import pikepdf

    with pikepdf.open(source) as book:
        spark = pages.sparkSession
        (doc,) = {r.document_id for r in pages.select("document_id").distinct().limit(2).collect()}
        sizes = []
        for i, page in enumerate(book.pages):
            x0, y0, x1, y1 = (float(v) for v in page.MediaBox)
            images = [(int(m.Width), int(m.Height)) for m in page.images.values()]
            wide, high = max(images, default=(x1 - x0, y1 - y0))
            sizes.append((doc, i, float(wide), float(high), x1 - x0, y1 - y0))
        table = spark.createDataFrame(sizes, "document_id string, page_ord int, width_px double, height_px double, page_width double, page_height double")
        for row in streams(pages, table).orderBy("page_ord").toLocalIterator():
            page = book.pages[row.page_ord]
            font = book.make_indirect(pikepdf.Dictionary(Type=pikepdf.Name.Font, Subtype=pikepdf.Name.Type1, BaseFont=pikepdf.Name.Helvetica))
            page.obj.setdefault("/Resources", pikepdf.Dictionary())
            page.Resources.setdefault("/Font", pikepdf.Dictionary())
            page.Resources.Font.F1 = font
            page.contents_add(pikepdf.Stream(book, row.stream.encode("latin-1", "replace")), prepend=False)
        book.save(path)
