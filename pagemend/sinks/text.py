"""Corrected documents as text, review files, and the invisible text layer of a page."""

from __future__ import annotations

import csv
import json
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemend.operators.review import review_order
from pagemend.schema import REVIEW_COLUMNS

# Fixed values of the formats.
PAGE_GAP = "\n\n\n"
RENDER_MODE = 3
LEAST_FONT = 4.0
FONT_SHARE = 0.9


def page_texts(pages: DataFrame) -> DataFrame:
    """(document_id, page_ord, page_number, body): a marker, then the corrected lines."""
    marker = F.concat(F.lit("=== page "), F.col("page_number").cast("string"), F.lit(" ==="))
    return pages.select("document_id", "page_ord", "page_number", F.concat(marker, F.lit("\n"), F.array_join("corrected", "\n")).alias("body"))


def assembled(pages: DataFrame) -> DataFrame:
    """(document_id, page_ord, page_number, start, body): where in its document's text each page's body lies.

    The text is the bodies by page number, two blank lines apart; a document is never one row.
    """
    bodies = page_texts(pages).withColumn("n", F.length("body").cast("long"))
    before = Window.partitionBy("document_id").orderBy("page_number", "page_ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + len(PAGE_GAP)).over(before), F.lit(0))
    places = bodies.select("document_id", "page_ord", "page_number", "n").withColumn("start", start).drop("n")  # numbers only
    return bodies.drop("n").join(places, ["document_id", "page_ord", "page_number"]).select("document_id", "page_ord", "page_number", "start", "body")


def stream_text(pages: DataFrame, out) -> int:
    """The text of one document to an open file, page by page; the driver holds one partition at most. Returns its pages."""
    n = 0
    for row in page_texts(pages).orderBy("document_id", "page_number", "page_ord").toLocalIterator():
        out.write((PAGE_GAP if n else "") + row.body)
        n += 1
    out.write("\n")
    return n


def write_texts(pages: DataFrame, folder: str) -> None:
    """A folder of text files for each document: its part files in the order of their names are the text."""
    last = F.lead("page_number").over(Window.partitionBy("document_id").orderBy("page_number", "page_ord")).isNull()
    flagged = pages.select("document_id", "page_ord", "page_number").withColumn("__last", last)  # numbers only
    bodies = page_texts(pages).join(flagged, ["document_id", "page_ord", "page_number"])
    value = F.when(F.col("__last"), F.col("body")).otherwise(F.concat("body", F.lit(PAGE_GAP[1:])))  # the writer ends each row's line
    rows = bodies.select("document_id", "page_number", "page_ord", value.alias("value"))
    parts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "document_id", "page_number", "page_ord").sortWithinPartitions("document_id", "page_number", "page_ord")
    ordered.select("document_id", "value").write.partitionBy("document_id").text(folder)


def delimiter_for(path: str) -> str:
    """Commas for names in .csv, else tabs."""
    return {".csv": ","}.get(PurePath(path).suffix.lower(), "\t")


def write_review(rows: DataFrame, path: str) -> int:
    """One review file in order; rows are streamed to it, so the driver holds one partition at most."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, delimiter=delimiter_for(path), lineterminator="\n")
        writer.writerow(REVIEW_COLUMNS)
        for row in rows.orderBy(*review_order()).select(*REVIEW_COLUMNS).toLocalIterator():
            writer.writerow(list(row))
            n += 1
    return n


def write_profile(profile: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(json.loads(profile), out, indent=2, sort_keys=True)
        out.write("\n")


def escape_literal(c) -> Column:
    for special in ("\\", "(", ")"):
        c = F.replace(c, F.lit(special), F.lit("\\" + special))
    return c


def text_layer(lines, page_height, scale_x, scale_y) -> Column:
    """Drawing operators of one page: lines is an array of (text, box), boxes in image pixels.

    Lines without text or box are left out; the vertical axis is flipped; characters beyond
    Latin-1 become question marks.
    """
    number = lambda x: F.call_function("format_number", x, F.lit("0.0"))
    shown = F.filter(lines, lambda x: (x["text"] != "") & x["box"].isNotNull())

    def ops(x):
        box = x["box"]
        size = F.greatest(F.lit(LEAST_FONT), (box["y1"] - box["y0"]) * scale_y * FONT_SHARE)
        return F.concat(
            F.lit("/F1 "), number(size), F.lit(" Tf\n1 0 0 1 "), number(box["x0"] * scale_x), F.lit(" "), number(page_height - box["y1"] * scale_y),
            F.lit(" Tm\n("), escape_literal(x["text"]), F.lit(") Tj"),
        )

    body = F.concat(F.array(F.lit("BT"), F.lit(f"{RENDER_MODE} Tr")), F.transform(shown, ops), F.array(F.lit("ET")))
    return F.regexp_replace(F.array_join(body, "\n"), r"[^\x00-\xFF]", "?")


def layered_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_ord, page_number, layer): corrected texts with the boxes of their lines, by position."""
    paired = F.transform("lines", lambda x, i: F.struct(F.coalesce(F.get("corrected", i), x["text"]).alias("text"), x["box"].alias("box")))
    return pages.select("document_id", "page_ord", "page_number", paired.alias("layer"))
