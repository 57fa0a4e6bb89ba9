"""Small documents as the engine's tables, and the results of one run over many of them."""

from types import SimpleNamespace

from pagemend.plans.correct import correct
from pagemend.schema import PAGES

BRAND = "GalaxSea Freight Forwarding"
FOOTER = "411 S 1st Street - Chelan, WA 98816 - Fx# 509-888-0058"


def page_rows(numbered, document="d"):
    box = lambda b: None if b is None else dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True))
    return [(document, i, number, [{"text": x[0], "conf": float(x[1]), "box": box(x[2]) if len(x) > 2 else None} for x in lines]) for i, (number, lines) in enumerate(numbered)]


def pages(spark, numbered, document="d"):
    """numbered: [(page_number, [(text, conf) or (text, conf, box)])]"""
    return spark.createDataFrame(page_rows(numbered, document), PAGES)


def many(spark, documents):
    """documents: {document_id: numbered pages}"""
    return spark.createDataFrame([r for name, numbered in documents.items() for r in page_rows(numbered, name)], PAGES)


TABLES = {
    "changes": ("page_number", "kind", "old", "new"), "clusters": ("cluster_key", "n_pages", "can_vote"), "uncorrected": ("page_number", "text", "reason"),
    "disagreements": ("page_number", "text", "canonical", "kind"), "unresolved_non_ascii": ("page_number", "text"), "protected": ("guard", "before", "after"),
    "error_events": ("page_number", "pattern", "detail"),
}


def run(spark, documents, **options):
    """Every result by document: text {page: lines}, and a sorted list of rows for each table."""
    done = correct(many(spark, documents), **options)
    out = SimpleNamespace(done=done, text={d: {} for d in documents})
    for r in done.pages.collect():
        out.text[r.document_id][r.page_number] = list(r.corrected)
    for table, columns in TABLES.items():
        found = {d: [] for d in documents}
        for r in getattr(done, table).collect():
            found[r.document_id].append(tuple(r[c] for c in columns))
        setattr(out, table, {d: sorted(x) for d, x in found.items()})
    return out


def footer_doc(n, garble="41-- #--- # - - 058", conf=0.60):
    body = lambda i: [(BRAND, 0.99), ("SHIPMENT DETAILS", 0.99), (f"body value {i}", 0.99)]
    return [(i + 1, [*body(i), (FOOTER, 0.99)]) for i in range(n)] + [(99, [*body(99), (garble, conf)])]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
