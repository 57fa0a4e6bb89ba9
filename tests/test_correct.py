"""The correction chain on small documents whose right results are known.

Documents are corrected together, as the engine does; each test looks at its own.
"""

import pytest
from pyspark.sql import functions as F

from pagemend.operators import canon, errors, fold, lexical
from pagemend.operators.cluster import cluster_info, cluster_pages
from pagemend.schema import NO_CANONICAL, NO_SUPPORT, lines_of, pages_of
from tests.fixtures import BRAND, FOOTER, footer_doc, many, pages, rows, run

STANDING = f"Please Wire payment to: {BRAND}"
CANON = "(include an additional $35 wire fee if paying by wire"
GARBLE = "(include an additional $35 wireLfed if pa85byU@84191"
SLIPS = ["Sitka. AK 99835", "invoice Terms", "SHIPPING WORL.DWIDE", "ABA#'325081403"]
RIGHT = ["Sitka, AK 99835", "Invoice Terms", "SHIPPING WORLDWIDE", "ABA# 325081403"]


def consensus_doc(conf=0.82):
    page = lambda i, fifth, sixth: (i, [(f"opening remark {i}", 0.99), (f"page note {i}", 0.99), (f"third {i}", 0.98), (f"fourth {i}", 0.97), fifth, sixth, *[(f"{c} {i}", 0.99) for c in "bcd"], (f"end {i}", 0.99)])
    clean = [page(i, (STANDING, 0.99), (f"a {i}", 0.99)) for i in range(1, 7)]
    return [*clean, page(7, ("Please Wire payment to: GaTxSea 4g Fbwd3", conf), ("body value 999 (rare wording)", 0.70))]


def disagree_doc(tagline="SHIPPING WOALDWIDE", n=8, fee="Forwarding Fee  $105.00"):
    page = lambda i, t, c, f: (i, [(BRAND, 0.99), (t, c), ("SHIPMENT DETAILS", 0.99), (f"Sailing Date: 0{1 + i % 8}/1{i % 9}/2024", 0.99), (f, 0.99)])
    return [page(i, "SHIPPING WORLDWIDE", 0.99, f"Forwarding Fee  ${90 + i}.00") for i in range(1, n + 1)] + [page(99, tagline, 0.96, fee)]


def typography_doc(lines):
    return [(i, [(t, 0.99) for t in RIGHT]) for i in range(1, 13)] + [(99, [(t, 0.97) for t in lines])]


def figures_doc(conf):
    page = lambda i, t, c, f, fc: (i, [(BRAND, 0.99), (t, c), ("SHIPMENT DETAILS", 0.99), (f, fc)])
    return [page(i, CANON, 0.99, f"Forwarding Fee and Handling  $9{i}.00", 0.99) for i in range(1, 7)] + [page(99, GARBLE, conf, "Forwarding Fee and Handling  $105.00", 0.62)]


def accent_doc(plain, accented):
    a, b = "Port of Loading: Zurich, Switzerland", "Port of Loading: Zürich, Switzerland"
    return [(i, [(a, 0.99)]) for i in range(plain)] + [(100 + i, [(b, 0.99)]) for i in range(accented)]


def lexicon_doc(*lines):
    words = [("Valdez", 5), ("Seattle", 4), ("Forwarding", 4), ("SEGU", 3), ("Booking", 4)]
    return [(1, [*[(w, 0.99) for w, n in words for _ in range(n)], *[(x, 0.7) for x in lines]])]


def prefixes():
    return [(i, [("SHIPMENT DETAILS", 0.99), ("SEGU", 0.99)]) for i in range(1, 7)] + [(99, [("SHIPMENT DETAILS", 0.99), ("SEKU", 0.62)])]


def cosmetic_doc():
    wide = FOOTER.replace(" - ", "  -  ")
    return [*footer_doc(4), (98, [(BRAND, 0.99), ("SHIPMENT DETAILS", 0.99), ("body value 98", 0.99), (wide, 0.62)])]


def variable_doc():
    doc = footer_doc(4)
    doc[-1][1][2] = ("zzz qqq", 0.5)
    return doc


DOCUMENTS = {
    "small": footer_doc(2), "footer": footer_doc(4), "cosmetic": cosmetic_doc(), "consensus": consensus_doc(), "gated": consensus_doc(0.99),
    "disagree": disagree_doc(), "rare": disagree_doc(n=2), "typography": typography_doc(SLIPS),
    "replaced": typography_doc([RIGHT[0], RIGHT[1], "SHIPPING WORL.WIDE", RIGHT[3]]), "misread": typography_doc([RIGHT[0], RIGHT[1], "SHIPPING WORLOWIDE", RIGHT[3]]),
    "figures": figures_doc(0.62), "sure figures": figures_doc(0.97), "accent": accent_doc(40, 1), "accents": accent_doc(0, 40), "prepaid": [(1, [("Prépaid", 0.99)]), (2, [("other line", 0.99)])],
    "lexicon": lexicon_doc("near  Va1dez now", "Forwardng Fee $246.00", "Forwardng UL7792815", "SEKU"), "prefix": prefixes(), "blank": [(1, []), (2, [("x", 0.99)])], "variable": variable_doc(),
}


@pytest.fixture(scope="module")
def out(spark):
    return run(spark, DOCUMENTS)


def test_small_cluster_refuses(out):
    assert out.changes["small"] == []
    assert out.clusters["small"] == [("A", 3, False)]
    assert out.uncorrected["small"] == [(99, "41-- #--- # - - 058", NO_SUPPORT)]


def test_footer_is_restored(out):
    assert out.text["footer"][99][3] == FOOTER
    assert out.changes["footer"] == [(99, "boilerplate", "41-- #--- # - - 058", FOOTER)]
    assert out.uncorrected["footer"] == []


def test_every_line_stays(out):
    lines = sum(len(x) for d in DOCUMENTS.values() for _, x in d)
    assert out.done.lines.count() == lines
    assert all([p for p, _ in d] == sorted(out.text[name], key=[p for p, _ in d].index) for name, d in DOCUMENTS.items())


def test_cosmetic_edit_is_dropped(out):
    assert [c for c in out.changes["cosmetic"] if c[0] == 98] == []
    assert [u[0] for u in out.uncorrected["cosmetic"]] == [98]


def test_prefix_recovery(out):
    assert out.text["consensus"][7][4:6] == [STANDING, "body value 999 (rare wording)"]
    assert out.clusters["consensus"] == [("?", 7, True)]


def test_confident_lines_are_not_voted_on(out):
    assert out.text["gated"][7][4] == "Please Wire payment to: GaTxSea 4g Fbwd3"


def test_confident_disagreement_is_flagged(out):
    assert out.disagreements["disagree"] == [(99, "SHIPPING WOALDWIDE", "SHIPPING WORLDWIDE", "disagrees")]
    assert out.text["disagree"][99][1] == "SHIPPING WOALDWIDE" and out.changes["disagree"] == []
    assert out.disagreements["rare"] == []


def test_typography_is_adopted(out):
    assert out.text["typography"][99] == RIGHT
    assert {k for _, k, _, _ in out.changes["typography"]} == {"typography"}
    assert out.disagreements["typography"] == []


@pytest.mark.parametrize(("name", "slip"), [("replaced", "SHIPPING WORL.WIDE"), ("misread", "SHIPPING WORLOWIDE")])
def test_letters_are_never_adopted(out, name, slip):
    assert out.text[name][99][2] == slip
    assert out.disagreements[name] == [(99, slip, "SHIPPING WORLDWIDE", "disagrees")]


def test_invariant_figure_is_restored(out):
    assert out.text["figures"][99][1] == CANON
    assert out.text["figures"][99][3] == "Forwarding Fee and Handling  $105.00"
    assert out.text["sure figures"][99][1] == GARBLE
    assert (99, GARBLE, CANON, "disagrees") in out.disagreements["sure figures"]


def test_folding_needs_evidence(out):
    assert [k for _, k, _, _ in out.changes["accent"]] == ["ascii"]
    assert out.changes["accents"] == [] and out.unresolved_non_ascii["accents"] == []
    assert out.unresolved_non_ascii["prepaid"] == [(1, "Prépaid")]


def test_lexicon_repair_and_guards(out):
    assert out.text["lexicon"][1][-4:] == ["near Valdez now", "Forwardng Fee $246.00", "Forwardng UL7792815", "SEGU"]
    assert out.protected["lexicon"] == [("identifier", "Forwardng UL7792815", "Forwarding UL7792815"), ("numeric", "Forwardng Fee $246.00", "Forwarding Fee $246.00")]


def test_page_without_lines(out, spark):
    assert out.text["blank"] == {1: [], 2: ["x"]}
    assert out.clusters["blank"] == [("?", 2, False)]
    doc = pages(spark, DOCUMENTS["blank"])
    assert pages_of(lines_of(doc), doc).orderBy("page_ord").collect() == doc.orderBy("page_ord").collect()


def test_reason_without_canonical(out):
    assert out.uncorrected["variable"] == [(99, "zzz qqq", NO_CANONICAL)]
    assert out.text["prefix"][99][1] == "SEGU"


def patterns(spark, wrong, right):
    vocabulary = errors.known_entries(spark.createDataFrame(list(enumerate(right)), "ord int, term string"))
    return errors.compile_patterns(errors.resolve(errors.patterns_table(spark, wrong), vocabulary))


def test_options(spark):
    routes = [(i, [("SHIPMENT DETAILS", 0.99), (f"Routing: SEA/KOD/TA{i}", 0.99)]) for i in range(1, 6)] + [(99, [("SHIPMENT DETAILS", 0.99), ("Routing: SEA/KOO/TAO via XYZQ", 0.96)])]
    docs = {"routes": routes, "accents": accent_doc(0, 5), "typography": typography_doc(SLIPS), "prefix": prefixes(), "lexicon": lexicon_doc("SEKU")}
    got = run(spark, docs, known=["seku"], error_patterns=patterns(spark, ["KOO", "XYZQ"], ["KOD", "Seattle"]), typography=False, ascii_mode="force")
    assert got.text["routes"][99][1] == "Routing: SEA/KOD/TAO via XYZQ"
    assert [k for _, k, _, _ in got.changes["routes"]] == ["errorfix"]
    assert got.error_events["routes"] == [(99, "XYZQ", "nearest known pattern is 4 edits away (budget 1)")]
    assert [k for _, k, _, _ in got.changes["accents"]] == ["ascii"] * 5
    assert got.text["typography"][99] == SLIPS
    assert sorted(k for _, _, _, k in got.disagreements["typography"]) == ["case", "punctuation", "punctuation", "punctuation"]
    assert got.text["prefix"][99][1] == "SEKU" and ("known", "SEKU", "SEGU") in got.protected["prefix"]
    assert got.text["lexicon"][1][-1] == "SEKU" and got.protected["lexicon"] == [("known", "SEKU", "SEGU")]


def test_repartitioning_changes_nothing(spark, out):
    from pagemend.plans.correct import correct

    some = {d: DOCUMENTS[d] for d in ("footer", "typography", "lexicon", "accent")}
    again = correct(many(spark, some).repartition(5), ascii_mode="evidence")
    got = {d: {} for d in some}
    for r in again.pages.collect():
        got[r.document_id][r.page_number] = list(r.corrected)
    assert got == {d: out.text[d] for d in some}


def test_near_misses(spark):
    tally = [("SHIPPING WORLDWIDE", 38), ("SHIPPING WORLOWIDE", 3), ("Terrina Guempel at desk", 41), ("Vessel: EVER GIVEN 01", 8), ("Vessel: EVER GOING 02", 6)]
    table = spark.createDataFrame([("d", "A", t, n) for t, n in tally], "document_id string, cluster_key string, text string, n long")
    kept = canon.drop_near_misses(table, ["document_id", "cluster_key"])
    assert sorted(r.text for r in kept.collect()) == [t for t, _ in sorted(tally) if t != "SHIPPING WORLOWIDE"]


def test_modal_choice(spark):
    tallies = {"a": {"Fax#": 2, "#ax#": 2}, "b": {"#ax#": 3, "Fax#": 2}, "c": {"aount": 40, "amount": 1}}
    table = spark.createDataFrame([(k, t, n) for k, x in tallies.items() for t, n in x.items()], "key string, text string, n long")
    assert rows(canon.choose(table, ["key"]), "key", "text") == [("a", "#ax#"), ("b", "#ax#"), ("c", "aount")]
    names = spark.createDataFrame([("fax",), ("amount",), ("galaxsea",)], "token string")
    plain = canon.choose(table, ["key"], lexical.Plausibility(names))
    assert rows(plain, "key", "text", "support") == [("a", "Fax#", 2), ("b", "Fax#", 2), ("c", "aount", 40)]
    assert rows(canon.choose(table, ["key"], lambda c: F.contains(c, F.lit("F")).cast("double")), "key", "text") == [("a", "Fax#"), ("b", "Fax#"), ("c", "aount")]
    zipf = spark.createDataFrame([("fax", 4.0), ("rare", 1.0)], "token string, zipf double")
    texts = spark.createDataFrame([("Fax rare",), ("12",), ("Fax rare",), ("Fax seldom",)], "text string")
    known = spark.createDataFrame([("rare",)], "token string")
    got = {r.text: r.p for r in lexical.Plausibility(known, lexical.table_frequencies(zipf)).scores(texts).collect()}
    assert got == {"Fax rare": 0.8, "12": 0.0, "Fax seldom": 0.3}
    assert {r.p for r in lexical.Plausibility().scores(texts).collect()} == {0.0}


def test_frequency_file(spark, tmp_path):
    path = tmp_path / "f.tsv"
    path.write_text("The\t7.7\nodd line\nzyx\tnone\n the \t7.1\nInvoice\t4.0\n")
    assert rows(lexical.read_frequencies(spark, str(path)), "token", "zipf") == [("invoice", 4.0), ("the", 7.7)]


def test_vouched_texts(spark):
    known = spark.createDataFrame([("seku",), ("a1",)], "token string")
    texts = spark.createDataFrame([("SEKU - a1!",), ("SEKU x",), ("...",), ("SEKU - a1!",)], "text string")
    assert rows(lexical.vouched_texts(texts, known), "text") == [("SEKU - a1!",)]


def test_fold_candidates(spark):
    df = spark.createDataFrame([("Chelän",), ("Prépaid",), ("Account Number:·3592668683",), ("plain",), ("··",)], "t string").withColumn("f", fold.fold_marks("t"))
    got = {r.t: list(r.c) for r in df.select("t", fold.candidates(F.col("t"), F.col("f")).alias("c")).collect()}
    assert got == {"Chelän": ["Chelan"], "Prépaid": ["Prepaid"], "Account Number:·3592668683": ["Account Number:3592668683"], "plain": [], "··": []}


CASES = [
    ("Port DAIANX then DAIAN, CHINA", ["DAIAN"], ["DALIAN"], "Port DAIANX then DALIAN, CHINA", []),
    ("SHIPPING WORL.WIDE", ["WORL.WIDE"], ["WORLDWIDE"], "SHIPPING WORLDWIDE", []),
    ("Routing: SEA/KOJ/TAO", ["/KOJ/"], ["KOD"], "Routing: SEA/KOD/TAO", []),
    ("/KOJ/KOJ/", ["/KOJ/"], ["KOD"], "/KOD/KOD/", []),
    ("code AB1", ["AB1"], ["AB2"], "code AB1", ["correction would alter digits"]),
    ("one A$B here", ["A$B"], ["A$BC"], "one A$B here", ["nearest known pattern is 3 edits away (budget 1)"]),
    ("one A$B here", ["A$B"], ["AxB"], "one AxB here", []),
    ("éKOJ KOJ", ["KOJ"], ["KOD"], "éKOJ KOD", []),
    ("CAT then CUT", ["CAT", "CUT"], ["CUTS", "CUP"], "CAT then CUT", ["nearest known pattern is 2 edits away (budget 1)", "ambiguous: CUP, CUTS are equally close"]),
    ("abc -- d", ["--"], ["abc"], "abc -- d", ["no known pattern of comparable length"]),
]


@pytest.mark.parametrize("case", CASES)
def test_apply_patterns(spark, case):
    line, wrong, right, want, details = case
    new, events = errors.apply_patterns(F.lit(line), patterns(spark, wrong, right))
    row = spark.range(1).select(new.alias("t"), events.alias("e")).first()
    assert row.t == want and [e.detail for e in row.e if not e.fixed] == details


def test_malformed_and_contradictions(spark):
    table = errors.patterns_table(spark, ["Wire information:", "DAIAN", "/KOJ/", "WORL.WIDE", "--"])
    assert [r.pattern for r in errors.malformed(table).orderBy("ord").collect()] == ["Wire information:", "--"]
    vocabulary = spark.createDataFrame([("daian",), ("KOD",)], "entry string")
    assert [r.pattern for r in errors.contradictions(table, vocabulary).collect()] == ["DAIAN"]


def test_cluster_order_and_straddling(spark):
    doc = pages(spark, [(1, [("Bill To", 0.9), ("SHIPMENT DETAILS", 0.9)]), (2, [("SHIPMENT", 0.9), ("DETAILS", 0.9)]), (3, [("neither", 0.9)])])
    assert rows(cluster_pages(doc), "page_number", "cluster_key") == [(1, "B"), (2, "A"), (3, "?")]
    assert rows(cluster_info(cluster_pages(doc)), "cluster_key", "can_vote") == [("?", False), ("A", False), ("B", False)]
