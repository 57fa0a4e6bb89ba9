"""Sources, sinks, the review round trip, profiles and the command line."""

import io
import json
import logging
import zipfile

import pytest
from pyspark.sql import functions as F

from pagemend import cli
from pagemend.operators import errors, review
from pagemend.plans.correct import correct
from pagemend.preflight import Use, complaints
from pagemend.schema import lines_of
from pagemend.sinks import pdf
from pagemend.sinks import text as sink
from pagemend.sources import cached, container, profiles, rules, terms
from pagemend.streaming import ingest
from tests.fixtures import BRAND, FOOTER, footer_doc, pages, rows


def dump(path, numbered):
    path.write_text(json.dumps({str(p): {"txts": [x[0] for x in lines], "scores": [x[1] for x in lines]} for p, lines in numbered}), encoding="utf-8")
    return str(path)


# --- sources -----------------------------------------------------------------


def test_cached_dump(spark, tmp_path):
    raw = {"10": {"txts": ["b", "extra"], "scores": [0.5]}, "2": {"txts": ["a", 7], "scores": [0.9, 1]}, "3": "skipped", "4": {}, "5": {"txts": None}}
    (tmp_path / "one.json").write_text(json.dumps(raw))
    got = cached.load_cached(spark, str(tmp_path / "one.json"))
    assert [(r.page_ord, r.page_number, [(x.text, x.conf) for x in r.lines]) for r in got.orderBy("page_ord").collect()] == [(0, 2, [("a", 0.9), ("7", 1.0)]), (1, 4, []), (2, 5, []), (3, 10, [("b", 0.5)])]


@pytest.mark.parametrize(("text", "why"), [("{not json", "is not valid JSON"), ("[1]", "must be a page-keyed object")])
def test_broken_dump(spark, tmp_path, text, why):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match=why):
        cached.load_cached(spark, str(tmp_path / "bad.json"))


def test_terms(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("﻿DAIAN   # -> DALIAN\nFax#\n\n  # a note\n  /KOJ/  \nHO CHI MINH\t# city\r\nho chi\n", encoding="utf-8")
    named = terms.load_terms(spark, str(path))
    assert [r.term for r in named.orderBy("ord").collect()] == ["DAIAN", "Fax#", "/KOJ/", "HO CHI MINH", "ho chi"]
    assert sorted(r.token for r in errors.known_tokens(named).collect()) == ["chi", "daian", "fax", "koj", "minh"]
    assert [r.entry for r in errors.known_entries(named).orderBy("first").collect()] == ["DAIAN", "Fax", "KOJ", "HO", "CHI", "MINH"]


def test_bundles_images_and_kinds(spark, tmp_path):
    def bundle(files):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name, data in files.items():
                z.writestr(name, data)
        return held.getvalue()

    listed = {"manifest.json": json.dumps({"pages": [{"page_number": 2, "image": {"path": "x/b.jpg"}}, "junk", {"page_number": 1, "image": {"path": "a.jpg"}}, {"image": "no"}]}), "x/b.jpg": b"B", "a.jpg": b"A"}
    files = {"listed.pdf": bundle(listed), "plain.pdf": bundle({"p10.png": b"10", "p9.jpeg": b"9", "in/p1.jpg": b"1", "note.txt": b""}), "bare.bin": b"\xff\xd8\xff\xe0"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    docs = container.read_documents(spark, str(tmp_path))
    assert sorted(r.kind for r in docs.select(container.sniff().alias("kind")).collect()) == ["bundle", "bundle", "image"]
    got = {}
    for r in container.enumerate_pages(docs).orderBy("page_ord").collect():
        got.setdefault(r.document_id.rsplit("/", 1)[1], []).append(bytes(r.content))
    assert got == {"listed.pdf": [b"A", b"B"], "plain.pdf": [b"9", b"10"], "bare.bin": [b"\xff\xd8\xff\xe0"]}
    heads = spark.createDataFrame([(bytearray(b),) for b in (b"%PDF-1.7", b"garbage!", b"")], "content binary")
    assert [r.k for r in heads.select(container.sniff().alias("k")).collect()] == ["pdf", "unknown", "unknown"]
    with pytest.raises(Exception, match="unrecognized container"):
        container.enumerate_pages(heads.select(F.lit("d").alias("document_id"), "content").filter("length(content) = 8 and hex(content) like '67%'")).count()
    if not container.available_renderer():
        with pytest.raises(RuntimeError, match="pypdfium2"):
            container.rasterize(b"%PDF-1.7")
    mixed = spark.createDataFrame([("a/x.jpg", bytearray(b"\xff\xd8\xff\xe0")), ("a/bad.zip", bytearray(b"PK\x03\x04broken")), ("a/odd", bytearray(b"garbage!")), ("a/none", None)], "document_id string, content binary")
    told = {r.document_id: (r.name, r.error) for r in container.enumerate_pages(mixed, strict=False).collect()}
    assert told["a/x.jpg"] == ("x.jpg", None) and told["a/bad.zip"][1].startswith("BadZipFile") and told["a/odd"][1] == told["a/none"][1] == "ValueError: unrecognized container: unknown"


def test_resolution_of_images(spark):
    found = spark.createDataFrame([("d", 0, 299.6, 200.0), ("d", 3, None, 399.5), ("e", 0, 0.0, None), ("f", 0, None, None)], "document_id string, page int, horizontal double, vertical double")
    assert rows(container.native_dpi(found), "document_id", "native") == [("d", 400)]
    assert container.image_resolutions(spark.createDataFrame([("d", bytearray(b"garbage"))], "document_id string, content binary")).count() == 0


def test_recognizer_plugin(spark):
    def factory():
        return lambda data: [(data.decode(), 0.5, [[3, 9], [1, 9], [1, 2], [3, 2]]), ("no box", 1, None)]

    container.register_recognizer("fake", factory)
    images = spark.createDataFrame([("d", 0, "a", bytearray(b"one"), None)], container.IMAGES)
    (row,) = container.recognize(images, "fake").collect()
    assert row.page_number == 1 and [(x.text, x.conf) for x in row.lines] == [("one", 0.5), ("no box", 1.0)]
    assert tuple(row.lines[0].box) == (1.0, 2.0, 3.0, 9.0) and row.lines[1].box is None
    with pytest.raises(RuntimeError, match="isn't registered"):
        container.recognize(images, "missing")
    container.register_recognizer("absent", factory, lambda: False)
    assert container.recognizer_available("fake") and not container.recognizer_available("absent") and not container.recognizer_available("missing")
    with pytest.raises(RuntimeError, match="can't run here"):
        container.recognize(images, "absent")


def test_engine_notes_are_dropped(monkeypatch):
    import sys
    import types

    class Engine:
        def __call__(self, image):
            return types.SimpleNamespace(txts=["a", "b"], scores=[0.5, 1], boxes=[[[0, 0], [1, 0], [1, 1], [0, 1]]]) if image else types.SimpleNamespace()

    monkeypatch.setitem(sys.modules, "rapidocr", types.SimpleNamespace(RapidOCR=Engine))
    read = container._rapidocr()
    assert read(b"x") == [("a", 0.5, [[0, 0], [1, 0], [1, 1], [0, 1]]), ("b", 1, None)] and read(b"") == []
    assert not logging.getLogger("RapidOCR").filter(logging.LogRecord("RapidOCR", logging.INFO, "", 0, "note", (), None))
    assert logging.getLogger("RapidOCR").filter(logging.LogRecord("RapidOCR", logging.WARNING, "", 0, "note", (), None))


# --- review ------------------------------------------------------------------


def review_file(path, records, columns=("rule_id", "page", "original_text", "corrected_text", "scope")):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(columns) + "\n" + "".join("\t".join(r) + "\n" for r in records))
    return str(path)


def test_rules_and_warnings(spark, tmp_path):
    path = review_file(tmp_path / "r.tsv", [("", "1", "a", "", ""), ("", "1", "", "x", ""), ("", "one", "a", "x", ""), ("p0001-00000000", "1", "a", " x ", "ALL"), ("", "2", "b", "y", "odd")])
    got, warned = rules.load_rules(spark, path)
    assert [(r.ord, r.page, r.original, r.corrected, r.scope) for r in got.orderBy("ord").collect()] == [(5, 1, "a", "x", "all"), (6, 2, "b", "y", "page")]
    said = [w.warning for w in warned.collect()]
    assert [s.split(":")[0] for s in said] == ["row 3", "row 4", "row 5", "row 6"]
    assert "no original_text" in said[0] and "not a number" in said[1] and "does not match" in said[2] and "unknown scope 'odd'" in said[3]


@pytest.fixture(scope="module")
def done(spark):
    doc = [(i, [(BRAND, 0.99), (f"C/O {i}", 0.99), ("SHIPMENT DETAILS", 0.99), ("body (x) it's", 0.85 if i == 2 else 0.99), (FOOTER, 0.99, (0, 10, 50, 20))]) for i in range(1, 7)]
    doc.append((99, [(BRAND, 0.99), ("C/O 1", 0.60), ("SHIPMENT DETAILS", 0.99), ("Zürich", 0.99), ("41-- #--- # - - 058", 0.60)]))
    return correct(pages(spark, doc))


def overlay(spark, *given):
    return spark.createDataFrame([(i, *g, "") for i, g in enumerate(given)], "ord int, page int, original string, corrected string, scope string, stated_id string")


def test_rules_outrank_and_go_stale(spark, done):
    given = overlay(spark, (99, "Zürich", "ZURICH", "page"), (1, BRAND, "GSFF", "all"), (1, BRAND, "shadowed", "page"), (5, "gone", "x", "all"), (1, "Zürich", "wrong page", "page"))
    final, forced, stale = review.apply_rules(done, given)
    text = {r.page_number: list(r.corrected) for r in final.collect()}
    assert text[99][3] == "ZURICH" and all(t[0] == "GSFF" for t in text.values()) and text[99][4] == FOOTER
    assert forced.count() == 8 and sorted(r.ord for r in stale.collect()) == [2, 3, 4]
    done2 = type(done)(**{**done.__dict__, "pages": final})
    again, more, _ = review.apply_rules(done2, given)
    assert more.count() == 0 and {r.page_number: list(r.corrected) for r in again.collect()} == text


def test_repeated_rules_meet_repeated_lines_once(spark):
    """As many rules as lines of one text: the joins give a row a line, not a row for each pair."""
    line = "struct<document_id: string, page_ord: int, page_number: int, line_no: int, text: string, corrected: string>"
    lines = spark.createDataFrame([("d", i, i, 0, "same", "same") for i in range(300)], line)
    rules_ = spark.createDataFrame([(1000 - i, i, "same", f"new {i}", "all" if i % 2 else "page") for i in range(300)], "ord int, page int, original string, corrected string, scope string")
    won = review.winning_rules(lines, rules_)
    got = {r.page_ord: (r.ord, r.forced) for r in won.collect()}
    assert got == {i: (701, "new 299") for i in range(300)}  # the last of the rules for all pages has the least number
    plan, made = won._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    won.write.format("noop").mode("overwrite").save()
    won._jdf.queryExecution().toRdd().count()
    walk(plan)
    assert made and max(made) <= 600, made


def test_review_rows(spark, done, tmp_path):
    made = [r.asDict() for r in review.build_rows(done, "scan.pdf").orderBy(*review.review_order()).collect()]
    by = {(r["page"], r["status"]): r for r in made}
    fixed = by["99", "boilerplate"]
    assert (fixed["conf"], fixed["count"], fixed["original_text"], fixed["tool_text"], fixed["file"]) == ("0.60", "1", "41-- #--- # - - 058", FOOTER, "scan.pdf")
    assert by["99", "nonascii"]["original_text"] == "Zürich" and by["2", "uncorrected"]["count"] == "6"
    assert [(int(r["page"]), r["rule_id"]) for r in made] == sorted((int(r["page"]), r["rule_id"]) for r in made)
    n = sink.write_review(review.build_rows(done, "scan.pdf"), str(tmp_path / "out.csv"))
    text = (tmp_path / "out.csv").read_text()
    assert n == len(made) and text.startswith("rule_id,file,page,conf,count,status,original_text,tool_text,corrected_text,scope,notes\n")
    back, _ = rules.load_rules(spark, str(tmp_path / "out.csv"))
    assert back.count() == 0  # an empty correction is no rule


def test_quoting(spark):
    words = ["plain", "it's", 'say "x"', "both ' and \"", "tab\tnew\n", "back\\slash"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert [r.q for r in df.select(review.quoted("t").alias("q")).collect()] == [repr(w) for w in words]


# --- profiles ----------------------------------------------------------------


def test_profile_round_trip(spark, done, tmp_path):
    slots, lines = review.learn_profile(done.pages)
    (row,) = review.profile_json(slots, lines, done.clusters).collect()
    path = tmp_path / "p.json"
    sink.write_profile(row.profile, str(path))
    raw = json.loads(path.read_text())
    assert raw["version"] == 1 and raw["clusters"]["A"]["slots"]["bottom:0"] == FOOTER and FOOTER in raw["clusters"]["A"]["lines"]
    assert "$" not in path.read_text()
    loaded = profiles.load_profile(spark, str(path))
    assert profiles.counts_of(loaded) == (len(raw["clusters"]["A"]["slots"]), len(raw["clusters"]["A"]["lines"]))
    alone = pages(spark, [(1, [(BRAND, 0.99), ("C/O 7", 0.99), ("SHIPMENT DETAILS", 0.99), ("41-- #--- # - - 058", 0.60)])])
    plain, helped = correct(alone), correct(alone, profile=loaded)
    assert plain.changes.count() == 0 and rows(helped.changes, "kind", "new") == [("boilerplate", FOOTER)]
    assert rows(helped.clusters, "can_vote") == [(True,)]


def test_profile_never_learns_a_misread(spark):
    doc = [(i, [("SHIPPING WORLOWIDE" if i < 3 else "SHIPPING WORLDWIDE", 0.99), ("SHIPMENT DETAILS", 0.99), ("Fee $9.00 of this month", 0.99)]) for i in range(43)]
    table = pages(spark, doc).withColumn("cluster_key", F.lit("A")).withColumn("corrected", F.transform("lines", lambda x: x["text"]))
    slots, lines = review.learn_profile(table)
    assert [r.text for r in lines.collect()] == ["SHIPPING WORLDWIDE"]
    assert all("$" not in r.text and "WORLO" not in r.text for r in slots.collect())


def test_odd_profiles(spark, tmp_path):
    path = tmp_path / "p.json"
    for text, why in (("{", "not valid JSON"), ("[]", "must be a JSON object"), ("{}", "no clusters object")):
        path.write_text(text)
        with pytest.raises(ValueError, match=why):
            profiles.load_profile(spark, str(path))
    path.write_text(json.dumps({"clusters": {"A": {"slots": {"top:0": "x", "odd": "y", "top:z": "w"}, "lines": ["l"]}, "B": 7, "C": {"slots": [], "lines": {}}}}))
    got = profiles.load_profile(spark, str(path))
    assert rows(got.slots, "cluster_key", "side", "k", "text") == [("A", "top", 0, "x")] and rows(got.clusters, "cluster_key") == [("A",)]


# --- sinks -------------------------------------------------------------------


def test_text_layer(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    lines = [("SHIPPING (W\\O)", (10.0, 10.0, 200.0, 40.0)), ("", (0.0, 0.0, 1.0, 1.0)), ("no box", None), ("日é", (10.0, 50.0, 120.0, 52.0))]
    df = spark.createDataFrame([(lines,)], f"l array<struct<text: string, box: {box}>>")
    (row,) = df.select(sink.text_layer(F.col("l"), F.lit(792.0), F.lit(0.5), F.lit(0.5)).alias("s")).collect()
    assert row.s.split("\n") == ["BT", "3 Tr", "/F1 13.5 Tf", "1 0 0 1 5.0 772.0 Tm", "(SHIPPING \\(W\\\\O\\)) Tj", "/F1 4.0 Tf", "1 0 0 1 5.0 766.0 Tm", "(?é) Tj", "ET"]


def test_layered_pages_and_text(spark, done):
    layer = {r.page_number: r.layer for r in sink.layered_pages(done.pages).collect()}
    assert layer[99][4].text == FOOTER and layer[1][4].box.x1 == 50.0 and layer[1][0].box is None
    held = io.StringIO()
    assert sink.stream_text(done.pages, held) == 7
    text = held.getvalue()
    assert text.startswith(f"=== page 1 ===\n{BRAND}\nC/O 1\n") and text.count("\n\n\n=== page ") == 6 and text.endswith("\n")
    assert all(text[r.start : r.start + len(r.body)] == r.body for r in sink.assembled(done.pages).collect())
    assert pdf.problem(None, done.pages)


def test_texts_of_many_documents(spark, done, tmp_path):
    two = done.pages.unionByName(done.pages.withColumn("document_id", F.lit("other")).filter("page_number < 3")).repartition(5)
    sink.write_texts(two, str(tmp_path / "texts"))
    for name in [r.document_id for r in two.select("document_id").distinct().collect()]:
        held = io.StringIO()
        sink.stream_text(two.filter(F.col("document_id") == name), held)
        parts = sorted((tmp_path / "texts" / f"document_id={name}").glob("part-*"))
        assert "".join(p.read_text() for p in parts) == held.getvalue()


# --- command line ------------------------------------------------------------


def test_usage_errors(tmp_path, capsys):
    source = dump(tmp_path / "in.json", footer_doc(2))
    there = tmp_path / "there.txt"
    there.write_text("x")
    for bad in (["--cached", str(tmp_path / "none.json")], ["--cached", str(tmp_path)], ["--cached", source, "-o", source], ["--cached", source, "-o", str(there)], ["--cached", source, "-o", str(tmp_path / "no" / "x")], ["--cached", source, "-o", str(tmp_path / "o"), "--review-out", str(tmp_path / "o")], ["--cached", source, "-o", str(tmp_path)]):
        assert cli.main(bad) == 2
    for bad in ([], ["--cached", source, "--dpi", "zero"], ["--dpi", "0", "x.pdf"]):
        with pytest.raises(SystemExit) as stop:
            cli.main(bad)
        assert stop.value.code == 2
    said = capsys.readouterr().err
    assert "would replace the source" in said and "--force wasn't given" in said and "all mean the one file" in said and "its folder is missing" in said
    assert there.read_text() == "x"


def test_paths_are_compared_as_files(tmp_path):
    source, other = tmp_path / "s.json", tmp_path / "o.txt"
    source.write_text("{}"), other.write_text("")
    (tmp_path / "link").symlink_to(source)
    told = lambda writes, force=True: complaints([Use("--cached", str(source))], [Use(f"--{i}", str(w)) for i, w in enumerate(writes)], str(source), force)
    assert told([other, tmp_path / "new"]) == [] and len(told([other], False)) == 1
    assert "never done" in told([tmp_path / "link"])[0] and "never done" in told([tmp_path / "." / "s.json"], False)[0]
    assert "all mean" in told([tmp_path / "x", tmp_path / "." / "x"])[0]
    assert complaints([Use("--profile", str(tmp_path)), Use("--review-in", None)], [], None, False) == [f"--profile {str(tmp_path)!r}: a file is needed here, this is a folder"]


def test_run(spark, tmp_path, capsys):
    source = dump(tmp_path / "in.json", footer_doc(4))
    out, reviewed, learned = (str(tmp_path / n) for n in ("o.txt", "r.tsv", "p.json"))
    assert cli.main(["--cached", source, "-o", out, "--review-out", reviewed, "--learn-profile", learned, "--report"], spark) == 0
    text = open(out, encoding="utf-8").read()
    assert text.endswith(FOOTER + "\n") and text.startswith("=== page 1 ===\n")
    assert json.load(open(learned))["clusters"]["A"]["slots"]["bottom:0"] == FOOTER
    said = capsys.readouterr().err
    assert "format A: 5 pages -> consensus active" in said and "p99 [boilerplate]" in said
    short = dump(tmp_path / "short.json", footer_doc(1))
    human = review_file(tmp_path / "h.tsv", [("", "1", "body value 0", "BODY", "page"), ("", "9", "gone", "x", "page")])
    known, wrong = tmp_path / "k.txt", tmp_path / "w.txt"
    known.write_text("GalaxSea\nDETAIL\n")
    wrong.write_text("DETAILS\n")
    assert cli.main(["--cached", short, "-o", out, "--force", "--profile", learned, "--review-in", human, "--known-patterns", str(known), "--error-patterns", str(wrong)], spark) == 0
    text, said = open(out, encoding="utf-8").read(), capsys.readouterr().err
    assert "BODY" in text and "SHIPMENT DETAIL\n" in text and text.endswith(FOOTER + "\n") and "stale rule for page 9" in said
    wrong.write_text("two words\nGalaxSea\n")
    assert cli.main(["--cached", short, "-o", out, "--force", "--known-patterns", str(known), "--error-patterns", str(wrong)], spark) == 2
    (tmp_path / "bad.json").write_text("[]")
    assert cli.main(["--cached", str(tmp_path / "bad.json"), "-o", out, "--force"], spark) == 1


# --- streaming ---------------------------------------------------------------


def test_stream_of_dumps(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    dump(folder / "a.json", footer_doc(4))
    stream = ingest.watch(spark, str(folder))
    started = ingest.correct_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    started.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 20 and got.filter(F.col("text") != F.col("corrected")).count() == 1


def test_null_cells(spark):
    doc = spark.createDataFrame([("d", 0, 1, [{"text": None, "conf": None, "box": None}, {"text": "x", "conf": 0.99, "box": None}])], pages(spark, []).schema)
    out = correct(doc)
    assert [list(r.corrected) for r in out.pages.collect()] == [["", "x"]] and lines_of(doc).count() == 2
