"""Blocked similarity joins against all pairs, in plain Python."""

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemend.functions.similarity import Openings, nearest_words, ratio, ratio_value
from pagemend.functions.spelling import kinds as spelling_kinds
from pagemend.functions.text import classify, common_prefix, core_of, figure_safe, resolve_dpi, rule_id, strip, two_places
from pagemend.operators import disagree, lexicon
from pagemend.operators.blocking import near_pairs
from pagemend.operators.openings import longest_opening

WORDS = st.text("abcdeABé1.", min_size=3, max_size=14)


def plain(a, b):
    return SequenceMatcher(None, a, b).ratio()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(WORDS, st.text("ab", min_size=60, max_size=70), st.text("aé😀", min_size=3, max_size=9)), min_size=1, max_size=12), st.lists(st.text("abcdeABé1.", min_size=6, max_size=6), min_size=1, max_size=25, unique=True), st.integers(1, 3))
def test_nearest_words_against_all_pairs(asked, others, block):
    places = [(i * 7 % 25, i) for i in range(len(others))]
    want = {}
    for i, a in enumerate(asked):
        value, _, j = max((plain(a, b), tuple(-x for x in places[j]), j) for j, b in enumerate(others))
        if value >= 0.72:
            want[i] = (value, j)
    assert {i: (value, j) for i, value, j in nearest_words(asked, others, places, 0.72, block)} == want


def test_lookup_grows_slower_than_words():
    rng = np.random.default_rng(5)
    parts = ["the", "ion", "er", "st", "an", "th", "re", "on", "ly", "ing", "ou", "ar", "es", "ti", "un", "con"]
    made = sorted({w[:8] for w in map("".join, rng.choice(parts, (200_000, 5))) if len(w) >= 8})
    others = [made[k] for k in rng.permutation(len(made))]
    asked = [w.replace("o", "0", 1) for w in others[-400:] if "o" in w]
    states = {}
    for n in (4000, 32000):
        seen = []
        Openings(others[:n]).alike(asked, np.full(len(asked), 6), seen)
        states[n] = sum(seen)
    assert states[32000] < 4 * states[4000] and states[32000] < len(asked) * 32000 / 10, states


def test_words_longer_than_a_machine_word():
    base = "abcdefghij" * 7
    others = [base[:35] + "X" + base[36:], "z" * 70, base[:-1] + "Y"]
    assert nearest_words([base, base[1:] + "q"], others, [2, 1, 0], 0.72) == [(0, plain(base, others[2]), 2), (1, plain(base[1:] + "q", others[2]), 2)]


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS, st.sampled_from([0.0, 0.25, 0.72, 0.9]))
def test_ratio_bounds(a, b, least):
    want = plain(a, b)
    assert ratio_value(a, b, least) == (want if want >= least else 0.0)


def test_ratio_keeps_order_and_nulls(spark):
    df = spark.createDataFrame([("Va1dez", "Valdez"), (None, "x"), ("", ""), ("ab" * 150, "ba" * 150)], "a string, b string")
    got = [r.r for r in df.select(ratio("a", "b").alias("r")).collect()]
    assert got == [plain("Va1dez", "Valdez"), None, 1.0, plain("ab" * 150, "ba" * 150)]


def noisy(seed, n, low=8, high=40):
    rng = np.random.default_rng(seed)
    out = set()
    while len(out) < n:
        base = "".join(rng.choice(list("abcdefgh i1"), rng.integers(low, high)))
        out.add(base)
        for _ in range(4):
            x = list(base)
            for _ in range(rng.integers(1, 4)):
                at, kind = rng.integers(0, len(x)), rng.integers(0, 3)
                if kind == 0:
                    x[at] = rng.choice(list("abcxyz"))
                elif kind == 1 and len(x) > low:
                    del x[at]
                else:
                    x.insert(at, rng.choice(list("abcxyz")))
            out.add("".join(x))
    return sorted(x for x in out if len(x) >= low)


def test_near_pairs_lose_nothing(spark):
    texts = noisy(7, 150)
    probes = spark.createDataFrame([("k", t) for t in texts], "key string, text string")
    canon = spark.createDataFrame([("k", t) for t in texts[::2]], "key string, other string")
    for t, shortest in ((0.9, 8), (0.85, 8), (0.9, 1), (0.6, 8)):
        got = {(r.text, r.other) for r in near_pairs(probes, canon, ["key"], 3, t, shortest).collect()}
        want = {(a, b) for a in texts for b in texts[::2] if a != b and abs(len(a) - len(b)) <= 3 and plain(a, b) >= t}
        assert want <= got and all(abs(len(a) - len(b)) <= 3 for a, b in got)


def metrics(df, part, name):
    """The values of a metric in the nodes of a plan, once it has run, whose names have ``part``."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    df._jdf.queryExecution().toRdd().count()

    def walk(node):
        if re.search(part, node.nodeName()) and node.metrics().contains(name):
            out.append(node.metrics().apply(name).value())
        for inner in ("executedPlan",) * (node.nodeName() == "AdaptiveSparkPlan") + ("plan",) * ("QueryStage" in node.nodeName()):
            walk(getattr(node, inner)())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return out


def long_texts(n):
    rng = np.random.default_rng(4)
    return sorted({"".join(rng.choice(["the ", "ion ", "er", "st", "an", "th", "re ", "on"], 80))[:160] for _ in range(n)})


def test_near_pairs_join_no_trigrams(spark):
    texts = long_texts(300)
    probes, canon = (spark.createDataFrame([("k", t) for t in texts], f"key string, {c} string") for c in ("text", "other"))
    pairs = near_pairs(probes, canon, ["key"], 3, 0.9, 8)
    assert max(metrics(pairs, "Join", "numOutputRows")) <= 7 * len(texts)


def test_disagreements_move_no_probes(spark):
    texts = long_texts(2000)
    counts = spark.createDataFrame([("d", "c", t, 1, 1, (i, 0)) for i, t in enumerate(texts)] + [("d", "c", "a heading of all pages", 9, 9, (0, 1))], "document_id string, cluster_key string, text string, n long, n_confident long, first struct<page_ord: int, line_no: int>")
    clusters = spark.createDataFrame([("d", "c", 12, True)], "document_id string, cluster_key string, n_pages long, can_vote boolean")
    out = disagree.disagreeing_texts(counts, disagree.canonical_counts(counts, clusters))
    assert out.count() == 0 and sum(metrics(out, "^Exchange", "dataSize")) < sum(map(len, texts)) / 2


def test_closest_token(spark):
    rng = np.random.default_rng(8)
    words = [w.replace(" ", "q") for w in noisy(9, 200, 3, 12)]
    order = rng.permutation(len(words)).tolist()
    lex = [("d", w, 1, {"page_ord": 0, "line_no": int(i), "tok_no": 0}) for w, i in zip(words, order, strict=True) if i % 3]
    asked = [w for w, i in zip(words, order, strict=True) if not i % 3]
    lexicon_ = spark.createDataFrame(lex, "document_id string, token string, freq long, first struct<page_ord: int, line_no: int, tok_no: int>")
    got = {r.token: r.best for r in lexicon.closest(spark.createDataFrame([("d", w) for w in asked], "document_id string, token string"), lexicon_).collect()}
    attested = [w for _, w, _, _ in sorted(lex, key=lambda r: r[3]["line_no"])]
    want = {}
    for w in asked:
        best, most = None, 0.0
        for c in attested:
            if abs(len(c) - len(w)) <= 2 and (r := plain(w, c)) > most:
                best, most = c, r
        if best is not None and most >= 0.72 and w not in attested:
            want[w] = best
    assert got == want


def test_disagreements_against_all_pairs(spark):
    rng = np.random.default_rng(10)
    texts = noisy(11, 120, 9, 45)
    counts = [("d", "A", t, int(n), int(n), int(n), {"page_ord": int(p), "line_no": 0}) for t, n, p in zip(texts, rng.choice([1, 1, 1, 2, 6, 20], len(texts)), rng.permutation(len(texts)), strict=True)]
    table = spark.createDataFrame(counts, "document_id string, cluster_key string, text string, n long, n_clean long, n_confident long, first struct<page_ord: int, line_no: int>")
    clusters = spark.createDataFrame([("d", "A", 20, True)], "document_id string, cluster_key string, n_pages long, can_vote boolean")
    canon = disagree.canonical_counts(table, clusters)
    got = {r.text: r.canonical for r in disagree.disagreeing_texts(table, canon).collect()}
    frequent = sorted([(c[6]["page_ord"], c[2], c[3]) for c in counts if c[3] >= 5])
    want = {}
    for _, _, text, seen, *_ in counts:
        if text in {t for _, t, _ in frequent}:
            continue
        best, most = None, 0.9
        for _, other, support in frequent:
            if abs(len(other) - len(text)) <= 3 and seen <= max(1, support // 4) and (r := plain(text, other)) > most:
                best, most = other, r
        if best is None:
            shared_most, mine = 0, text.strip()
            for _, other, support in frequent:
                theirs = other.strip()
                n = next((i for i, (x, y) in enumerate(zip(mine, theirs, strict=False)) if x != y), min(len(mine), len(theirs)))
                if seen <= max(1, support // 4) and theirs != mine and n >= 20 and n >= 0.4 * len(theirs) and n > shared_most:
                    best, shared_most = other, n
        if best is not None:
            want[text] = best
    assert got == want and len(want) > 5


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text_functions(spark):
    pairs = [("SHIPPING X", "SHIPPING WO", 9), ("", "x", 0), ("ab", "abc", 2), ("é😀x", "é😀y", 2), ("same", "same", 4)]
    assert one(spark, *[common_prefix(F.lit(a), F.lit(b)) for a, b, _ in pairs]) == tuple(n for _, _, n in pairs)
    cores = [("/KOJ/", "KOJ"), ("WORL.WIDE", "WORL.WIDE"), ("--", ""), (" a b\nc! ", "a b\nc")]
    assert one(spark, *[core_of(F.lit(a)) for a, _ in cores]) == tuple(b for _, b in cores)
    kinds = [("A B", "AB", "spacing"), ("A.B", "AB", "punctuation"), ("aB", "AB", "case"), ("AXB", "AB", "disagrees")]
    assert one(spark, *[classify(F.lit(a), F.lit(b)) for a, b, _ in kinds]) == tuple(k for _, _, k in kinds)
    figures = [("plain text", "other text", True), ("Forwarding Fee $90.00", "Forwarding Fee $105.00", False), ("(include an additional $35 wireLfed", "(include an additional $35 wire fee if", True), ("short $3", "short $4", False)]
    assert one(spark, *[figure_safe(F.lit(a), F.lit(b)) for a, b, _ in figures]) == tuple(x for _, _, x in figures)
    assert one(spark, strip(F.lit("\t a \x1c ")), rule_id(F.lit(7), F.lit("abc")), rule_id(F.lit(123456), F.lit("abc"))) == ("a", "p0007-a9993e36", "p123456-a9993e36")
    assert one(spark, *[two_places(F.lit(x)) for x in (0.125, 0.145, 0.985, 1.0)]) == tuple(f"{x:.2f}" for x in (0.125, 0.145, 0.985, 1.0))


def test_resolution(spark):
    cases = [(400, None, 400, ""), (400, 200, 200, "detail will be discarded"), (0, None, 300, "native resolution unknown; rendering at 300 dpi"), (300, 600, 600, "this adds no detail"), (0, 200, 200, ""), (300, 300, 300, "")]
    for native, requested, dpi, said in cases:
        got = one(spark, *resolve_dpi(F.lit(native), F.lit(requested).cast("int")))
        assert got[:2] == (dpi, native) and got[2].endswith(said) and bool(got[2]) == bool(said)


def brute_opening(texts, lines, least):
    want = {}
    for text in texts:
        best = None
        for other, place in lines:
            a, b = text.strip(), other.strip()
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            if other != text and n >= least and len(b) >= least and (best is None or (-n, place) < best[:2]):
                best = (-n, place, other)
        if best is not None:
            want[text] = best[2]
    return want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text("abé😀 ", min_size=1, max_size=9), max_size=40), st.sets(st.text("abé😀 ", min_size=1, max_size=9), max_size=40), st.randoms())
def test_longest_opening_against_all_pairs(spark, texts, lines, random):
    places = [(0, i, t) for i, t in enumerate(random.sample(sorted(lines), len(lines)))]
    given_ = spark.createDataFrame([("d", "A", t, p) for p in places for t in [p[2]]], "document_id string, cluster_key string, other string, ord struct<asserted: int, by: long, t: string>")
    asked = spark.createDataFrame([("d", "A", t) for t in texts], "document_id string, cluster_key string, text string")
    got = {r.text: r.other for r in longest_opening(asked, given_, ["document_id", "cluster_key"], 2).collect()}
    assert got == brute_opening(texts, [(p[2], p) for p in places], 2)


SPELLINGS = st.lists(st.tuples(*[st.one_of(st.none(), st.text("aAb1., \t\x1c\x85\xa0\u1680\u2003\u2028\u205f\u3000\u200b\u180eéÂ€😀", max_size=5))] * 2), max_size=30)


@settings(max_examples=200, deadline=None)
@given(SPELLINGS, st.integers(0, 3))
def test_spelling_kinds_of_a_batch(pairs, skipped):
    def plain_kind(a, b):
        if a is None or b is None:
            return "disagrees"
        space = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
        x, y = (re.sub("[^A-Za-z0-9]", "", t) for t in (a, b))
        return "spacing" if re.sub(space, "", a) == re.sub(space, "", b) else "punctuation" if x == y else "case" if x.lower() == y.lower() else "disagrees"

    a, b = (pa.array([p[k] for p in pairs], pa.string())[skipped:] for k in (0, 1))
    assert spelling_kinds(a, b).to_pylist() == [plain_kind(*p) for p in pairs[skipped:]]


def test_classify_rewrites_no_text(spark, capsys):
    spark.createDataFrame([("a b", "ab")], "a string, b string").select(classify("a", "b")).explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" in plan and "regexp_replace" not in plan
