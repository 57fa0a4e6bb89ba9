"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Each document's set of word shingles is hashed; its k smallest hashes are the sketch.
   Documents with equal sets form one class, and only one of each class goes on.
2. Inverted lists of retained values. Two sets at similarity t share at least c of k
   retained values (but for a chance under ``MISS``, and far under it for closer sets), so a
   sketch needs to list only its k - c + 1 rarest values. Lists are split by size class, as
   sets at t differ in size by at most 1 / t.
3. A list doesn't give its pairs. Each member is compared with the list's hub only (the
   member whose values are the most common), by exact Jaccard on full sets: linear in the
   list. Union-sketch estimates drop hopeless comparisons with hubs of a single member.
4. What hubs may miss is found exactly, however far members are from their hub. Of two
   members of one hub: if x is not linked to hub h but is to y, then x and y share an
   element of x ^ h and y ^ h (else J(x, y) <= J(x, h)), and at least t * |x | h| - |x & h|
   of them. So differences from hubs are listed by the same rarest-first rule, lists within
   one component are done, and the rest are compared pair by pair behind a test of sizes and
   places that passes few. What all members have in common with their hub is in no
   difference, so a passage of many documents gives no pairs by itself.
   While there are very many such tests, further hubs link members first, as linked members
   of one component need no test; hubs only add links, and what is left is tested, dealt in parts.
5. Links give components; a document's component is the least doc_id reachable.

Full sets are rebuilt only for documents in some comparison. Nothing is capped: but for
``MISS`` no link is lost. The price is the difference from a hub, up to the size of both sets
where they are far apart; and documents made of the same few passages, no one of which tells
them apart, pass more of the tests of step 4.

Defined cases: null, empty or wordless text has an empty set and no links; fewer words
than a shingle are one shingle; rows with a null doc_id are never linked, have a null
component and are kept; rows that repeat a doc_id are one document, linked if any of
them is; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, scratch, settle, tune
from .components import connected

WIDTH = 5
PERCENT = 80
K = 48
#: The chance that two sets exactly at the similarity share too few retained values to meet.
MISS = 1e-5
#: A hub of one member isn't compared with it below this estimate; hubs of several are with all.
HOPELESS = 0.2
CACHE_WORDS = 100_000
#: Ids up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Above so many tests further hubs link members before the lists are joined with themselves.
DIRECT_TESTS = 50_000_000
#: A list's join with itself is dealt over parts of about so many tests, at most MOST_PARTS.
PART_TESTS = 1_000_000
MOST_PARTS = 1000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, width: int = WIDTH):
        self.width, self.cache = width, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.int64)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_digest(w)
        h = np.frombuffer(b"".join([cache[w] for w in words]), np.uint64)
        n = min(self.width, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            s = (s ^ (s >> np.uint64(29))) * _ODD[i % 8] + h[i : len(h) - n + 1 + i]
        s = (s ^ (s >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        s = (s ^ (s >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.unique((s ^ (s >> np.uint64(31))).view(np.int64))


def shared_values(k: int, t: float, miss: float = MISS) -> int:
    """The most c with P(Binomial(k, t) < c) <= miss."""
    total, c = 0.0, 0
    while c < k:
        total += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if total > miss:
            break
        c += 1
    return max(1, c)


def _sketches(width: int, k: int):
    def run(batches):
        shingle = Shingler(width)
        for batch in batches:
            n, f1, f2, sketch = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle(text)
                n.append(len(s))
                if len(s) and doc is not None:
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                    f1.append(a), f2.append(b), sketch.append(s[:k])
                else:
                    f1.append(None), f2.append(None), sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "n", "f1", "f2", "sketch"],
            )
            settle()

    return run


def _sets(width: int):
    def run(batches):
        shingle = Shingler(width)
        for batch in batches:
            sets = [shingle(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])
            settle()

    return run


def _compare(percent: int):
    """x, h, sets of both, several -> link, and where h has several members the differences and the overlap they need."""

    def run(batches):
        for batch in batches:
            link, need, own, hub, diff = [], [], [], [], []
            for a, b, several in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                both = np.concatenate([a, b])
                both.sort()
                twice = np.flatnonzero(both[1:] == both[:-1])
                inter, union = len(twice), len(both) - len(twice)
                linked = 100 * inter >= percent * union
                link.append(linked)
                own.append(len(a) - inter)
                hub.append(len(b))
                if several:
                    lone = np.ones(len(both), bool)
                    lone[twice] = lone[twice + 1] = False
                    diff.append(both[lone])
                    need.append(-(-percent * (union - inter) // (100 + percent)) if linked else (percent * union - 100 * inter + 99) // 100)
                else:
                    diff.append(None)
                    need.append(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(link), pa.array(need, pa.int64()), pa.array(own, pa.int64()), pa.array(hub, pa.int64()), pa.array(diff, pa.list_(pa.int64()))],
                names=["x", "h", "link", "need", "own", "hub", "diff"],
            )
            settle()

    return run


def _ranked(rows: DataFrame, key: list[str], scope: list[str], value: str) -> DataFrame:
    """Values that more than one key of the scope has, with ``at``, their place by rarity in the key.

    Values of one key only come first in rarity; they are counted, not kept.
    """
    counts = rows.groupBy(*scope, value).agg(F.count("*").alias("df")).filter("df > 1")
    common = rows.join(counts, [*scope, value])
    order = Window.partitionBy(*key).orderBy("df", value)
    return common.withColumn("at", F.row_number().over(order) + F.col("size") - F.count("*").over(Window.partitionBy(*key)))


def _with_hub(lists: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """Members of lists with h, the list's candidate of the greatest w (ties to the least id); the hub itself is left out."""
    hubs = candidates.groupBy(*key).agg(F.max(F.struct("w", (-F.col("x")).alias("neg"))).alias("hub"))
    return lists.join(hubs.select(*key, (-F.col("hub.neg")).alias("h")), key).filter("x <> h")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, h, several) with their exact link; what ``_differences`` needs where ``several`` says so."""
    left = pairs.join(sets.select(F.col("node").alias("x"), F.col("hashes").alias("hx")), "x")
    both = left.join(sets.select(F.col("node").alias("h"), F.col("hashes").alias("hh")), "h")
    return cut(both.select("x", "h", "hx", "hh", "several").mapInArrow(_compare(percent), "x long, h long, link boolean, need long, own long, hub long, diff array<long>"))


def _full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    nodes = cut(nodes.distinct())
    few = nodes.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(nodes) if few else nodes, docs["doc_id"] == nodes["node"], "left_semi")
    return cut(wanted.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("t")).mapInArrow(_sets(width), "node long, hashes binary"))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("h").alias("node")))


def _first_pairs(reps: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (x, h, several) of members of lists with their hubs; ``several`` if the hub has more than one."""
    t = percent / 100
    kept = F.size("sketch")
    # of sketches at the similarity, if the smaller set has n
    need = F.least(F.lit(shared_values(k, t)), F.ceil(F.col("n") * percent / 100))
    values = reps.select(F.col("node").alias("x"), "n", kept.alias("size"), need.alias("need"), F.explode("sketch").alias("v"))
    central = F.sum(F.log("df")).over(Window.partitionBy("x", "n")) / F.col("size")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / t)).cast("int")
    once = _ranked(values, ["x", "n"], [], "v").withColumn("w", central)
    once = cut(once.select("x", "n", "v", "w", (F.col("at") <= F.col("size") - F.col("need") + 1).alias("listed")))
    ranked = once.withColumn("band", F.explode(F.array(band, band + 1)))
    # a hub may hold the value beyond its listed ones, so that the lists of a group agree on one hub
    listed = ranked.filter("listed").drop("listed")
    several = listed.groupBy("v", "band").agg(F.count("*").alias("m")).filter("m > 1").select("v", "band")
    hubs = cut(_with_hub(listed.join(several, ["v", "band"]), ranked, ["v", "band"]).select("x", "h").distinct())
    forget(reps.sparkSession, once)
    pairs = hubs.join(hubs.groupBy("h").agg((F.count("*") > 1).alias("several")), "h")
    alone = pairs.filter("not several")
    both = alone.join(reps.select(F.col("node").alias("x"), F.col("sketch").alias("sx")), "x").join(reps.select(F.col("node").alias("h"), F.col("sketch").alias("sh")), "h")
    union = F.slice(F.array_sort(F.array_union("sx", "sh")), 1, k)
    estimate = F.size(F.array_intersect(F.array_intersect("sx", "sh"), union)) / F.size(union)
    likely = both.filter(estimate >= HOPELESS)
    return cut(pairs.filter("several").select("x", "h", "several").unionByName(likely.select("x", "h", "several")))


def _differences(found: DataFrame) -> DataFrame:
    """Lists (h, v) of the differences from a hub; a member is open if it is not linked to h."""
    open_hubs = found.filter("diff is not null and not link").select("h").distinct()
    rows = found.filter("diff is not null").join(open_hubs, "h", "left_semi")
    values = rows.select("x", "h", (~F.col("link")).alias("open"), "need", "own", "hub", F.size("diff").alias("size"), F.explode("diff").alias("v"))
    short = _ranked(values, ["x", "h"], ["h"], "v").filter(F.col("at") <= F.col("size") - F.greatest("need", F.lit(1)) + 1)
    return cut(short.select("x", "h", "v", "at", "open", "size", "own", "hub", (-F.col("size")).alias("w")))


def _rest(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Lists (h, v) with an open member and a member of another component; ``tests`` counts such pairs, ``parts`` deals them."""
    named = members.join(comps.withColumnRenamed("node", "x"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    each = named.groupBy("h", "v", "comp").agg(F.sum(F.col("open").cast("long")).alias("o"), F.count("*").alias("a"))
    several = each.groupBy("h", "v").agg((F.sum("o") * F.sum("a") - F.sum(F.col("o") * F.col("a"))).alias("tests")).filter("tests > 0")
    parts = F.least(F.ceil(F.col("tests") / PART_TESTS), F.lit(MOST_PARTS)).cast("int")
    return cut(named.join(several, ["h", "v"]).withColumn("parts", parts))


def _direct(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, h) of an open and any member of a list of differences that are of two components and can still be at the similarity.

    With o shared differences, |x & y| = |h| - |h - x| - |h - y| + o, so the similarity sets
    the least o; the first shared value, at places i and j, leaves 1 + min of what follows.
    """
    a = rest.filter("open").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).alias("a")
    b = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    both = F.col("a.size") + F.col("b.size")
    own = F.col("a.own") + F.col("b.own")
    least = percent * (F.col("a.hub") + own) - 100 * F.col("a.hub") + 100 * (both - own)
    most = 1 + F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    on = (F.col("a.comp") != F.col("b.comp")) & (most * (100 + percent) >= least)
    for c in ("h", "v", "part"):
        on &= F.col(f"a.{c}") == F.col(f"b.{c}")
    return a.join(b, on).select(F.greatest("a.x", "b.x").alias("x"), F.least("a.x", "b.x").alias("h")).distinct()


def near_components(docs: DataFrame, reps: DataFrame, same: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """(node, comp): components of all pairs at the similarity and of the links (a, b) in ``same``."""
    pairs = _first_pairs(reps, percent, k)
    sets = _full_sets(docs, _nodes(pairs), width)  # of all hubs and members, so of all pairs to come
    found, done = _links(pairs, sets, percent), pairs.select("x", "h")
    as_links = lambda f: f.filter("link").select(F.col("x").alias("a"), F.col("h").alias("b"))
    links = as_links(found).unionByName(same)
    comps = cut(connected(links))
    members = _differences(found)
    before = math.inf
    while True:
        forget(reps.sparkSession)
        rest = _rest(members, comps)
        n_tests = rest.select("h", "v", "tests").distinct().agg(F.sum("tests")).first()[0] or 0
        if not n_tests:
            return comps
        rounds = DIRECT_TESTS < n_tests <= before / 2
        if rounds:
            before = n_tests
            # hubs of the open lists; they only add links, so no pair is left untested for them
            named = rest.withColumnRenamed("h", "from_hub")
            p = _with_hub(named, named.filter("open"), ["from_hub", "v"]).select("x", "h").distinct()
        else:
            p = _direct(rest, percent)
        old = done.unionByName(done.select(F.col("h").alias("x"), F.col("x").alias("h")))
        p = cut(p.join(old, ["x", "h"], "left_anti").withColumn("several", F.lit(False)))
        new = None if p.isEmpty() else as_links(_links(p, sets, percent))
        if new is not None and not new.isEmpty():
            links = links.unionByName(new)
            comps = cut(connected(links))
        elif rounds:
            before = 0  # hubs add no more links: the lists are tested as they are
        done = done.unionByName(p.select("x", "h"))
        if not rounds:
            return comps


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a row of docs."""
    tune(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(_groups(docs, width, percent, k))


def _groups(docs: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    base = cut(docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(_sketches(width, k), "doc_id long, n long, f1 long, f2 long, sketch array<long>"))
    classes = cut(base.filter("f1 is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    rows = cut(base.select("doc_id", "n", "f1", "f2").join(classes.select("f1", "f2", "node"), ["f1", "f2"], "left").select("doc_id", "n", "node"))
    forget(docs.sparkSession, base)
    # one doc_id in several classes: its classes are one document
    split = rows.filter("node is not null").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("doc_id")
    same = cut(rows.join(split, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    comps = near_components(docs.select("doc_id", "text"), classes.select("node", "n", "sketch"), same, width, percent, k)
    named = rows.join(comps, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "node", "doc_id").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, k: int = K) -> DataFrame:
    """docs without the documents that aren't the least of their group."""
    gone = near_groups(docs, width, percent, k).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
