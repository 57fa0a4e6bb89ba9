"""The line with the longest common opening, found by order instead of by pairs.

In sorted order the longest opening that a text shares with any line is shared with a
neighbour. One pass up and one down over texts and lines of a common opening, sorted by the
engine (which spills), give it in linear time however many lines open alike. Ties go to the
first line in index order: a stack keeps, for each length that the last line shares with
those before it, the first of these.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemend.functions.text import strip

PLACE = ("asserted", "by", "t")


def shared_opening(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Before:
    """What the lines read so far share with the last of them."""

    def __init__(self):
        self.last: str | None = None
        self.first: list[tuple[int, tuple]] = []  # (shared length, first place), lengths rising

    def add(self, line: str, place: tuple) -> None:
        if self.last is not None:
            n, best = shared_opening(self.last, line), None
            while self.first and self.first[-1][0] >= n:
                own = self.first.pop()[1]
                best = own if best is None else min(best, own)
            if best is not None:
                self.first.append((n, best))
        self.last = line
        self.first.append((len(line), place))

    def ask(self, text: str) -> tuple[int, tuple] | None:
        if self.last is None:
            return None
        n = shared_opening(self.last, text)
        return n, min(place for length, place in self.first if length >= n)


def _pass(keys: int):
    """Rows (keys, head, s, is_line, text, asserted, by, t) in order -> texts with what is shared with the lines before."""
    names = [f"k{i}" for i in range(keys)] + ["text", "n", *PLACE]
    kinds = [pa.string()] * (keys + 1) + [pa.int32(), pa.int32(), pa.int64(), pa.string()]

    def run(batches):
        group, before = None, Before()
        for batch in batches:
            out = []
            for *key, s, is_line, text, asserted, by, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != group:
                    group, before = key, Before()
                if is_line:
                    before.add(s, (asserted, by, t))
                elif (found := before.ask(s)) is not None:
                    out.append((*key[:keys], text, found[0], *found[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def longest_opening(texts: DataFrame, lines: DataFrame, key: list[str], least: int) -> DataFrame:
    """(key, text, other): for each text (key, text) the other line (key, other, ord) that shares the longest opening.

    Openings are of stripped texts and at least ``least`` long; ord is (asserted, by, t).
    """
    long_enough = lambda df, c: df.withColumn("s", strip(c)).filter(F.length("s") >= least).withColumn("head", F.substring("s", 1, least))
    asked = long_enough(texts.select(*key, "text").distinct(), "text")
    given = long_enough(lines.select(*key, "other", F.col("ord.asserted").cast("int").alias("asserted"), F.col("ord.by").cast("long").alias("by"), F.col("ord.t").alias("t")), "other")
    place = F.struct(*PLACE)
    # lines that differ from the text in outer white space only are spellings of one text, and few
    same = asked.join(given.select(*key, "s", "other", *PLACE), [*key, "s"]).filter("text <> other").select(*key, "text", F.length("s").alias("n"), *PLACE)
    first = given.groupBy(*key, "head", "s").agg(F.min(place).alias("p"))
    numbered = [F.col(c).alias(f"k{i}") for i, c in enumerate(key)]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(PLACE, ("int", "long", "string"), strict=True)]
    both = asked.select(*numbered, "head", "s", F.lit(False).alias("is_line"), "text", *nothing).unionByName(
        first.select(*numbered, "head", "s", F.lit(True).alias("is_line"), F.lit(None).cast("string").alias("text"), "p.*")
    )
    ks = [f"k{i}" for i in range(len(key))]
    dealt = both.repartition(*ks, "head")
    schema = ", ".join(f"{k} string" for k in ks) + ", text string, n int, asserted int, by long, t string"
    # a text comes before the lines that equal it, in both directions
    up = dealt.sortWithinPartitions(*ks, "head", "s", "is_line").mapInArrow(_pass(len(ks)), schema)
    down = dealt.sortWithinPartitions(*ks, "head", F.desc("s"), "is_line").mapInArrow(_pass(len(ks)), schema)
    found = up.unionByName(down).select(*[F.col(k).alias(c) for k, c in zip(ks, key, strict=True)], "text", "n", *PLACE).unionByName(same)
    best = found.groupBy(*key, "text").agg(F.min(F.struct((-F.col("n")).alias("n"), *PLACE)).alias("b"))
    return best.select(*key, "text", F.col("b.t").alias("other"))
