"""Candidate pairs of similar texts: blocks of one length, in which counts bound all pairs.

Lengths within the gap are the only key, so a text moves once for each length that it may
meet. In a block, two bounds that lose nothing are taken from counts: characters that two
texts share, then trigrams. Let L be the sum of two lengths and t the ratio: at least t L / 2
characters lie in at most (1 - t) L + 1 matching blocks, and a block of b characters holds
b - 2 trigrams, so both texts hold L (2.5 t - 2) - 2 trigrams in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block holds at most about so many characters of probes and of canonicals, and so many canonicals.
CHARACTERS_A_DEAL = 8_000_000
CHARACTERS_A_PART = 2_000_000
TEXTS_A_PART = 4_000
LETTERS = 64
GRAMS = 1024
#: Counts that are compared at once.
CELLS = 1 << 22


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, code points of all texts in one array)."""
    return np.array([len(t) for t in texts], np.int64), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _counted(owner: np.ndarray, what: np.ndarray, n: int, classes: int) -> np.ndarray:
    return np.bincount(owner * classes + what, minlength=n * classes).reshape(n, classes).astype(np.int32)


def _letters(texts: list[str]) -> np.ndarray:
    length, codes = _codes(texts)
    return _counted(np.repeat(np.arange(len(texts)), length), codes % LETTERS, len(texts), LETTERS)


def _grams(texts: list[str]) -> np.ndarray:
    length, codes = _codes(texts)
    owner = np.repeat(np.arange(len(texts)), length)
    whole = np.flatnonzero(owner[:-2] == owner[2:]) if len(owner) > 2 else np.zeros(0, np.int64)
    mixed = (codes[whole] * 1_000_003 + codes[whole + 1]) * 1_000_003 + codes[whole + 2]
    return _counted(owner[whole], (mixed ^ (mixed >> 20)) % GRAMS, len(texts), GRAMS)


def can_be_alike(asked: list[str], others: list[str], t: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs but those that counts of characters or of trigrams show to be under a ratio of t."""
    found = [(np.zeros(0, np.int64),) * 2]
    theirs, size = _letters(others), np.array([len(x) for x in others], np.int64)
    step = max(1, CELLS // (LETTERS * len(others)))
    for lo in range(0, len(asked), step):
        part = asked[lo : lo + step]
        both = np.array([len(x) for x in part], np.int64)[:, None] + size[None, :]
        i, j = np.nonzero(2 * np.minimum(_letters(part)[:, None, :], theirs[None, :, :]).sum(axis=2) >= t * both - 1e-9)
        least = both[i, j] * (2.5 * t - 2) - 2 - 1e-9
        if len(i) and least.max() > 0:
            stay = []
            for at in range(0, len(i), CELLS // GRAMS):
                a, b = i[at : at + CELLS // GRAMS], j[at : at + CELLS // GRAMS]
                (x, own), (y, other) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
                shared = np.minimum(_grams([part[k] for k in x])[own], _grams([others[k] for k in y])[other]).sum(axis=1)
                stay.append(shared >= least[at : at + CELLS // GRAMS])
            keep = np.concatenate(stay)
            i, j = i[keep], j[keep]
        found.append((i + lo, j))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def near_pairs(probes: DataFrame, canon: DataFrame, key: list[str], gap: int, t: float, shortest: int, with_sizes=lambda df: df) -> DataFrame:
    """Distinct pairs (key, text, other) that can have a ratio of t, with lengths within the gap.

    probes: key, text, and columns that go along; canon: key, other; both distinct; all texts
    at least ``shortest`` long. with_sizes marks the small tables of lengths (see ``cut.small``).
    """
    at = [*key, "__n"]
    blocks = lambda chars, most: F.ceil(F.greatest(F.count("*") * F.first("__n") / chars, F.count("*") / most)).cast("int")
    right = canon.select(*key, "other", F.length("other").alias("__n"))
    parts = right.groupBy(*at).agg(blocks(CHARACTERS_A_PART, TEXTS_A_PART).alias("__parts"))
    # most probes are as long as no canonical, within the gap
    band = F.explode(F.sequence(F.greatest(F.lit(shortest), F.col("__n") - gap), F.col("__n") + gap)).alias("__n")
    sizes = parts.select(*key, band).distinct()
    more = [c for c in probes.columns if c not in (*key, "text")]
    met = probes.withColumn("__n", F.length("text")).join(with_sizes(sizes), at, "left_semi")
    left = met.select(*key, "text", *more, band).join(with_sizes(parts), at)
    deals = left.groupBy(*at).agg(blocks(CHARACTERS_A_DEAL, CHARACTERS_A_DEAL).alias("__deals"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = left.join(deals, at).withColumn("__deal", own("text", "__deals")).withColumn("__part", every("__parts"))
    right = right.join(parts, at).join(deals, at).withColumn("__part", own("other", "__parts")).withColumn("__deal", every("__deals"))
    block = [*at, "__part", "__deal"]
    # names of their own, as both sides may come from one table
    named = [F.col(c).alias(f"b_{c}") for c in block]
    by = [f"b_{c}" for c in block]
    schema = probes.select(*key, "text", F.col("text").alias("other"), *more).schema

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine) or not len(theirs):
            i = j = np.zeros(0, np.int64)
        else:
            i, j = can_be_alike(mine["text"].to_pylist(), theirs["other"].to_pylist(), t)
        mine, theirs = mine.take(pa.array(i)), theirs.take(pa.array(j))
        return pa.table([*[mine[f"b_{c}"] for c in key], mine["text"], theirs["other"], *[mine[c] for c in more]], names=[*key, "text", "other", *more])

    pairs = left.select(*named, "text", *more).groupBy(*by).cogroup(right.select(*named, "other").groupBy(*by)).applyInArrow(run, schema)
    return pairs.filter("text <> other")
