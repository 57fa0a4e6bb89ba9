"""What Spark has no function for: matching-block similarity, the nearest word of a block, mark folding.

``ratio`` is the share of characters in matching blocks (longest block first, then both
sides of it). It isn't symmetric, so the order of arguments is part of each call. The
functions take Arrow batches; upper bounds (lengths, then character bags) spare most of
the exact work where only values from ``least`` on matter.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def ratio_value(a: str, b: str, least: float = 0.0) -> float:
    """The ratio, or 0.0 if it is under ``least``."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if least and 2 * min(len(a), len(b)) < least * total:
        return 0.0
    if least and 2 * (Counter(a) & Counter(b)).total() < least * total:
        return 0.0
    value = SequenceMatcher(None, a, b).ratio()
    return value if value >= least else 0.0


def bag_bounds(left: list[str], right: list[str]) -> np.ndarray:
    """An upper bound of each pair's ratio, for a whole batch: bags of characters hashed to 64 counts can only share more."""
    place: dict[str, int] = {}
    at = np.array([[place.setdefault(x, len(place)), place.setdefault(y, len(place))] for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    length = np.array([len(x) for x in place], np.int64)
    owner = np.repeat(np.arange(len(place)), length)
    codes = np.frombuffer("".join(place).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    bags = np.bincount(owner * 64 + codes % 64, minlength=64 * len(place)).reshape(-1, 64).astype(np.int32)
    shared = np.minimum(bags[at[:, 0]], bags[at[:, 1]]).sum(axis=1)
    return 2 * shared / np.maximum(length[at[:, 0]] + length[at[:, 1]], 1)


def ratio(a, b, least: float = 0.0) -> Column:
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = left.to_pylist(), right.to_pylist()
        whole = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if p is not None and q is not None]
        out: list[float | None] = [None] * len(x)
        hope = bag_bounds([x[i] for i in whole], [y[i] for i in whole]) >= least - 1e-9 if least and whole else np.ones(len(whole), bool)
        for i, h in zip(whole, hope.tolist(), strict=True):
            out[i] = ratio_value(x[i], y[i], least) if h else 0.0
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(col(a), col(b))


def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts.to_pylist()], pa.string())


def fold_marks(c) -> Column:
    """Decomposed, combining marks dropped."""
    return F.arrow_udf(_folded, "string")(col(c))


def drop_non_ascii(c) -> Column:
    return F.regexp_replace(col(c), r"[^\x00-\x7F]", "")


# --- nearest words -----------------------------------------------------------

BUCKETS = 32
LEVELS = 2
#: Words of 64 or more characters don't fit the bits of a machine word; their bags alone bound them.
WORD_BITS = 64


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, code points of all words in one array)."""
    return np.array([len(w) for w in words], np.int64), np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """0/1 vectors of (character class, how manieth) up to LEVELS, and how many characters they leave out."""
    length, codes = _characters(words)
    owner = np.repeat(np.arange(len(words)), length)
    counts = np.bincount(owner * BUCKETS + codes % BUCKETS, minlength=len(words) * BUCKETS).reshape(-1, BUCKETS)
    return np.concatenate([counts > k for k in range(LEVELS)], axis=1).astype(np.float32), np.maximum(counts - LEVELS, 0).sum(axis=1)


class Trie:
    """Words of one length by their openings: depth by depth, each node's character and its range of children."""

    def __init__(self, letters: np.ndarray):
        n, self.size = letters.shape
        self.rows = np.lexsort(letters.T[::-1]) if self.size else np.arange(n)
        ordered = letters[self.rows]
        differs = ordered[1:] != ordered[:-1]
        lead = np.where(differs.any(axis=1), differs.argmax(axis=1), self.size)
        starts = [np.zeros(1, np.int64)] + [np.flatnonzero(np.concatenate(([True], lead < t))) for t in range(1, self.size + 1)] + [np.arange(n)]
        self.char = [None] + [ordered[starts[t], t - 1] for t in range(1, self.size + 1)]
        self.first = [np.append(np.searchsorted(starts[t + 1], starts[t]), len(starts[t + 1])) for t in range(self.size + 1)]

    def children(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into node, child): all children of the nodes; below the last depth, rows."""
        count = self.first[depth][node + 1] - self.first[depth][node]
        owner = np.repeat(np.arange(len(node)), count)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + self.first[depth][node][owner]


#: States that a walk holds at once.
FRONTIER = 1 << 16


def _below(bits: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << bits.clip(0, WORD_BITS - 1).astype(np.uint64)) - np.uint64(1)


def _walk(trie: Trie, masks: np.ndarray, length: np.ndarray, need: np.ndarray, half: int, lost: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, row, common): words whose longest common subsequence with asked word i reaches need[i], with at most lost[i] of the first ``half`` characters outside of it.

    A state is one bit a character of the asked word (masks: where each letter stands in it). A
    branch ends where its opening has lost more characters than the whole may, or the half may.
    """
    size = trie.size
    spare, skipped = size - need, length - need
    within = [_below(np.minimum(length, t + length - size)) for t in range(size + 1)]
    near = [_below(np.minimum(length, t + skipped)) for t in range(half + 1)]
    whole, found = _below(length), []
    i = np.flatnonzero((lost >= 0) & (need <= np.minimum(length, size)))
    todo = [(0, i, np.zeros(len(i), np.int64), np.full(len(i), ~np.uint64(0)))]
    while todo:
        depth, i, node, state = todo.pop()
        while depth < size and len(i):
            if len(i) > 1 and (trie.first[depth][node + 1] - trie.first[depth][node]).sum() > FRONTIER:
                cut = len(i) // 2
                todo.append((depth, i[cut:], node[cut:], state[cut:]))
                i, node, state = i[:cut], node[:cut], state[:cut]
                continue
            owner, node = trie.children(depth, node)
            depth += 1
            i, state = i[owner], state[owner]
            hit = state & masks[i, trie.char[depth][node]]
            state = (state + hit) | (state - hit)
            stay = np.bitwise_count(~state & within[depth][i]) >= depth - spare[i]
            if depth <= half:
                stay &= np.bitwise_count(~state & near[depth][i]) >= depth - lost[i]
            if seen is not None:
                seen.append(len(i))
            i, node, state = i[stay], node[stay], state[stay]
        if len(i):
            owner, row = trie.children(size, node)
            found.append((i[owner], trie.rows[row], np.bitwise_count(~state & whole[i])[owner].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


class Openings:
    """Words of one length, to be asked for by their first and by their last halves.

    Of the characters that a word may lose against an asked one, its first half loses at most
    half, or its last half loses fewer. So one walk from each end, with half the losses in the
    half that it begins with, meets all that qualify, and few others.
    """

    def __init__(self, words: list[str]):
        self.size, self.n = len(words[0]), len(words)
        self.alphabet, place = np.unique(_characters(words)[1], return_inverse=True)
        letters = place.reshape(self.n, self.size)
        self.ends = (Trie(letters), Trie(letters[:, ::-1]))

    def masks(self, asked: list[str], backward: bool) -> np.ndarray:
        length, mine = _characters(asked)
        owner = np.repeat(np.arange(len(asked)), length)
        at = np.arange(len(mine)) - np.repeat(np.cumsum(length) - length, length)
        if backward:
            at = length[owner] - 1 - at
        known = np.searchsorted(self.alphabet, mine).clip(max=len(self.alphabet) - 1)
        held = self.alphabet[known] == mine
        out = np.zeros((len(asked), len(self.alphabet)), np.uint64)
        np.bitwise_or.at(out, (owner[held], known[held]), np.uint64(1) << at[held].astype(np.uint64))
        return out

    def alike(self, asked: list[str], need: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, common): all pairs whose longest common subsequence reaches need[i]; asked words fit a machine word. seen: gets the states visited."""
        length, spare = np.array([len(w) for w in asked], np.int64), self.size - need
        first = _walk(self.ends[0], self.masks(asked, False), length, need, self.size // 2, spare // 2, seen)
        last = _walk(self.ends[1], self.masks(asked, True), length, need, self.size - self.size // 2, spare - spare // 2 - 1, seen)
        i, j, common = (np.concatenate(c) for c in zip(first, last, strict=True))
        _, once = np.unique(i * self.n + j, return_index=True)
        return i[once], j[once], common[once]


def nearest_words(asked: list[str], others: list[str], places: list, least: float, block: int = 4096) -> list[tuple[int, float, int]]:
    """(i, ratio, j): for asked words with a ratio of ``least`` to one of ``others``, the best; ties to the smallest place.

    All of ``others`` have one length. Walks over their openings and endings find those whose
    longest common subsequence is long enough (for longer words, bags of characters bound all
    pairs), and the exact ratio is taken from the highest bound down while it can still win.
    """
    out = []
    if not asked or not others:
        return out
    size = len(others[0])
    openings = Openings(others) if any(len(w) < WORD_BITS for w in asked) else None
    right, right_more = _bags(others) if any(len(w) >= WORD_BITS for w in asked) else (None, None)
    rank = np.argsort(np.array(sorted(range(len(others)), key=places.__getitem__)))
    for lo in range(0, len(asked), block):
        part = asked[lo : lo + block]
        length = np.array([len(w) for w in part], np.int64)
        need = np.ceil(least * (length + size) / 2 - 1e-9).astype(np.int64)
        short, long = np.flatnonzero(length < WORD_BITS), np.flatnonzero(length >= WORD_BITS)
        i, j, most = openings.alike([part[k] for k in short], need[short]) if len(short) else (np.zeros(0, np.int64),) * 3
        i = short[i]
        if len(long):
            left, left_more = _bags([part[k] for k in long])
            shared = left @ right.T
            if left_more.any() and right_more.any():
                shared += np.minimum(left_more[:, None], right_more[None, :])
            more, other = np.nonzero(shared >= need[long][:, None])
            i, j = np.concatenate((i, long[more])), np.concatenate((j, other))
            most = np.concatenate((most, np.minimum(shared[more, other].astype(np.int64), np.minimum(length[long[more]], size))))
        order = np.lexsort((rank[j], -most, i))
        best: dict[int, tuple[float, int, int]] = {}
        for a, b, m in zip(i[order].tolist(), j[order].tolist(), most[order].tolist(), strict=True):
            now = best.get(a)
            bound = 2.0 * m / (len(part[a]) + size)
            if now is not None and (bound, -rank[b]) < now[:2]:
                continue
            value = SequenceMatcher(None, part[a], others[b]).ratio()
            if value >= least and (now is None or (value, -rank[b]) > now[:2]):
                best[a] = (value, -rank[b], b)
        out += [(lo + a, value, b) for a, (value, _, b) in best.items()]
    return out
