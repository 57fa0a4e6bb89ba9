"""The matching-block ratio in SQL, so that queries with similarities have twins there.

``ratio_parts(pairs)`` gives CTEs that turn a table ``pairs`` (a, b: distinct pairs of texts)
into ``ratios`` (a, b, r). A recursive table holds segments of both texts; each row knows its
longest common block (the first in a, then in b, on ties) and gives the segments left and
right of it. In texts b of 200 characters and more, characters that make up over a hundredth
don't begin blocks, but extend them. ``bag_bound`` and ``mask`` are cheap upper bounds.
"""

from __future__ import annotations


def _block(a: str, b: str, am: str, bm: str, al: str, ah: str, bl: str, bh: str) -> str:
    """A struct (i, j, k): the longest block of a[al:ah) and b[bl:bh), 1-based; k = 0 if there is none."""
    sa, sb = f"substr({am}, {al}, {ah} - {al})", f"substr({bm}, {bl}, {bh} - {bl})"
    # for each start in a how long a run b holds, the greatest, its first start, and where b has it first
    runs = f"list_transform(range(1, {ah} - {al} + 1), lambda p: len(list_filter(range(1, least({ah} - {al} - p + 1, {bh} - {bl}) + 1), lambda n: contains({sb}, substr({sa}, p, n)))))"
    return f"(SELECT {{'i': CASE WHEN k > 0 THEN {al} + list_position(runs, k) - 1 ELSE {al} END, 'j': CASE WHEN k > 0 THEN {bl} + strpos({sb}, substr({sa}, list_position(runs, k), k)) - 1 ELSE {bl} END, 'k': k}} FROM (SELECT runs, coalesce(list_max(runs), 0) AS k FROM (SELECT {runs} AS runs)))"


def _extended(a: str, b: str, al: str, ah: str, bl: str, bh: str, m: str) -> str:
    """The block m, grown by equal characters of any kind on both sides."""
    left = f"len(list_filter(range(1, least({m}.i - {al}, {m}.j - {bl}) + 1), lambda n: substr({a}, {m}.i - n, n) = substr({b}, {m}.j - n, n)))"
    right = f"len(list_filter(range(1, least({ah} - {m}.i - {m}.k, {bh} - {m}.j - {m}.k) + 1), lambda n: substr({a}, {m}.i + {m}.k, n) = substr({b}, {m}.j + {m}.k, n)))"
    return f"{{'i': {m}.i - {left}, 'j': {m}.j - {left}, 'k': {m}.k + {left} + {right}}}"


def ratio_parts(pairs: str, ratios: str = "ratios") -> str:
    seg = f"{ratios}_seg"
    dull = "list_filter(list_distinct(string_split(b, '')), lambda c: length(b) >= 200 AND length(b) - length(replace(b, c, '')) > length(b) // 100 + 1)"
    masked = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN list_contains(dull, c) THEN chr({1}) ELSE c END), '')"
    return f"""
{ratios}_texts AS (
  SELECT a, b, CASE WHEN len(dull) = 0 THEN a ELSE {masked.format('a', 1)} END AS am, CASE WHEN len(dull) = 0 THEN b ELSE {masked.format('b', 2)} END AS bm
  FROM (SELECT a, b, {dull} AS dull FROM {pairs})
), {seg}(a, b, am, bm, al, ah, bl, bh, m) AS (
  SELECT a, b, am, bm, al, ah, bl, bh, {_extended('a', 'b', 'al', 'ah', 'bl', 'bh', 'm')} FROM (
    SELECT *, {_block('a', 'b', 'am', 'bm', 'al', 'ah', 'bl', 'bh')} AS m FROM (
      SELECT a, b, am, bm, 1 AS al, length(a) + 1 AS ah, 1 AS bl, length(b) + 1 AS bh FROM {ratios}_texts))
  UNION ALL
  SELECT a, b, am, bm, al, ah, bl, bh, {_extended('a', 'b', 'al', 'ah', 'bl', 'bh', 'm')} FROM (
    SELECT *, {_block('a', 'b', 'am', 'bm', 'al', 'ah', 'bl', 'bh')} AS m FROM (
      SELECT a, b, am, bm, s.al, s.ah, s.bl, s.bh FROM (
        SELECT a, b, am, bm, unnest([{{'al': al, 'ah': m.i, 'bl': bl, 'bh': m.j}}, {{'al': m.i + m.k, 'ah': ah, 'bl': m.j + m.k, 'bh': bh}}]) AS s FROM {seg} WHERE m.k > 0)
      WHERE s.al < s.ah AND s.bl < s.bh))
), {ratios} AS (
  SELECT a, b, 2.0::DOUBLE * sum(m.k)::DOUBLE / (length(a) + length(b))::DOUBLE AS r FROM {seg} GROUP BY a, b
)"""


def bag_bound(a: str, b: str) -> str:
    """Characters that two texts can share in any order."""
    return f"list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, '')))))"


def mask(t: str) -> str:
    """Bits of the characters of a text."""
    return f"list_reduce(list_transform(string_split({t}, ''), lambda c: 1::BIGINT << (unicode(c) % 60)), lambda x, y: x | y)"


def can_share(a: str, b: str, ma: str, mb: str) -> str:
    """At most so many characters of a and b match, by their bits."""
    return f"least(length({a}) - bit_count({ma} & ~{mb}), length({b}) - bit_count({mb} & ~{ma}))"
