"""Unigram encoding over a double-array trie, with byte fallback, and decoding.

The vocabulary comes from a SentencePiece model file (read by a small wire parser; nothing
is trained). Files of merge-ranked pieces have no log scores; a piece of rank r gets the
Zipf score log(1 / (r + 2)), normalized over the vocabulary. Viterbi picks the split with
the greatest sum of scores; a character that no piece covers costs the least score less
10 and comes out as its UTF-8 bytes.

Spaces become markers (U+2581) and one marker goes before the text, if the model says so.
Where no piece has a marker after another character, the best split of a text is the best
splits of its chunks (markers, then other characters), which are cached in bounded halves;
a vocabulary with such pieces is searched over the whole text.
The trie is built once on the driver and shipped; its size is the vocabulary's.

A model without byte pieces gives its unknown piece for a character that no piece covers; one
without that, either, is refused. Only the plain normalization is read: a model with a
normalizer map, or one that removes extra spaces, is refused, too.

Defined cases: null or empty text has no ids; a marker character in the text decodes as a
space (``exact`` is false then); rows that repeat give repeated rows; an empty table gives
no rows; a column ``__pieces`` of the input raises ValueError.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reserved, settle, tune
from .token_store import Generations

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS = 80_000
#: Longer chunks are encoded each time, so that the cache's bytes are bounded too.
CACHED_CHARS = 64
#: Chunks are searched together by numpy from so many on, at most so many at once, of texts of so many characters.
FEW_CHUNKS = 50
CHUNKS_AT_ONCE = 20_000
CHARS_AT_ONCE = 1_000_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_PROCESS: dict[int, Encoder] = {}


def _fields(data: bytes):
    """(field, value) of a protobuf message: int, float32 or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif key & 7 == 1:
            at += 8
        else:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> dict:
    """Pieces with scores and kinds, and whether a marker is put before a text."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, unigram, prefix = [], True, True
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        elif field == 2:
            unigram = dict(_fields(value)).get(3, 1) == 1
        elif field == 3:
            rules = dict(_fields(value))
            prefix = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1):
                raise ValueError("the model normalizes texts (a map, or extra spaces), which isn't read here")
    if not unigram:
        ranks = [-s if s > -1e8 else len(pieces) for _, s, _ in pieces]
        total = math.log(sum(1 / (r + 2) for r, p in zip(ranks, pieces, strict=True) if p[2] == NORMAL))
        # float32, as a model file would hold them
        pieces = [(p, float(np.float32(-math.log(r + 2) - total)) if k == NORMAL else 0.0, k) for (p, _, k), r in zip(pieces, ranks, strict=True)]
    return {"pieces": pieces, "prefix": prefix}


class DoubleArray:
    """Trie as two arrays: from state s by code c to base[s] + c, if check there is s."""

    def __init__(self, words: dict[str, int]):
        self.codes = {ch: i + 1 for i, ch in enumerate(sorted({c for w in words for c in w}))}
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for word, ident in words.items():
            node = 0
            for ch in word:
                c = self.codes[ch]
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                node = tree[node][c]
            ends[node] = ident
        size = 2 * len(tree) + len(self.codes) + 2
        taken = bytearray(size)
        taken[0] = 1
        place: dict[int, int] = {}
        order = [0]
        for node in order:  # breadth first
            order.extend(tree[node].values())
        # wide nodes first, each at the first place of its children after ``start``; places that
        # fail often are left to the nodes of one child, which take any
        start, lone = 1, 1
        for node in sorted((n for n in order if tree[n]), key=lambda n: -len(tree[n])):
            cs = sorted(tree[node])
            if len(cs) > 1:
                start = self._fit(node, cs, taken, place, start)
                continue
            lone = lone if (free := taken.find(0, lone)) < 0 else free
            at = taken.find(0, max(lone, cs[0] + 1))
            if at < 0:
                at = len(taken)
                taken.extend(bytes(1024))
            taken[at] = 1
            place[node] = at - cs[0]
        self._settle(tree, place, ends, len(taken))

    @staticmethod
    def _fit(node: int, cs: list[int], taken: bytearray, place: dict[int, int], start: int) -> int:
        first, tries, at = cs[0], 0, start
        while True:
            at = taken.find(0, max(at, first + 1))
            if at < 0:
                at = len(taken)
            if at - first + cs[-1] >= len(taken):
                taken.extend(bytes(at - first + cs[-1] + 1024 - len(taken)))
            if not any(taken[at - first + c] for c in cs):
                break
            at, tries = at + 1, tries + 1
        for c in cs:
            taken[at - first + c] = 1
        place[node] = at - first
        return at if tries > 32 else start

    def _settle(self, tree, place, ends, size: int) -> None:
        state = {0: 0}
        check, base, value = [-1] * size, [0] * size, [-1] * size
        todo = [0]
        for node in todo:
            s = state[node]
            value[s] = ends.get(node, -1)
            if tree[node]:
                base[s] = place[node]
                for c, child in tree[node].items():
                    state[child] = place[node] + c
                    check[place[node] + c] = s
                    todo.append(child)
        self.base, self.check, self.value = base, check, value


class Model:
    """What a worker needs: the trie's arrays, scores, byte ids and the bytes of each piece."""

    def __init__(self, path: str):
        spec = read_model(path)
        pieces = spec["pieces"]
        self.prefix = spec["prefix"]
        trie = DoubleArray({p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)})
        self.codes, self.base, self.check, self.value = trie.codes, np.array(trie.base, np.int32), np.array(trie.check, np.int32), np.array(trie.value, np.int32)
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        self.least = min(s for _, s, k in pieces if k == NORMAL) - UNKNOWN_PENALTY
        kinds = [k for _, _, k in pieces]
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else -1
        self.has_bytes = kinds.count(BYTE) == 256
        if not self.has_bytes and self.unknown < 0:
            raise ValueError("the model has neither byte pieces nor an unknown piece")
        self.bytes_ = [max(self.unknown, 0)] * 256
        self.out: list[bytes] = []
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.bytes_[int(p[3:5], 16)] = i
            self.out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode())
        #: whether a text may be split before each run of markers that follows another character
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in pieces if k in (NORMAL, USER))
        self.ident = zlib.crc32(self.base.tobytes() + self.scores.tobytes())


class Encoder:
    def __init__(self, model: Model):
        self.m = model
        self.codes, self.base, self.check, self.value = model.codes, model.base.tolist(), model.check.tolist(), model.value.tolist()
        self.scores = model.scores.tolist()
        self.code_of = np.zeros(0x110000, np.int32)
        self.code_of[[ord(c) for c in self.codes]] = list(self.codes.values())
        self.cache = Generations(CACHE_CHUNKS)
        self.byte_ids = {*model.bytes_} if model.has_bytes else {model.unknown}

    def viterbi(self, chunk: str) -> list[int]:
        n = len(chunk)
        codes, base, check, value, scores, least = self.codes, self.base, self.check, self.value, self.scores, self.m.least
        cs = [codes.get(c, 0) for c in chunk]
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        came, ident = [0] * (n + 1), [-1] * (n + 1)
        top = len(check)
        for i in range(n):
            here, s, j = best[i], 0, i
            single = False
            while j < n and cs[j]:
                t = base[s] + cs[j]
                if t >= top or check[t] != s or not t:
                    break
                s = t
                j += 1
                v = value[s]
                if v >= 0:
                    score = here + scores[v]
                    if score > best[j]:
                        best[j], came[j], ident[j] = score, i, v
                    if j == i + 1:
                        single = True
            if not single and here + least > best[i + 1]:
                best[i + 1], came[i + 1], ident[i + 1] = here + least, i, -1
        out, at = [], n
        while at:
            i = came[at]
            if ident[at] >= 0:
                out.append(ident[at])
            else:
                out.extend([self.m.bytes_[b] for b in reversed(chunk[i:at].encode())] if self.m.has_bytes else [self.m.unknown])
            at = i
        return out[::-1]

    def viterbi_all(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as bytes: ``viterbi`` step by step over all chunks at once, at each place from the first start on, so that ties go the same way."""
        order = sorted(range(len(chunks)), key=lambda i: -len(chunks[i]))
        out: list[bytes] = [b""] * len(chunks)
        for lo in range(0, len(order), CHUNKS_AT_ONCE):
            part = order[lo : lo + CHUNKS_AT_ONCE]
            for i, ids in zip(part, self._step_all([chunks[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _step_all(self, chunks: list[str]) -> list[bytes]:
        """Chunks are in order of falling length."""
        m, size = self.m, np.array([len(c) for c in chunks])
        longest, n = int(size[0]), len(chunks)
        codes = np.zeros((n, longest + 1), np.int32)
        codes[np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = self.code_of[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0.0
        came, ident = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        top = len(m.check)
        for i in range(longest):
            count = int(np.searchsorted(-size, -i, "left"))  # chunks that go on at i
            rows, here, single = np.arange(count), best[:count, i], np.zeros(count, bool)
            state, j = np.zeros(count, np.int64), i
            while len(rows):
                c = codes[rows, j]
                to = m.base[state] + c
                ok = (c > 0) & (to > 0) & (to < top)
                ok[ok] = m.check[to[ok]] == state[ok]
                rows, state, j = rows[ok], to[ok].astype(np.int64), j + 1
                if not len(rows):
                    break
                piece = m.value[state]
                ends = piece >= 0
                at, piece = rows[ends], piece[ends]
                score = here[at] + m.scores[piece]
                more = score > best[at, j]
                hit = at[more]
                best[hit, j], came[hit, j], ident[hit, j] = score[more], i, piece[more]
                if j == i + 1:
                    single[at] = True
            alone = np.flatnonzero(~single & (here + m.least > best[:count, i + 1]))
            best[alone, i + 1], came[alone, i + 1], ident[alone, i + 1] = here[alone] + m.least, i, -1
        back, used = np.zeros((n, longest), np.uint32), np.zeros(n, np.int64)
        rows, at, bytewise = np.arange(n), size.copy(), np.zeros(n, bool)
        while len(rows):
            piece = ident[rows, at]
            bytewise[rows[piece < 0]] = True
            used[rows] += 1
            back[rows, longest - used[rows]] = piece.astype(np.uint32)
            at = came[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        flat = back.tobytes()
        ends = (np.arange(n) + 1) * longest * 4
        cuts = zip((ends - 4 * used).tolist(), ends.tolist(), bytewise.tolist(), chunks, strict=True)
        return [self._bytes(c) if b else flat[a:z] for a, z, b, c in cuts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= CHARS_AT_ONCE:
                held, end = held + len(texts[end]), end + 1
            out += self._encode_some(texts[at:end])
            at = end
        return out

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        mark = MARK if self.m.prefix else ""
        marked = [mark + t.replace(" ", MARK) if t else "" for t in texts]
        cut = [_CHUNK.findall(t) for t in marked] if self.m.splits else [[t] if t else [] for t in marked]
        self.cache.turn()
        distinct = set().union(*cut)
        long = {c: self._bytes(c) for c in distinct if len(c) > CACHED_CHARS}
        new = self.cache.missing(distinct.difference(long) if long else distinct)
        if len(new) < FEW_CHUNKS:
            for c in new:
                self.cache.now[c] = self._bytes(c)
        else:
            self.cache.now.update(zip(new, self.viterbi_all(new), strict=True))
        ids = self.cache.now
        if long:
            return [np.frombuffer(b"".join([long[c] if c in long else ids[c] for c in chunks]), np.uint32) for chunks in cut]
        return [np.frombuffer(b"".join([ids[c] for c in chunks]), np.uint32) for chunks in cut]

    def _bytes(self, chunk: str) -> bytes:
        return np.array(self.viterbi(chunk), np.uint32).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        out = self.m.out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


def encoder(model: Model) -> Encoder:
    if model.ident not in _PROCESS:
        _PROCESS.clear()  # a worker keeps the trie and words of one model
        _PROCESS[model.ident] = Encoder(model)
    return _PROCESS[model.ident]


def encode_texts(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """docs with ``__pieces``: n_pieces, n_bytes (fallback pieces), ids_crc32, decoded_sha256, exact, and the ids as little-endian u32 bytes if asked for."""
    spark = docs.sparkSession
    tune(spark)
    reserved(docs, "__pieces")
    shipped = spark.sparkContext.broadcast(Model(path))
    kinds = [("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())] + [("ids", pa.binary())] * with_ids

    def run(texts: pa.Array) -> pa.Array:
        enc, rows = encoder(shipped.value), []
        byte_piece = np.zeros(len(enc.scores), bool)
        byte_piece[list(enc.byte_ids)] = True
        plain = [t or "" for t in texts.to_pylist()]
        for text, ids in zip(plain, enc.encode_all(plain), strict=True):
            raw, back = ids.astype("<u4").tobytes(), enc.decode(ids)
            row = (len(ids), int(byte_piece[ids].sum()), zlib.crc32(raw), hashlib.sha256(back.encode()).hexdigest(), back == text)
            rows.append((*row, raw) if with_ids else row)
        cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        settle()
        return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    schema = "struct<n_pieces: long, n_bytes: long, ids_crc32: long, decoded_sha256: string, exact: boolean" + (", ids: binary>" if with_ids else ">")
    return docs.withColumn("__pieces", F.arrow_udf(run, schema)(F.col("text")))
