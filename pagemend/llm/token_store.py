"""Token ids of a corpus in segment files with Elias-Fano document boundaries.

A segment file holds documents of one doc_id range in ascending order::

    magic "EFTK", u32 version, u32 id_bytes, u64 n_docs, u64 n_ids, u64 n_null, i64 first_id,
    boundaries, doc_ids, ids (u16 or u32)

Boundaries (n_docs + 1 offsets, the first 0) and doc_ids (of the documents that have one,
less the first) are Elias-Fano lists::

    u64 n, u32 low_bits, u32 n_samples, u64 n_low_words, u64 n_high_words,
    low words, high words, select samples (u64)

Values are split into ``low_bits`` low bits, packed, and high parts in unary; select(i) finds
the i-th set bit from a sample every ``SAMPLE`` ones, so that a boundary takes
2 + log2(n_ids / n_docs) bits. Segments begin at bounds in the order of (doc_id, hash of the
text), at most ``SEGMENT_DOCS`` documents apart, so that rows of one doc_id may fill many; a
task also begins a new file after ``SEGMENT_BYTES``, and holds no more than that and one
document.

Files go to the shared folder through pyarrow's file systems under a name of their own
for each attempt; the checkpointed manifest names those that count. A retried or lost
task leaves at most an unnamed file behind, never a half-read one.

Defined cases: null text counts as empty and still gets the end id; a null doc_id comes
first; rows that repeat a doc_id are written each, in an order fixed by their ids; an
empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete_uri, scratch_uri, tune

MAGIC = b"EFTK"
HEAD = struct.Struct("<4sIIQQQq")
LIST = struct.Struct("<QIIQQ")
SAMPLE = 64
END_ID = 2
SEGMENT_DOCS = 4096
SEGMENT_BYTES = 32 << 20
#: Words (and pieces) in each of the two halves of a worker's cache: about 150 MB in all.
CACHE_WORDS = 200_000


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """values: non-decreasing, >= 0, at least one."""
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1])
        low_bits = max(0, int(np.floor(np.log2(max(1, top / n)))))
        low = np.zeros(0, np.uint64)
        if low_bits:
            bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            low = _words(bits)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, _words(bits), at[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """The position of the i-th set bit of the high part."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word, mask = at >> 6, (~0 << (at & 63)) & 0xFFFFFFFFFFFFFFFF
        bits = int(self.high[word]) & mask
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        low = 0
        if self.low_bits:
            at = i * self.low_bits
            both = int(self.low[at >> 6]) | (int(self.low[(at >> 6) + 1]) << 64 if (at >> 6) + 1 < len(self.low) else 0)
            low = (both >> (at & 63)) & ((1 << self.low_bits) - 1)
        return ((self.select(i) - i) << self.low_bits) | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low.view(np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)


    def pack(self) -> bytes:
        return LIST.pack(self.n, self.low_bits, len(self.samples), len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """The list that begins at a byte, and where it ends."""
        n, low_bits, n_samples, n_low, n_high = LIST.unpack_from(data, at)
        at, parts = at + LIST.size, []
        for size in (n_low, n_high, n_samples):
            parts.append(np.frombuffer(data, np.uint64, size, at))
            at += 8 * size
        return cls(n, low_bits, *parts), at


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], id_bytes: int) -> bytes:
    """doc_ids ascend, nulls first."""
    bounds = EliasFano.build(np.concatenate([[0], np.cumsum([len(x) for x in ids])]))
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    own = EliasFano.build(known.view(np.uint64) - np.int64(first).view(np.uint64) if len(known) else np.zeros(1, np.uint64))
    flat = np.concatenate(ids).astype(np.uint16 if id_bytes == 2 else np.uint32)
    head = HEAD.pack(MAGIC, 2, id_bytes, len(ids), len(flat), len(ids) - len(known), first)
    return b"".join([head, bounds.pack(), own.pack(), flat.tobytes()])


class Segment:
    """A segment file read back; documents are cut out by select on the boundaries."""

    def __init__(self, data: bytes):
        magic, version, id_bytes, self.n_docs, n_ids, self.n_null, self.first = HEAD.unpack_from(data)
        if magic != MAGIC or version != 2:
            raise ValueError("not a segment file")
        self.bounds, at = EliasFano.unpack(data, HEAD.size)
        self.own, at = EliasFano.unpack(data, at)
        self.ids = np.frombuffer(data, np.uint16 if id_bytes == 2 else np.uint32, n_ids, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else (self.first + self.own[i - self.n_null] + (1 << 63)) % (1 << 64) - (1 << 63)

    def all_ids(self) -> list[int | None]:
        known = (self.own.all() + np.int64(self.first))[: self.n_docs - self.n_null]
        return [None] * self.n_null + known.tolist()

    def document(self, i: int) -> tuple[int, np.ndarray]:
        """Offset within the segment and ids of the i-th document."""
        a, b = self.bounds[i], self.bounds[i + 1]
        return a, self.ids[a:b]


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> str:
    system, path = filesystem(folder)
    final = f"{path}/{name}"
    with system.open_output_stream(final) as out:
        out.write(data)
    return name


def read_file(folder: str, name: str) -> bytes:
    system, path = filesystem(folder)
    with system.open_input_stream(f"{path}/{name}") as f:
        return f.read()


class WordTokenizer:
    """Encodes texts word by word with bounded caches.

    Only for tokenizers that drop white space and never merge over it; then the ids of a
    text are the ids of its words in turn. ``separable`` checks the tokenizer's own parts.
    A word of Latin-1 that isn't cached is lower-cased, as the tokenizer would do, and cut
    further where a letter meets punctuation (the tokenizer's own split always cuts there;
    apostrophes are left, as they begin suffixes). Pieces of letters only go straight to
    the tokenizer's BPE model in its byte alphabet.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.separable = self._separable(path)
        self.words, self.pieces = Generations(CACHE_WORDS), Generations(CACHE_WORDS)

    @staticmethod
    def _separable(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        split = next((p for p in pre.get("pretokenizers", []) if p.get("type") == "Split"), {})
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        drops = split.get("behavior") == "Removed" and split.get("invert") and "\\s" in str(split.get("pattern"))
        suffix = (spec.get("model") or {}).get("type") == "BPE" and any(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") for p in pre.get("pretokenizers", []))
        marked = suffix and all(t["content"].startswith("<|") and t["content"].endswith("|>") for t in spec.get("added_tokens", []))
        return bool(drops) and marked and kinds == ["NFC", "Replace", "Lowercase"] and not spec.get("post_processor")

    def _run(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: pieces are encoded together and told apart by offsets."""
        out = []
        for i in range(0, len(pieces), 500):
            part = pieces[i : i + 500]
            whole = self.tok.encode(" ".join(part), add_special_tokens=False)
            at = np.array([o[0] for o in whole.offsets], np.int64)
            starts = np.cumsum([0, *(len(p) + 1 for p in part)])
            if len(at) and (np.diff(at) < 0).any():
                out += [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch(part, add_special_tokens=False)]
                continue
            ids, cuts = np.array(whole.ids, np.uint32).tobytes(), (4 * np.searchsorted(at, starts)).tolist()
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, words: list[str]) -> None:
        cut = [_SEAM.split(w.lower()) if _LATIN.fullmatch(w) and "<|" not in w else [w] for w in words]
        known = self.pieces
        known.turn()
        new = known.missing({p for parts in cut for p in parts})
        tokenize, rest = self.tok.model.tokenize, []
        for p in new:
            if _LETTERS.fullmatch(p):
                known.now[p] = array("I", [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))]).tobytes()
            else:
                rest.append(p)
        for p, ids in zip(rest, self._run(rest), strict=True):
            known.now[p] = ids
        for w, parts in zip(words, cut, strict=True):
            self.words.now[w] = b"".join([known.now[p] for p in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.separable:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        out = []
        for text in texts:
            # only white space that every such tokenizer drops; other kinds stay inside a "word"
            words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            self.words.turn()
            new = self.words.missing(set(words))
            if new:
                self._learn(new)
            ids = self.words.now
            out.append(np.frombuffer(b"".join([ids[w] for w in words]), np.uint32))
        return out


class Generations:
    """A dictionary of bounded size: when the young half is full it becomes the old half."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {"": b""}, {}

    def turn(self) -> None:
        if len(self.now) > self.most:
            self.now, self.old = {"": b""}, self.now

    def missing(self, keys: set[str]) -> list[str]:
        keys = keys.difference(self.now)
        if self.old:
            for k in [k for k in keys if k in self.old]:  # intersection() would walk the dictionary
                self.now[k] = self.old[k]
            keys = keys.difference(self.now)
        return list(keys)


_LATIN = re.compile(r"[\x00-\xff]*")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_SEAM = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[!-&(-/:-@\[-`{-~])")
#: The byte alphabet of byte-level vocabularies: printable Latin-1 stays, other bytes go to U+0100 and up, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_TOKENIZERS: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with its caches, for all tasks of a Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _tokenize(path: str, id_bytes: int):
    def run(batches):
        tok = worker_tokenizer(path)
        kind = np.uint16 if id_bytes == 2 else np.uint32
        for batch in batches:
            ids = [np.append(x, np.uint32(END_ID)).astype(kind).tobytes() for x in tok.encode([t or "" for t in batch.column(2).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["seg", "doc_id", "ids"])

    return run


def _write_segments(folder: str, id_bytes: int, segment_bytes: int):
    kind = np.uint16 if id_bytes == 2 else np.uint32

    def flush(seg, part, docs, ids):
        data = pack_segment(docs, [np.frombuffer(x, kind) for x in ids], id_bytes)
        name = write_file(folder, f"seg-{seg:09d}-{part:06d}-{uuid.uuid4().hex}.eftk", data)
        row = (seg, part, name, len(docs), sum(len(x) for x in ids) // id_bytes, zlib.crc32(data), len(data))
        return pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, row, strict=True))], schema=MANIFEST)

    def run(batches):
        seg, part, docs, ids, held = None, 0, [], [], 0
        for batch in batches:
            for s, d, x in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if docs and (s != seg or held + len(x) > segment_bytes):
                    yield flush(seg, part, docs, ids)
                    docs, ids, held = [], [], 0
                    part = part + 1 if s == seg else 0
                seg = s
                docs.append(d)
                ids.append(x)
                held += len(x)
        if docs:
            yield flush(seg, part, docs, ids)

    return run


NULL = -(1 << 63)
MANIFEST = pa.schema([("seg", pa.int64()), ("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("n_bytes", pa.int64())])


def write_store(docs: DataFrame, path: str, folder: str, id_bytes: int = 2, segment_docs: int = SEGMENT_DOCS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Encode all documents into segment files in ``folder``; returns the manifest.

    Segment bounds come from doc_ids alone, and from hashes of texts where one id has very many
    rows: they are ranged into partitions, and the first of every ``segment_docs`` in a
    partition starts a segment.
    """
    spark = docs.sparkSession
    tune(spark)
    delete_uri(spark, folder)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    key, spread = F.coalesce("doc_id", F.lit(NULL)).alias("k"), F.xxhash64("text").alias("h")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def every(rows: DataFrame, *order: str) -> list[tuple]:
        """The first row of every ``segment_docs`` in order, in ranges."""
        ranged = rows.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id())
        numbered = ranged.withColumn("rn", F.row_number().over(Window.partitionBy("pid").orderBy(*order)))
        return [tuple(r) for r in numbered.filter((F.col("rn") - 1) % segment_docs == 0).select(*order).collect()]

    # one number for each segment_docs documents: 8 bytes of driver memory for about 30 MB of text
    first = Counter(k for (k,) in every(docs.select(key), "k"))
    starts = {(k, NULL) for k in first}
    # ids whose rows fill whole segments are cut further by the hashes of their texts
    full = [(k,) for k, n in first.items() if n > 1]
    if full:
        hot = F.broadcast(spark.createDataFrame(full, "k long"))  # fewer than there are segments
        starts |= set(every(docs.select(key, spread).join(hot, "k", "left_semi"), "k", "h"))
    starts = sorted(starts)
    bounds = np.array(starts, np.int64).reshape(-1, 2)
    locate = F.pandas_udf(_locate(spark.sparkContext.broadcast(bounds)), "long")
    tokens = docs.select(locate(key, spread).alias("seg"), "doc_id", "text").mapInArrow(_tokenize(path, id_bytes), "seg long, doc_id long, ids binary")
    n = max(1, min(len(starts), max(parts, len(starts) // 8)))
    dealt = tokens.repartition(n, "seg").sortWithinPartitions("seg", F.col("doc_id").asc_nulls_first(), "ids")
    return cut(dealt.mapInArrow(_write_segments(folder, id_bytes, segment_bytes), "seg long, part long, name string, n_docs long, n_ids long, crc32 long, n_bytes long"))


def _locate(bounds):
    def run(key: pd.Series, spread: pd.Series) -> pd.Series:
        k, h = bounds.value[:, 0], bounds.value[:, 1]
        own, x = key.to_numpy(np.int64), spread.to_numpy(np.int64)
        lo, hi = np.searchsorted(k, own, "left"), np.searchsorted(k, own, "right")
        out = hi - 1
        for i in np.flatnonzero(hi > lo):  # an id that starts a segment: the hash tells on which side
            out[i] = lo[i] + np.searchsorted(h[lo[i] : hi[i]], x[i], "right") - 1
        return pd.Series(out.clip(min=0))

    return run


def _read_segments(folder: str):
    def run(batches):
        for batch in batches:
            for name, crc, base in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                data = read_file(folder, name)
                if zlib.crc32(data) != crc:
                    raise ValueError(f"{name} is damaged")
                seg = Segment(data)
                start, n, sums = [], [], []
                for i in range(seg.n_docs):
                    at, ids = seg.document(i)
                    start.append(base + at)
                    n.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                docs = pa.array(seg.all_ids(), pa.int64())
                yield pa.RecordBatch.from_arrays([docs, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_store(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    before = Window.orderBy("seg", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("name", "crc32", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    return spread.mapInArrow(_read_segments(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_round_trip(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_uri(spark, "tokens")
    rows = cut(read_store(write_store(docs, path, folder), folder))
    delete_uri(spark, folder)
    return rows
