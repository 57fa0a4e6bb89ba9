"""Line deduplication over a sharded minimal perfect hash.

Keys are hashed to 128 bits: one half picks the shard and drives the perfect hash, the
other half is the fingerprint. Counts a key come from a map-side combined aggregate, so
a line found in a third of all documents is one row a task before any shuffle. Each
shard's perfect hash is built with numpy (levels of bit arrays; keys that collide go one
level down), and its slots index arrays of fingerprints, counts and last holders of all
distinct lines of enough characters. Documents then send 24-byte probes to the shards,
dealt into bounded groups, the count array tells which keys are common, and the keys that
they lose come back; no line text is joined or shuffled.

Defined cases: null or empty text is one empty line; a null doc_id ranks below every id;
rows that repeat a doc_id are documents of their own and count each (all of them that have
the greatest doc_id keep the line); an empty table gives no rows; input columns that begin
with ``__line`` raise ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, reserved, scratch, settle, tune

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_A_SHARD = 250_000
PROBES_A_GROUP = 400_000
NULL_ID = -(1 << 63)


def line_keys(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    lines = (text or b"").split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: about 3.7 bits a key with gamma 1.5."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.bits = words
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        left, level, flags, sizes = keys.astype(np.uint64), 0, [], []
        while len(left):
            size = max(64, int(np.ceil(len(left) * gamma / 64)) * 64)
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            flags.append(alone)
            sizes.append(size)
            left, level = left[~alone[at]], level + 1
            if level > 200:
                raise ValueError("keys are not distinct")
        bits = np.concatenate(flags) if flags else np.zeros(0, bool)
        return cls(np.packbits(bits, bitorder="little").view(np.uint64), np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 for keys that reach no set bit (not members)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = self.rank[at[hit] >> 6] + below
            left = left[~hit]
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, last: np.ndarray) -> dict:
    mph = PerfectHash.build(h1.view(np.uint64))
    at = mph.slots(h1.view(np.uint64))
    prints, counts, lasts = np.empty(len(at), np.int64), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    prints[at], counts[at], lasts[at] = h2, count, last
    return {"bits": mph.bits.tobytes(), "sizes": mph.sizes.tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes(), "lasts": lasts.tobytes()}


def probe_shard(shard: dict, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and last holder of each key; count 0 where the key isn't indexed."""
    arrays = {k: np.frombuffer(shard[k], np.int64) for k in ("sizes", "prints", "counts", "lasts")}
    mph = PerfectHash(np.frombuffer(shard["bits"], np.uint64), arrays["sizes"])
    at = mph.slots(h1.view(np.uint64))
    known = at >= 0
    known[known] = arrays["prints"][at[known]] == h2[known]
    count, last = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
    count[known], last[known] = arrays["counts"][at[known]], arrays["lasts"][at[known]]
    return count, last


def _explode_keys(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {key_hash(k) for k in set(line_keys(text)[1]) if long_enough(k, min_chars)}
                hashes.extend(own)
                ids.extend([doc] * len(own))
            if ids:
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["k", "h1", "h2"])
            settle()

    return run


def _drop_keys(min_docs: int):
    def run(key, probes, shards):
        if not len(shards) or not len(probes):
            return pd.DataFrame({"k": [], "h1": [], "h2": []}, dtype="int64")
        h1, h2, k = (probes[c].to_numpy(np.int64) for c in ("h1", "h2", "k"))
        count, last = probe_shard(shards.iloc[0].to_dict(), h1, h2)
        lost = (count >= min_docs) & (k < last)
        return pd.DataFrame({"k": k[lost], "h1": h1[lost], "h2": h2[lost]})

    return run


def lost_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k, lost): for each document that loses lines, the 16-byte hashes of the keys it loses."""
    tune(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(_lost(docs, min_chars, min_docs))


def _lost(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    raw = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), F.col("text").cast("binary").alias("t"))
    probes = cut(raw.mapInArrow(_explode_keys(min_chars), "k long, h1 long, h2 long"))
    counted = probes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("k").alias("last"))
    # the shard comes from both halves: keys whose first halves agree would have to meet in one shard to clash
    lines = cut(counted)
    n_keys = lines.count()
    n_shards = max(1, -(-n_keys // KEYS_A_SHARD))
    shard = F.pmod(F.xxhash64("h1", "h2"), F.lit(n_shards)).cast("int").alias("shard")
    names = ["bits", "sizes", "prints", "counts", "lasts"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = [pdf[c].to_numpy(np.int64) for c in ("h1", "h2", "n", "last")]
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0])} | pack_shard(*arrays)])

    index = cut(lines.select(shard, "*").groupBy("shard").applyInPandas(build, "shard int, " + ", ".join(f"{n} binary" for n in names)))
    routed = probes.select(shard, "*")
    load = routed.groupBy("shard").agg(F.ceil(F.count("*") / PROBES_A_GROUP).cast("int").alias("groups"))  # one row a shard
    load = cut(load)
    salted = routed.join(load, "shard").withColumn("salt", F.pmod(F.xxhash64("k", "h1"), F.col("groups")).cast("int"))
    copies = index.join(load, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    lost = (
        salted.select("shard", "salt", "k", "h1", "h2").groupBy("shard", "salt")
        .cogroup(copies.select("shard", "salt", *names).groupBy("shard", "salt"))
        .applyInPandas(_drop_keys(min_docs), "k long, h1 long, h2 long")
    )
    return lost.groupBy("k").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))


def _rewrite(texts: pa.Array, lost: pa.Array) -> pa.Array:
    n_lines, n_dropped, kept, digest = [], [], [], []
    for text, own in zip(texts.to_pylist(), lost.to_pylist(), strict=True):
        text = text or b""
        dropped = 0
        if own:
            gone = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in own}
            lines, keys = line_keys(text)
            memo: dict[bytes, bool] = {}
            for k in set(keys):
                memo[k] = len(k) >= 1 and key_hash(k) in gone
            rest = [x for x, k in zip(lines, keys, strict=True) if not memo[k]]
            n_lines.append(len(lines))
            dropped = len(lines) - len(rest)
            text = b"\n".join(rest)
        else:
            n_lines.append(text.count(b"\n") + 1)
        n_dropped.append(dropped)
        kept.append(text)
        digest.append(hashlib.sha256(text).hexdigest())
    settle()
    return pa.StructArray.from_arrays(
        [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())],
        names=["n_lines", "n_dropped", "kept", "sha256"],
    )


def _digest_only(texts: pa.Array, lost: pa.Array) -> pa.Array:
    whole = _rewrite(texts, lost)
    return pa.StructArray.from_arrays([whole.field("n_lines"), whole.field("n_dropped"), whole.field("sha256")], names=["n_lines", "n_dropped", "sha256"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, texts: bool = True) -> DataFrame:
    """docs with a struct column ``__lines`` (n_lines, n_dropped, kept, sha256); ``kept`` only with texts=True."""
    reserved(docs, "__line")
    lost = lost_keys(docs, min_chars, min_docs)
    keyed = docs.withColumn("__line_k", F.coalesce("doc_id", F.lit(NULL_ID)))
    joined = keyed.join(lost.select(F.col("k").alias("__line_k"), F.col("lost").alias("__line_lost")), "__line_k", "left")
    kind = "struct<n_lines: long, n_dropped: long, " + ("kept: binary, " if texts else "") + "sha256: string>"
    rewrite = F.arrow_udf(_rewrite if texts else _digest_only, kind)
    return joined.withColumn("__lines", rewrite(F.col("text").cast("binary"), F.col("__line_lost"))).drop("__line_k", "__line_lost").select(*[F.col(f"`{c}`") for c in docs.columns], "__lines")
