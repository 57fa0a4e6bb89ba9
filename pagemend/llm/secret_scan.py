"""Secret scans: pattern kinds plus a token-efficiency test for random strings.

Base kinds are regular expressions. The method adds spans of kind ``random``: runs of
key characters that a byte-pair vocabulary can't compress, i.e. few characters a token.
A run is tested as a whole, and else in the stretches between parts (of separators) that
the vocabulary does compress, so words before a key don't hide it. Known digests (hex of
the usual lengths) and UUIDs are excluded, and identifiers: groups of letters or digits
that are each compressed, one token, or a number of less than 20 digits. All offsets are
code points.

Defined cases: null text counts as empty; overlapping spans of different kinds all stay;
rows that repeat give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reserved, tune

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("passw", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
IDENTIFIER = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[_/+=-]+(?:[A-Za-z]+|[0-9]+))*[_/+=-]*\Z|[_/+=-]*\Z")
PART = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])|[A-Za-z0-9]+")
LEAST_RUN = 20
MAX_CHARS_PER_TOKEN = 2.0
#: A run longer than this is encoded in pieces of this size, so that time stays linear.
PIECE = 4096


def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def random_spans(text: str, enc, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    def tokens(run: str) -> int:
        return sum(len(enc.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))

    def known(run: str) -> bool:
        return bool(DIGEST.match(run) or UUID.match(run))

    def random(run: str) -> bool:
        return len(run) >= LEAST_RUN and not known(run) and len(run) <= most * tokens(run)

    def named(part: str) -> bool:
        return (part.isdigit() and len(part) < LEAST_RUN) or (n := tokens(part)) == 1 or len(part) > most * n

    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if known(run):
            continue
        parts = list(PART.finditer(run))
        if random(run) and not (IDENTIFIER.match(run) and all(named(p[0]) for p in parts)):
            out.append((m.start(), 3, m.end()))
            continue
        stretch: list[re.Match] = []
        for p in [*parts, None]:
            if p is not None and not known(p[0]) and len(p[0]) <= most * tokens(p[0]):
                stretch.append(p)
                continue
            if stretch:
                spans = [(stretch[0].start(), stretch[-1].end())]
                if not random(run[spans[0][0] : spans[0][1]]):
                    spans = [q.span() for q in stretch]
                whole = IDENTIFIER.match(run) and all(named(q[0]) for q in stretch)
                out += [(m.start() + i, 3, m.start() + j) for i, j in spans if not whole and random(run[i:j])]
            stretch = []
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_column(path: str, most: float = MAX_CHARS_PER_TOKEN):
    """An Arrow UDF text -> struct(n_assign, n_access, n_hex, n_random, base_sha256, spans)."""
    kind = "struct<n_assign: long, n_access: long, n_hex: long, n_random: long, base_sha256: string, spans: string>"
    held: dict[str, object] = {}

    def scan(texts: pa.Array) -> pa.Array:
        enc = held.get("enc") or held.setdefault("enc", encoding(path))
        rows = []
        for text in texts.to_pylist():
            text = text or ""
            base = base_spans(text)
            more = random_spans(text, enc, most)
            n = [sum(1 for s in base if s[1] == k) for k in range(3)]
            rows.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)], names=names)

    return F.arrow_udf(scan, kind)


def scan_secrets(docs: DataFrame, path: str, most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """docs with the struct column ``__secrets``."""
    reserved(docs, "__secrets")
    tune(docs.sparkSession)
    return docs.withColumn("__secrets", scan_column(path, most)(F.col("text")))
