"""Document fingerprints by a homomorphic multiset hash.

Every paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane by lane,
modulo powers of two. So the order of paragraphs doesn't matter, equal multisets have equal fingerprints, and a paragraph can
be inserted or deleted by adding or subtracting its vector.

The vector has two parts. Four lanes modulo 2^64 (keyed hashes of the whole paragraph) decide equality. 256 lanes modulo 2^32
(a text of 2 GB doesn't wrap one) hold signed counts of the paragraph's windows of eight bytes, each at a hashed lane with a hashed sign; as they are sums too,
the cosine of two such parts estimates how much text two documents share, to about 1/16.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import ordered, texts

KEYS = (0x51, 0xA7, 0x1D3, 0x2EF)
LANES = 256
STEP = 1 << 19
M64 = (1 << 64) - 1
SIZE = 8 * len(KEYS) + 4 * LANES


def window_counts(raw: bytes) -> np.ndarray:
    """Signed counts of the eight-byte windows inside each paragraph; a shorter paragraph is one window, filled with zeros."""
    total = np.zeros(2 * LANES, "i8")
    short = [int.from_bytes(p.ljust(8, b"\0"), "little") for p in raw.split(b"\n") if 0 < len(p) < 8]
    for at in range(0, max(len(raw) - 7, 0), STEP):
        part = raw[at : at + STEP + 7]
        n = len(part) - 7
        w = np.empty(n, "<u8")
        for o in range(min(8, n)):
            w[o::8] = np.frombuffer(part, "<u8", len(w[o::8]), o)
        cut = np.frombuffer(part, "u1") == 10
        if cut.any():
            c = np.concatenate([[0], np.cumsum(cut, dtype="i4")])
            w = w[c[8:] == c[:-8]]
        total += lanes(w)
    return total + lanes(np.array(short, "<u8")) if short else total


def lanes(w: np.ndarray) -> np.ndarray:
    h = w * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((h >> np.uint64(55)).astype("i8"), minlength=2 * LANES)


def fingerprint(text: str) -> bytes:
    """Bytes of all lanes, little-endian. The empty text is one empty paragraph."""
    raw = text.encode()
    wide = [0] * len(KEYS)
    for p in raw.split(b"\n"):
        for i, k in enumerate(KEYS):
            wide[i] += xxhash.xxh3_64_intdigest(p, k)
    c = window_counts(raw)
    return np.array([x & M64 for x in wide], "<u8").tobytes() + (c[1::2] - c[::2]).astype("<i4").tobytes()


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """The fingerprint with the paragraphs of ``b`` inserted (sign 1) or deleted (-1)."""
    n, s = 8 * len(KEYS), np.uint64(sign & M64)
    return (np.frombuffer(a[:n], "<u8") + np.frombuffer(b[:n], "<u8") * s).tobytes() + (np.frombuffer(a[n:], "<u4") + np.frombuffer(b[n:], "<u4") * np.uint32(sign & 0xFFFFFFFF)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal fingerprints, else the cosine of the count lanes, at least 0 and below 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(v, "<i4", offset=8 * len(KEYS)).astype("f8") for v in (a, b))
    size = float(np.sqrt(x.dot(x) * y.dot(y)))
    return min(max(float(x.dot(y)) / size, 0.0), 0.999999) if size else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and their likeness to each other and the next.

    Documents are ordered by doc_id (nulls first, equal ids by text); the last is followed by the first, a single document by
    itself. Null text counts as empty. The text is shuffled once, into ordered partitions; each row is hashed once and its
    fingerprint serves the row before it too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = place = None
        for parts, ahead, ids, ts in texts(batches, "_part", "_ahead", "doc_id", "text"):
            out: list[tuple] = []
            for p, a, d, t in zip(parts, ahead, ids, ts, strict=True):
                if wait is None and (a or p != place) and a:
                    continue  # a further row with the key looked ahead for
                own = (d, t, fingerprint(t))
                if wait is not None:
                    out.append(row(*wait, own[1], own[2]))
                wait, place = (None if a else own), p
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    def row(d: int, t: str, f: bytes, following: str, g: bytes) -> dict:
        e = edited(t, following)
        h = fingerprint(e)
        return {"doc_id": d, "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "fingerprint": f.hex(), "edited_fingerprint": h.hex(), "near_edited": likeness(f, h), "near_next": likeness(f, g)}

    kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    placed = ordered(docs.select("doc_id", "text"), "doc_id", lookahead=True)
    return placed.select("_part", "_ahead", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
