"""Token ids in binary files of transposed, compressed planes.

A file holds fixed-size blocks of ids. A block is turned so that all lowest bytes (or bits) stand together, then the next,
and each such plane is compressed alone with zstandard: high planes are nearly constant and vanish, low ones keep their
entropy. The chunk index at the end gives every block's place, length and plane sizes, and every document's id and length,
so that one document or one block can be read without the rest.

    TSPL1 | plane, plane, ... of block 0 | block 1 | ... | footer (zstd of JSON head + arrays) | footer length u64 | TSPL1
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_count import Memo, piece_encoder, tokenizer_path
from .common import ordered, scratch, texts

MAGIC = b"TSPL1"
BLOCK = 1 << 16
#: Pieces a worker remembers with their ids; some 350 MB with the pre-tokens behind them.
REMEMBERED = 1_200_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view("u1").reshape(-1, 4)
    if kind == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, "u1") for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, "u1"), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Appends documents; at most one block of ids waits in memory."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3) -> None:
        if kind not in ("byte", "bit"):
            raise ValueError("kind is byte or bit")
        self.out, self.kind, self.block = out, kind, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC) and len(MAGIC)
        self.wait: list[bytes] = []
        self.waiting = 0
        self.chunks: list[list[int]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: unsigned 32-bit, little-endian."""
        self.docs.append((doc_id, len(ids) // 4))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * self.block:
            raw = b"".join(self.wait)
            for i in range(0, len(raw) - 4 * self.block + 1, 4 * self.block):
                self._flush(raw[i : i + 4 * self.block])
            rest = raw[len(raw) // (4 * self.block) * 4 * self.block :]
            self.wait, self.waiting = [rest], len(rest)

    def _flush(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, "<u4")
        packed = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), *map(len, packed)])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        if raw := b"".join(self.wait):
            self._flush(raw)
        head = json.dumps({"kind": self.kind, "chunks": self.chunks, "docs": len(self.docs)}).encode()
        known = np.array([d is not None for d, _ in self.docs], "u1")
        body = known.tobytes() + np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([n for _, n in self.docs], "<i8").tobytes()
        foot = self.zip.compress(len(head).to_bytes(8, "little") + head + body)
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        return sum(n for _, n in self.docs)


class PlaneReader:
    """``docs()`` streams (doc_id, ids as bytes), one block at a time; ``doc(i)`` reads only the blocks of one document."""

    def __init__(self, file, size: int) -> None:
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        file.seek(size - 8 - len(MAGIC))
        tail = file.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file, or cut short")
        n = int.from_bytes(tail[:8], "little")
        file.seek(size - 8 - len(MAGIC) - n)
        foot = self.unzip.decompress(file.read(n))
        k = int.from_bytes(foot[:8], "little")
        head = json.loads(foot[8 : 8 + k])
        self.kind, self.chunks, m = head["kind"], head["chunks"], head["docs"]
        body = foot[8 + k :]
        known = np.frombuffer(body, "u1", m)
        self.ids = [int(d) if ok else None for d, ok in zip(np.frombuffer(body, "<i8", m, m), known, strict=True)]
        self.lengths = np.frombuffer(body, "<i8", m, 9 * m)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def chunk(self, i: int) -> bytes:
        at, n, *sizes = self.chunks[i]
        self.file.seek(at)
        raw, planes = self.file.read(sum(sizes)), []
        for s in sizes:
            planes.append(self.unzip.decompress(raw[:s]))
            raw = raw[s:]
        return from_planes(planes, n, self.kind).tobytes()

    def docs(self) -> Iterator[tuple[int | None, bytes]]:
        have, i = b"", 0
        for d, n in zip(self.ids, self.lengths.tolist(), strict=True):
            got = [have]
            size = len(have)
            while size < 4 * n:
                got.append(self.chunk(i))
                size += len(got[-1])
                i += 1
            have = b"".join(got) if len(got) > 1 else have
            yield d, have[: 4 * n]
            have = have[4 * n :]

    def doc(self, i: int) -> bytes:
        lo, hi = int(self.starts[i]), int(self.starts[i + 1])
        ends = np.cumsum([0, *(c[1] for c in self.chunks)])
        a = int(np.searchsorted(ends, lo, side="right")) - 1
        b = int(np.searchsorted(ends, hi, side="left"))
        raw = b"".join(self.chunk(j) for j in range(a, b))
        return raw[4 * (lo - int(ends[a])) :][: 4 * (hi - lo)]


def open_uri(uri: str):
    return pafs.FileSystem.from_uri(uri)


_ENCODERS: dict[tuple, Memo] = {}


def encoder(path: str, remembered: int) -> Memo:
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Memo(piece_encoder(path, remembered), remembered)
    return _ENCODERS[path, remembered]


def write_token_ids(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, kind: str = "byte", block: int = BLOCK, remembered: int = REMEMBERED) -> list[dict]:
    """Encodes every text, appends ``end_id``, and writes plane files in ascending doc_id order.

    One file a partition; a retried task writes under a name of its own and then renames, so that a file is whole or absent.
    Returns the files in order (one dict a file: uri, start, docs, ids), also written as ``_index.json``. Null text: only the
    end id. Null doc_id: first, kept as null. Rows of one doc_id are ordered by text.
    """
    path = path or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(path, remembered)
        writer = part = stream = name = fs = None
        n = 0
        for parts, ids, ts in texts(batches, "_part", "doc_id", "text"):
            if writer is None:
                part = parts[0]
                fs, root = open_uri(out)
                name = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                stream = fs.open_output_stream(name)
                writer = PlaneWriter(stream, kind, block)
            for d, x in zip(ids, memo.joined(ts), strict=True):
                writer.add(d, x + end)
            n += len(ids)
        if writer is not None:
            total = writer.close()
            stream.close()
            fs.move(name, final := f"{root}/part-{part:06d}.tspl")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [f"{out}/{os.path.basename(final)}"], "docs": pa.array([n], pa.int64()), "ids": pa.array([total], pa.int64())})

    rows = sorted(ordered(docs.select("doc_id", "text"), "doc_id").select("_part", "doc_id", "text").mapInArrow(run, "part int, uri string, docs long, ids long").collect())
    files, start = [], 0
    for r in rows:  # one row a file
        files.append({"uri": r.uri, "start": start, "docs": r.docs, "ids": r.ids})
        start += r.ids
    fs, root = open_uri(out)
    with fs.open_output_stream(f"{root}/_index.json") as f:
        f.write(json.dumps({"block": block, "kind": kind, "end_id": end_id, "files": files}).encode())
    return files


def read_token_ids(spark, files: list[dict], digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids themselves (``ids`` array<long>), or with ``digest`` their crc32, from the files alone."""
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                fs, place = open_uri(f["uri"])
                with fs.open_input_file(place) as file:
                    out, at, size = [], f["start"], 0
                    for d, raw in PlaneReader(file, file.size()).docs():
                        out.append((d, at, len(raw) // 4, zlib.crc32(raw) if digest else np.frombuffer(raw, "<u4").astype("i8").tolist()))
                        at += len(raw) // 4
                        size += len(raw)
                        if len(out) >= 4096 or size > 1 << 23:
                            yield packed(out)
                            out, size = [], 0
                    if out:
                        yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        d, s, n, x = zip(*out, strict=True)
        kind = pa.int64() if digest else pa.list_(pa.int64())
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32" if digest else "ids": pa.array(x, kind)})

    given = spark.createDataFrame([(i, f["uri"], f["start"]) for i, f in enumerate(files)], "i int, uri string, start long")
    return given.repartitionById(len(files), F.col("i")).mapInArrow(run, schema)


def token_id_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files to shared scratch space and returns what they hold, read back: doc_id, start, n_tokens, ids_crc32."""
    out = scratch(docs.sparkSession, "token-ids")
    return read_token_ids(docs.sparkSession, write_token_ids(docs, out, path, **options), digest=True)
