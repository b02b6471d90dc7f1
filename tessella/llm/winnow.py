"""Deletion of repeated runs of lines, found by winnowing over line hashes.

Lines (white space folded, blank ones skipped) are hashed. A window is the shortest stretch of lines, from each line on, that
holds at least ``min_words`` words, or the shortest up to each line that does. Its line of smallest hash (the last of equals)
is selected, and only selected positions leave the text: one row each, with the line hashes and word counts of the windows that
selected it. So any run of ``min_words`` words or more that occurs twice holds a whole window in both places, and both select
the same line at the same distance: the guarantee of winnowing, with windows measured in words.

Positions are joined on the fingerprint, their line's hash: one selected in a single place ends there. From each joined position the
match is extended both ways over the line hashes it came with, which gives the windows around it; each is named by the hash of
its lines and belongs to the repeated run if the first place of that name, by doc_id, then text, then position, lies before it.
Matches chain: every window inside a run selects a position of its own, so the windows' union is the whole run in both
directions. No pairs are built: one row a distinct window around a joined position.

The first place keeps its lines; those of all later ones go. A place counts as later only if it doesn't overlap the first one, so
of n equal lines in one text the first window stays. Every deleted line survives in an earlier place, as places only point backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, forget, texts, written

MIN_WORDS = 50
#: A key of more rows than this is joined in as many salted shares as it needs.
SHARE, MOST_HOT = 20_000, 10_000


def stretches(sizes: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of every window over lines of these word counts, in order."""
    spans = set()
    j = total = 0
    for i in range(len(sizes)):  # the shortest from each line on
        while total < min_words and j < len(sizes):
            total += sizes[j]
            j += 1
        if total < min_words:
            break
        spans.add((i, j - 1))
        total -= sizes[i]
    i = total = 0
    for j in range(len(sizes)):  # the shortest up to each line
        total += sizes[j]
        while total - sizes[i] >= min_words:
            total -= sizes[i]
            i += 1
        if total >= min_words:
            spans.add((i, j))
    return sorted(spans)


def pick(hashes: list[int], i: int, j: int) -> int:
    """The position a window selects: its smallest hash, the last of equals."""
    own = hashes[i : j + 1]
    return j - own[::-1].index(min(own)) if j > i else i


def selected(text: str, min_words: int = MIN_WORDS) -> tuple[list[int], list[int], dict[int, list[int]]]:
    """Hashes and word counts of the non-blank lines, and the selected positions with the bounds of the windows that selected them."""
    hashes, sizes = [], []
    for line in text.split("\n"):
        if ws := line.split():
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(ws)))
            sizes.append(len(ws))
    at: dict[int, list[int]] = {}
    for i, j in stretches(sizes, min_words):
        around = at.setdefault(pick(hashes, i, j), [i, j])
        around[1] = max(around[1], j)
    return hashes, sizes, at


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def selected_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """One row a selected position: _doc, _ver (hash of the text), at (among the non-blank lines), print, lo (first line of
    its windows), lines (their hashes) and sizes (their word counts)."""
    names = ["_doc", "_ver", "at", "print", "lo", "lines", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for ids, ts in texts(batches, "doc_id", "text"):
            doc, ver, place, prints, low, ends = [], [], [], [], [], [0]
            lines: list[int] = []
            words: list[int] = []
            for d, t in zip(ids, ts, strict=True):
                hashes, sizes, found = selected(t, min_words)
                if not found:
                    continue
                doc += [d] * len(found)
                ver += [signed(xxhash.xxh3_64_intdigest(t))] * len(found)
                for p, (i, j) in found.items():
                    place.append(p)
                    prints.append(hashes[p])
                    low.append(i)
                    lines += hashes[i : j + 1]
                    words += sizes[i : j + 1]
                    ends.append(len(lines))
            if doc:
                at = pa.array(ends, pa.int32())
                long = lambda x: pa.array(np.array(x, "u8").view("i8"))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ver, pa.int64()), pa.array(place, pa.int32()), long(prints), pa.array(low, pa.int32()), pa.ListArray.from_arrays(at, long(lines)), pa.ListArray.from_arrays(at, pa.array(words, pa.int32()))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "_doc long, _ver long, at int, print long, lo int, lines array<long>, sizes array<int>")


def extended(positions: DataFrame, min_words: int) -> DataFrame:
    """_doc, _ver, first, last, content of the windows around joined positions: those that selected the position, named by the hash of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            out: list[tuple] = []
            ends, flat = b.column("lines").offsets.to_numpy(), b.column("lines").values.to_numpy()
            counts = b.column("sizes").values.to_numpy()
            for k, (d, v, p, lo) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_doc", "_ver", "at", "lo")), strict=True)):
                h = np.ascontiguousarray(flat[ends[k] : ends[k + 1]]).view("u8")
                hashes, sizes = h.tolist(), counts[ends[k] : ends[k + 1]].tolist()
                out += [(d, v, lo + i, lo + j, signed(xxhash.xxh3_64_intdigest(h[i : j + 1].tobytes()))) for i, j in stretches(sizes, min_words) if lo + pick(hashes, i, j) == p]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["_doc", "_ver", "first", "last", "content"])

    return positions.select("_doc", "_ver", "at", "lo", "lines", "sizes").mapInArrow(run, "_doc long, _ver long, first int, last int, content long")


def joined(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``keys`` (one row a key, ``n`` rows of it): a key of many rows is joined in salted shares."""
    share = max(SHARE, rows.count() // MOST_HOT)
    cut = keys.withColumn("_s", (F.floor(F.col("n") / share) + 1).cast("int")).drop("n")
    spread = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    # a key above the share has over rows / MOST_HOT rows, so there are fewer than MOST_HOT of them
    hot = F.broadcast(cut.where("_s > 1").select(key, F.col("_s").alias("_hot")))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_doc", "_ver"), F.col("_hot")).cast("int")).otherwise(0)
    return rows.join(hot, key, "left").withColumn("_salt", salt).join(spread, [key, "_salt"]).drop("_salt", "_hot")


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The windows that have an earlier place: _doc, _ver, first, last. Rows with the same doc_id and text are one place."""

    def place(at: str):
        return F.struct(F.coalesce("_doc", F.lit(NULL_KEY)).alias("d"), F.col("_ver").alias("v"), F.col(at).alias("p"))

    rows = written(selected_rows(docs, min_words), "selected")
    # fingerprints of two places: partial aggregation sends one row a fingerprint and task
    twice = rows.groupBy("print").agg(F.min(place("at")).alias("a"), F.max(place("at")).alias("b"), F.count("*").alias("n")).where("a <> b").select("print", "n")
    windows = written(extended(joined(rows, twice, "print"), min_words), "windows")
    found = windows.groupBy("content").agg(F.min(place("first")).alias("earliest"), F.max(place("first")).alias("latest"), F.count("*").alias("n")).where("earliest <> latest")
    own, e = place("first"), F.col("earliest")
    overlaps = (own["d"] == e["d"]) & (own["v"] == e["v"]) & (F.col("first") <= e["p"] + F.col("last") - F.col("first"))
    return joined(windows, found.select("content", "earliest", "n"), "content").where((own > e) & ~overlaps).select("_doc", "_ver", "first", "last")


def delete_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with later repeated runs cut from ``text`` and n_chars (where present) set to the new length.

    Adds ``removed_lines``, ``removed_words`` (a column of that name is replaced; any other name may occur). Rows stay: a text may
    become empty. A row without repeats keeps its text to the byte; blank lines inside a deleted run go with it. Null texts
    stay null, repeated rows (same doc_id and text) are one place and come out alike. Later means a larger doc_id (null first),
    then text hash, then position; a run repeated inside one text counts too, where the two places don't overlap.
    """
    spans = repeated_windows(docs, min_words).groupBy("_doc", "_ver").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))  # bounded by the lines of one document
    names = docs.drop("removed_lines", "removed_words").columns

    @F.pandas_udf("long")
    def version(t):
        import pandas as pd

        forget()
        return pd.Series([signed(xxhash.xxh3_64_intdigest(x or "")) for x in t])

    @F.pandas_udf("text string, removed_lines int, removed_words int")
    def cut(t, spans):
        import pandas as pd

        forget()
        return pd.DataFrame([cut_spans(x, s) for x, s in zip(t, spans, strict=True)], columns=["text", "removed_lines", "removed_words"])

    version, cut = version.asNondeterministic(), cut.asNondeterministic()  # computed once, not once a use
    # the input's own columns travel in one struct, so that none of their names can clash
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").alias("_d"), version("text").alias("_v"))
    both = keyed.join(spans, F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_v") == F.col("_ver")), "left")
    text = F.col("row")["text"]
    done = both.select("row", F.col("_spans").isNotNull().alias("_hit"), F.when(F.col("_spans").isNotNull(), cut(F.when(F.col("_spans").isNotNull(), text), F.col("_spans"))).alias("_cut"))
    new = {"text": F.col("_cut.text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("_cut.text").cast(docs.schema["n_chars"].dataType)
    out = [F.when(F.col("_hit"), new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in names]
    return done.select(*out, F.coalesce("_cut.removed_lines", F.lit(0)).alias("removed_lines"), F.coalesce("_cut.removed_words", F.lit(0)).alias("removed_words"))


def cut_spans(text: str | None, spans: list | None) -> tuple[str | None, int, int]:
    if text is None or spans is None:
        return text, 0, 0
    lines = text.split("\n")
    numbers = [i for i, x in enumerate(lines) if x.split()]
    gone: set[int] = set()
    words = count = 0
    for s in spans:
        gone.update(range(s["first"], s["last"] + 1))
    drop: set[int] = set()
    for p in gone:
        drop.add(numbers[p])
        count += 1
        words += len(lines[numbers[p]].split())
        if p + 1 in gone:
            drop.update(range(numbers[p], numbers[p + 1]))
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), count, words
