"""Entity resolution: exact merges inside a file, blocked fuzzy pairs, guards, components, rewired edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import damerau_of, entropy, fold, jaro_of, jaro_winkler_of, normal_label, numbers_differ, shingles, variant_pair

from .components import connected_components

#: Bands and rows of the LSH filter for 128 permutations at 0.7: the pair that evens out both error areas.
PERMUTATIONS, BANDS, ROWS = 128, 14, 9
LEAST, ENTROPY = 92.0, 2.5
#: Added to the score of two long labels of one community.
BOOST = 5.0


def coefficients(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The permutations' factors: uniform below the Mersenne prime 2^61 - 1, from a fixed seed."""
    draw = np.random.RandomState(1).randint
    prime = (1 << 61) - 1
    return draw(1, prime, n, dtype=np.uint64), draw(0, prime, n, dtype=np.uint64)


def minhash_of(text: str, k: int = 3, factors: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Smallest permuted hashes of the text's character k-grams (spaces dropped); 64-bit products wrap before the modulus."""
    a, b = factors or coefficients()
    t = text.replace(" ", "")
    grams = {t[i : i + k] for i in range(len(t) - k + 1)} if len(t) >= k else {t}
    h = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams], np.uint64)
    return (((h[:, None] * a + b) % np.uint64((1 << 61) - 1)) & np.uint64(0xFFFFFFFF)).min(axis=0)


def accepted(a: str, b: str, same_file: bool, anchored: bool, boost: float = 0.0) -> bool:
    """Whether two different normalised labels are one entity: similarity and every guard.

    Across files long labels are held to plain Jaro; short ones need the same length and one edit; a label that extends the
    other, a version-like pair, different numbers, and (``anchored``) file-bound records of two files stay apart.
    """
    longest = max(len(a), len(b))
    score = 100 * (jaro_of(a, b) if not same_file and longest >= 12 else jaro_winkler_of(a, b))
    if variant_pair(a, b) or numbers_differ(a, b) or (anchored and not same_file):
        return False
    if longest < 12 and not (score >= 97 and len(a) == len(b) and damerau_of(a, b) <= 1):
        return False
    if a != b and (a.startswith(b) or b.startswith(a)):
        return False
    if min(len(a), len(b)) >= 12:
        score += boost
    return score >= LEAST and (a != b or same_file)


def candidates(nodes: DataFrame) -> DataFrame:
    """The first node of every normalised label (code aside) whose label has enough entropy: id, norm, file, anchored, community, pos.

    ``community`` is null where the nodes have none.
    """
    n = nodes.where("coalesce(file_type, '') <> 'code'").withColumn("norm", normal_label(F.coalesce("label", "id"))).where("norm <> ''")
    anchored = F.coalesce("file_type", F.lit("")).isin("rationale", "document")
    community = F.col("community") if "community" in nodes.columns else F.lit(None)
    own = F.struct("id", F.coalesce("source_file", F.lit("")).alias("file"), anchored.alias("anchored"), community.cast("string").alias("community"))
    first = n.groupBy("norm").agg(F.min_by(own, F.struct("pos", "id")).alias("r"), F.min("pos").alias("pos"))
    return first.where(entropy(F.col("norm")) >= ENTROPY).select("norm", "r.id", "r.file", "r.anchored", "r.community", "pos")


def fuzzy_pairs(cands: DataFrame) -> DataFrame:
    """a, b (a first by norm) of the accepted pairs among those that share an LSH band.

    Bands are grouped by their hash. A bucket is cut into blocks of bounded size and each pair of blocks is a group of its own,
    so no bucket is gathered whole.
    """
    block = 2000

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors = coefficients()
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                m = minhash_of(r.norm, factors=factors).astype("<u8")
                rows += [(i, int.from_bytes(hashlib.blake2b(m[i * ROWS : (i + 1) * ROWS].tobytes(), digest_size=8).digest(), "little", signed=True), r.id, r.norm, r.file, r.anchored, r.community) for i in range(BANDS)]
            yield pd.DataFrame(rows, columns=["band", "h", "id", "norm", "file", "anchored", "community"])

    rows = cands.select("id", "norm", "file", "anchored", "community").mapInPandas(banded, "band int, h long, id string, norm string, file string, anchored boolean, community string")
    size = rows.groupBy("band", "h").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    held = rows.join(size, ["band", "h"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("lo"), F.greatest(o, F.col("own")).alias("hi")))
    spread = held.withColumn("pair", F.explode(pairs)).select("*", "pair.lo", "pair.hi").drop("pair", "blocks")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        rs = pdf.sort_values("norm").to_dict("records")
        for i, p in enumerate(rs):
            for q in rs[i + 1 :]:
                if p["lo"] == p["hi"] or p["own"] != q["own"]:
                    boost = BOOST if isinstance(p["community"], str) and p["community"] == q["community"] else 0.0
                    if accepted(p["norm"], q["norm"], p["file"] == q["file"], p["anchored"] and q["anchored"], boost):
                        out.append((p["id"], q["id"]))
        return pd.DataFrame(out, columns=["a", "b"])

    return spread.groupBy("band", "h", "lo", "hi").applyInPandas(compare, "a string, b string").distinct()


def exact_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: each node and its group's first id, for equal normalised labels in one named file; code aside."""
    n = nodes.where("coalesce(file_type, '') <> 'code' and coalesce(source_file, '') <> ''").withColumn("norm", normal_label(F.coalesce("label", "id"))).where("norm <> ''")
    g = n.groupBy("norm", "source_file").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    return n.join(g, ["norm", "source_file"]).where("id <> a").select("a", F.col("id").alias("b"))


def resolve_entities(nodes: DataFrame, edges: DataFrame, decided: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and the remap (old, new). ``nodes`` needs id, label, file_type, source_file, pos and may have community; ``decided`` may add pairs (a, b).

    The winner of a group has no chunk suffix (_c1), then the shortest id, then the first position. Rewired edges lose new
    self-loops and exact repeats. Nodes of several repositories are refused.
    """
    if "repo" in nodes.columns and nodes.where("repo is not null").select("repo").distinct().limit(2).count() > 1:
        raise ValueError("entities of several repositories are not merged by label")
    one = nodes.groupBy("id").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "id"]), F.col("pos")).alias("r")).select("id", "r.*")
    pairs = exact_pairs(one).union(fuzzy_pairs(candidates(one)))
    if decided is not None:
        pairs = pairs.union(decided.select("a", "b"))
    comp = connected_components(pairs)
    rank = F.struct(F.col("id").rlike(r"_c\d+$").alias("s"), F.length("id").alias("l"), "pos", "id")
    group = comp.join(one.select("id", "pos"), comp.node == one.id)
    win = group.groupBy("component").agg(F.min(rank).alias("w")).select("component", F.col("w.id").alias("new"))
    remap = group.join(win, "component").where("id <> new").select(F.col("id").alias("old"), "new")
    kept = one.join(remap.select(F.col("old").alias("id")), "id", "left_anti").select(*nodes.columns)
    return kept, rewire(edges, remap), remap


def rewire(edges: DataFrame, remap: DataFrame) -> DataFrame:
    from .merge import remap_ids

    marked = edges.withColumn("_loop", F.col("source") == F.col("target"))
    return remap_ids(marked, remap).where("source <> target or _loop").drop("_loop").dropDuplicates()


def label_winner(nodes: DataFrame) -> DataFrame:
    """id, keep: one node per lower-cased label (shortest id, then smallest)."""
    key = F.lower(F.trim("label"))
    win = nodes.where("label is not null").groupBy(key.alias("k")).agg(F.min(F.struct(F.length("id").alias("l"), "id")).alias("w"))
    return nodes.where("label is not null").join(win, key == F.col("k")).select("id", F.col("w.id").alias("keep"))


__all__ = ["accepted", "candidates", "exact_pairs", "fold", "fuzzy_pairs", "label_winner", "minhash_of", "resolve_entities", "rewire", "shingles"]
