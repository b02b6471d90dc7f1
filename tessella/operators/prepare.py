"""Document preparation: scans, manifests, hashes, slices, secrets, token estimates and packing, fragment rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.paths import credential_content, credential_path, ignored, kind_of
from tessella.functions.text import body, words


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """path, bytes, modified, content, md5, kind, words of every file below a folder that the ignore rules keep."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", rf"^(file:/*)?/?{root.strip('/')}/", "")
    files = raw.select(rel.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content", F.md5("content").alias("md5"))
    text = F.col("content").cast("string")
    first = F.element_at(F.split(F.substring(text, 1, 200), r"\r?\n"), 1)
    out = ignored(files, patterns or []).where("not ignored").drop("ignored")
    return out.withColumn("kind", kind_of(F.col("path"), first)).withColumn("words", F.when(F.col("kind").isin("code", "document"), words(text)).otherwise(0))


def scan_totals(files: DataFrame) -> DataFrame:
    """One row: files and words, and what to warn of."""
    t = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return t.withColumn("advice", F.when(F.col("words") > 500_000, "very large corpus").when((F.col("words") > 50_000) | (F.col("files") > 500), "large corpus"))


def manifest_delta(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """path, state (new, changed, unchanged, deleted): by content hash alone. Both have path, hash."""
    a, b = manifest.select("path", F.col("hash").alias("old")), now.select("path", F.col("hash").alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def update_manifest(manifest: DataFrame, now: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The old rows that aren't replaced or removed, and the new ones."""
    kept = manifest.join(now.select("path"), "path", "left_anti")
    if removed is not None:
        kept = kept.join(removed.select("path"), "path", "left_anti")
    return kept.select(*now.columns).unionByName(now)


def content_hash(content: Column, path: Column) -> Column:
    """Of the body without front matter (Markdown) and the lower-cased path, with a NUL between."""
    md = F.lower(path).rlike(r"\.(md|mdx)$")
    return F.sha2(F.concat(F.when(md, body(content)).otherwise(content), F.lit("\u0000"), F.lower(path)), 256)


def egress(files: DataFrame, endpoint: str = "public") -> DataFrame:
    """path, eligible, reason, digest: path rules first, then content, then the endpoint. ``files``: path, content."""
    reason = F.coalesce(credential_path(F.col("path")), credential_content(F.col("content")), F.lit(None if endpoint in ("public", "loopback", "private") else "unknown_endpoint"))
    return files.select("path", reason.isNull().alias("eligible"), F.coalesce(reason, F.lit("eligible")).alias("reason"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))


def neutralised(text: Column) -> Column:
    """Markers that would end or open a quoted source block made harmless."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<(/?)\s*(untrusted[_-]?source|system|assistant)\b", r"&lt;$1$2")


# --- slices


def cut_points(text: str, most: int) -> list[tuple[int, int]]:
    """Consecutive (start, end) of at most ``most`` characters: before the last heading in the window, else after its last blank
    line, else after its last line end, else where it is full."""
    if most < 1:
        raise ValueError("a slice has at least one character")
    out, at, n = [], 0, len(text)
    while n - at > most:
        window = text[at : at + most]
        cut = window.rfind("\n#", 1)
        if cut > 0:
            cut += 1
        elif (blank := window.rfind("\n\n", 1)) > 0:
            cut = blank + 2
        elif (line := window.rfind("\n", 1)) > 0:
            cut = line + 1
        else:
            cut = most
        out.append((at, at + cut))
        at += cut
    return [*out, (at, n)]


def slices(docs: DataFrame, most: int = 20_000, key: str = "doc_id") -> DataFrame:
    """key, index, total, start, end, text: whole documents in lossless slices; an empty or null text is one empty slice."""
    kind = "array<struct<start:int,end:int>>"

    @F.pandas_udf(kind)
    def cut(t: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in cut_points(x or "", most)] for x in t])

    # short texts never leave the JVM
    t = F.coalesce("text", F.lit(""))
    spans = F.when(F.length(t) <= most, F.array(F.struct(F.lit(0).alias("start"), F.length(t).alias("end")))).otherwise(cut(F.when(F.length(t) > most, t)))
    d = docs.select(key, t.alias("t"), spans.alias("spans"))
    e = d.select(key, "t", F.size("spans").alias("total"), F.posexplode("spans").alias("index", "s"))
    return e.select(key, "index", "total", "s.start", "s.end", F.substring("t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


def bisected(slices_: DataFrame) -> DataFrame:
    """Each slice in two halves at a line end near its middle, if it has one before its end, else in the middle."""
    @F.pandas_udf("int")
    def middle(t: pd.Series) -> pd.Series:
        def at(x: str) -> int:
            m = len(x) // 2
            a, b = x.rfind("\n", 0, m), x.find("\n", m)
            best = [i + 1 for i in (a, b) if 0 <= i < len(x) - 1]
            return min(best, key=lambda i: abs(i - m)) if best else m

        return t.map(lambda x: at(x or ""))

    m = slices_.withColumn("_m", middle("text"))
    half = lambda i, start, size, text: F.struct(F.lit(i).alias("half"), start.alias("start"), size.alias("end"), text.alias("text"))
    s, e, c = F.col("start"), F.col("end"), F.col("_m")
    both = F.array(half(0, s, s + c, F.substring("text", F.lit(1), c)), half(1, s + c, e, F.substring("text", c + 1, F.length("text"))))
    rest = [x for x in slices_.columns if x not in ("start", "end", "text")]
    return m.select(*rest, F.explode(both).alias("h")).select(*rest, "h.half", "h.start", "h.end", "h.text")


# --- tokens and packing


def token_estimate(text: Column, most: int = 20_000, overhead: int = 160) -> Column:
    """A quarter of the characters (of the first ``most``, as the request sends no more) and the overhead."""
    return F.floor((F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(most)) + overhead) / 4).cast("long")


def pack(files: DataFrame, budget: int, images: int = 20) -> DataFrame:
    """path, folder, chunk: files of a folder in order, a chunk closed when the next file would pass the budget (or the image limit).

    ``files``: path, tokens, is_image. A fold over one folder, whose state is two numbers: sorted rows stream through the task that
    holds the folder, so a folder is never gathered.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    rows = files.select("path", "tokens", "is_image", folder.alias("folder"))
    placed = rows.repartition("folder").sortWithinPartitions("folder", "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, used, pictures = None, 0, 0, 0
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.folder != now:
                    now, chunk, used, pictures = r.folder, 0, 0, 0
                elif used and (used + r.tokens > budget or (r.is_image and pictures >= images)):
                    chunk, used, pictures = chunk + 1, 0, 0
                used, pictures = used + r.tokens, pictures + bool(r.is_image)
                out.append((r.path, r.folder, chunk, r.tokens))
            yield pd.DataFrame(out, columns=["path", "folder", "chunk", "tokens"])

    return placed.mapInPandas(run, "path string, folder string, chunk int, tokens long")


def token_reduction(docs: DataFrame, answer_lines: DataFrame) -> DataFrame:
    """One row: corpus tokens (words x 100 / 75), answer tokens (characters / 4), and their ratio."""
    a = docs.agg(F.floor(F.sum(words(F.col("text"))) * 100 / 75).cast("long").alias("corpus_tokens"))
    b = answer_lines.agg(F.floor(F.sum(F.length("line") + 1) / 4).cast("long").alias("answer_tokens"))
    return a.join(b).withColumn("ratio", F.round(F.col("corpus_tokens") / F.greatest(F.lit(1), F.coalesce("answer_tokens", F.lit(0))), 1))  # single rows


# --- fragments


def sentence_like(label: Column) -> Column:
    t = F.trim(F.coalesce(label, F.lit("")))
    return ((F.length(t) >= 80) | (F.size(F.split(t, r"\s+")) >= 8)) & t.rlike("[.!?:]")


def sanitised(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rationale nodes, and concepts with sentences for labels, folded into the nodes they explain (attribute ``rationale``); their edges go."""
    loose = F.col("file_type").isin("rationale") | ((F.col("file_type") == "concept") & sentence_like(F.col("label")))
    gone = nodes.where(loose).select(F.col("id").alias("g"), F.col("label").alias("note"))
    said = edges.where("relation = 'rationale_for'").join(gone, F.col("source") == F.col("g")).groupBy(F.col("target").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("note")), "\n\n").alias("rationale"))
    kept = nodes.where(~F.coalesce(loose, F.lit(False))).join(said, "id", "left")
    ids = gone.select(F.col("g").alias("x"))
    e = edges.join(ids.withColumnRenamed("x", "source"), "source", "left_anti").join(ids.withColumnRenamed("x", "target"), "target", "left_anti").select(*edges.columns)
    return kept, e


def scoped_ids(nodes: DataFrame) -> DataFrame:
    """id, source_file, scoped: an id that several files claim gets the path's hash behind it."""
    w = nodes.select("id", F.coalesce("source_file", F.lit("")).alias("source_file")).distinct()
    n = w.groupBy("id").agg(F.count("*").alias("n"))
    return w.join(n, "id").select("id", "source_file", F.when(F.col("n") > 1, F.concat_ws("_", "id", F.substring(F.sha1("source_file"), 1, 6))).otherwise(F.col("id")).alias("scoped"))


def oversized(nodes: DataFrame, edges: DataFrame, hyper: DataFrame) -> DataFrame:
    """rule, n of the size rules that a fragment breaks."""
    rows = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("rule"), "n", F.lit(10_000).alias("most"))
    rows = rows.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("rule"), "n", F.lit(100_000).alias("most")))
    rows = rows.unionByName(hyper.agg(F.max(F.size("nodes")).cast("long").alias("n")).select(F.lit("members").alias("rule"), "n", F.lit(256).alias("most")))
    return rows.where("n > most").select("rule", "n")


def cache_lookup(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (with what is cached) and misses by content hash."""
    return files.join(cache, "hash"), files.join(cache.select("hash").distinct(), "hash", "left_anti")


def running_top(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group; the planner limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)
