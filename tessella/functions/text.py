"""Text functions: column expressions where the JVM has them, Arrow UDFs for Unicode rules and string similarity."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- plain rules, used by the UDFs and by tests


def fold(label: str | None) -> str:
    """Compatibility form, case folded, runs of non-word characters to one space."""
    folded = unicodedata.normalize("NFKC", label or "").casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in folded).split())


def slug(text: str | None) -> str:
    """An id from a text: folded twice around compatibility normalisation, non-word runs to ``_``."""
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", t)).strip("_")


def plain(text: str | None) -> str:
    """Without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))


def entropy_of(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, and half the transpositions among them."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(first, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro raised by up to four common leading characters, where it is above 0.7."""
    s = jaro_of(a, b)
    if s <= 0.7:
        return s
    p = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        p += 1
    return s + p * weight * (1 - s)


def damerau_of(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            cost = 0 if x == y else 1
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


VARIANT = re.compile(r"(?P<stem>.*[a-z])(?P<tail>\d+[a-z]*|[a-z][a-z]+)")


def variant_pair(first: str, second: str) -> bool:
    """Short labels with one stem and different version-like endings."""
    if first == second or len(first) > 11 or len(second) > 11:
        return False
    m, n = (VARIANT.fullmatch(t) for t in (first, second))
    return bool(m and n and m["stem"] == n["stem"] and m["tail"] != n["tail"])


def numbers_differ(first: str, second: str) -> bool:
    """Whether the multisets of digit runs (leading zeros dropped) differ."""
    found = [sorted(n.lstrip("0") or "0" for n in re.findall(r"\d+", t)) for t in (first, second)]
    return found[0] != found[1]


# --- UDFs


def _text(rule):
    @F.pandas_udf(T.StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.map(rule)

    return apply


normal_label, make_slug, strip_marks = _text(fold), _text(slug), _text(plain)


def _pair(rule, kind: T.DataType):
    @F.pandas_udf(kind)
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rule(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return apply


jaro, jaro_winkler = _pair(jaro_of, T.DoubleType()), _pair(jaro_winkler_of, T.DoubleType())
damerau, is_variant, numbers_apart = _pair(damerau_of, T.IntegerType()), _pair(variant_pair, T.BooleanType()), _pair(numbers_differ, T.BooleanType())

# --- column expressions


def words(text: Column) -> Column:
    """Number of white-space separated words; null counts 0."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character, without leaving the JVM: one pass over the sorted characters' runs."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - c / n * F.log2(c / n))).otherwise(0.0)


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct character k-grams; the text itself if it is shorter."""
    return F.when(F.length(text) < k, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))))


def bare_name(label: Column) -> Column:
    """Lower case without a trailing call marker."""
    return F.regexp_replace(F.lower(label), r"\(\)$", "")


def callable_name(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), r"\(\)$", ""), r"^\.+", ""))


def safe_label(text: Column, most: int = 256) -> Column:
    """Control characters dropped, length limited (a display rule)."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]", ""), 1, most)


def cypher_text(text: Column) -> Column:
    """For a single-quoted Cypher string."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]", " ")
    return F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def yaml_text(text: Column) -> Column:
    """For a double-quoted YAML string."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.regexp_replace(t, r"[\x00-\x1f\x7f]", " "), F.lit('"'))


def body(text: Column) -> Column:
    """Markdown without its leading front matter."""
    return F.regexp_replace(text, r"^---\r?\n(?s:.*?)\r?\n---[ \t]*(\r?\n|$)", "")


def url_kind(url: Column) -> Column:
    """tweet, arxiv, github, youtube, pdf, image or webpage."""
    u, host = F.lower(url), F.coalesce(F.lower(F.parse_url(url, F.lit("HOST"))), F.lit(""))
    path = F.coalesce(F.lower(F.parse_url(url, F.lit("PATH"))), F.lit(""))
    return (
        F.when(host.rlike(r"(^|\.)(twitter|x)\.com$"), "tweet")
        .when(host.rlike(r"(^|\.)arxiv\.org$"), "arxiv")
        .when(host.rlike(r"(^|\.)github\.com$"), "github")
        .when(host.rlike(r"(^|\.)(youtube\.com|youtu\.be)$"), "youtube")
        .when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpe?g|webp|gif)$"), "image")
        .when(u.isNull(), None)
        .otherwise("webpage")
    )


def page_markdown(html: Column, most: int | None = None) -> Column:
    """Scripts and styles out, tags to spaces, white space folded; ``most`` cuts the result where the caller wants the cap."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.substring(t, 1, most) if most else t


#: Signs of an academic paper; three of them in the first 3,000 characters are enough.
PAPER = (
    r"(?i)\babstract\b", r"(?i)\b(?:arxiv|preprint)\b", r"(?i)\bdoi\s*:", r"(?i)\b(?:journal|proceedings)\b", r"\\cite\{", r"\[\d{1,3}\]",
    r"(?i)\b(?:eq\.|equation)\s*\(?\d+", r"\b\d{4}\.\d{4,5}\b", r"(?i)\bwe (?:propose|present)\b", r"(?i)\bliterature\b", r"(?i)\breferences\b", r"(?i)\btheorem\b", r"(?i)\bet al\.",
)


def paper_signals(text: Column) -> Column:
    head = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    return sum((head.rlike(p).cast("int") for p in PAPER[1:]), head.rlike(PAPER[0]).cast("int"))


def confidence_score(score: Column, confidence: Column, other: float = 0.0) -> Column:
    """The given score, else 1.0, 0.5 or 0.2 by the confidence's name, else ``other``."""
    c = F.upper(confidence)
    return F.coalesce(score, F.when(c == "EXTRACTED", 1.0).when(c == "INFERRED", 0.5).when(c == "AMBIGUOUS", 0.2), F.lit(other))


def usable_weight(weight: Column) -> Column:
    """A finite weight of at least 0, else 1.0."""
    return F.when(weight.isNotNull() & ~F.isnan(weight) & (weight >= 0) & (weight < float("inf")), weight).otherwise(1.0)


def edge_key(relation: Column, source_file: Column, location: Column) -> Column:
    """A stable key from the triple that tells parallel edges apart."""
    return F.concat(F.lit("edge:v1:"), F.sha2(F.concat_ws("\u001f", *(F.coalesce(c, F.lit("")) for c in (relation, source_file, location))), 256))
