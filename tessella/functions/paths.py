"""Rules on paths: kinds, categories, tests, credentials, ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {
    "code": "py pyw js jsx mjs ejs ts tsx mts cts vue svelte go rs java kt kts scala c h cpp cc cxx hpp rb swift cs php r lua sh bash zig ex exs sql jl dart m mm",
    "document": "md mdx txt rst html htm adoc json yaml yml toml csv docx xlsx pptx",
    "paper": "pdf",
    "image": "png jpg jpeg gif webp svg bmp",
    "video": "mp4 mov mkv webm mp3 wav m4a",
}
FAMILY = {
    "python": "py pyw", "js": "js jsx mjs ejs ts tsx mts cts vue svelte", "go": "go", "rust": "rs", "jvm": "java kt kts scala",
    "c": "c h cpp cc cxx hpp", "ruby": "rb", "swift": "swift", "dotnet": "cs", "php": "php", "r": "r",
}
INTERPRETERS = ("python", "bash", "sh", "zsh", "node", "ruby", "perl", "php", "lua", "Rscript")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/]\.([A-Za-z0-9]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def top_dir(path: Column) -> Column:
    p = F.coalesce(path, F.lit(""))
    return F.when(p.contains("/"), F.element_at(F.split(p, "/"), 1)).otherwise(p)


def _lookup(value: Column, table: dict[str, str], other: str | None) -> Column:
    named = [F.when(value.isin(*words.split()), k) for k, words in table.items()]
    return F.coalesce(*named, F.lit(other))


def kind_of(path: Column, first_line: Column | None = None) -> Column:
    """code, document, paper, image, video by suffix, or code by a shebang; null for others."""
    by = _lookup(suffix(path), KINDS, None)
    return by if first_line is None else F.coalesce(by, F.when(interpreter(first_line).isNotNull(), "code"))


def interpreter(first_line: Column) -> Column:
    """The program a ``#!`` line names, through ``env`` and its ``-S``; null if it isn't a known one."""
    name = F.regexp_extract(F.coalesce(first_line, F.lit("")), r"^#!\s*(?:\S*/env\s+(?:-S\s+)?)?(?:\S*/)?([A-Za-z]+)[0-9.]*\b", 1)
    return F.when(name.isin(*INTERPRETERS), name)


def category(path: Column) -> Column:
    """code, paper, image or doc."""
    s = suffix(path)
    return F.when(s.isin(*KINDS["code"].split()), "code").when(s == "pdf", "paper").when(s.isin(*KINDS["image"].split()), "image").otherwise("doc")


def cross_language(a: Column, b: Column) -> Column:
    """Both of a known language family, and not the same."""
    x, y = _lookup(suffix(a), FAMILY, None), _lookup(suffix(b), FAMILY, None)
    return F.coalesce(x != y, F.lit(False))


def is_test(path: Column) -> Column:
    """A path segment named like a test folder, or a file named like a test."""
    p = F.lower(F.coalesce(path, F.lit("")))
    return p.rlike(r"(^|/)(tests?|__tests__|spec|specs|testing|e2e)/") | base_name(p).rlike(r"^(test_.*|.*_test|.*\.test|.*\.spec|.*_spec|conftest)\.[a-z]+$")


def clean_path(path: Column, root: str | None = None) -> Column:
    """Forward slashes, no leading ``./`` or root, no doubled slash."""
    p = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), r"/{2,}", "/")
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.when(p.startswith(root.rstrip("/") + "/"), F.substring(p, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(p) if root else p


def safe_stem(value: Column) -> Column:
    """A file name that every system takes."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.when(s == "", "unnamed").when(F.upper(s).rlike(r"^(CON|PRN|AUX|NUL|COM\d|LPT\d)$"), F.concat(F.lit("_"), s)).otherwise(s)


def credential_path(path: Column) -> Column:
    """Why a path shouldn't leave the machine, or null."""
    p = F.lower(F.coalesce(path, F.lit("")))
    name = base_name(p)
    return (
        F.when(name.rlike(r"^\.env(\..*)?$") & ~name.rlike(r"\.(example|sample|template)$"), "env_file")
        .when(name.rlike(r"\.(pem|key|p12|pfx|jks|keystore|kdbx)$"), "key_file")
        .when(name.rlike(r"^id_(rsa|dsa|ecdsa|ed25519)$"), "ssh_key")
        .when(name.rlike(r"^(\.netrc|\.pgpass|\.npmrc|\.pypirc|\.git-credentials|credentials(\.json)?|secrets?\.(ya?ml|json|toml))$"), "credential_file")
        .when(p.rlike(r"(^|/)(\.ssh|\.gnupg|\.aws|secrets?|credentials)/"), "credential_directory")
    )


SECRETS = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("provider_key", r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[opsru]_\w{20,}|xox[abeprs]-[\w-]{10,}|sk-[\w-]{20,})"),
)
ASSIGNED = r"(?i)(?:password|passwd|secret|token|api_?key|access_?key)[A-Z0-9_]*\s*[:=]\s*[\"']?([^\s\"',;]{12,})"


def secret_like(value: Column) -> Column:
    """At least 12 characters of three of the four classes, and no placeholder."""
    n = sum((value.rlike(p).cast("int") for p in ("[A-Z]", "[0-9]", r"[^A-Za-z0-9]")), value.rlike("[a-z]").cast("int"))
    return (F.length(value) >= 12) & (n >= 3) & ~F.lower(value).rlike(r"example|placeholder|changeme|your[_-]|dummy|xxxx|<.*>|\$\{")


def credential_content(text: Column) -> Column:
    """private_key, provider_key or secret_assignment, the first that holds, or null; stays in the JVM."""
    t = F.coalesce(text, F.lit(""))
    found = F.exists(F.regexp_extract_all(t, F.lit(ASSIGNED), 1), secret_like)
    return F.when(t.rlike(SECRETS[0][1]), SECRETS[0][0]).when(t.rlike(SECRETS[1][1]), SECRETS[1][0]).when(found, "secret_assignment")


def ignore_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """(regex, negated, directories only) of an ignore-file line; null for blank lines and comments."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.lstrip("!") if line.startswith("!") else line
    only_dir, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif line[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            j = line.index("]", i + 1)
            out, i = out + "[" + line[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, only_dir


def ignored(paths: DataFrame, patterns: list[str], column: str = "path") -> DataFrame:
    """Adds ``ignored``: the last matching rule decides, and nothing below an ignored folder comes back.

    Rules are literals of the plan; each row tests its own ancestors, so there is no join.
    """
    rules = [r for p in patterns if (r := ignore_regex(p))]
    parts = F.split(F.col(column), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("p"), (i < F.size(parts)).alias("dir")))

    def state(x: Column) -> Column:
        out = F.lit(False)
        for regex, negated, only_dir in rules:
            hit = x["p"].rlike(regex) & (x["dir"] if only_dir else F.lit(True))
            out = F.when(hit, F.lit(not negated)).otherwise(out)
        return out

    return paths.withColumn("ignored", F.exists(ancestors, state))
