"""Sources of records: package manifests, tool configs, symbol indexes, workspace files, memory documents, database catalogs."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.feedback import parse_memory

NAME = re.compile(r"^\s*(@?[A-Za-z0-9][A-Za-z0-9._/-]*)")


def package_rows(path: str, text: str) -> list[tuple[str, str]]:
    """(package, dependency) rows of a pyproject, go.mod, pom or package.json file; malformed files give none."""
    name, deps = None, []
    try:
        if path.endswith("pyproject.toml"):
            p = tomllib.loads(text).get("project", {})
            name, deps = p.get("name"), [m.group(1) for d in p.get("dependencies", []) if (m := NAME.match(d))]
        elif path.endswith("go.mod"):
            m = re.search(r"(?m)^module\s+(\S+)", text)
            name, deps = m and m.group(1), re.findall(r"(?m)^(?:require\s+|\t)([\w./-]+)\s+v", text)
        elif path.endswith("pom.xml") and "<!ENTITY" not in text:
            root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
            name, deps = root.findtext("artifactId"), [d.findtext("artifactId") or "" for d in root.iterfind("dependencies/dependency")]
        elif path.endswith("package.json"):
            p = json.loads(text)
            name, deps = p.get("name"), [*p.get("dependencies", {}), *p.get("devDependencies", {})]
        elif path.endswith("Cargo.toml"):
            p = tomllib.loads(text)
            name, deps = p.get("package", {}).get("name"), list(p.get("dependencies", {}))
    except (ValueError, ET.ParseError, AttributeError, TypeError):
        return []
    return [(name, d) for d in deps if d] if name else []


def packages(files: DataFrame) -> DataFrame:
    """source, target, relation, source_file of dependencies in manifests. ``files``: path, content (text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, d, "depends_on", p) for p, t in zip(b["path"], b["content"], strict=True) for n, d in package_rows(p, t or "")]
            yield pd.DataFrame(rows, columns=["source", "target", "relation", "source_file"])

    named = files.where(F.col("path").rlike(r"(^|/)(pyproject\.toml|go\.mod|pom\.xml|package\.json|Cargo\.toml)$"))
    return named.select("path", "content").mapInPandas(run, "source string, target string, relation string, source_file string")


def workspace_crates(files: DataFrame) -> DataFrame:
    """source, target of dependencies between crates of one workspace."""
    all_ = packages(files.where(F.col("path").endswith("Cargo.toml")))
    own = all_.select(F.col("source").alias("target")).distinct()
    return all_.join(own, "target", "left_semi").select("source", "target", F.lit("crate_depends_on").alias("relation"), "source_file").distinct()


def tool_servers(files: DataFrame, most: int = 200) -> DataFrame:
    """server, command, env of server configs (JSON); a file with more servers than ``most`` is refused, not cut."""
    kind = "mcpServers map<string,struct<command:string,args:array<string>,env:map<string,string>>>"
    s = files.select("path", F.from_json("content", kind)["mcpServers"].alias("m")).where("m is not null")
    checked = s.select("path", F.when(F.size("m") > most, F.raise_error(F.lit("too many servers in one file"))).otherwise(F.col("m")).alias("m"))
    return checked.select("path", F.explode("m").alias("server", "c")).select("path", "server", "c.command", F.array_sort(F.map_keys(F.coalesce("c.env", F.create_map().cast("map<string,string>")))).alias("env"))


def symbol_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """symbols (symbol, document, id) and refs (source, symbol, document, relation) of a symbol-index JSON file; flags must be true."""
    rel = "symbol string, is_implementation boolean, is_type_definition boolean, is_definition boolean, is_reference boolean"
    kind = f"documents array<struct<relative_path:string,symbols:array<struct<symbol:string,display_name:string,relationships:array<struct<{rel.replace(' ', ':').replace(',:', ',')}>>>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["documents"]).alias("d"))
    s = raw.select(F.col("d.relative_path").alias("document"), F.explode("d.symbols").alias("s"))
    symbols = s.select("s.symbol", "document", F.concat_ws("#", "document", "s.symbol").alias("id"))
    r = s.select("document", F.concat_ws("#", "document", "s.symbol").alias("source"), F.explode("s.relationships").alias("r"))
    relation = F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_type_definition"), "scip_type").when(F.col("r.is_definition"), "scip_def").otherwise("scip_ref")
    return symbols, r.select("source", "r.symbol", "document", relation.alias("relation"))


def memory_docs(spark: SparkSession, folder: str) -> DataFrame:
    """date, question, outcome, correction, source_nodes, path of the saved answers in a folder."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.select(parse_memory(F.col("value")).alias("m"), "path").select("m.*", "path").where("question is not null")


def catalog_graph(columns: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a database: tables with their columns, and foreign keys.

    ``columns``: table_schema, table_name, column_name; ``keys``: table_schema, table_name, ref_schema, ref_table. Read them with
    ``spark.read.jdbc`` from information_schema.
    """
    t = F.concat_ws(".", "table_schema", "table_name")
    tables = columns.select(t.alias("id"), F.col("table_name").alias("label")).distinct()
    cols = columns.select(F.concat_ws(".", "table_schema", "table_name", "column_name").alias("id"), F.col("column_name").alias("label"))
    inside = columns.select(t.alias("source"), F.concat_ws(".", "table_schema", "table_name", "column_name").alias("target"), F.lit("contains").alias("relation"))
    refs = keys.select(t.alias("source"), F.concat_ws(".", "ref_schema", "ref_table").alias("target"), F.lit("references").alias("relation")).distinct()
    return tables.unionByName(cols), inside.unionByName(refs)


def llm_fragment(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``fragment``: the JSON object in a model's reply, with or without a code fence; null where there is none."""
    fenced = F.nullif(F.regexp_extract(column, r"```(?:json)?\s*(\{(?s:.*)\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(column, r"(\{(?s:.*)\})", 1), F.lit(""))
    kind = "nodes array<struct<id:string,label:string,file_type:string,source_file:string>>, edges array<struct<source:string,target:string,relation:string,confidence:string>>"
    return raw.withColumn("fragment", F.from_json(F.coalesce(fenced, bare), kind))
