"""Text and structure of office files by the standard library: workbooks, word-processor documents; PDF only where a reader is installed."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes that one member of an archive may unpack to; more is refused, never cut.
MEMBER = 64 << 20


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    info = z.getinfo(name)
    raw = z.read(name) if info.file_size <= MEMBER else b""
    if not raw or b"<!ENTITY" in raw:
        raise ValueError(f"{name} is refused")
    return ET.fromstring(re.sub(rb'\sxmlns(:\w+)?="[^"]*"', b"", re.sub(rb"<(/?)\w+:", rb"<\1", re.sub(rb"\s\w+:(\w+)=", rb" \1=", raw))))


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n".join("".join(t.text or "" for t in p.iter("t")) for p in _xml(z, "word/document.xml").iter("p"))


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of every sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter("t")) for s in _xml(z, "xl/sharedStrings.xml").iter("si")] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") or f"sheet{i}" for i, s in enumerate(_xml(z, "xl/workbook.xml").iter("sheet"), 1)]
        out = []
        for i, title in enumerate(titles, 1):
            if f"xl/worksheets/sheet{i}.xml" not in names:
                continue
            rows = []
            for row in _xml(z, f"xl/worksheets/sheet{i}.xml").iter("row"):
                cells = []
                for c in row.iter("c"):
                    v = c.findtext("v") or ""
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else "".join(t.text or "" for t in c.iter("t")) or v)
                rows.append(cells)
            out.append((title, rows))
        return out


def pdf_text(content: bytes) -> str | None:
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def office_text(files: DataFrame) -> DataFrame:
    """path, text of workbooks (tables), documents and, with a reader, PDFs; null where a file can't be read. ``files``: path, content."""
    def text(path: str, content: bytes) -> str | None:
        try:
            if path.lower().endswith(".docx"):
                return docx_text(content)
            if path.lower().endswith(".xlsx"):
                return "\n\n".join(f"## {t}\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) for t, rows in sheets(content))
            return pdf_text(content) if path.lower().endswith(".pdf") else None
        except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ET.ParseError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [text(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def workbook_graph(files: DataFrame) -> DataFrame:
    """source, target, relation: workbook to sheet, sheet to column (its first row)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    for title, rows in sheets(bytes(c)):
                        out.append((p, f"{p}#{title}", "contains"))
                        out += [(f"{p}#{title}", f"{p}#{title}#{h}", "contains") for h in (rows[0] if rows else []) if h]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ET.ParseError):
                    continue
            yield pd.DataFrame(out, columns=["source", "target", "relation"])

    return files.select("path", "content").mapInPandas(run, "source string, target string, relation string")
