"""Files of several kinds as a DataFrame of sections: markdown, plain text, CSV, DOCX and XLSX.

A section is (path, section, heading, page, text).  Bytes are read and unpacked in Arrow-batched functions, one file at a
time; markdown goes through the column expressions of ``operators.sections``.  PDF and images have no extractor here:
``extract`` takes one as an argument, and lists such files as problems without it.
"""

from __future__ import annotations

import csv
import io
import os
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.operators.sections import sections as markdown_sections

# Folders that are not searched, the kinds of files by extension, and the largest file.
SKIPPED_DIRS = {".git", ".obsidian", "_archive", "node_modules", ".venv", "__pycache__", "_backups", "_to_delete", ".claude", ".projects"}
KINDS = {
    "md": ["md"],
    "text": ["txt", "csv"],
    "pdf": ["pdf"],
    "office": ["docx", "xlsx"],
    "image": ["jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp"],
}
MOST_BYTES = 200 * 1024 * 1024

_KIND = {e: kind for kind, es in KINDS.items() for e in es}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SECTION = "path string, section int, heading string, page int, text string, problem string"
_FIELDS = pa.schema([("path", pa.string()), ("section", pa.int32()), ("heading", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("problem", pa.string())])

Part = tuple[str | None, int | None, str]  # heading, page, text


def _extension(name: str) -> str:
    return os.path.splitext(name)[1].lower().removeprefix(".")


def found(root: str) -> Iterator[tuple[str, str, int, int]]:
    """Relative path, kind, size and time of change of the files under root that have a kind; links and empty files are left out."""
    for folder, dirs, names in os.walk(root, followlinks=False):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED_DIRS)
        for name in sorted(names):
            kind, path = _KIND.get(_extension(name)), os.path.join(folder, name)
            if kind is None or name.startswith(".") or os.path.islink(path):
                continue
            try:
                s = os.stat(path)
            except OSError:
                continue
            if 0 < s.st_size <= MOST_BYTES:
                yield os.path.relpath(path, root).replace(os.sep, "/"), kind, s.st_size, s.st_mtime_ns


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, size, mtime_ns of the files of a folder that every executor can read."""
    return spark.createDataFrame(list(found(root)), "path string, kind string, size long, mtime_ns long")


def of_text(raw: bytes) -> list[Part]:
    text = raw.decode("utf-8", "replace").strip()
    return [(None, None, text)] if text else []


def of_csv(raw: bytes) -> list[Part]:
    """One section: a line for each row that has a cell with text."""
    lines = [" | ".join(r) for r in csv.reader(io.StringIO(raw.decode("utf-8", "replace"))) if "".join(r).strip()]
    return [(None, None, "\n".join(lines))] if lines else []


def _paragraph(p: ElementTree.Element) -> str:
    signs = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((e.text or "") if e.tag == _WORD + "t" else signs.get(e.tag.removeprefix(_WORD), "") for e in p.iter())


def of_docx(raw: bytes) -> list[Part]:
    """Paragraphs under the heading before them, then the tables of the body, ``Table 1`` and so on."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_WORD + "body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ()
    named = {s.get(_WORD + "styleId"): n.get(_WORD + "val", "") for s in styles if (n := s.find(_WORD + "name")) is not None}
    groups: list[tuple[str | None, list[str]]] = [(None, [])]
    for p in body.findall(_WORD + "p"):
        text = _paragraph(p).strip()
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        style = "" if style is None else style.get(_WORD + "val", "")
        if text and named.get(style, style).lower().startswith("heading"):
            groups.append((text, []))
        elif text:
            groups[-1][1].append(text)
    out: list[Part] = [(h, None, "\n".join(lines)) for h, lines in groups if lines]
    for number, table in enumerate(body.findall(_WORD + "tbl"), 1):
        cells = ([" ".join(_paragraph(p) for p in c.iter(_WORD + "p")).strip() for c in r.findall(_WORD + "tc")] for r in table.findall(_WORD + "tr"))
        if lines := [" | ".join(r) for r in cells if any(r)]:
            out.append((f"Table {number}", None, "\n".join(lines)))
    return out


def _column(reference: str) -> int:
    n = 0
    for letter in reference:
        if letter.isalpha():
            n = n * 26 + ord(letter.upper()) - 64
    return n - 1


def of_xlsx(raw: bytes) -> list[Part]:
    """A section for each sheet with text, headed by its name; numbers and dates as they are stored."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        strings = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(_SHEET + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out: list[Part] = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_SHEET + "sheet"):
            target = targets[sheet.get(_REL + "id")]
            rows = ElementTree.fromstring(z.read(target[1:] if target.startswith("/") else "xl/" + target)).iter(_SHEET + "row")
            if lines := [line for line in (_row(r, strings) for r in rows) if line]:
                out.append((sheet.get("name"), None, "\n".join(lines)))
    return out


def _row(row: ElementTree.Element, strings: list[str]) -> str:
    cells: dict[int, str] = {}
    for c in row.findall(_SHEET + "c"):
        at = _column(c.get("r", "")) if c.get("r") else len(cells)
        value, kind = c.findtext(_SHEET + "v"), c.get("t")
        if kind == "s" and value is not None:
            value = strings[int(value)]
        elif kind == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(_SHEET + "t"))
        elif kind == "b" and value is not None:
            value = str(value == "1")
        cells[at] = value or ""
    return " | ".join(cells.get(i, "") for i in range(max(cells, default=-1) + 1)).rstrip(" |") if any(v.strip() for v in cells.values()) else ""


_BY_EXTENSION: dict[str, Callable[[bytes], list[Part]]] = {"txt": of_text, "csv": of_csv, "docx": of_docx, "xlsx": of_xlsx}


def _read(root: str, extra: dict[str, Callable[[bytes], list[Part]]]):
    def one(path: str) -> list[tuple]:
        how = (_BY_EXTENSION | extra).get(_extension(path))
        if how is None:
            return [(path, None, None, None, None, "no extractor")]
        try:
            with open(os.path.join(root, path), "rb") as f:
                return [(path, k, *part, None) for k, part in enumerate(how(f.read()))]
        except Exception as e:  # a broken file is a row of its own, and the others go on
            return [(path, None, None, None, None, f"{type(e).__name__}: {e}")]

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = one(path)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    return run


def _whole(root: str):
    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                        text, problem = f.read(), None
                except OSError as e:
                    text, problem = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pydict({"path": [path], "text": pa.array([text], pa.string()), "problem": pa.array([problem], pa.string())})

    return run


def extract(files: DataFrame, root: str, extractors: dict[str, Callable[[bytes], list[Part]]] | None = None) -> DataFrame:
    """path, section, heading, page, text, problem of files (path, kind) under root.

    extractors: functions from a file's bytes to (heading, page, text) by extension, such as one for PDF.  A file that
    cannot be read or has no extractor gives one row with a problem and no text; one without text gives none.
    """
    other = files.filter("kind <> 'md'").select("path").mapInArrow(_read(root, extractors or {}), _SECTION)
    md = files.filter("kind = 'md'").select("path").mapInArrow(_whole(root), "path string, text string, problem string")
    parts = markdown_sections(md.filter("problem is null")).select("path", F.col("section").cast("int").alias("section"), F.nullif("heading", F.lit("")).alias("heading"), F.lit(None).cast("int").alias("page"), "text", F.lit(None).cast("string").alias("problem"))
    bad = md.filter("problem is not null").select("path", F.lit(None).cast("int").alias("section"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("page"), "text", "problem")
    return other.unionByName(parts).unionByName(bad)


def flatten(parts: DataFrame) -> DataFrame:
    """path, text: the sections of each file one after another, each with its page and heading."""
    one = F.concat(F.coalesce(F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("] ")), F.lit("")), F.coalesce(F.concat("heading", F.lit("\n")), F.lit("")), F.coalesce("text", F.lit("")))
    trimmed = parts.filter("problem is null").select("path", "section", F.regexp_replace(one, r"^\s+|\s+$", "").alias("text")).filter("text <> ''")
    return trimmed.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "text"))), lambda s: s["text"]), "\n\n").alias("text"))
