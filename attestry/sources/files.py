"""Files of any kind as tables: what a file is, and what its text holds. Inputs come from the binaryFile reader:
path, content. Whole files are read; nothing is opened by path."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File signatures (offset 0) of images.
IMAGES = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "bmp": b"BM", "tiff_le": b"II*\x00", "tiff_be": b"MM\x00*"}
LEGACY = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
SEPARATORS = ",;\t|"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zip_kind(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            types = z.read("[Content_Types].xml") if "[Content_Types].xml" in names else b""
    except zipfile.BadZipFile:
        return "unsupported"
    if b"spreadsheetml" in types:
        return "xlsx"
    if b"wordprocessingml" in types or any(n.startswith("word/") for n in names):
        return "docx"
    return "xlsx" if any(n.startswith("xl/") for n in names) else "unsupported"


def decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def separator(data: bytes) -> str | None:
    """The first separator that the leading lines have equally often, at least once."""
    text = decoded(data[:8192])
    if re.search("[\x00-\x08\x0e-\x1f]", text):
        return None
    lines = [x for x in text.splitlines() if x.strip()][:10]
    for sep in SEPARATORS if len(lines) > 1 else "":
        if lines[0].count(sep) and len({x.count(sep) for x in lines}) == 1:
            return sep
    return None


def sniff(data: bytes | None) -> str:
    """The route of a file by its first bytes: pdf, legacy_office, xlsx, docx, image, csv or unsupported."""
    if data is None or len(data) < 4:
        return "unsupported"
    if data.startswith(b"%PDF"):
        return "pdf"
    if data.startswith(LEGACY):
        return "legacy_office"
    if data.startswith(b"PK"):
        return zip_kind(data)
    if (data.startswith(b"RIFF") and data[8:12] == b"WEBP") or any(data.startswith(s) for s in IMAGES.values()):
        return "image"
    return "csv" if separator(data) else "unsupported"


@F.pandas_udf(T.StringType())
def route(content: pd.Series) -> pd.Series:
    return content.map(sniff)


def csv_cells(files: DataFrame) -> DataFrame:
    """(path, r, c, raw) of every cell of the CSV files, each in its own dialect."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = csv.reader(io.StringIO(decoded(content)), delimiter=separator(content) or ",")
                yield pd.DataFrame([(path, r, c, raw) for r, row in enumerate(rows) for c, raw in enumerate(row)], columns=["path", "r", "c", "raw"])

    return files.mapInPandas(read, "path string, r int, c int, raw string")


def column_number(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_cells(data: bytes) -> list[tuple[str, int, int, str, str | None]]:
    """(sheet, r, c, value, formula) of every filled cell of a workbook."""
    strip = lambda tag: tag.rpartition("}")[2]
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if strip(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for cell in (e for e in ET.fromstring(z.read(name)).iter() if strip(e.tag) == "c"):
                parts = {strip(e.tag): e for e in cell}
                value = parts["v"].text if "v" in parts else "".join(t.text or "" for t in cell.iter() if strip(t.tag) == "t")
                if value is None or value == "":
                    continue
                if cell.get("t") == "s":
                    value = shared[int(value)]
                ref = cell.get("r")
                out.append((name.rpartition("/")[2][:-4], int(re.search(r"\d+", ref)[0]) - 1, column_number(ref), value, parts["f"].text if "f" in parts else None))
    return out


def xlsx_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, r, c, raw, formula) of every filled cell; a file that is no workbook has none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                cells = sheet_cells(content) if sniff(content) == "xlsx" else []
                yield pd.DataFrame([(path, *x) for x in cells], columns=["path", "sheet", "r", "c", "raw", "formula"])

    return files.mapInPandas(read, "path string, sheet string, r int, c int, raw string, formula string")


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(path, ord, text) of every paragraph that has text, tables included."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if sniff(content) != "docx":
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ET.fromstring(z.read("word/document.xml"))
                texts = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")]
                yield pd.DataFrame([(path, i, t) for i, t in enumerate(t for t in texts if t)], columns=["path", "ord", "text"])

    return files.mapInPandas(read, "path string, ord int, text string")
