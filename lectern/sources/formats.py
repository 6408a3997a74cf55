"""Text out of files of other formats: a row (path, content) becomes (path, page, text).

Unreadable files have the text null; a file without text has ''."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import col
from lectern.sources.corpus import decoded


def html_text(c: Column | str) -> Column:
    """Tags, scripts and styles dropped; a JVM expression."""
    c = F.regexp_replace(F.regexp_replace(col(c), r"(?is)<script\b[^>]*>.*?</script>", ""), r"(?is)<style\b[^>]*>.*?</style>", "")
    c = F.regexp_replace(F.replace(F.regexp_replace(c, r"(?s)<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" ")), "&[a-z]+;", "")
    return F.regexp_replace(c, r"\n\s*\n", "\n")


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def docx(raw: bytes) -> list[tuple[int | None, str]]:
    root = _xml(zipfile.ZipFile(io.BytesIO(raw)), "word/document.xml")
    return [(None, "\n".join("".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in root.iter() if _local(p) == "p"))]


def odt(raw: bytes) -> list[tuple[int | None, str]]:
    root = _xml(zipfile.ZipFile(io.BytesIO(raw)), "content.xml")
    return [(None, "\n".join("".join(p.itertext()) for p in root.iter() if _local(p) == "p"))]


def pptx(raw: bytes) -> list[tuple[int | None, str]]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_natural)
    return [(None, "\n".join(f"## Diapositiva {i}\n" + "\n".join(t.text or "" for t in _xml(z, n).iter() if _local(t) == "t") for i, n in enumerate(slides, 1)))]


def xlsx(raw: bytes) -> list[tuple[int | None, str]]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _xml(z, "xl/sharedStrings.xml") if _local(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.get("name") for s in _xml(z, "xl/workbook.xml").iter() if _local(s) == "sheet"] if "xl/workbook.xml" in z.namelist() else []
    out = []
    for i, n in enumerate(sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_natural)):
        out.append(f"## Hoja: {names[i] if i < len(names) else i + 1}")
        for row in (r for r in _xml(z, n).iter() if _local(r) == "row"):
            cells = []
            for c in (c for c in row if _local(c) == "c"):
                v = next((x.text for x in c.iter() if _local(x) in ("v", "t") and x.text), None)
                cells.append(shared[int(v)] if v and c.get("t") == "s" else v or "")
            if any(cells):
                out.append(" | ".join(c for c in cells if c))
    return [(None, "\n".join(out))]


def rtf(raw: bytes) -> list[tuple[int | None, str]]:
    t = re.sub(r"\{\\\*[^{}]*\}", "", raw.decode("latin-1"))
    t = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m.group(1)) % 65536), t)
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m.group(1)).decode("cp1252", "replace"), t)
    t = re.sub(r"\\(?:par|line)\b ?", "\n", t)
    t = re.sub(r"\\tab\b ?", "\t", t)
    return [(None, re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", t)).strip())]


def pdf(raw: bytes) -> list[tuple[int | None, str]]:
    """By page with a reader library where one is installed; else the printable runs of the bytes as one page."""
    try:
        from pypdf import PdfReader
    except ImportError:
        runs = "".join(chr(b) if 32 <= b < 127 else "\n" if b in (10, 13) else "" for b in raw)
        return [(1, re.sub(r"[^\w\s.,;:!?\-áéíóúñüÁÉÍÓÚÑÜ]", "", runs))]
    return [(i, p.extract_text() or "") for i, p in enumerate(PdfReader(io.BytesIO(raw)).pages, 1)]


def xls(raw: bytes) -> list[tuple[int | None, str | None]]:
    """Sheets of a legacy workbook with a reader library where one is installed; else null, for its records are no text."""
    try:
        from xlrd import open_workbook
    except ImportError:
        return [(None, None)]
    out = []
    for sheet in open_workbook(file_contents=raw).sheets():
        out.append(f"## Hoja: {sheet.name}")
        rows = ([str(c).strip() for c in sheet.row_values(i)] for i in range(sheet.nrows))
        out += [" | ".join(c for c in r if c) for r in rows if any(r)]
    return [(None, "\n".join(out))]


READERS = {"docx": docx, "odt": odt, "pptx": pptx, "xlsx": xlsx, "xls": xls, "rtf": rtf, "pdf": pdf}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for path, raw in zip(p["path"], p["content"]):
            try:
                rows += [(path, page, text) for page, text in READERS[path.rpartition(".")[2].lower()](bytes(raw))]
            except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, ValueError, IndexError, TypeError):
                rows.append((path, None, None))
        out = pd.DataFrame(rows, columns=["path", "page", "text"])
        out["page"] = out["page"].astype("Int32")
        yield out


def extracted(files: DataFrame) -> DataFrame:
    """(path, page, text) of files (path, content), each by the reader of its extension; other extensions are left out."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    plain = files.where(ext.isin("txt", "md", "markdown")).select("path", F.lit(None).cast("int").alias("page"), decoded(F.col("content")).alias("text"))
    web = files.where(ext == "html").select("path", F.lit(None).cast("int").alias("page"), html_text(decoded(F.col("content"))).alias("text"))
    table = files.where(ext == "csv").select("path", F.lit(None).cast("int").alias("page"), csv_prose(decoded(F.col("content"))).alias("text"))
    rest = files.where(ext.isin(*READERS)).select("path", "content").mapInPandas(_read, "path string, page int, text string")
    return plain.union(web).union(table).union(rest)


def csv_prose(text: Column) -> Column:
    """A table as text to search: the columns, then each row as ``column: value`` pairs.  The delimiter is the commonest of , ; tab | in the first line."""

    @F.pandas_udf("string")
    def prose(s: pd.Series) -> pd.Series:
        import csv

        def one(t):
            if t is None:
                return None
            head = t.split("\n", 1)[0]
            rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(t), delimiter=max(",;\t|", key=head.count)) if any(c.strip() for c in r)]
            if not rows:
                return ""
            body = (". ".join(f"{h}: {v}" for h, v in zip(rows[0], r) if v) for r in rows[1:])
            return "\n".join(["Columnas: " + " | ".join(rows[0]), *(b for b in body if b)])

        return s.map(one)

    return prose(text)


def records_prose(df: DataFrame, *columns: str) -> Column:
    """The same for rows of a table that Spark has read: ``column: value`` pairs of the columns that have a value."""
    pairs = [F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in (columns or df.columns)]
    return F.concat_ws(". ", *pairs)


def uploaded(content: Column | str) -> Column:
    """Text of a base64 upload."""
    return decoded(F.unbase64(col(content)))
