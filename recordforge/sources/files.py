"""Files as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recordforge.functions.text import html_meta, html_to_text


def read_text_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, text, size and modified of whole text files."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))


def read_html_pages(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds the text of each page and its metadata."""
    return df.withColumns({"text": html_to_text(F.col(html)), **html_meta(F.col(html), F.col(url))})


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _texts(root, name: str) -> str:
    return "".join(e.text or "" for e in root.iter() if _tag(e) == name)


def _docx(z: zipfile.ZipFile) -> str:
    body = next(iter(ElementTree.fromstring(z.read("word/document.xml"))), ())
    if not len(body):
        return ""
    paragraphs = [_texts(p, "t") for p in body if _tag(p) == "p"]
    cells = [_texts(c, "t") for c in body.iter() if _tag(c) == "tc"]
    return "\n\n".join(x for x in [*paragraphs, *cells] if x.strip())


def _xlsx(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
    out = []
    files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for title, name in zip(sheets, files):
        out.append(f"--- Sheet: {title} ---")
        for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if _tag(e) == "row"):
            cells = []
            for c in row:
                value = _texts(c, "v") or _texts(c, "t")
                if value:
                    is_shared = c.get("t") == "s"
                    cells.append(shared[int(value)] if is_shared and value.isdecimal() and int(value) < len(shared) else "" if is_shared else value)
            if cells:
                out.append("\t".join(cells))
    return "\n".join(out)


def _pptx(z: zipfile.ZipFile) -> str:
    files = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for i, name in enumerate(files, 1):
        shapes = [s for s in ElementTree.fromstring(z.read(name)).iter() if _tag(s) == "sp"]
        out += [f"--- Slide {i} ---", *(t for t in (_texts(s, "t") for s in shapes) if t.strip())]
    return "\n".join(out)


#: The part of the archive that tells each format.
OFFICE = (("word/document.xml", _docx), ("xl/workbook.xml", _xlsx), ("ppt/presentation.xml", _pptx))


def office_text(content: bytes | None) -> str | None:
    """Text of a docx, xlsx or pptx file; null for anything else, broken and encrypted archives too."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            names = set(z.namelist())
            return next((read(z) for part, read in OFFICE if part in names), None)
    except Exception:  # whatever is wrong with one file must not end the job
        return None


def decode_office_files(df: DataFrame, content: str = "content", text: str = "text") -> DataFrame:
    """All columns but the files' bytes, and their text. One file is decoded at a time."""
    kept = [c for c in df.columns if c not in (content, text)]
    rows = df.select(*kept, content)

    def run(batches):
        for batch in batches:
            texts = pa.array((office_text(x.as_py()) for x in batch.column(len(kept))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*kept, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(text, T.StringType())]))


def write_documents(df: DataFrame, path: str, files: int = 8) -> None:
    """Extracted texts beside their output names, in a few large files."""
    df.select("name", "text").repartition(files).write.mode("overwrite").parquet(path)
