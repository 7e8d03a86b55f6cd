"""Files as documents: type routing, readers, and read snapshots with blocks.

Files come from Spark's ``binaryFile`` source, one row a file. DOCX is read with the standard library; images ask
for OCR; for PDF a function from bytes to the texts of pages is passed in, as no PDF library is assumed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.text import file_type
from docsieve.schemas import BLOCKS

Pages = Callable[[bytes], list[str]]
#: Letters and digits that a text must have to count as read.
LEAST = 10
# fixed values: the namespace of word-processing documents
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

SNAPSHOT = f"document_id long, file_type string, read_method string, text string, blocks {BLOCKS}, page_count int, requires_ocr boolean, read_status string, error_code string, error_message string"
_COLUMNS = [c.split(" ", 1)[0] for c in ("document_id", "file_type", "read_method", "text", "blocks", "page_count", "requires_ocr", "read_status", "error_code", "error_message")]
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("page_number", pa.int32()), ("block_index", pa.int32())]))
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), _BLOCKS, pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string()]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_type, content, sha256, size) of the files below a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", file_type(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("file_type"), "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def _run(run: ElementTree.Element) -> str:
    """The text of a run: its own tabs and line breaks, a hyphen for one that does not break; page and column breaks, and
    what stands in drawings and text boxes, are no text of it."""
    out = []
    for x in run:
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag in (f"{_W}tab", f"{_W}ptab"):
            out.append("\t")
        elif x.tag == f"{_W}cr" or x.tag == f"{_W}br" and x.get(f"{_W}type", "textWrapping") == "textWrapping":
            out.append("\n")
        elif x.tag == f"{_W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def _words(part: ElementTree.Element) -> str:
    """The text of one paragraph: its runs and those of its links. Runs that a change inserts or deletes are left out."""
    runs = [r for x in part if x.tag in (f"{_W}r", f"{_W}hyperlink") for r in ([x] if x.tag == f"{_W}r" else x.findall(f"{_W}r"))]
    return "".join(map(_run, runs))


def _rows(table: ElementTree.Element) -> str:
    """Rows as lines, cells set apart by tabs; a cell that spans columns stands in each, blank rows are left out."""
    lines: list[str] = []
    above: list[str] = []
    for row in table.findall(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            text = "\n".join(_words(p) for p in cell.findall(f"{_W}p")).strip()
            span, merged = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            if merged is not None and merged.get(f"{_W}val", "continue") == "continue" and len(cells) < len(above):
                text = above[len(cells)]
            cells += [text] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
        above = cells
        lines.append("\t".join(cells))
    return "\n".join(x for x in lines if x.strip())


def docx_blocks(content: bytes) -> list[str]:
    """Paragraphs and tables of the body in order, blank ones left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    parts = [_words(x).strip() if x.tag == f"{_W}p" else _rows(x) if x.tag == f"{_W}tbl" else "" for x in (body if body is not None else [])]
    return [p for p in parts if p]


def _meaningful(text: str) -> bool:
    return len(re.findall(r"[^\W_]", text)) >= LEAST


def _read(kind: str, content: bytes | None, pdf: Pages | None) -> tuple:
    """The snapshot's columns behind the id."""
    fail = lambda method, code, message, pages=None, status="failed": (kind, method, "", [], pages, status == "ocr_required", status, code, message)
    blocks = lambda texts: [{"text": t, "page_number": p, "block_index": i} for i, (t, p) in enumerate(texts)]
    if kind in ("jpg", "jpeg", "png"):
        return fail("image_pending_ocr", "OCR_REQUIRED", "images need OCR", 1, "ocr_required")
    if kind not in ("docx", "pdf"):
        return fail("unknown", "DOCUMENT_READ_FAILED", f"no reader for {kind}")
    method = "docx" if kind == "docx" else "pdf_text"
    try:
        if kind == "docx":
            pages, texts = None, [(t, None) for t in docx_blocks(content or b"")]
        elif pdf is None:
            return fail(method, "DOCUMENT_READ_FAILED", "no reader for pdf was given")
        else:
            found = [p.strip() for p in pdf(content or b"")]
            pages, texts = len(found), [(t, i + 1) for i, t in enumerate(found) if t]
    except Exception as error:  # a broken file is a failed read, not a failed job
        return fail(method, "DOCUMENT_READ_FAILED", f"{type(error).__name__}: {error}")
    text = "\n\n".join(t for t, _ in texts)
    if not _meaningful(text):
        return fail(method, "DOCUMENT_CONTENT_EMPTY", "no text to speak of") if kind == "docx" else fail(method, "OCR_REQUIRED", "no text to speak of", pages, "ocr_required")
    return (kind, method, text, blocks(texts), pages, False, "success", None, None)


def read(documents: DataFrame, pdf: Pages | None = None) -> DataFrame:
    """A read snapshot for each row (document_id, file_type, content).

    Types are compared in lower case without leading dots; a type without a reader, a broken or null content is a
    failed read, never an error of the job. Each file is read whole in its task.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *_read((k or "").lower().lstrip("."), c, pdf)) for i, k, c in zip(*(batch.column(n).to_pylist() for n in ("document_id", "file_type", "content")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _COLUMNS)

    return documents.select(F.col("document_id").cast("long").alias("document_id"), F.col("file_type").cast("string").alias("file_type"), "content").mapInArrow(work, SNAPSHOT)


def append(rows: DataFrame, path: str) -> None:
    """Add rows to an append-only table of snapshots, hits, results or logs."""
    rows.write.mode("append").parquet(path)
