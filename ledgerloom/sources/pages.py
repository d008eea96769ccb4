"""What is inside of files: page counts, words and ruled tables, by whatever library can open them.

Files come as Spark reads them, from any store (path, content). A backend is an object with ``open(content)``, which gives a
document with ``pages()``, a list of page numbers, ``words(number)``, a dict of rotation, width, height and words (text, x0, y0, x1,
y1, conf), and ``tables(number)``, a list of (header or None, rows); it may have ``image(number)``, bytes, and ``close()``. Any of these may
raise Encrypted, or anything else for what it can't read. A file or page that fails gives a row that says so, and the others
go on. A document is opened once for all pages that are asked of it, and no other page is touched; words and tables of a
page are read together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import rotate_boxes

PAGE = (
    "page_number int, rotation int, page_width double, page_height double, words array<struct<text: string, x0: double, y0: double, x1: double, y1: double, conf: double>>,"
    " tables array<struct<header: array<string>, header_external: boolean, rows: array<array<string>>>>, digest string, error string"
)
_STRINGS = pa.list_(pa.string())
_WORDS = pa.list_(pa.struct([("text", pa.string()), *((k, pa.float64()) for k in ("x0", "y0", "x1", "y1", "conf"))]))
_TABLES = pa.list_(pa.struct([("header", _STRINGS), ("header_external", pa.bool_()), ("rows", pa.list_(_STRINGS))]))
ARROW_PAGE = pa.schema([("page_number", pa.int32()), ("rotation", pa.int32()), ("page_width", pa.float64()), ("page_height", pa.float64()), ("words", _WORDS), ("tables", _TABLES), ("digest", pa.string()), ("error", pa.string())])


class Encrypted(Exception):
    """A file that needs a password."""


def failure(e: Exception) -> str:
    return "encrypted" if isinstance(e, Encrypted) else f"unreadable: {type(e).__name__}"


def _page(document, number: int) -> dict:
    """A page as a row of PAGE. Its digest is of its image, if there is one, and of all that is read."""
    page = document.words(number)
    words = [{"text": text, **dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True)), "conf": None if conf is None else float(conf)} for text, *box, conf in page["words"]]
    tables = [{"header": header if header is not None else (rows[0] if rows else []), "header_external": header is not None, "rows": rows} for header, rows in document.tables(number)]
    about = {"rotation": int(page["rotation"] or 0), **{f"page_{k}": None if page[k] is None else float(page[k]) for k in ("width", "height")}}
    image = document.image(number) if hasattr(document, "image") else b""
    digest = hashlib.sha256(json.dumps([about, words, tables]).encode() + b"\0" + image).hexdigest()
    return {"page_number": number, **about, "words": words, "tables": tables, "digest": digest, "error": None}


def pages_of(backend, content: bytes, wanted: Iterable[int] | None) -> Iterator[dict]:
    """Rows of PAGE for the wanted pages that the document has, or for all: one open document, one row for each page, or one for a file that can't be opened."""
    try:
        document = backend.open(content or b"")
        there = document.pages()
    except Exception as e:  # any fault of a file is that file's
        yield {"error": failure(e)}
        return
    try:
        some = set(there if wanted is None else wanted)
        for number in there:
            if number in some:
                try:
                    yield _page(document, number)
                except Exception as e:
                    yield {"page_number": number, "error": failure(e)}
    finally:
        if hasattr(document, "close"):
            document.close()


def page_counts(files: DataFrame, backend, content: str = "content", file_type: str = "file_type") -> DataFrame:
    """path, page_count, error for each file: an image has one page; a file that needs a password is encrypted, one that can't be opened unreadable, both without a count. Null content is unreadable."""

    def run(batches):
        for batch in batches:
            counts, errors = [], []
            for data in batch.column(1).to_pylist():
                try:
                    document = backend.open(data or b"")
                    counts.append(len(document.pages()))
                    errors.append(None)
                    if hasattr(document, "close"):
                        document.close()
                except Exception as e:
                    counts.append(None)
                    errors.append(failure(e))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int32()), pa.array(errors, pa.string())], names=["path", "page_count", "error"])

    image = F.col(file_type).isin("jpeg", "png", "webp")
    whole = files.filter(image).select("path", F.lit(1).alias("page_count"), F.lit(None).cast("string").alias("error"))
    opened = files.filter(~F.coalesce(image, F.lit(False))).select("path", F.col(content)).mapInArrow(run, "path string, page_count int, error string")
    return whole.unionByName(opened)


def read_pages(files: DataFrame, backend, scope: DataFrame | None = None, content: str = "content") -> DataFrame:
    """path and PAGE: a row for each page of files, or for each that scope (path, page_number) asks for, and one, without a page_number, for a file that can't be opened.

    The pages asked of a file come to it as one array, so each file is opened once and only these pages are read; files that
    none are asked of are not opened. A page that fails has an error and nothing else.
    """
    rows = files.select("path", F.col(content).alias("content"))
    if scope is not None:
        rows = rows.join(scope.groupBy("path").agg(F.collect_set(F.col("page_number").cast("int")).alias("wanted")), "path")
    else:
        rows = rows.withColumn("wanted", F.lit(None).cast("array<int>"))
    schema = pa.schema([("path", pa.string()), *ARROW_PAGE])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                path, data, wanted = (batch.column(i)[row].as_py() for i in range(3))
                got = [{"path": path, **page} for page in pages_of(backend, data, wanted)]
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema)

    return rows.select("path", "content", "wanted").mapInArrow(run, f"path string, {PAGE}")


def page_words(read: DataFrame) -> DataFrame:
    """path, page_number, word_ord, text, x0, y0, x1, y1, conf: the words of the pages read, their boxes as the page is seen, whatever its rotation."""
    words = read.filter("error is null").select("path", "page_number", "rotation", "page_width", "page_height", F.posexplode("words").alias("word_ord", "w"))
    return rotate_boxes(words.select("path", "page_number", "word_ord", "w.*", "rotation", "page_width", "page_height")).drop("rotation", "page_width", "page_height")


def page_tables(read: DataFrame) -> DataFrame:
    """path, page_number, table_index, header, header_external, rows: the ruled tables of the pages read. Without a header of its own, a table's first row is it."""
    return read.filter("error is null").select("path", "page_number", F.posexplode("tables").alias("table_index", "t")).select("path", "page_number", "table_index", "t.*")


def page_errors(read: DataFrame) -> DataFrame:
    """path, page_number (null for a whole file), error of what could not be read."""
    return read.filter("error is not null").select("path", "page_number", "error")
