"""Uploaded files through all checks to invoices."""

import json

from pyspark.sql import functions as F

from ledgerloom.plans.ingest import ingest
from ledgerloom.plans.paged import JsonDocument
from ledgerloom.sources import files
from ledgerloom.sources.pages import Encrypted


def words(*lines):
    return {"words": [[w, 50.0 + 40 * i, 20.0 * y, 80.0 + 40 * i, 20.0 * y + 10, None] for y, line in enumerate(lines) for i, w in enumerate(line.split(" "))]}


def test_ingest(spark, tmp_path):
    class PdfOfJson:
        """A file that looks like a PDF and holds JSON; local, so that tasks get it with its code."""

        def open(self, content):
            doc = json.loads(content.removeprefix(b"%PDF-"))
            if doc.get("encrypted"):
                raise Encrypted
            return JsonDocument(doc)

    table = {"rows": [["Product", "Qty", "Value"], ["Pen", "2", "4.00"]]}
    pages = [words("Invoice No: A-1001", "and so on with more words") | {"tables": [table]}, words("Invoice No: B-1002", "and so on with more words"), {}]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-" + json.dumps({"pages": pages}).encode())
    (tmp_path / "b.pdf").write_bytes(b'%PDF-{"encrypted": true}')
    (tmp_path / "c.pdf").write_bytes(b"plain")
    (tmp_path / "d.png").write_bytes(bytes.fromhex(files.SIGNATURES["png"]))
    (tmp_path / "f.pdf").write_bytes(b"%PDF-" + json.dumps({"pages": [words("IRN No: " + "a1" * 32, "and so on with more words"), {"broken": True}, words("more of the same, in words")]}).encode())
    (tmp_path / "e.pdf").write_bytes(b"%PDF-" + json.dumps({"pages": [{}] * 151}).encode())
    rows = [(1, "a.pdf", None, True), (2, "a.pdf", "1-2", False), (3, "a.pdf", "9", False), (4, "a.pdf", None, False), (5, "b.pdf", None, True), (6, "c.pdf", None, True), (7, "d.png", None, True), (8, "e.pdf", None, True), (9, "no.pdf", None, True), (10, "f.pdf", None, True), (11, "f.pdf", "1", False)]
    jobs = spark.createDataFrame(rows, "job_id int, path string, split_value_raw string, confirmed_no_split boolean")
    found = files.read_files(spark, f"file://{tmp_path}").withColumn("path", F.element_at(F.split("path", "/"), -1))
    done = ingest(found, jobs, PdfOfJson(), lambda bare: bare.withColumn("text", F.concat(F.lit("Bill No. S-"), F.col("job_id").cast("string"), F.lit("0000"))))
    got = {r.job_id: (r.page_count, r.error, r.status, r.n_groups) for r in done.jobs.collect()}
    assert got == {
        1: (3, None, "review_required", 3), 2: (3, None, "review_required", 2), 3: (3, "split_bounds", None, None), 4: (3, "confirm_no_split", None, None), 5: (None, "encrypted", None, None),
        6: (None, "unknown_type", None, None), 7: (1, None, "review_required", 1), 8: (151, "too_many_pages", None, None), 9: (None, "missing", None, None),
        10: (3, None, "review_required", 2), 11: (3, None, "ready_to_export", 1),
    }
    groups = {(r.job_id, r.invoice_number): (r.source_page_list, r.invoice_number_confidence) for r in done.extraction.headers.collect()}
    assert groups[1, "A-1001"] == ([1], "review") and groups[1, "S-10000"] == ([3], "low") and groups[7, "S-70000"] == ([1], "low") and len(groups) == 9
    # A page of job 10 can't be read; job 11 doesn't ask for it.
    assert {(r.job_id, r.page_number): r.error for r in done.page_errors.collect()} == {(10, 2): "unreadable: ValueError"}
    assert {(r.job_id, r.item_description, r.quantity) for r in done.extraction.items.collect()} == {(1, "Pen", 2.0), (2, "Pen", 2.0)}
