"""Kept exports: made, served, replaced, and whole after a crash; requests by route, number and columns."""

import io
import os
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import export_requests, export_store

ITEMS = [(1, "g", 1, "Pen", 2.0), (1, "g", 2, 'a "b", c', None), (1, "h", 1, "Cup", 1.5), (2, "k", 1, "Ink", 3.0)]
NAMED = [(1, "g", "one"), (1, "h", "two"), (2, "k", "three"), (3, "z", "empty")]


def frames(spark, items=ITEMS, named=NAMED):
    return spark.createDataFrame(items, "job_id int, group_id string, line_number int, item_description string, quantity double"), spark.createDataFrame(named, "job_id int, group_id string, filename string")


def texts(files):
    return {(r.job_id, r.group_id): bytes(r.content).decode("utf-8-sig") for r in export_store.with_content(files).collect() if r.group_id}


def states(files):
    return {r.job_id: r.state for r in files.collect()}


def test_made_served_replaced(spark, tmp_path):
    where = f"file://{tmp_path}"
    items, named = frames(spark)
    first = export_store.exports(items, named, where, "20260131")
    assert states(first) == {"1": "made", "2": "made", "3": "made"}
    rows = {(r.job_id, r.group_id): r for r in first.collect()}
    assert {r.filename for r in rows.values()} == {"one.csv", "two.csv", "three.csv", "empty.csv", "invoices_1_20260131.zip"}
    got = texts(first)
    assert got["1", "g"].splitlines()[1:] == ["1,Pen,,,,,,,2.0,,,,,,,,,,,,,,,,,,,,,", '2,"a ""b"", c",,,,,,,,,,,,,,,,,,,,,,,,,,,,'] and len(got["3", "z"].splitlines()) == 1
    whole = next(r for r in export_store.with_content(first).collect() if r.group_id is None)
    with zipfile.ZipFile(io.BytesIO(bytes(whole.content))) as z:
        assert {n: z.read(n).decode("utf-8-sig") for n in z.namelist()} == {"one.csv": got["1", "g"], "two.csv": got["1", "h"]}
    assert all(Path(r.file_path.removeprefix("file:")).stat().st_size == r.size_bytes for r in rows.values())

    again = export_store.exports(items.repartition(3), named, where, "20260201")
    assert states(again) == {"1": "served", "2": "served", "3": "served"} and {r.file_path for r in again.collect()} == {r.file_path for r in rows.values()}

    changed = frames(spark, [*ITEMS[:3], (2, "k", 1, "Ink", 4.0), (3, "z", 1, "late", None)])[0]
    third = export_store.exports(changed, named, where, "20260301")
    assert states(third) == {"1": "served", "2": "replaced", "3": "replaced"}
    assert "1,Ink,,,,,,,4.0" in texts(third)["2", "k"] and "late" in texts(third)["3", "z"]
    # What was there before is what an input like before gets again.
    assert states(export_store.exports(items, named, where, "20260401")) == {"1": "served", "2": "served", "3": "served"}
    moved = changed.withColumnRenamed("quantity", "quantity_sold")
    assert states(export_store.exports(moved, named, where, "20260401")) == {"1": "replaced", "2": "replaced", "3": "served"}
    renamed = named.withColumn("filename", F.concat("filename", F.lit("x")))
    assert states(export_store.exports(items.filter("job_id = 2"), renamed.filter("job_id = 2"), where, "20260501")) == {"2": "replaced"}


def test_an_unfinished_write_is_made_again(spark, tmp_path):
    """A task dies after other tasks, and part of its own files, are written."""
    items, named = frames(spark)
    where = f"file://{tmp_path}"
    spark.dataSource.register(export_store.ExportStore)
    files = export_store.group_files(items, named).selectExpr("cast(job_id as string) job_id", "'v' as version", "group_id", "filename", "content").repartition(1).sort("filename")

    def dies(batches):
        for batch in batches:
            yield batch.slice(0, 2)
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        files.mapInArrow(dies, files.schema).write.format("export_store").mode("append").save(where)
    assert export_store.manifests(spark, where).count() == 0 and not list(Path(tmp_path).rglob("*.csv"))
    assert states(export_store.exports(items, named, where, "20260131")) == {"1": "made", "2": "made", "3": "made"}


def test_torn_files_of_a_dead_driver_are_never_read(spark, tmp_path):
    """The writer's tasks are done, one file is torn, and no commit comes."""
    import pyarrow as pa

    where = f"file://{tmp_path}"
    writer = export_store.StoreWriter(where)
    batch = pa.RecordBatch.from_pylist([{"job_id": "1", "version": "v", "group_id": "g", "filename": "one.csv", "content": b"whole"}])
    writer.write(iter([batch]))
    torn = next(Path(tmp_path).rglob("one.csv"))
    os.truncate(torn, 2)
    items, named = frames(spark)
    done = export_store.exports(items, named, where, "20260131")
    assert states(done) == {"1": "made", "2": "made", "3": "made"} and "Pen" in texts(done)["1", "g"] and torn.exists()


def test_attempts_that_do_not_count_go(tmp_path):
    import pyarrow as pa

    writer = export_store.StoreWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pylist([{"job_id": "1", "version": "v", "group_id": "g", "filename": "one.csv", "content": b"whole"}])
    _, counts, empty = writer.write(iter([batch])), writer.write(iter([batch])), writer.write(iter([]))
    writer.commit([counts, None, empty])
    assert len(list(tmp_path.rglob("one.csv"))) == 1 and len(list(tmp_path.rglob("manifest.parquet"))) == 1 and not list((tmp_path / "staging").iterdir())
    other = export_store.StoreWriter(str(tmp_path))
    other.write(iter([batch]))
    other.abort([])
    other.abort([])
    assert len(list(tmp_path.rglob("one.csv"))) == 1
    export_store.StoreWriter(str(tmp_path)).commit([None])


def test_answer_is_the_archive_or_the_one_file(spark, tmp_path):
    items, named = frames(spark)
    got = {r.job_id: (r.filename, r.media_type) for r in export_store.answer(items, named, str(tmp_path), "20260131").collect()}
    assert got == {"1": ("invoices_1_20260131.zip", "application/zip"), "2": ("three.csv", "text/csv"), "3": ("empty.csv", "text/csv")}


def test_exported_jobs_say_so(spark, tmp_path):
    items, named = frames(spark)
    jobs = spark.createDataFrame([(1, "ready_to_export"), (2, "review_required"), (4, "ready_to_export")], "job_id int, status string")
    files = export_store.exports(items, named, str(tmp_path), "20260131")
    assert {r.job_id: r.status for r in export_store.exported(jobs, files).collect()} == {1: "exported", 2: "exported", 4: "ready_to_export"}


def test_requests(spark, tmp_path):
    items, _ = frames(spark)
    groups = spark.createDataFrame([(1, "g", 1, "INV/2026/1", "a/b"), (1, "h", 2, "INV/2026/2", "a/b"), (2, "k", 1, "INV/9", "it's"), (3, "z", 1, None, "e")], "job_id int, group_id string, group_ord int, invoice_number string, seed string")
    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job_id int")
    asked = [
        ("a", 1, "export", None, None), ("b", 1, "zip", None, "item_description"), ("c", 1, "number", "INV/2026/2", None), ("d", 1, "number", "INV/2026/3", None), ("e", 2, "zip", None, None), ("f", 4, "export", None, None),
        ("g", 9, "export", None, None), ("h", 2, "export", None, " quantity , item_description"), ("i", 2, "export", None, "nonsense"), ("j", 3, "export", None, "quantity"), ("k", 1, "number", "INV/2026/2", "item_description"), ("l", 3, "number", None, None),
    ]
    requests = spark.createDataFrame(asked, "request_id string, job_id int, route string, invoice_number string, columns string")
    done = export_requests.answers(requests, jobs, groups, items, str(tmp_path), "20260131")
    got = {r.request_id: (r.status, r.error, r.filename, r.media_type) for r in done.collect()}
    assert got == {
        "a": (200, None, "invoices_1_20260131.zip", "application/zip"), "b": (200, None, "invoices_1_20260131.zip", "application/zip"), "c": (200, None, "a-b_2.csv", "text/csv"), "d": (404, "invoice_not_found", None, None),
        "e": (404, "single_invoice", None, None), "f": (404, "no_invoices", None, None), "g": (404, "job_not_found", None, None), "h": (200, None, "it's.csv", "text/csv"), "i": (200, None, "it's.csv", "text/csv"),
        "j": (200, None, "e.csv", "text/csv"), "k": (200, None, "a-b.csv", "text/csv"), "l": (404, "invoice_not_found", None, None),
    }
    held = {}
    for r in export_requests.members(done).collect():
        held.setdefault(r.request_id, {})[r.name] = bytes(r.content).decode("utf-8-sig")
    assert held["b"] == {"a-b.csv": 'Item Description\r\nPen\r\n"a ""b"", c"\r\n', "a-b_2.csv": "Item Description\r\nCup\r\n"}
    assert held["h"] == {"it's.csv": "Item Description,Quantity\r\nInk,3.0\r\n"} and held["j"] == {"e.csv": "Quantity\r\n"} and held["k"] == {"a-b.csv": "Item Description\r\nCup\r\n"}
    assert set(held["a"]) == {"a-b.csv", "a-b_2.csv"} and held["a"]["a-b_2.csv"] == held["c"]["a-b_2.csv"] and held["i"]["it's.csv"].startswith("Line #,Item Description,Pack")
    # Nothing of the selections is kept.
    assert export_store.manifests(spark, str(tmp_path)).select("job_id").distinct().count() == 2
