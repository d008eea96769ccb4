"""Files opened by a backend: page counts, words, tables, errors; and exports that are kept."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from ledgerloom.operators import export, positional
from ledgerloom.plans.paged import JsonDocument, JsonPages
from ledgerloom.sources import cache, files, pages, readers

DOC = {"pages": [{"rotation": 90, "width": 600, "height": 800, "words": [["Item", 10, 20, 40, 30, None], ["Qty", 60, 20, 80, 30, 96.5]], "tables": [{"rows": [["Item", "Qty"], ["Pen", None]]}, {"header": ["Name", "Price"], "rows": [["a", "1"]]}]}, {"broken": True}, {"words": [["end", 1, 2, 3, 4, -1]]}]}


def saved(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(json.dumps(DOC).encode())
    (tmp_path / "b.json").write_bytes(b'{"encrypted": true}')
    (tmp_path / "c.json").write_bytes(b"nonsense")
    (tmp_path / "d.json").write_bytes(b"[]")
    (tmp_path / "e.png").write_bytes(bytes.fromhex(files.SIGNATURES["png"]) + b"x")
    return files.read_files(spark, f"file://{tmp_path}").withColumn("path", F.element_at(F.split("path", "/"), -1))


def test_page_counts(spark, tmp_path):
    got = {r.path: (r.page_count, r.error) for r in pages.page_counts(saved(spark, tmp_path), JsonPages()).collect()}
    assert got == {"a.json": (3, None), "b.json": (None, "encrypted"), "c.json": (None, "unreadable: JSONDecodeError"), "d.json": (None, "unreadable: AttributeError"), "e.png": (1, None)}


def test_page_words_and_tables(spark, tmp_path):
    read = pages.read_pages(saved(spark, tmp_path).filter("path like '%json'"), JsonPages()).cache()
    got = {(r.path, r.page_number, r.word_ord): (r.text, r.x0, r.y0, r.x1, r.y1, r.conf) for r in pages.page_words(read).collect()}
    assert got == {("a.json", 1, 0): ("Item", 770.0, 10.0, 780.0, 40.0, None), ("a.json", 1, 1): ("Qty", 770.0, 60.0, 780.0, 80.0, 96.5), ("a.json", 3, 0): ("end", 1.0, 2.0, 3.0, 4.0, -1.0)}
    errors = {(r.path, r.page_number): r.error for r in pages.page_errors(read).collect()}
    assert errors == {("a.json", 2): "unreadable: ValueError", ("b.json", None): "encrypted", ("c.json", None): "unreadable: JSONDecodeError", ("d.json", None): "unreadable: AttributeError"}
    tables = {(r.page_number, r.table_index): (r.header, r.header_external, r.rows) for r in pages.page_tables(read).collect()}
    assert tables == {(1, 0): (["Item", "Qty"], False, [["Item", "Qty"], ["Pen", None]]), (1, 1): (["Name", "Price"], True, [["a", "1"]])}
    digests = {(r.path, r.page_number): r.digest for r in read.collect()}
    assert len({d for d in digests.values() if d}) == 2 and digests["a.json", 2] is None


def logged(folder):
    """A backend that notes in a folder what is opened and read; local, so that tasks get it with its code."""

    class Noted(JsonDocument):
        def words(self, number):
            note(f"page {number}")
            return JsonDocument.words(self, number)

        def close(self):
            note("close")

    class Notes:
        def open(self, content):
            note("open")
            return Noted(json.loads(content))

    def note(what):
        import uuid
        from pathlib import Path

        (Path(folder) / uuid.uuid4().hex).write_text(what)

    return Notes()


def notes(folder):
    got = sorted(p.read_text() for p in folder.iterdir())
    for p in folder.iterdir():
        p.unlink()
    return got


def test_only_pages_in_scope_are_read_of_a_file_opened_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "log").mkdir()
    (tmp_path / "in/long.json").write_bytes(json.dumps({"pages": [{"words": [[f"w{i}", 1, 2, 3, 4, None]]} for i in range(150)]}).encode())
    (tmp_path / "in/other.json").write_bytes(json.dumps({"pages": [{}]}).encode())
    found = files.read_files(spark, f"file://{tmp_path}/in")
    path = f"file:{tmp_path}/in/long.json"
    scope = spark.createDataFrame([(path, 7), (path, 149), (path, 151)], "path string, page_number int")
    read = pages.read_pages(found, logged(tmp_path / "log"), scope).collect()
    assert {r.page_number: r.words[0].text for r in read} == {7: "w6", 149: "w148"}
    assert notes(tmp_path / "log") == ["close", "open", "page 149", "page 7"]

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(readers.page_source(logged(tmp_path / "log")))
    source = lambda: spark.read.format("page_content").option("paths", f"{path},file:{tmp_path}/in/other.json").load()
    got = source().filter(F.col("page_number").isin(3, 60, 61) & (F.col("path") == path)).collect()
    assert {r.page_number for r in got} == {3, 60, 61} and notes(tmp_path / "log") == ["close", "close", "open", "open", "page 3", "page 60", "page 61"]
    assert {r.page_number for r in source().filter("page_number > 148 and path like '%long%'").collect()} == {149, 150}
    assert notes(tmp_path / "log").count("page 149") == 1
    assert source().filter("page_number <= 2").count() == 3
    assert source().filter("page_number = 400").count() == 0 and source().filter("path = 'x'").count() == 0
    notes(tmp_path / "log")
    assert source().count() == 151 and notes(tmp_path / "log").count("open") == 6
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_a_content_is_read_by_ocr_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def ocr(df):
        def run(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b.set_column(b.schema.get_field_index("text"), "text", b.column(b.schema.get_field_index("digest")).cast("string"))

        return df.mapInArrow(run, df.schema)

    rows = [(job, 1, "", "same") for job in range(10)] + [(1, 2, "", "other"), (2, 2, "", None)]
    bare = spark.createDataFrame(rows, "job_id int, page_number int, text string, digest string")
    read = cache.cached(ocr, str(tmp_path / "cache"))
    first = read(bare.filter("digest is not null"))
    assert {(r.job_id, r.page_number): r.text for r in first.collect()} == {**{(j, 1): "same" for j in range(10)}, (1, 2): "other"} and asked.value == 2
    assert read(bare.filter("digest is not null")).count() == 11 and asked.value == 2
    again = files.page_sources(bare, read).collect()
    assert asked.value == 3 and len(again) == 12 and {r.source for r in again} == {"ocr"}
    assert read(spark.createDataFrame([(9, 9, "", "new")], bare.schema)).first().text == "new" and asked.value == 4
    assert cache.read_before(spark, str(tmp_path / "cache")).count() == 3 and cache.read_before(spark, str(tmp_path / "none")).count() == 0


def test_pages_without_text(spark):
    df = spark.createDataFrame([(1, "\n" * 30), (2, "a text layer that will do"), (3, None)], "page long, text string")
    bare = {r.page: (r.source, r.has_text_layer) for r in files.page_sources(df).collect()}
    assert bare == {1: ("native_pdf_text_layer", False), 2: ("native_pdf_text_layer", True), 3: ("native_pdf_text_layer", False)}
    read = {r.page: (r.text, r.source) for r in files.page_sources(df, lambda d: d.withColumn("text", F.lit("seen"))).collect()}
    assert read == {1: ("seen", "ocr"), 2: ("a text layer that will do", "native_pdf_text_layer"), 3: ("seen", "ocr")}


def test_saved_files_are_found(spark, tmp_path):
    where = f"file://{tmp_path}/out"
    files_ = spark.createDataFrame([(1, "one.csv", bytearray(b"x")), (2, "two.csv", bytearray(b"yy"))], "job_id int, filename string, content binary")
    assert export.save(files_, where).count() == 2 == export.save(files_, where).count()
    names = spark.createDataFrame([(1, "one.csv"), (1, "no.csv"), (3, "one.csv")], "job_id int, filename string")
    assert {(r.job_id, r.filename): r.stored for r in export.exists(spark, where, names).collect()} == {(1, "one.csv"): True, (1, "no.csv"): False, (3, "one.csv"): False}
    assert export.stored(spark, f"file://{tmp_path}/none").count() == 0
    assert not list(tmp_path.rglob("*.part"))


def test_archives_hold_the_files(spark):
    df = spark.createDataFrame([(1, "a.csv", bytearray(b"x")), (1, "b.csv", bytearray(b"yy")), (2, "c.csv", bytearray(b"z"))], "job_id int, filename string, content binary")
    rows = export.zip_files(df, "20260131").collect()
    assert [r.filename for r in rows] == ["invoices_1_20260131.zip"]
    with zipfile.ZipFile(io.BytesIO(bytes(rows[0].content))) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a.csv": b"x", "b.csv": b"yy"}


def test_a_rate_without_a_name_goes_to_the_nearest_tax():
    upper = [(50, 90, "Item"), (200, 220, "Qty"), (300, 330, "CGST"), (400, 430, "SGST"), (500, 530, "Total")]
    lower = [(280, 295, "Rate"), (305, 325, "Amount"), (202, 218, "Free"), (438, 452, "Rate"), (405, 428, "Amount")]
    at, data, named, rest = positional.find_header([upper, lower, [(50, 60, "x")]])
    assert (at, data) == (0, 2)
    assert {f: named[f][2] for f in ("cgst_rate", "sgst_rate", "cgst_amount", "sgst_amount")} == {"cgst_rate": "Rate", "sgst_rate": "Rate", "cgst_amount": "CGST Amount", "sgst_amount": "SGST Amount"} and rest == []
