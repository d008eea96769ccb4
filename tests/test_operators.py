"""Operators against the plain loops they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.fields import cap_for_source, header_fields
from ledgerloom.operators import export, grouping, items, layout, positional, sections, splits, tables
from ledgerloom.sources import files


def test_grouping_as_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for job in range(60):
        open_, seen, groups = None, {}, []
        for page in range(1, rng.randrange(2, 12)):
            n = rng.choice([None, "A", "B", "C"])
            c = "not_found" if n is None else rng.choice(["high", "review"])
            rows.append((job, page, n, c))
            if n is None:
                if open_ is None:
                    open_ = dict(n=None, c="not_found", p=[], m=False, r=True)
                    groups.append(open_)
                open_["p"].append(page)
                open_["r"] = True
            elif open_ is not None and open_["n"] == n:
                open_["p"].append(page)
            elif n in seen:
                open_ = seen[n]
                open_["p"].append(page)
                open_["m"] = open_["r"] = True
            else:
                open_ = dict(n=n, c=c, p=[page], m=False, r=c != "high")
                seen[n] = open_
                groups.append(open_)
        want[job] = [(g["n"], g["c"], g["p"], g["m"], g["r"]) for g in groups]
    df = spark.createDataFrame(rows, "job_id int, page_number int, invoice_number string, confidence string").withColumn("range_id", F.lit(0))
    got: dict = {}
    for r in grouping.group_pages(df).orderBy("job_id", "group_ord").collect():
        got.setdefault(r.job_id, []).append((r.invoice_number, r.invoice_number_confidence, r.source_page_list, r.is_non_contiguous_merge, r.needs_user_review))
    assert got == want


def test_fence_drops_pages_outside(spark):
    pages = spark.createDataFrame([(1, p, "A", "high") for p in range(1, 8)] + [(2, 1, "B", "high")], "job_id int, page_number int, invoice_number string, confidence string")
    ranges = spark.createDataFrame([(1, [(1, 2), (4, 5)])], "job_id int, ranges array<struct<start: int, end: int>>")
    got = {(r.job_id, r.page_number): r.range_id for r in grouping.fence(pages, ranges).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 4): 2, (1, 5): 2, (2, 1): 0}


@pytest.mark.parametrize("raw, ranges, error", [(None, [], None), ("  ", [], None), ("5", [(5, 5)], None), ("7-9, 1-3, 4-6", [(1, 3), (4, 6), (7, 9)], None), ("5-1", [], "reversed"), ("1-20", [], "bounds"), ("1-5, 4-8", [], "overlap"), ("abc", [], "syntax"), ("0", [], "bounds"), (" 2 - 3 ,", [(2, 3)], None), ("99999999999999999999", [], "bounds")])
def test_splits(spark, raw, ranges, error):
    r = splits.parse_splits(spark.createDataFrame([(raw, 10)], "split_value_raw string, page_count int")).first()
    assert ([tuple(x) for x in r.ranges], r.split_error) == (ranges, error)


def test_pages_in_scope(spark):
    df = spark.createDataFrame([(1, [(2, 3), (3, 4)], 9), (2, [], 2), (3, [], 0)], "job_id int, ranges array<struct<start: bigint, end: bigint>>, page_count int")
    assert sorted(tuple(r) for r in splits.pages_in_scope(df).collect()) == [(1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]


def test_rows_as_a_loop(spark):
    rng = random.Random(5)
    words = [(1, p, i, f"w{i}", float(rng.randrange(0, 400)), y := float(rng.randrange(0, 120)), 0.0, y + rng.randrange(0, 14)) for p in range(20) for i in range(25)]
    want = {}
    for p in range(20):
        cur, row = [], -1
        for w in sorted((w for w in words if w[1] == p), key=lambda w: (w[5], w[4], w[2])):
            h = max(w[7] - w[5], 1.0)
            if cur and abs(w[5] - sum(x[5] for x in cur) / len(cur)) <= 0.6 * max(max(cur[-1][7] - cur[-1][5], 1.0), h):
                cur.append(w)
            else:
                cur, row = [w], row + 1
            want[p, w[2]] = row
    df = spark.createDataFrame(words, "job_id int, page_number int, word_ord int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page_number, r.word_ord): r.row_id for r in layout.cluster_rows(df).collect()} == want


def slow_map(cells):
    out = {}
    for i, c in enumerate(cells):
        t = (c or "").strip().lower()
        if not c:
            continue
        if t in C.EXACT_COLUMNS and C.EXACT_COLUMNS[t] not in out.values():
            out[i] = C.EXACT_COLUMNS[t]
            continue
        hit = [f for f, ks in C.COLUMNS.items() if f not in out.values() and any(k in t for k in ks)]
        if hit:
            out[i] = hit[0]
    return [out.get(i) for i in range(len(cells))]


def test_header_map_as_a_loop(spark):
    rng = random.Random(7)
    pool = [k for ks in C.COLUMNS.values() for k in ks] + ["Amount", "NET AMOUNT", "", None, "Transaction", "Remarks", "Old Mrp", "It's"]
    rows = [[rng.choice(pool) for _ in range(rng.randrange(1, 9))] for _ in range(200)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h array<string>")
    got = {r.i: r.m for r in df.select("i", tables.map_header("h").alias("m")).collect()}
    assert all(got[i] == slow_map(r) for i, r in enumerate(rows))


def test_stacked_headers(spark):
    cells = ["Mfg Date/\nExp Date", "Material/\nHSN", "Amount/\nSGST%", "Disc/\nDisc %", "long wrapped\nname\nof it", "Qty"]
    got = spark.createDataFrame([(cells,)], "h array<string>").select(tables.map_stacked("h").alias("m")).first().m
    assert [x and tuple(x) for x in got] == [("mfg_date", "expiry_date"), (None, "hsn_sac"), ("sgst_amount", "sgst_rate"), ("discount_amount", "discount_rate"), None, None]


def test_ruled_tables(spark):
    decoy = (1, 1, 0, ["Name", "Product"], False, [["Name", "Product"], ["a", "b"]])
    real = (1, 1, 1, None, False, [["Product", "HSN", "CGST", None, "Value"], ["", "", "Rate", "Amt", None], ["Soap\nbar", "3004", "2.50", "697.69", "28,000.00"], ["Total", "", "", "", "28000"]])
    df = spark.createDataFrame([decoy, real], "job_id int, page_number int, table_index int, header array<string>, header_external boolean, rows array<array<string>>")
    chosen = tables.best_table(tables.candidates(df))
    assert chosen.first().table_index == 1
    rows = {r.item_description: r for r in tables.table_items(chosen).collect()}
    assert (rows["Soap bar"].cgst_rate, rows["Soap bar"].cgst_amount, rows["Soap bar"].line_total) == (2.5, 697.69, 28000.0)
    assert rows["Total"].is_subtotal and rows["Total"].line_number is None


def test_header_without_rules():
    rows = [[(0, 30, "Letterhead")], [(50, 90, "Item"), (230, 250, "HSN"), (300, 320, "CGST"), (350, 380, "OLD"), (410, 440, "SALE")], [(302, 318, "%"), (352, 380, "MRP"), (412, 438, "QTY"), (460, 480, "Total")], [(50, 60, "x")]]
    at, data, named, rest = positional.find_header(rows)
    assert (at, data) == (1, 3)
    assert {f: b[2] for f, b in named.items()} == {"cgst_rate": "CGST %", "mrp_old": "OLD MRP", "item_description": "Item", "hsn_sac": "HSN", "quantity": "SALE QTY", "line_total": "Total"}
    assert rest == []


def test_items_without_rules(spark):
    def line(y, *cells):
        return [(x, float(y), t) for x, t in cells]

    page = line(0, (50, "Item"), (230, "HSN"), (300, "Qty"), (350, "Rate"), (410, "Taxable"), (480, "Tax"), (530, "Total"))
    page += line(20, (50, "Blue"), (75, "soap"), (230, "3401"), (300, "20"), (350, "45.00"), (410, "900.00"), (480, "zz"), (530, "945.00"))
    page += line(40, (50, "Group")) + line(60, (50, "Pen"), (300, "2")) + line(80, (50, "Total"), (75, "Amount"), (530, "947.00")) + line(100, (50, "Never"), (300, "9"))
    words = [(1, 1, i, t, float(x), y, x + 5.0 * len(t), y + 10) for i, (x, y, t) in enumerate(page)]
    df = layout.cluster_rows(spark.createDataFrame(words, "job_id int, page_number int, word_ord int, text string, x0 double, y0 double, x1 double, y1 double"))
    got = positional.items(df, layout.row_texts(df)).orderBy("line_number").collect()
    assert [(r.item_description, r.quantity, r.taxable_value, r.line_total) for r in got] == [("Blue soap", 20.0, 900.0, 945.0), ("Pen", 2.0, None, None)]
    assert got[0].base_confidence == C.REVIEW


def test_scan_as_a_loop(spark):
    rng = random.Random(11)
    rows, want = [], []
    for job in range(80):
        unmatched, n, done = 0, 0, False
        for i in range(rng.randrange(1, 14)):
            kind = rng.choice(["item"] * 4 + ["un"] * 3 + ["skip", "stop"])
            rows.append((job, i, kind == "stop", kind == "un", kind == "item"))
            done = done or kind == "stop" or n >= 5
            if done:
                continue
            unmatched = unmatched + 1 if kind == "un" else 0
            done = unmatched >= 2
            if kind == "item":
                n += 1
                want.append((job, i, n))
    df = spark.createDataFrame(rows, "job_id int, row_id int, hard_stop boolean, unmatched boolean, is_item boolean")
    got = positional.scan(df, key=("job_id",), cap=5)
    assert sorted((r.job_id, r.row_id, r.line_number) for r in got.collect()) == want


def test_page_splits(spark):
    df = spark.createDataFrame([(1, 1, "Long name", None), (1, 2, "goes on", 5.0), (1, 3, "Next", 1.0), (1, 4, "last alone", None), (2, 1, "a", None), (2, 2, "b", None), (2, 3, "c", 1.0)], "job_id int, line_number int, item_description string, quantity double")
    got = [tuple(r) for r in items.merge_page_splits(df).orderBy("job_id", "line_number").collect()]
    assert got == [(1, 1, "Long name goes on", 5.0), (1, 2, "Next", 1.0), (1, 3, "last alone", None), (2, 1, "a", None), (2, 2, "b c", 1.0)]


def test_two_row_items(spark):
    lines = ["header", "100001 MAT1 GLUCO 0.5% 5 ML 12.00 EA 10.00 8.00 9.00 7.50 12.00% 7,827.84", "boilerplate", "30049099 BATCH NO:B1 EXP DT : MAR-2028 MFG DT : 04/26 12.00", "100002 MAT2 PLAIN 1.00 EA 1.00 1.00 1.00 1.00 5.00% 1.00"]
    got = items.pair_details(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc int, row_idx int, text string")).orderBy("line_number").collect()
    assert (got[0].item_description, got[0].pack, got[0].ptr, got[0].line_total, got[0].batch_number, got[0].expiry_date, got[0].mfg_date) == ("GLUCO 0.5%", "5 ML", 7.5, 7827.84, "B1", "01-03-2028", "01-04-2026")
    assert (got[1].item_description, got[1].hsn_sac) == ("PLAIN", None)


def test_header_fields(spark):
    text = "IRN No. : " + "ab" * 32 + "\nDated: 14-07-2026\nAck No. : \nGSTIN No. : 27ABCDE1234F1Z5\nBill To: Corner Shop\nAdjustment Amount: -0.12\nNet Payable Amount: 2,724.00\n  For Good Goods Ltd \n"
    r = header_fields(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert (r[0].invoice_number_confidence, r[0].invoice_date, r[0].ack_number, r[0].party_gstin_confidence, r[0].buyer_name, r[0].adjustment_amount, r[0].invoice_total, r[0].party_name) == ("high", "14-07-2026", None, "high", "Corner Shop", -0.12, 2724.0, "Good Goods Ltd")
    assert r[0].ack_number_confidence == "not_found" and r[1].invoice_number is None


@pytest.mark.parametrize("f, v, band, want", [("invoice_total", "1", "high", "review"), ("invoice_number", "ab" * 32, "high", "review"), ("invoice_number", "X1", "review", "low"), ("ack_number", None, "not_found", "not_found"), ("ack_number", "1", "review", "review")])
def test_ocr_cap(spark, f, v, band, want):
    df = spark.createDataFrame([(v, band)], "v string, b string")
    assert df.select(cap_for_source(f, F.col("v"), F.col("b"), F.lit("ocr"))).first()[0] == want


def test_sections(spark):
    lines = ["Invoice", "Bill To: X", "street", "Total Amount: 5", "Terms & Conditions", "legal", "more"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc int, row_idx int, text string")
    found = sections.sections(rows)
    assert sorted((r.kind, r.row_start, r.row_end) for r in found.collect()) == [("buyer", 1, 3), ("exclude", 4, 7)]
    assert [r.section for r in sections.row_kinds(rows, found).orderBy("row_idx").collect()] == [None, "buyer", "buyer", None, "exclude", "exclude", "exclude"]


def test_files(spark):
    rows = [("a", bytearray(b"%PDF-1.7")), ("b", bytearray(b"\x89PNG\r\n\x1a\n0")), ("c", bytearray()), ("d", bytearray(b"text")), ("e", bytearray(b"\xff\xd8\xff0")), ("f", bytearray(b"RIFF1234WEBP")), ("g", bytearray(b"%PDF-" + b"x" * 100)), ("h", None)]
    got = {r.name: (r.file_type, r.error) for r in files.sniff(spark.createDataFrame(rows, "name string, content binary"), max_bytes=50).collect()}
    assert got == {"a": ("pdf", None), "b": ("png", None), "c": (None, "empty"), "d": (None, "unknown_type"), "e": ("jpeg", None), "f": ("webp", None), "g": (None, "too_large"), "h": (None, "empty")}


def test_unique_names(spark):
    df = spark.createDataFrame([(1, 1, "INV/1"), (1, 2, "INV\\1"), (1, 3, "INV-2"), (2, 1, None), (2, 2, None), (2, 3, "A"), (3, 1, "A"), (3, 2, "A"), (3, 3, "A_2")], "job_id int, ord int, v string")
    got = [r.filename for r in export.unique_names(df, "v", prefix="invoice").orderBy("job_id", "ord").collect()]
    assert got == ["INV-1", "INV-1_2", "INV-2", "invoice_1", "invoice_2", "A", "A", "A_2", "A_2"]


def test_projection():
    assert export.selected_columns(export.parse_columns("hsn_sac, item_description")) == ["item_description", "hsn_sac"]
    assert export.selected_columns(["nothing"]) == list(C.ITEM_COLUMNS) == export.selected_columns(None)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "g1", 1, 'So"ap, blue', 850.0), (1, "g1", 2, None, None), (1, "g2", 1, "Pen", 0.5)], "job_id int, group_id string, line_number int, item_description string, quantity double")
    made = export.csv_files(df, ["line_number", "item_description", "quantity"])
    content = {r.group_id: bytes(r.content) for r in made.collect()}
    assert content["g1"] == '﻿Line #,Item Description,Quantity\r\n1,"So""ap, blue",850.0\r\n2,,\r\n'.encode()
    named = made.withColumn("filename", F.concat("group_id", F.lit(".csv")))
    paths = [r.file_path for r in export.save(named, f"file://{tmp_path}").collect()]
    assert len(paths) == 2 and (tmp_path / "1" / "g2.csv").read_bytes() == content["g2"]
    zipped = export.zip_files(named, "20260131").collect()
    assert [r.filename for r in zipped] == ["invoices_1_20260131.zip"]


def test_empty_inputs(spark):
    pages = spark.createDataFrame([], "job_id int, page_number int, invoice_number string, confidence string, range_id int")
    words = spark.createDataFrame([], "job_id int, page_number int, word_ord int, text string, x0 double, y0 double, x1 double, y1 double")
    assert grouping.group_pages(pages).count() == 0
    assert layout.page_texts(layout.row_texts(layout.cluster_rows(words))).count() == 0


def test_a_page_of_many_words_is_clustered_in_one_pass(spark):
    """A page of 100,000 words, ten times the words of another, against the rule word by word."""
    import time

    def page(n):
        return spark.range(n).selectExpr("1 as job_id", f"{n} as page_number", "cast(id as int) as word_ord", "'w' as text", "cast((id * 7919) % 600 as double) as x0", f"cast((id * 104729) % {n} as double) / 8 as y0", "cast((id * 7919) % 600 + 9 as double) as x1", f"cast((id * 104729) % {n} as double) / 8 + 1 + id % 7 as y1")

    took = []
    for n in (10_000, 100_000):
        began = time.time()
        got = {r.word_ord: r.row_id for r in layout.cluster_rows(page(n)).select("word_ord", "row_id").collect()}
        took.append(time.time() - began)
        words = sorted((r.y0, r.x0, r.word_ord, max(r.y1 - r.y0, 1.0)) for r in page(n).collect())
        row, tops, last = -1, [], 0.0
        for top, _, i, h in words:
            if tops and abs(top - sum(tops) / len(tops)) <= 0.6 * max(last, h):
                tops.append(top)
            else:
                row, tops = row + 1, [top]
            last = h
            assert got[i] == row
        assert len(got) == n
    assert took[1] < 60


def test_only_rows_that_may_be_headers_reach_the_claims(spark, tmp_path, monkeypatch):
    plain = positional.find_header

    def noted(rows, memo=None, folder=str(tmp_path), plain=plain):
        import uuid
        from pathlib import Path

        (Path(folder) / uuid.uuid4().hex).write_text("\n".join(" ".join(b[2] for b in row) for row in rows))
        return plain(rows)

    monkeypatch.setattr(positional, "find_header", noted)
    lines = ["Company of Pens", "Item Qty Rate Total", "% MRP", "Soap 1 2.00 2.00", "more of it", "total value"]
    rows = [(job, 1, r, i, 60.0 * i, 60.0 * i + 30, w) for job, some in ((1, lines), (2, lines[3:])) for r, line in enumerate(some) for i, w in enumerate(line.split(" "))]
    df = spark.createDataFrame(rows, "job_id int, page_number int, row_id int, word_ord int, x0 double, x1 double, text string")
    got = positional.header_anchors(df).collect()
    assert {r.job_id for r in got} == {1} and {(r.header_row, r.data_row) for r in got} == {(1, 2)}
    assert [p.read_text() for p in tmp_path.iterdir()] == ["Item Qty Rate Total\n% MRP"]


def test_soaps_of_a_brand_meet_their_sum(spark):
    """The worked example: a category, two items and the sum of their part are found, and the sum holds."""
    lines = [["Item", "@300 Qty", "@410 Rate", "@500 Total"], ["BRAND A"], ["Blue soap", "@300 9", "@410 45.00", "@500 405.00"], ["Red soap", "@300 12", "@410 45.00", "@500 540.00"], ["Sub Total", "@500 945.00"], ["Ack No. 1"]]
    rows = []
    for r, line in enumerate(lines):
        for c in line:
            x, text = (float(c[1:4]), c[5:]) if c.startswith("@") else (50.0, c)
            for w in text.split(" "):
                rows.append((1, 1, r, len(rows), x, x + 5.0 * len(w), w))
                x += 5.0 * len(w) + 5
    df = spark.createDataFrame(rows, "job_id int, page_number int, row_id int, word_ord int, x0 double, x1 double, text string")
    found = positional.trace(df, layout.row_texts(df), positional.column_bounds(positional.header_anchors(df)))
    assert [(r.row_id, r.kind, r.stop_reason) for r in found.orderBy("row_id").collect()] == [(1, "category", None), (2, "item", None), (3, "item", None), (4, "subtotal", None), (5, "end", "end_marker")]
    held = None
    for kind in ("item", "category", "subtotal"):
        one = positional.traced(found, kind).select(F.col("job_id").alias("doc"), "page_number", "row_id", F.lit(kind).alias("kind"), F.col("item_description").alias("text"), "taxable_value", "line_total")
        held = one if held is None else held.unionByName(one)
    got = {r.kind: (r.label, r.first_line, r.last_line, r.n_items, r.line_total, r.line_total_items, r.line_total_reconciles) for r in items.spans(held).collect()}
    assert got == {"category": ("BRAND A", 1, 2, 2, None, 945.0, None), "section": (None, 1, 2, 2, 945.0, 945.0, True)}


def test_a_scan_ends_past_the_cap(spark):
    lines = [["Item", "Qty", "Rate"], *([f"a{i}", "1", "2"] for i in range(4))]
    rows = [(1, 1, r, 3 * r + c, 100.0 * c, 100.0 * c + 30, w) for r, line in enumerate(lines) for c, w in enumerate(line)]
    df = spark.createDataFrame(rows, "job_id int, page_number int, row_id int, word_ord int, x0 double, x1 double, text string")
    bounds = positional.column_bounds(positional.header_anchors(df))
    got = [(r.kind, r.stop_reason) for r in positional.trace(df, layout.row_texts(df), bounds, cap=2).orderBy("row_id").collect()]
    assert got == [("item", None), ("item", None), ("end", "cap"), ("after", None)]


def test_rows_texts_come_from_their_words(spark):
    """Without texts a scan makes them of the words that it deals by page anyway, so plans hold one exchange of words, and the header's kernel reads what the scan reads."""
    lines = [["Item", "Qty", "Rate"], ["a", "1", "2"], ["b", " ", "n/a"], ["Total", "3"]]
    rows = [(p, 1, r, 3 * r + c, 100.0 * c, 100.0 * c + 30, w) for p in (1, 2) for r, line in enumerate(lines) for c, w in enumerate(line)]
    df = spark.createDataFrame(rows, "job_id int, page_number int, row_id int, word_ord int, x0 double, x1 double, text string")
    bounds = positional.column_bounds(positional.header_anchors(df))
    got, want = (sorted(map(repr, positional.trace(df, texts, bounds).collect())) for texts in (None, layout.row_texts(df)))
    assert got == want and len(got) == 6
    found = positional.trace(df, None, bounds)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    # Words and what their headers give; the second reader of the words takes the first one's exchange.
    assert plan.count("ReusedExchange") == 1 and plan.count("MapInArrow") == 1


def test_a_row_that_names_nothing_is_not_searched():
    class Names(tuple):
        asked = 0

        def __iter__(self):
            return (Word(w) for w in tuple.__iter__(self))

    class Word(str):
        def split(self, *a):
            Names.asked += 1
            return str.split(self, *a)

    columns = {k: Names(v) for k, v in C.COLUMNS.items()}
    assert positional.claim([(0.0, 1.0, "P1"), (2.0, 3.0, "45")], columns)[0] == {} and Names.asked == 0
    assert list(positional.claim([(0.0, 1.0, "Qty")], columns)[0]) == ["quantity"] and Names.asked == 1


def test_sections_are_not_sent_to_all(spark):
    """Texts that rows make are many times what Catalyst takes them for: their sections must not pass through the driver."""
    lines = spark.range(3).selectExpr("id as doc", "explode(array(struct(0 as row_idx, 'Bill To' as text), struct(1 as row_idx, 'x' as text), struct(2 as row_idx, 'Declaration' as text)))").select("doc", "col.*")
    words = lines.selectExpr("doc", "row_idx", "explode(array(0d, 200d)) as x0", "text").selectExpr("doc", "row_idx", "x0", "x0 + 10 as x1", "text")
    pooled = sections.word_pools(words, sections.sections(lines))
    assert sorted((r.doc, r.row_idx, r.x0, r.pool) for r in pooled.collect()) == [(d, i, x, p) for d in range(3) for i in (0, 1) for x, p in ((0.0, "buyer"), (200.0, "general"))]
    assert "Broadcast" not in pooled._jdf.queryExecution().executedPlan().toString()


def test_many_parts_are_not_sent_to_all(spark, monkeypatch):
    from ledgerloom.plans import rendered

    lineitem = spark.createDataFrame([(1, 2, 3, 1, 5.0, 10.0, 0.1, "O", "1998-01-01")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string, l_shipdate string")
    part = spark.range(3).selectExpr("id as p_partkey", "'p' as p_name", "'b' as p_brand", "1d as p_retailprice")
    kinds = []
    for most in (3, 2):
        monkeypatch.setattr(rendered, "SENT_PARTS", most)
        made = rendered.items({"lineitem": lineitem, "part": part})
        assert made.count() == 1
        kinds.append("BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString())
    assert kinds == [True, False]
