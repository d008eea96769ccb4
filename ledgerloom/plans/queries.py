"""Queries over the order tables that apply the library's operators, each with the SQL that says the same in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import config as C
from ..functions import fields as FI
from ..functions import scalars as S
from ..operators import export, grouping, items, layout, sections, splits, tables
from ..operators.positional import assign_columns, column_bounds, header_anchors, scan
from ..operators.positional import items as positional_items_of
from ..sources import files, images
from . import rendered as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(R.tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return keep


_ITEMS = f"items as ({R.ITEMS})"
_PAGES = f"pages as ({R.PAGES})"
_WORDS = f"{_ITEMS}, words as ({R.WORDS})"
_TEXTS = f"texts as (select o_orderkey as doc, o_custkey, {R.ORDER_TEXT} as text from orders)"
_LINES = f"{_TEXTS}, lines as (select doc, unnest(range(len(string_split(text, chr(10)))))::int as row_idx, unnest(string_split(text, chr(10))) as text from texts)"


#: In DuckDB, x without the characters that count as blank at its ends.
_BLANKS = " || ".join(f"chr({ord(c)})" for c in C.BLANKS)


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _lines(t):
    return R.order_texts(t).select("doc", F.posexplode(F.split("text", "\n")).alias("row_idx", "text"))


# Items and quantities.

_DERIVED = """derived as (select *, coalesce(nullif(rate_pts, 0), unit_rate) as divisor,
  case when quantity is not null then round_even(taxable_value / nullif(coalesce(nullif(rate_pts, 0), unit_rate), 0), 0) end as original from items)"""


@query(f"""with {_ITEMS}, {_DERIVED}
select i.job_id as invoice, c_name as buyer_name, s_name as party_name, line_number, item_description, hsn_sac, quantity, unit_rate, taxable_value,
  original as pts_original_quantity, quantity - original as pts_free_quantity, original as quantity_sold, quantity - original as quantity_free
from derived i join orders on o_orderkey = i.job_id join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey""")
def invoice_line_items(t):
    """The flagship: lines of all invoices with buyer, vendor, packs and derived quantities. Dimensions are small and go where Catalyst sends them."""
    done = items.finish(R.items(t))
    o = t["orders"].select(F.col("o_orderkey").alias("job_id"), "o_custkey")
    c = t["customer"].select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("buyer_name"))
    s = t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("party_name"))
    out = done.join(o, "job_id").join(c, "o_custkey").join(s, "l_suppkey")
    return out.select(F.col("job_id").alias("invoice"), "buyer_name", "party_name", "line_number", "item_description", "hsn_sac", "quantity", "unit_rate", "taxable_value", "pts_original_quantity", "pts_free_quantity", "quantity_sold", "quantity_free")


@query(f"""with {_ITEMS}, {_DERIVED} select job_id, line_number, divisor, original, quantity - original as free from derived""")
def derived_quantity(t):
    d = R.items(t).withColumn("divisor", S.effective_divisor(F.col("rate_pts"), F.col("unit_rate")))
    d = d.withColumn("d", S.derived_quantities(F.col("quantity"), F.col("taxable_value"), F.col("divisor")))
    return d.select("job_id", "line_number", "divisor", "d.original", "d.free")


@query(f"""with {_ITEMS}, q as (select job_id, line_number, case when line_number % 4 = 0 then quantity end as quantity, case when line_number % 4 = 1 then quantity end as total,
  case when line_number % 4 = 2 then 3e0 end as sold, case when line_number % 2 = 0 then 2e0 end as free from items)
select job_id, line_number, coalesce(quantity, total, case when sold is not null or free is not null then coalesce(sold, 0) + coalesce(free, 0) end) as effective from q""")
def effective_quantity(t):
    on = lambda k, n, v: F.when(F.col("line_number") % k == n, v)
    q = on(4, 0, F.col("quantity")), on(4, 1, F.col("quantity")), on(4, 2, F.lit(3.0)), on(2, 0, F.lit(2.0))
    return R.items(t).select("job_id", "line_number", S.effective_quantity(*q).alias("effective"))


_CORE = "(quantity is not null or rate_pts is not null or unit_rate is not null or taxable_value is not null)"
_BARE = "case when line_number % 3 = 1 then null else {} end as {}"
_BLANKED = "select job_id, line_number, item_description, " + ", ".join(_BARE.format(c, c) for c in ("quantity", "rate_pts", "unit_rate", "taxable_value")) + " from {}"


@query(f"""with {_ITEMS}, b as ({_BLANKED.format("items")}), c as (select *, {_CORE} as core from b),
n as (select *, lag(core) over w as pc, lag(item_description) over w as pd, lead(core) over w as nc from c window w as (partition by job_id order by line_number))
select job_id, cast(row_number() over (partition by job_id order by line_number) as int) as line_number,
  case when core and pc = false then pd || ' ' || item_description else item_description end as item_description, quantity
from n where not (not core and coalesce(nc, false))""")
def page_split_merge(t):
    b = t["lineitem"].sparkSession.sql(_BLANKED.format("{items}"), items=R.items(t))
    return items.merge_page_splits(b).select("job_id", "line_number", "item_description", "quantity")


_PACKS = """case line_number % 6 when 0 then item_description || ' -15s' when 1 then item_description || ' Pack Size: 1*10 CAPSULE' when 2 then item_description || ' 5ML SALE 1100 L'
  when 3 then 'Multi - Vitamin ' || item_description || ' - 200ml' when 4 then 'Anti-' || item_description else item_description end"""


@query(rf"""with {_ITEMS}, d as (select job_id, line_number, {_PACKS} as d from items)
select job_id, line_number,
  case when regexp_matches(d, '(?i)^(.*?)\s*pack\s*size\s*:\s*(.+)$') then trim(regexp_extract(d, '(?i)^(.*?)\s*pack\s*size\s*:\s*(.+)$', 1)) when regexp_matches(d, '^(.*\S)\s-\s*(\S+)$') then trim(regexp_extract(d, '^(.*\S)\s-\s*(\S+)$', 1)) else d end as description,
  case when regexp_matches(d, '(?i)^(.*?)\s*pack\s*size\s*:\s*(.+)$') then trim(regexp_extract(d, '(?i)^(.*?)\s*pack\s*size\s*:\s*(.+)$', 2)) when regexp_matches(d, '^(.*\S)\s-\s*(\S+)$') then trim(regexp_extract(d, '^(.*\S)\s-\s*(\S+)$', 2)) end as pack,
  case when regexp_matches(d, '^((?:.*\s)?)(\d\S*(?:\s+[^\d\s]\S*)*)$') then trim(regexp_extract(d, '^((?:.*\s)?)(\d\S*(?:\s+[^\d\s]\S*)*)$', 2)) end as number_pack
from d""")
def pack_split(t):
    d = t["lineitem"].sparkSession.sql(f"select job_id, line_number, {_PACKS} as d from {{items}}", items=R.items(t))
    p = d.withColumns({"p": S.resolve_pack(F.col("d"), F.lit(None).cast("string")), "n": S.split_pack_number(F.col("d"))})
    return p.select("job_id", "line_number", "p.description", "p.pack", F.col("n.pack").alias("number_pack"))


_DATES = """case o_orderkey % 9 when 0 then cast(day(o_orderdate) as string) || '/' || cast(month(o_orderdate) as string) || '/' || cast(year(o_orderdate) as string)
  when 1 then cast(month(o_orderdate) as string) || '/' || cast(year(o_orderdate) as string) when 2 then '14 Jul 2026' when 3 then 'August ' || cast(day(o_orderdate) as string) || ', 2026'
  when 4 then 'MAR-' || cast(year(o_orderdate) % 100 + 10 as string) when 5 then ' Q3 2026' when 6 then '13/2027' when 7 then null else '5.3.28' end"""


def _date_sql() -> str:
    months = "case lower(m) " + " ".join(f"when '{k}' then {v}" for k, v in C.MONTHS.items()) + " end"
    y = "case when y < 100 then y + 2000 else y end"
    forms = (
        (r"^(\d{1,2})[\/\-.](\d{1,2})[\/\-.](\d{2,4})$", 1, 2, 3, False), (r"^(\d{1,2})[\s\/\-.]([A-Za-z]{3,9})[\s\/\-.,]+(\d{2,4})$", 1, 2, 3, True),
        (r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{2,4})$", 2, 1, 3, True), (r"^([A-Za-z]{3,9})[\s\/\-.](\d{2,4})$", 0, 1, 2, True), (r"^(\d{1,2})[\/\-.](\d{2,4})$", 0, 1, 2, False),
    )
    parts = []
    for i, (p, d, m, yy, named) in enumerate(forms):
        g = lambda k, p=p: f"regexp_extract(trim(v), '{p}', {k})"
        day, month = "1" if not d else f"try_cast({g(d)} as int)", months.replace("(m)", f"({g(m)})") if named else f"try_cast({g(m)} as int)"
        year = y.replace("y ", f"try_cast({g(yy)} as int) ").replace("else y", f"else try_cast({g(yy)} as int)")
        parts.append(f"case when regexp_matches(trim(v), '{p}') then struct_pack(d := {day}, m := {month}, y := {year}) end as f{i}")
    ok = " ".join(f"when f{i}.d between 1 and 31 and f{i}.m between 1 and 12 then lpad(f{i}.d::varchar, 2, '0') || '-' || lpad(f{i}.m::varchar, 2, '0') || '-' || lpad(f{i}.y::varchar, 4, '0')" for i in range(5))
    return f"with v as (select o_orderkey as doc, {_DATES} as v from orders), f as (select doc, v, {', '.join(parts)} from v) select doc, case {ok} else v end as normalized from f"


@query(_date_sql())
def date_normalize(t):
    return t["orders"].selectExpr("o_orderkey as doc", f"{_DATES} as v").select("doc", S.normalize_date(F.col("v")).alias("normalized"))


_AMOUNTS = """case o_orderkey % 6 when 0 then 'Rs. ' || cast(o_orderkey as string) when 1 then ' -1,' || cast(o_orderkey as string) || '.50' when 2 then '1.2.3' when 3 then chr(9) || '-5' || chr(13) when 4 then chr(10) || chr(160) || '- 7' else cast(o_orderkey as string) || '%' end"""


@query(f"""with v as (select o_orderkey as doc, {_AMOUNTS} as v from orders)
select doc, try_cast(regexp_replace(v, '[^0-9.]', '', 'g') as double) * case when starts_with({_strip('v')}, '-') then -1 else 1 end as amount from v""")
def amount_parse(t):
    return t["orders"].selectExpr("o_orderkey as doc", f"{_AMOUNTS} as v").select("doc", S.parse_amount(F.col("v")).alias("amount"))


_TOTALS = "case when line_number % 5 = 0 then 'Sub-Total ' || hsn_sac when line_number % 7 = 0 then 'TOTAL for ' || hsn_sac when line_number % 11 = 0 then 'Totally new' else item_description end"


@query(rf"""with {_ITEMS} select job_id, line_number, regexp_matches({_TOTALS}, '(?i)^\s*(grand\s*total|sub[\s\-]?total|total)\b') as is_subtotal from items""")
def subtotal_filter(t):
    d = t["lineitem"].sparkSession.sql(f"select job_id, line_number, {_TOTALS} as d from {{items}}", items=R.items(t))
    return d.select("job_id", "line_number", S.is_subtotal(F.col("d")).alias("is_subtotal"))


@query(f"""with {_ITEMS}, s as (select hsn_sac, cast(sum(cast(taxable_value as decimal(18,2))) as double) as items_total from items group by 1),
g as (select hsn_sac, items_total + case when hsn_sac like '%1' then 10 else 0 end as stated_total, items_total from s)
select hsn_sac, stated_total, items_total, round(stated_total - items_total, 2) as difference, abs(stated_total - items_total) <= 0.005 as reconciles from g""")
def subtotal_reconcile(t):
    i = R.items(t)
    stated = i.groupBy("hsn_sac").agg(F.sum(F.col("taxable_value").cast("decimal(18,2)")).cast("double").alias("taxable_value"))
    stated = stated.withColumn("taxable_value", F.col("taxable_value") + F.when(F.col("hsn_sac").like("%1"), 10).otherwise(0))
    return items.reconcile(i, stated, "hsn_sac")


@query(r"""select o_orderkey as doc, trim(regexp_replace('  ' || o_orderpriority || chr(10) || chr(9) || 'x  y ', '\s+', ' ', 'g')) as cell from orders""")
def cell_normalize(t):
    return t["orders"].select(F.col("o_orderkey").alias("doc"), S.normalize_cell(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\n\tx  y "))).alias("cell"))


_ROW = """case line_number % 3 when 0 then '30049' || cast(100 + line_number % 10 as string) || ' batch no: B' || cast(l_suppkey as string) || ' EXP DT : 0' || cast(1 + l_partkey % 9 as string) || '-2028 MFG DT : MAR-25 10.00'
  when 1 then 'page boilerplate' else '10' || lpad(cast(l_partkey as string), 5, '0') || ' MAT' || cast(l_suppkey as string) || ' ' || item_description || ' 0.5% 5 ML ' || cast(line_number as string) || '.00 EA 10.00 8.00 9.50 7.25 12.00% 1,' || lpad(cast(l_partkey % 1000 as string), 3, '0') || '.84' end"""
_I, _DT = items.ITEM_ROW, items.DETAIL_ROW


@query(rf"""with {_ITEMS}, r as (select job_id as doc, line_number as row_idx, {_ROW} as text from items),
m as (select *, regexp_matches(text, '{_I}') as it, sum(regexp_matches(text, '{_I}')::int) over (partition by doc order by row_idx)::int as line_number from r),
d as (select doc, line_number, min(row_idx) filter (not it and regexp_matches(text, '{_DT}')) as dr, min(row_idx) filter (it) as ir from m where line_number > 0 group by 1, 2)
select d.doc, d.line_number, trim(regexp_extract(i.text, '{_I}', 1)) as raw, regexp_extract(i.text, '{_I}', 2)::double as quantity, replace(regexp_extract(i.text, '{_I}', 9), ',', '')::double as line_total,
  nullif(regexp_extract(x.text, '{_DT}', 1), '') as hsn_sac, nullif(regexp_extract(x.text, '{_DT}', 2), '') as batch_number, '01-' || regexp_extract(x.text, '{_DT}', 3) as expiry_date
from d join r i on i.doc = d.doc and i.row_idx = d.ir left join r x on x.doc = d.doc and x.row_idx = d.dr""")
def batch_detail_pairs(t):
    r = t["lineitem"].sparkSession.sql(f"select job_id as doc, line_number as row_idx, {_ROW} as text from {{items}}", items=R.items(t))
    p = items.pair_details(r)
    return p.select("doc", "line_number", F.concat_ws(" ", "item_description", "pack").alias("raw"), "quantity", "line_total", "hsn_sac", "batch_number", "expiry_date")


# Jobs, ranges and invoices.

_GROUPED = """runs as (select *, last_value(invoice_number ignore nulls) over w as g, row_number() over w as rn from fenced window w as (partition by job_id, range_id order by page_number rows between unbounded preceding and current row)),
marks as (select *, case when rn = 1 then 1 when g is not distinct from lag(g) over (partition by job_id, range_id order by page_number) then 0 else 1 end as nw from runs),
agg as (select job_id, range_id, g as invoice_number, list(page_number order by page_number) as source_page_list, coalesce(arg_min(confidence, page_number) filter (invoice_number is not null), 'not_found') as invoice_number_confidence,
  sum(nw) > 1 as is_non_contiguous_merge, bool_or(invoice_number is null) as blank, min(page_number) as first from marks group by 1, 2, 3),
groups as (select job_id, range_id, cast(row_number() over (partition by job_id order by range_id, first) as int) as group_ord, sha256(job_id::varchar || '|' || range_id::varchar || '|' || first::varchar) as group_id,
  invoice_number, invoice_number_confidence, source_page_list, is_non_contiguous_merge, is_non_contiguous_merge or blank or invoice_number_confidence <> 'high' as needs_user_review from agg)"""
_PLAIN = f"with {_PAGES}, fenced as (select *, 0 as range_id from pages), {_GROUPED}"
_RANGES = "array(named_struct('start', 1L, 'end', 4L), named_struct('start', 6L, 'end', 9L), named_struct('start', 10L, 'end', 30L))"


def _groups(t):
    return grouping.group_pages(R.pages(t).withColumn("range_id", F.lit(0)))


@query(f"{_PLAIN} select * from groups")
def group_pages(t):
    return _groups(t)


@query(f"""with {_PAGES}, fenced as (select *, case when job_id % 3 = 0 then 0 when page_number between 1 and 4 then 1 when page_number between 6 and 9 then 2 when page_number between 10 and 30 then 3 end as range_id from pages
  where job_id % 3 = 0 or page_number between 1 and 4 or page_number between 6 and 9 or page_number between 10 and 30), {_GROUPED} select * from groups""")
def group_pages_fenced(t):
    p = R.pages(t)
    ranges = p.select("job_id").distinct().withColumn("ranges", F.expr(f"if(job_id % 3 = 0, slice({_RANGES}, 1, 0), {_RANGES})"))
    return grouping.group_pages(grouping.fence(p, ranges))


@query(f"{_PLAIN} select job_id, case when bool_or(needs_user_review) then 'review_required' else 'ready_to_export' end as status, count(*) as n_groups from groups group by 1")
def job_status(t):
    return grouping.job_status(R.pages(t).select("job_id").distinct(), _groups(t))


@query(f"{_PLAIN}, jobs as (select distinct user_id as job_id, 'u' || (user_id % 4)::varchar as user_id from events) select j.job_id, j.user_id, count(g.group_id) as n_groups from jobs j left join groups g on g.job_id = j.job_id where j.user_id = 'u1' group by 1, 2")
def job_history(t):
    jobs = R.pages(t).select("job_id").distinct().withColumn("user_id", F.concat(F.lit("u"), (F.col("job_id") % 4).cast("string")))
    return grouping.list_jobs(jobs, _groups(t), "u1")


@query(f"{_PLAIN} select job_id, group_ord, group_id, source_page_list from groups where invoice_number = 'click' qualify row_number() over (partition by job_id order by group_ord) = 1")
def find_first_group(t):
    return grouping.find_group(_groups(t), "click").select("job_id", "group_ord", "group_id", "source_page_list")


@query("select user_id as job_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1")
def latest_jobs(t):
    rows = t["events"].select(F.col("user_id").alias("job_id"), "event_id", "event_type", "value")
    return grouping.latest(rows.withColumn("v", F.col("event_id")), "job_id", "v").drop("v")


_SPLIT = """case o_orderkey % 9 when 0 then null when 1 then concat(' ', chr(9), chr(10)) when 2 then '5' when 3 then '1-5' when 4 then '7-9, 1-3, 4-6' when 5 then '5-1' when 6 then '1-20' when 7 then '1-5, 4-8' else '2, abc' end"""


def _splits(t):
    jobs = t["orders"].selectExpr("o_orderkey as job_id", f"{_SPLIT} as split_value_raw", "10 as page_count", "o_orderkey % 2 = 0 as confirmed_no_split")
    return splits.parse_splits(jobs)


_TOK = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"
_SPLITS = rf"""with j as (select o_orderkey as job_id, {_SPLIT} as raw, o_orderkey % 2 = 0 as ok from orders),
k as (select job_id, unnest(list_filter(string_split(raw, ','), lambda x: {_strip('x')} <> '')) as tok, unnest(range(len(list_filter(string_split(raw, ','), lambda x: {_strip('x')} <> '')))) as i from j where {_strip("coalesce(raw, '')")} <> ''),
p as (select job_id, i, regexp_matches(tok, '{_TOK}') as fine, try_cast(regexp_extract(tok, '{_TOK}', 1) as bigint) as s, try_cast(coalesce(nullif(regexp_extract(tok, '{_TOK}', 2), ''), regexp_extract(tok, '{_TOK}', 1)) as bigint) as e from k),
b as (select *, case when not fine then 'syntax' when s > e then 'reversed' when s < 1 or e > 10 then 'bounds' end as bad, lead(s) over (partition by job_id order by s, e) as ns from p),
x as (select job_id, coalesce(arg_min(bad, i) filter (bad is not null), case when bool_or(ns is not null and e >= ns) then 'overlap' end) as err from b group by 1)"""


@query(f"{_SPLITS} select p.job_id, s as range_start, e as range_end from p join x on x.job_id = p.job_id where err is null")
def split_parse(t):
    return _splits(t).select("job_id", F.explode("ranges").alias("r")).select("job_id", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


@query(f"{_SPLITS} select j.job_id, x.err as split_error, coalesce(raw, '') = '' and not ok as conflict from j left join x on x.job_id = j.job_id")
def split_errors(t):
    return splits.needs_confirmation(_splits(t)).select("job_id", "split_error", "conflict")


@query(f"{_SPLITS} select distinct j.job_id, unnest(case when y.job_id is null then range(1, 11) else range(y.s, y.e + 1) end) as page_number from j left join x on x.job_id = j.job_id left join p y on y.job_id = j.job_id where x.err is null")
def pages_in_scope(t):
    return splits.pages_in_scope(_splits(t).filter("split_error is null"))


# Files and text layers.

_BLOB = """case o_orderkey % 6 when 0 then '%PDF-1.7 ' || cast(o_orderkey as string) when 1 then '' when 2 then 'plain text' when 3 then 'RIFF1234WEBPx' when 4 then '%PDF-' || repeat('y', 200) else 'RIFFxxxxWAVE' end"""


@query(f"""with b as (select o_orderkey as job_id, {_BLOB} as s from orders)
select job_id, case when s = '' then 'empty' when length(s) > 100 then 'too_large' when not (starts_with(s, '%PDF-') or (starts_with(s, 'RIFF') and s[9:12] = 'WEBP')) then 'unknown_type' end as error,
  case when s = '' or length(s) > 100 then null when starts_with(s, '%PDF-') then 'pdf' when starts_with(s, 'RIFF') and s[9:12] = 'WEBP' then 'webp' end as file_type from b""")
def file_sniff(t):
    b = t["orders"].selectExpr("o_orderkey as job_id", f"encode({_BLOB}, 'UTF-8') as content")
    return files.sniff(b, max_bytes=100).select("job_id", "error", "file_type")


#: Texts of documents, some of them blanks and a few letters only.
_LAYER = "case when doc_id % 7 = 0 then chr(10) || chr(9) || left(text, 12) || repeat(chr(10), 30) || chr(160) else text end"


@query("select doc_id, coalesce(length(" + _strip(_LAYER) + ") >= 20, false) as has_text_layer from documents")
def text_layer_flag(t):
    return t["documents"].select("doc_id", files.has_text_layer(F.expr(_LAYER)).alias("has_text_layer"))


@query(f"with {_WORDS}, c as (select *, case word_ord % 5 when 0 then '-1' when 1 then '96.5' when 2 then 'n/a' when 3 then null else '0' end as conf from words) select job_id, word_ord from c where not coalesce(try_cast(conf as double) < 0, false)")
def ocr_words(t):
    w = R.words(t).withColumn("conf", F.expr("case word_ord % 5 when 0 then '-1' when 1 then '96.5' when 2 then 'n/a' when 3 then null else '0' end"))
    return layout.usable_words(w).select("job_id", "word_ord")


@query("""with s as (select l_orderkey % 500 as page, case when l_partkey % 7 = 0 then 40.0 else cast((l_orderkey % 500) % 20 as double) - 10 + (l_suppkey % 3) * 0.25 end as angle from lineitem),
m as (select page, median(angle) filter (abs(angle) <= 15) as m, count(*) filter (abs(angle) <= 15) as n from s group by 1) select page, case when n >= 8 and abs(m) between 0.5 and 15 then m else 0 end as angle from m""")
def deskew_angle(t):
    s = t["lineitem"].selectExpr("l_orderkey % 500 as page", "case when l_partkey % 7 = 0 then 40d else cast((l_orderkey % 500) % 20 as double) - 10 + (l_suppkey % 3) * 0.25d end as angle")
    return images.deskew_angle(s)


@query("""with i as (select o_orderkey as page, cast(500 + o_orderkey % 3000 as double) as width, case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 400 as double) end as dpi from orders),
d as (select page, coalesce(case when dpi > 0 then dpi end, width / 8.5) as own from i) select page, case when own < 300 then least(300 / own, 3.0) else 1.0 end as factor from d""")
def upscale_factor(t):
    i = t["orders"].selectExpr("o_orderkey as page", "cast(500 + o_orderkey % 3000 as double) as width", "case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 400 as double) end as dpi")
    return i.select("page", images.upscale_factor(F.col("width"), F.col("dpi")).alias("factor"))


_OCR = "case when page_id % 3 = 0 then chr(10) || repeat(chr(9), 40) else 'page with a text layer ' || cast(page_id as string) end"


@query(f"""with p as (select o_orderkey as page_id from orders), r as (select page_id, {_OCR} as text from p)
select page_id, case when page_id % 3 = 0 then 'read ' || cast(page_id as varchar) else text end as text, case when page_id % 3 = 0 then 'ocr' else 'native_pdf_text_layer' end as source, page_id % 3 <> 0 as has_text_layer from r""")
def page_sources(t):
    """Pages with a text layer as they are, the others as the reader of images gives them."""
    raw = t["orders"].select(F.col("o_orderkey").alias("page_id")).withColumn("text", F.expr(_OCR))
    return files.page_sources(raw, lambda bare: bare.withColumn("text", F.concat(F.lit("read "), F.col("page_id").cast("string"))))


@query("""with j as (select user_id as job_id, count(*) as page_count from events group by 1) select job_id, page_count, page_count > 150 as refused from j""")
def page_limit(t):
    fine, over = files.limit_pages(t["events"].groupBy(F.col("user_id").alias("job_id")).agg(F.count(F.lit(1)).alias("page_count")))
    return fine.withColumn("refused", F.lit(False)).unionByName(over.withColumn("refused", F.lit(True)))


@query(f"""with {_WORDS}, r as (select *, job_id % 5 * 90 as rot from words), b as (select job_id, word_ord,
  case rot % 360 when 90 then 800 - y0 when 180 then 600 - x0 when 270 then y0 else x0 end as a0, case rot % 360 when 90 then 800 - y1 when 180 then 600 - x1 when 270 then y1 else x1 end as a1,
  case rot % 360 when 90 then x0 when 180 then 800 - y0 when 270 then 600 - x0 else y0 end as b0, case rot % 360 when 90 then x1 when 180 then 800 - y1 when 270 then 600 - x1 else y1 end as b1 from r)
select job_id, word_ord, least(a0, a1) as x0, least(b0, b1) as y0, greatest(a0, a1) as x1, greatest(b0, b1) as y1 from b""")
def rotated_words(t):
    w = R.words(t).withColumns({"rotation": (F.col("job_id") % 5 * 90).cast("int"), "page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    return files.rotate_boxes(w).select("job_id", "word_ord", "x0", "y0", "x1", "y1")


# Header fields.


def _group(label: str, value: str) -> str:
    return rf"regexp_extract(text, '(?i)(?:{label})[ \t]*[:\-#]?[ \t]*({value})', 1)"


def _labeled_sql(f: str) -> str:
    v = C.SHAPES[C.SHAPE_OF[f]]
    return "coalesce(" + ", ".join(rf"nullif({_strip(f"trim({_strip(_group(x, v))}, ':')")}, '')" for x in C.LABELS[f]) + ")"


def _value_sql(f: str) -> str:
    if f == "party_name":
        vendor = f"regexp_extract(text, '(?im){C.VENDOR_LINE}', 1)"
        return f"nullif({_strip(vendor)}, '')"
    v = _labeled_sql(f)
    if f == "invoice_number":
        return f"coalesce({v}, nullif(regexp_extract(text, '(?i){C.NEXT_LINE_NUMBER}', 1), ''))"
    return f"case when not starts_with({_strip(v)}, '/') then {v} end" if f == "buyer_name" else v


def _grade_sql(f: str) -> str:
    if f == "buyer_address":
        band = "'review'"
    elif f == "invoice_number":
        band = f"case when regexp_full_match(_{f}, '{C.SHAPES['irn']}') then 'high' else 'review' end"
    elif f in ("invoice_date", "eway_bill_date"):
        band = rf"case when regexp_matches(_{f}, '^\d{{1,4}}[\/\-\.]\d{{1,2}}[\/\-\.]\d{{2,4}}$|^[A-Za-z]{{3,9}}\s+\d{{1,2}},?\s+\d{{2,4}}$') then 'high' else 'review' end"
    elif f == "party_gstin":
        band = f"case when length(_{f}) = 15 then 'high' else 'review' end"
    else:
        band = "'high'"
    return f"case when _{f} is null then 'not_found' else {band} end"


def _amount_sql(f: str) -> str:
    return f"try_cast(regexp_replace(_{f}, '[^0-9.]', '', 'g') as double) * case when starts_with({_strip(f'_{f}')}, '-') then -1 else 1 end"


_FOUND = f"with {_TEXTS}, found as (select doc, text, case when doc % 2 = 0 then 'ocr' else 'native_pdf_text_layer' end as source, {', '.join(f'{_value_sql(f)} as _{f}' for f in C.HEADER_FIELDS)} from texts)"


def _headers(t):
    docs = R.order_texts(t).withColumn("source", F.when(F.col("doc") % 2 == 0, "ocr").otherwise("native_pdf_text_layer"))
    return FI.header_fields(docs, source="source")


@query(f"{_FOUND} select doc, {', '.join((_amount_sql(f) if f in C.AMOUNTS else f'_{f}') + f' as {f}' for f in C.HEADER_FIELDS)} from found")
def header_fields(t):
    return _headers(t).select("doc", *C.HEADER_FIELDS)


def _capped_sql(f: str) -> str:
    g = _grade_sql(f)
    low = f"when not coalesce(regexp_full_match(_{f}, '{C.SHAPES['irn']}'), false) then 'low'" if f == "invoice_number" else ""
    return f"case when source <> 'ocr' or _{f} is null then {g} {low} when {g} = 'high' then 'review' else {g} end as {f}_confidence"


@query(f"{_FOUND} select doc, {', '.join(map(_capped_sql, C.HEADER_FIELDS))} from found")
def header_confidence(t):
    return _headers(t).select("doc", *[f"{f}_confidence" for f in C.HEADER_FIELDS])


@query(f"{_FOUND} select doc, _invoice_number as invoice_number, {_capped_sql('invoice_number').replace('invoice_number_confidence', 'confidence')}, length({_strip("text")}) >= 20 as has_text_layer from found")
def page_numbers(t):
    docs = R.order_texts(t).withColumn("source", F.when(F.col("doc") % 2 == 0, "ocr").otherwise("native_pdf_text_layer"))
    return FI.page_numbers(docs).select("doc", "invoice_number", "confidence", "has_text_layer")


@query("""select o_orderkey as page, o_custkey as "group", case when o_orderkey % 5 = 0 then 'ocr' else 'native' end as source, bool_or(o_orderkey % 5 = 0) over (partition by o_custkey) as tainted from orders""")
def group_ocr_taint(t):
    p = t["orders"].selectExpr("o_orderkey as page", "o_custkey as group", "case when o_orderkey % 5 = 0 then 'ocr' else 'native' end as source")
    return sections.group_is_ocr(p)


# Sections.


def _any_sql(col: str, patterns) -> str:
    return f"regexp_matches({col}, '(?i)" + "|".join(f"(?:{p})" for p in patterns) + "')"


_SECTIONS = f"""{_LINES}, k as (select doc, row_idx, text, case when {_any_sql("text", C.SECTIONS["buyer"])} then 'buyer' when {_any_sql("text", C.SECTIONS["exclude"])} then 'exclude' end as kind, max(row_idx) over (partition by doc) + 1 as n from lines),
m as (select doc, kind, row_idx as row_start, coalesce(lead(row_idx) over (partition by doc order by row_idx), n) as nxt from k where kind is not null),
c as (select doc, kind, row_start, case when kind = 'buyer' then least(nxt, row_start + 10) else nxt end as cap from m),
st as (select doc, row_idx from lines where {_any_sql("text", C.SECTION_STOPS["buyer"])}),
sections as (select c.doc, c.kind, c.row_start, greatest(coalesce(min(st.row_idx), cap), row_start + 1)::int as row_end from c left join st on st.doc = c.doc and c.kind = 'buyer' and st.row_idx > c.row_start and st.row_idx < c.cap group by c.doc, c.kind, c.row_start, c.cap)"""


@query(f"with {_SECTIONS} select * from sections", name="sections")
def section_extents(t):
    return sections.sections(_lines(t))


@query(f"""with {_SECTIONS} select l.doc, l.row_idx, l.text, case when bool_or(s.kind = 'exclude') then 'exclude' when bool_or(s.kind = 'buyer') then 'buyer' end as section
from lines l left join sections s on s.doc = l.doc and l.row_idx >= s.row_start and l.row_idx < s.row_end group by 1, 2, 3""")
def section_rows(t):
    lines = _lines(t)
    return sections.row_kinds(lines, sections.sections(lines))


_TOKENS = f"{_LINES}, words as (select doc, row_idx, (unnest(range(len(string_split(text, ' ')))) * 60)::double as x0, (unnest(range(len(string_split(text, ' ')))) * 60 + case when row_idx % 2 = 0 then 50 else 5 end)::double as x1, unnest(string_split(text, ' ')) as text from lines)"


def _tokens(t):
    w = _lines(t).select("doc", "row_idx", F.posexplode(F.split("text", " ")).alias("i", "text"))
    return w.select("doc", "row_idx", (F.col("i") * 60).cast("double").alias("x0"), (F.col("i") * 60 + F.when(F.col("row_idx") % 2 == 0, 50).otherwise(5)).cast("double").alias("x1"), "text")


@query(f"""with {_SECTIONS.replace(_LINES, _TOKENS)}, seg as (select *, sum(case when x0 - px > 50 then 1 else 0 end) over (partition by doc, row_idx order by x0) as sg from (select *, lag(x1) over (partition by doc, row_idx order by x0) as px from words)),
cut as (select doc, row_idx, min(x0) as cutoff from seg where sg = 1 group by 1, 2)
select w.doc, w.row_idx, w.x0, case when b.doc is not null and w.x0 < coalesce(cut.cutoff, 'infinity'::double) then 'buyer' else 'general' end as pool
from words w left join sections b on b.doc = w.doc and b.kind = 'buyer' and w.row_idx >= b.row_start and w.row_idx < b.row_end left join cut on cut.doc = b.doc and cut.row_idx = b.row_start
where not exists (select 1 from sections e where e.doc = w.doc and e.kind = 'exclude' and w.row_idx >= e.row_start and w.row_idx < e.row_end)""")
def section_pools(t):
    return sections.word_pools(_tokens(t), sections.sections(_lines(t))).select("doc", "row_idx", "x0", "pool")


_CLEAN = _strip(f"trim({_strip('w.text')}, ':-')")
_NEAR = """lab as (select doc, min(row_idx) as label_row from lines where {label} group by 1),
cand as (select w.doc, {strip} as v, w.x0, w.row_idx - l.label_row as away from words w join lab l on l.doc = w.doc where abs(w.row_idx - l.label_row) between 1 and 3),
hit as (select doc, v, row_number() over (partition by doc order by (away < 0), abs(away), x0) as n from cand where regexp_full_match(v, '{shape}'))"""


@query(f"with {_TOKENS}, {_NEAR.format(strip=_CLEAN, label=_any_sql('text', C.LABELS['ack_number']), shape=C.SHAPES['code'])} select lab.doc, hit.v as value, label_row from lab left join hit on hit.doc = lab.doc and n = 1")
def value_near_label(t):
    return sections.value_near_label(_tokens(t), C.LABELS["ack_number"], C.SHAPES["code"])


@query(f"""with {_TOKENS}, lab as (select doc, min(row_idx) as label_row from lines where {_any_sql("text", C.LABELS["invoice_number"])} group by 1),
cand as (select w.doc, {_CLEAN} as v, w.x0, w.row_idx - l.label_row as away from words w join lab l on l.doc = w.doc where abs(w.row_idx - l.label_row) between 1 and 3),
e as (select doc, v, row_number() over (partition by doc order by (away < 0), abs(away), x0) as n from cand where regexp_full_match(v, '{C.SHAPES["irn"]}')),
g as (select doc, v, row_number() over (partition by doc order by (away < 0), abs(away), x0) as n from cand where regexp_full_match(v, '{C.SHAPES["number"]}') and regexp_matches(v, '[0-9]'))
select lab.doc, coalesce(e.v, g.v) as value, case when e.v is not null then 'review' when g.v is not null then 'low' else 'not_found' end as confidence
from lab left join e on e.doc = lab.doc and e.n = 1 left join g on g.doc = lab.doc and g.n = 1""")
def number_near_label(t):
    return sections.number_near_label(_tokens(t))


def _fallback_sql() -> str:
    """Candidates of each field as a list in order; then the fields in turn, each with the first that none before has taken."""
    texts = [f for f in C.HEADER_FIELDS if f not in C.AMOUNTS]
    out = [f"found as (select doc, text, case when doc % 2 = 0 then 'ocr' else 'native_pdf_text_layer' end as source, {', '.join(f'{_value_sql(f)} as _{f}' for f in C.HEADER_FIELDS)} from texts)"]
    out.append(f"s0 as (select doc, source, {', '.join(f'_{f}' for f in texts)}, list_filter([{', '.join(f'_{f}' for f in texts)}], lambda x: x is not null) as held from found)")
    for i, f in enumerate(C.FALLBACK_FIELDS):
        out.append(f"l{i} as (select doc, min(row_idx) as label_row from lines where {_any_sql('text', C.LABELS[f])} group by 1)")
        out.append(f"c{i} as (select w.doc, {_CLEAN} as v, w.x0, w.row_idx - l.label_row as away from words w join l{i} l on l.doc = w.doc where abs(w.row_idx - l.label_row) between 1 and 3)")
        out.append(f"k{i} as (select doc, list(v order by (away < 0), abs(away), x0) as vs from c{i} where regexp_full_match(v, '{C.SHAPES[C.SHAPE_OF[f]]}') group by 1)")
        out.append(f"n{i} as (select s{i}.*, case when _{f} is null then list_filter(vs, lambda v: not list_contains(held, v))[1] end as new_{f} from s{i} left join k{i} on k{i}.doc = s{i}.doc)")
        out.append(f"s{i + 1} as (select * replace (case when new_{f} is null then held else list_append(held, new_{f}) end as held) from n{i})")
    last = ", ".join(f"coalesce(_{f}, new_{f}) as {f}, case when new_{f} is not null then 'review' else g.{f}_confidence end as {f}_confidence" for f in C.FALLBACK_FIELDS)
    graded = f"g as (select doc, {', '.join(_capped_sql(f) for f in C.FALLBACK_FIELDS)} from found)"
    return f"with {_TOKENS}, {', '.join(out)}, {graded} select z.doc, {last} from s{len(C.FALLBACK_FIELDS)} z join g on g.doc = z.doc"


@query(_fallback_sql())
def field_fallback(t):
    """Fields filled from near their labels, in turn; a value one takes is gone for the next."""
    return sections.fill_near_labels(_headers(t), _tokens(t)).select("doc", *[c for f in C.FALLBACK_FIELDS for c in (f, f"{f}_confidence")])


# Layout.

_ROWS = f"""with recursive {_WORDS}, o as (select *, row_number() over (partition by job_id order by y0, x0, word_ord) as n, greatest(y1 - y0, 1) as h from words),
f as (select job_id, word_ord, n, 0 as row_id, 1 as c, y0 as s, h from o where n = 1
  union all select o.job_id, o.word_ord, o.n, case when abs(o.y0 - f.s / f.c) <= 0.6 * greatest(f.h, o.h) then f.row_id else f.row_id + 1 end, case when abs(o.y0 - f.s / f.c) <= 0.6 * greatest(f.h, o.h) then f.c + 1 else 1 end,
    case when abs(o.y0 - f.s / f.c) <= 0.6 * greatest(f.h, o.h) then f.s + o.y0 else o.y0 end, o.h from f join o on o.job_id = f.job_id and o.n = f.n + 1),
rows as (select w.*, f.row_id from f join words w on w.job_id = f.job_id and w.word_ord = f.word_ord)"""


@query(f"{_ROWS} select job_id, word_ord, row_id from rows")
def row_clusters(t):
    return layout.cluster_rows(R.words(t)).select("job_id", "word_ord", "row_id")


@query(f"{_ROWS}, l as (select job_id, row_id, string_agg(text, ' ' order by x0, word_ord) as text from rows group by 1, 2) select job_id, string_agg(text, chr(10) order by row_id) as text from l group by 1")
def page_text(t):
    return layout.page_texts(layout.row_texts(layout.cluster_rows(R.words(t)))).select("job_id", "text")


_SEG = "{rows}, g as (select *, case when x0 - lag(x1) over w > {limit} then 1 else 0 end as nw from rows window w as (partition by job_id, row_id order by x0, word_ord)) select job_id, word_ord, (sum(nw) over (partition by job_id, row_id order by x0, word_ord))::int as segment from g"


@query(_SEG.format(rows=_ROWS, limit="50"))
def column_segments(t):
    return layout.segments(layout.cluster_rows(R.words(t))).select("job_id", "word_ord", "segment")


@query(_SEG.format(rows=_ROWS, limit="6 * greatest(greatest(y1 - y0, 1), lag(greatest(y1 - y0, 1)) over w)"))
def ocr_segments(t):
    return layout.segments(layout.cluster_rows(R.words(t)), gap=None).select("job_id", "word_ord", "segment")


@query(f"{_SEG.format(rows=_ROWS, limit='50').replace(' select job_id, word_ord, (sum', ', s as (select *, (sum')} ), l as (select job_id, row_id, segment, string_agg(text, ' ' order by x0, word_ord) as text from s group by 1, 2, 3) select job_id, string_agg(text, chr(10) order by row_id, segment) as text from l group by 1")
def segmented_text(t):
    return layout.segment_texts(layout.segments(layout.cluster_rows(R.words(t)))).select("job_id", "text")


@query(f"{_SEG.format(rows=_ROWS, limit='50').replace(' select job_id, word_ord, (sum', ', s as (select *, (sum')} ) select job_id, word_ord from s where segment = 0")
def leftmost_segment(t):
    return layout.leftmost(layout.segments(layout.cluster_rows(R.words(t)))).select("job_id", "word_ord")


@query(f"with {_WORDS} select job_id, word_ord, greatest(y1 - y0, 1) as height, (x0 + x1) / 2 as x_center from words")
def word_geometry(t):
    return layout.geometry(R.words(t)).select("job_id", "word_ord", "height", "x_center")


# Tables.

_ANCHORS = """select o_orderkey as job_id, 1 as page_number, 0 as header_row, 1 as data_row, f.field, cast(f.x + o_orderkey % 7 as double) as x0, cast(f.x + o_orderkey % 7 + 20 as double) as x1, f.field as header_text
  from {orders} cross join (select 'item_description' as field, 60 as x union all select 'quantity', 160 union all select null, 230 union all select 'unit_rate', 300 union all select 'line_total', 400) f"""
_CELLS = """select o_orderkey as job_id, 1 as page_number, cast(1 + k.k % 2 as int) as row_id, cast(k.k as int) as word_ord, 'w' || cast(k.k as string) as text, cast((k.k * 61 + o_orderkey * 7) % 460 as double) as x0, cast((k.k * 61 + o_orderkey * 7) % 460 + 15 as double) as x1
  from {orders} cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7) k"""
_BOUNDS = f"""a as ({_ANCHORS.replace("{orders}", "orders")}), e as (select *, case when field = 'item_description' then '-infinity'::double else coalesce((lag(x1) over w + x0) / 2, '-infinity'::double) end as "left", coalesce((x1 + lead(x0) over w) / 2, 'infinity'::double) as "right" from a window w as (partition by job_id order by x0)),
bounds as (select *, (row_number() over (partition by job_id order by x0) - 1)::int as bound_idx from e where field is not null)"""


def _anchors(t):
    return t["orders"].sparkSession.sql(_ANCHORS, orders=t["orders"])


@query(f'with {_BOUNDS} select job_id, field, bound_idx, "left", "right" from bounds')
def column_bounds_query(t):
    return column_bounds(_anchors(t)).select("job_id", "field", "bound_idx", "left", "right")


@query(f"""with {_BOUNDS}, w as ({_CELLS.replace("{orders}", "orders")}), h as (select w.*, (select b.field from bounds b where b.job_id = w.job_id and b."left" <= (w.x0 + w.x1) / 2 and (w.x0 + w.x1) / 2 < b."right" order by bound_idx limit 1) as field from w)
select job_id, row_id, field, string_agg(text, ' ' order by x0, word_ord) as raw from h where field is not null group by 1, 2, 3""")
def assign_columns_query(t):
    w = t["orders"].sparkSession.sql(_CELLS, orders=t["orders"])
    return assign_columns(w, column_bounds(_anchors(t))).select("job_id", "row_id", "field", "raw")


_HEAD_WORDS = """select o_orderkey as job_id, 1 as page_number, w.r as row_id, w.o as word_ord, cast(w.x + o_orderkey % 5 as double) as x0, cast(w.x + o_orderkey % 5 + 30 as double) as x1, w.t as text
  from {} cross join (select 0 as r, 0 as o, 10 as x, 'Company' as t union all select 1, 1, 50, 'Item' union all select 1, 2, 230, 'HSN' union all select 1, 3, 300, 'CGST' union all select 1, 4, 350, 'OLD' union all select 1, 5, 410, 'SALE'
    union all select 2, 6, 302, '%' union all select 2, 7, 352, 'MRP' union all select 2, 8, 412, 'QTY' union all select 2, 9, 470, 'Total' union all select 3, 10, 50, 'Soap') w"""


@query("""select o_orderkey as job_id, 1 as header_row, 3 as data_row, u.field, cast(u.a + o_orderkey % 5 as double) as x0, cast(u.b + o_orderkey % 5 as double) as x1, u.h as header_text from orders cross join
(values ('item_description', 50, 80, 'Item'), ('hsn_sac', 230, 260, 'HSN'), ('cgst_rate', 300, 332, 'CGST %'), ('mrp_old', 350, 382, 'OLD MRP'), ('quantity', 410, 442, 'SALE QTY'), ('line_total', 470, 500, 'Total')) u(field, a, b, h)""")
def positional_header(t):
    """Columns claimed by the words of a header of two lines."""
    w = t["orders"].sparkSession.sql(_HEAD_WORDS.format("{orders}"), orders=t["orders"])
    return header_anchors(w).select("job_id", "header_row", "data_row", "field", "x0", "x1", "header_text")


_RATE_WORDS = """select o_orderkey as job_id, 1 as page_number, w.r as row_id, w.o as word_ord, cast(w.x + o_orderkey % 5 as double) as x0, cast(w.z + o_orderkey % 5 as double) as x1, w.t as text
  from {} cross join (values (0, 0, 50, 90, 'Item'), (0, 1, 200, 220, 'Qty'), (0, 2, 300, 330, 'CGST'), (0, 3, 400, 430, 'SGST'), (0, 4, 500, 530, 'Total'), (1, 5, 280, 295, 'Rate'), (1, 6, 305, 325, 'Amount'), (1, 7, 438, 452, 'Rate'), (1, 8, 405, 428, 'Amount'), (1, 10, 202, 218, 'Free'), (2, 9, 50, 60, 'Pen')) w(r, o, x, z, t)
  where not (o_orderkey % 3 = 0 and w.o = 7)"""


@query("""select o_orderkey as job_id, u.field, cast(u.a + o_orderkey % 5 as double) as x0, cast(u.b + o_orderkey % 5 as double) as x1, u.h as header_text from orders cross join
(values ('item_description', 50, 90, 'Item'), ('quantity_free', 200, 220, 'Qty Free'), ('cgst_amount', 300, 330, 'CGST Amount'), ('sgst_amount', 400, 430, 'SGST Amount'), ('line_total', 500, 530, 'Total'), ('cgst_rate', 280, 295, 'Rate'), ('unit_rate', 280, 295, 'Rate'), ('sgst_rate', 438, 452, 'Rate')) u(field, a, b, h) where not (o_orderkey % 3 = 0 and field = 'sgst_rate')""")
def positional_rates(t):
    """Rates without a name below a header go to the nearest tax that has an amount and no rate yet."""
    w = t["orders"].sparkSession.sql(_RATE_WORDS.format("{orders}"), orders=t["orders"])
    return header_anchors(w).select("job_id", "field", "x0", "x1", "header_text")


_PLAIN_TABLE = """select job_id, 1 as page_number, cast(line_number as int) as row_id, w.o as word_ord, w.x as x0, w.x + 5e0 * length(w.t) as x1, w.t as text from
  (select job_id, line_number, 'P' || cast(l_partkey as string) as d, case when l_partkey % 7 = 0 then '' else cast(l_suppkey % 50 as string) end as q, case when l_partkey % 7 = 0 then '' when l_partkey % 11 = 0 then 'n/a' else cast(l_suppkey % 9 as string) || '.50' end as r from {}) i
  cross join lateral (select 0 as o, 50e0 as x, d as t union all select 1, 300e0, q union all select 2, 410e0, r union all select 3, 500e0, case when q = '' then '' else '7' end) w where w.t <> ''
  union all select distinct job_id, 1, 0, w.o, w.x, w.x + 30, w.t from {} cross join (select 0 as o, 50e0 as x, 'Item' as t union all select 1, 300e0, 'Qty' union all select 2, 410e0, 'Rate' union all select 3, 500e0, 'Total') w"""


@query(f"""with {_ITEMS}, r as (select job_id, line_number, l_partkey % 7 = 0 as label, 'P' || l_partkey::varchar as d, (l_suppkey % 50)::double as q, case when l_partkey % 11 <> 0 then (l_suppkey % 9)::double + 0.5 end as u from items)
select job_id, row_number() over (partition by job_id order by line_number)::int as line_number, line_number as row_id, d as item_description, q as quantity, u as unit_rate, 7.0::double as line_total, 'low' as base_confidence, case when u is null then 'not_found' else 'low' end as rate_grade from r where not label""")
def positional_items(t):
    """Items of pages without ruled tables; rows of a description alone are none, and a header of few columns grades all low."""
    i = R.items(t)
    words = t["lineitem"].sparkSession.sql(_PLAIN_TABLE.format("{items}", "{items}"), items=i)
    made = positional_items_of(words)
    return made.select("job_id", "line_number", "row_id", "item_description", "quantity", "unit_rate", "line_total", "base_confidence", F.element_at("field_confidences", "unit_rate").alias("rate_grade"))


_SCAN = "select job_id, line_number as row_id, (l_partkey * 7 + l_suppkey) % 23 = 0 as hard_stop, (l_partkey + l_suppkey) % 4 = 0 as unmatched, (l_partkey + l_suppkey) % 4 > 1 as is_item from {}"


@query(f"""with {_ITEMS}, r as ({_SCAN.format("items")}), s as (select *, sum(case when hard_stop or (unmatched and coalesce(pu, false)) then 1 else 0 end) over (partition by job_id order by row_id) as st from (select *, lag(unmatched) over (partition by job_id order by row_id) as pu from r)),
k as (select *, (sum(is_item::int) over (partition by job_id order by row_id))::int as line_number from s where st = 0) select job_id, row_id, line_number from k where is_item and line_number <= 300""")
def positional_scan(t):
    r = t["lineitem"].sparkSession.sql(_SCAN.format("{items}"), items=R.items(t))
    return scan(r, key=("job_id",)).select("job_id", "row_id", "line_number")


_HEADS: tuple[tuple[str | None, ...], ...] = (
    ("Sr No", "Product Description", "HSN", "Qty", "Rate", "CGST %", "CGST Amt", "\tNet Amount\n"), ("Item", "Old Mrp", "New Mrp", "Ptr", "Pts", "Disc %", "Disc Amt", "Value"), ("Amount", "Net Amount", "Taxable Value", "Transaction", "", None, "Batch", "Exp Date"),
    ("Mfg Date/\nExp Date", "Material/\nHSN", "Amount/\nCGST%", "Disc/\nDisc %", "Wrapped\nname", "Name of\nProduct", "Qty", "Total"), ("Amount/\n SGST rate", " \nx", "Mfg Name\n\tBatch no", "Total Qty", "amount", "Free", "Sold", "Product"),
)


def _cell(c: str | None) -> str:
    return "null" if c is None else " || ".join(["''", *(f"chr({ord(p)})" if p in "\n\t" else f"'{p}'" for p in re.split("([\n\t])", c) if p)])


#: Headers of orders: one of those above, begun at another of its cells.
_TURNED = "with d as (select o_orderkey as job_id, {} as h0, cast(o_orderkey % 7 as int) as r from {}) select job_id, {} as h from d"
_HEADERS_DUCK = _TURNED.format(f"[{', '.join('[' + ', '.join(map(_cell, h)) + ']' for h in _HEADS)}][o_orderkey % 5 + 1]", "orders", "list_concat(h0[r + 1:], h0[:r])")
_HEADERS_SPARK = _TURNED.format(f"array({', '.join('array(' + ', '.join(map(_cell, h)) + ')' for h in _HEADS)})[cast(o_orderkey % 5 as int)]", "{orders}", "concat(slice(h0, r + 1, 8), slice(h0, 1, r))")


def _headers_of(t):
    return t["orders"].sparkSession.sql(_HEADERS_SPARK, orders=t["orders"])


def _map_sql() -> str:
    """A fold over the cells of each distinct header, with what is claimed so far."""
    vocabulary = "[" + ", ".join(f"{{'f': '{f}', 'k': [{', '.join(repr(k) for k in ks)}]}}" for f, ks in C.COLUMNS.items()) + "]"
    exact = "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in C.EXACT_COLUMNS.items()) + " end"
    cell = "coalesce(h[i + 1], '')"
    named = f"list_filter({vocabulary}, lambda v: not list_contains(used, v.f) and len(list_filter(v.k, lambda k: contains(t, k))) > 0)[1].f"
    return f"""with recursive heads as ({_HEADERS_DUCK}), d as (select distinct h from heads),
f as (select h, 0 as i, []::varchar[] as used, []::varchar[] as made from d union all
  select h, i + 1, case when p is null then used else list_append(used, p) end, list_append(made, coalesce(p, '-')) from
    (select *, case when c = '' then null when {exact} is not null and not list_contains(used, {exact}) then {exact} else {named} end as p from (select *, {cell} as c, lower({_strip(cell)}) as t from f where i < len(h))))
select job_id, array_to_string(made, '|') as columns from heads join f on f.h = heads.h and f.i = len(f.h)"""


@query(_map_sql())
def header_map(t):
    """Columns named by header cells: each distinct header is mapped once, by a fold over claimed names."""
    return tables.with_columns_of(_headers_of(t), "h", "columns").select("job_id", F.array_join("columns", "|", "-").alias("columns"))


def _stacked_sql() -> str:
    some = lambda x: "null" if x is None else f"'{x}'"
    cases = [(f"contains(l[1], '{a}') and contains(l[2], '{b}')", some(x), some(y)) for a, b, x, y in C.STACKED]
    cases += [(f"contains(l[1], 'amount') and contains(l[2], '{t}')", f"'{t}_amount'", f"'{t}_rate'") for t in C.STACKED_TAXES]
    pick = lambda k: "case when len(l) < 2 then null " + " ".join(f"when {c[0]} then {c[k]}" for c in cases) + " end"
    lines = f"list_filter(list_transform(string_split(lower(coalesce(c, '')), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
    return f"""with heads as ({_HEADERS_DUCK}), e as (select job_id, unnest(range(len(h)))::int as i, unnest(h) as c from heads), l as (select job_id, i, {lines} as l from e),
p as (select job_id, i, {pick(1)} as "first", {pick(2)} as "second" from l) select * from p where "first" is not null or "second" is not null"""


@query(_stacked_sql())
def stacked_headers(t):
    return _headers_of(t).select("job_id", F.posexplode(tables.map_stacked("h")).alias("i", "s")).select("job_id", "i", "s.first", "s.second").filter("first is not null or second is not null")


_GROUPS4 = "case c.c % 4 when 0 then 'G' || cast(o_orderkey % 5 as string) when 2 then case when o_orderkey % 3 = 0 then 'H' end end"
_SUBS4 = "case when c.c % 2 = 0 then 'Rate' when (o_orderkey + c.c) % 3 = 0 then 'Amt' end"
_SUBROW = f"select o_orderkey as job_id, c.c, {_GROUPS4} as p, {_SUBS4} as s from {{}} cross join (select 0 as c union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) c"


@query(f"""with r as ({_SUBROW.format("orders")}), g as (select *, last_value(p ignore nulls) over (partition by job_id order by c rows between unbounded preceding and current row) as lg from r)
select job_id, c, case when s is not null then case when lg is null then s else lg || ' ' || s end else p end as header from g""")
def header_subrow_merge(t):
    r = t["orders"].sparkSession.sql(_SUBROW.format("{orders}"), orders=t["orders"])
    rows = r.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("c", "p", "s"))).alias("x")).select("job_id", F.expr("transform(x, y -> y.p)").alias("p"), F.expr("transform(x, y -> y.s)").alias("s"))
    return rows.select("job_id", F.posexplode(tables.merge_subrow("p", "s")).alias("c", "header"))


@query("""with c as (select s_suppkey as job_id, (s_suppkey % 3)::int as page_number, k.k as table_index, ((s_suppkey * 5 + k.k * 7) % 6)::int as n_matched, ((s_suppkey + k.k) % 4)::int as nr, (s_suppkey + k.k) % 5 <> 0 as usable from supplier cross join (select 0 as k union all select 1 union all select 2 union all select 3) k)
select job_id, page_number, table_index, n_matched from c where usable qualify row_number() over (partition by job_id, page_number order by n_matched desc, nr desc, table_index) = 1""")
def best_table(t):
    c = t["supplier"].sparkSession.sql(
        """select s_suppkey as job_id, cast(s_suppkey % 3 as int) as page_number, k.k as table_index, cast((s_suppkey * 5 + k.k * 7) % 6 as int) as n_matched,
        slice(array('a', 'b', 'c'), 1, cast((s_suppkey + k.k) % 4 as int)) as data_rows, (s_suppkey + k.k) % 5 <> 0 as usable from {supplier} cross join (select 0 as k union all select 1 union all select 2 union all select 3) k""",
        supplier=t["supplier"],
    )
    return tables.best_table(c).select("job_id", "page_number", "table_index", "n_matched")


#: Ruled tables of orders: items with a sum, a header below a letterhead, a decoy of fewer columns, and taxes by rate; the figures are the order's.
_Q, _NAME = "cast(o_orderkey % 40 as string)", "concat('Soap ', cast(o_custkey as string))"
_TABLES = f"""select o_orderkey as job_id, 1 as page_number, p.i as table_index, false as header_external, cast(array() as array<string>) as header, case
  when p.i = 1 and o_orderkey % 3 = 0 then array(array('Product', 'HSN', 'Qty', 'Rate', 'Taxable Amt'), array('few', '1', '1', '1', '1'), array(null, '2', '', '', ''))
  when p.i = 1 then array(array('Name', 'Remarks'), array('a', 'b'))
  when o_orderkey % 3 = 0 then array(array('Sr No', 'Description', 'Qty', 'Rate', 'Taxable Amt'), array('1', {_NAME}, {_Q}, '5.00', concat({_Q}, ',000.50')), array('2', concat(chr(9), {_NAME}, chr(10), 'cake'), '3', 'x', concat('-', {_Q})), array('', concat('Total ', {_Q}), '', '', '59.00'))
  when o_orderkey % 3 = 1 then array(array('Some Company', null, null), array('', null, null), array('Product', 'Qty', 'Value'), array({_NAME}, {_Q}, concat('Rs. ', {_Q}, '.25')))
  else array(array('Tax Rate', 'Taxable Amt', 'Tax Amt'), array('5', concat({_Q}, '.00'), '25.00'), array(concat({_Q}, ' %'), concat(cast(o_orderkey as string), '.00'), '-1.00'), array('', '1', '2')) end as rows
  from {{orders}} cross join (values (0), (1)) p(i) where p.i = 0 or o_orderkey % 2 = 0"""


def _tables(t):
    return t["orders"].sparkSession.sql(_TABLES, orders=t["orders"])


_KIND = "k as (select o_orderkey as job_id, o_orderkey % 3 as kind, o_orderkey % 2 = 0 as two, (o_orderkey % 40)::double as q, (o_orderkey % 40)::varchar as qs, 'Soap ' || o_custkey::varchar as name from orders)"


@query(f"""with {_KIND} select job_id, 0 as row_ord, 1 as line_number, name as item_description, q as quantity, case when kind = 0 then q * 1000 + 0.5 end as taxable_value, case when kind = 1 then (qs || '.25')::double end as line_total, false as is_subtotal from k where kind = 0
union all select job_id, 1, 2, name || ' cake', 3.0, -q, null, false from k where kind = 0 union all select job_id, 2, null, 'Total ' || qs, null, 59.0, null, true from k where kind = 0
union all select job_id, 0, 1, name, q, null, try_cast('.' || qs || '.25' as double), false from k where kind = 1""")
def table_items(t):
    """Amounts keep every dot of their cell, so the one after a currency's abbreviation makes them no number."""
    chosen = tables.best_table(tables.candidates(_tables(t)))
    return tables.table_items(chosen).select("job_id", "row_ord", "line_number", "item_description", "quantity", "taxable_value", "line_total", "is_subtotal")


@query(f"with {_KIND} select job_id, 5.0::double as rate, q as taxable_amount, 25.0::double as tax_amount from k where kind = 2 union all select job_id, q, job_id::double, -1.0 from k where kind = 2")
def tax_brackets(t):
    return tables.tax_brackets(_tables(t)).select("job_id", "rate", "taxable_amount", "tax_amount")


@query(f"with {_KIND} select job_id, 0 as table_index, case kind when 0 then 0 when 1 then 2 end as header_row from k union all select job_id, 1, case kind when 0 then 0 end from k where two")
def internal_header(t):
    return tables.best_internal_header(_tables(t)).select("job_id", "table_index", "header_row")


@query(f"""with {_KIND} select job_id, 1 + two::bigint as n_tables, case kind when 0 then 1 + two::bigint when 1 then 1 else 0 end::bigint as n_usable, case when kind < 2 then 0 end as chosen, case kind when 0 then 5 when 1 then 3 end as n_matched, case kind when 0 then 3 when 1 then 1 end as n_rows,
  case when kind = 2 then 'no table names a description' when kind = 0 and two then 'most rows of those with most columns named' else 'only usable table' end as reason,
  case when kind = 0 then 'Total ' || qs || ' 59.00' end as subtotal, case when two then 2 else 1 end as n_candidates from k""")
def table_diagnostics(t):
    d = tables.diagnostics(tables.candidates(_tables(t)))
    return d.select("job_id", "n_tables", "n_usable", "chosen", "n_matched", "n_rows", "reason", F.get("subtotals", F.lit(0)).alias("subtotal"), F.size("candidates").alias("n_candidates"))


@query(f"""with {_ITEMS}, a as (select job_id, hsn_sac as group_id, line_number, case when job_id % 4 = 0 then 0 when job_id % 4 = 1 then 1 else 2 end as f from items)
select job_id, group_id, line_number, f as "from" from a""")
def extractor_choice(t):
    i = R.items(t).select("job_id", F.col("hsn_sac").alias("group_id"), "line_number")
    return tables.choose_items(i.filter("job_id % 4 = 0"), i.filter("job_id % 4 < 2"), i)


# Exports.

_NAMES = """case o_orderkey % 6 when 0 then 'INV/' || cast(o_custkey as string) when 1 then 'INV\\' || cast(o_custkey as string) when 2 then null when 3 then ' ''quoted name'' ' when 4 then ':*?' else 'A' end"""
_SAFE = r"""left(coalesce(nullif(case when coalesce(v, '') <> '' then regexp_replace(trim(trim(regexp_replace(v, '[\\/:*?"<>|]', '-', 'g')), ''''), '\s+', '_', 'g') end, ''), 'Unnamed_' || rn::varchar), 150)"""


def _named(t):
    return t["orders"].select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("ord"), F.expr(_NAMES.replace("\\", "\\\\").replace("''", "\\'")).alias("v"))


@query(f"""with n as (select o_custkey as job_id, o_orderkey as ord, {_NAMES} as v, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders),
b as (select *, {_SAFE} as base from n), u as (select *, row_number() over (partition by job_id, base order by ord) as k from b)
select job_id, ord, case when k = 1 then base else left(base, 150 - length('_' || k::varchar)) || '_' || k::varchar end as filename from u""")
def unique_filenames(t):
    return export.unique_names(_named(t), "v").select("job_id", "ord", "filename")


@query(f"with n as (select o_orderkey as ord, {_NAMES} as v, o_orderkey as rn from orders) select ord, {_SAFE} as filename from n")
def filename_sanitize(t):
    return _named(t).select("ord", S.sanitize_filename(F.col("v"), F.col("ord")).alias("filename"))


@query("""select o_orderkey as ord, coalesce(case when o_orderkey % 3 <> 0 then c_name end, 'Customer_Unspecified') || '_' || case when o_orderkey % 4 = 0 then '20260131' else '01-02-2026' end || '_' || coalesce(nullif(right(case when o_orderkey % 5 = 0 then '' else 'N' || o_orderkey::varchar end, 5), ''), 'NoIRN') as seed from orders join customer on c_custkey = o_custkey""")
def filename_seed(t):
    j = t["orders"].join(t["customer"], F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    seed = S.filename_seed(F.when(k % 3 != 0, F.col("c_name")), F.when(k % 4 != 0, "01-02-2026"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("N"), k.cast("string"))), F.lit("20260131"))
    return j.select(k.alias("ord"), seed.alias("seed"))


@query(f"with {_ITEMS} select job_id, item_description, hsn_sac, quantity from items")
def export_projection(t):
    return export.project(R.items(t), export.parse_columns("quantity, nothing,hsn_sac, ,item_description"), ("job_id",))


@query(f"""with {_ITEMS}, l as (select job_id, string_agg(line_number::varchar || ',' || item_description || ',' || hsn_sac || ',' || coalesce(quantity::varchar, '') || chr(13) || chr(10), '' order by line_number) as body from items group by 1)
select job_id, encode(chr(65279) || 'Line #,Item Description,HSN/SAC,Quantity' || chr(13) || chr(10) || body).octet_length()::bigint as size_bytes, sha256(chr(65279) || 'Line #,Item Description,HSN/SAC,Quantity' || chr(13) || chr(10) || body) as sha256_checksum from l""")
def export_manifest(t):
    return export.csv_files(R.items(t), ["line_number", "item_description", "hsn_sac", "quantity"], ("job_id",)).drop("content")


@query(f"with {_ITEMS}, g as (select job_id, count(distinct hsn_sac) as n from items group by 1) select job_id, 'invoices_' || job_id::varchar || '_20260131.zip' as filename from g where n > 1")
def export_archives(t):
    """One archive for each job of more than one invoice; its bytes are held against the files in the tests."""
    made = export.csv_files(R.items(t).withColumn("group_id", F.col("hsn_sac")), ["line_number", "item_description", "quantity"])
    return export.zip_files(made.withColumn("filename", F.concat("group_id", F.lit(".csv"))), "20260131").select("job_id", "filename")


for _old, _new in (("column_bounds_query", "column_bounds"), ("assign_columns_query", "assign_columns")):
    QUERIES[_new] = QUERIES.pop(_old)
    SQL[_new] = SQL.pop(_old)
