"""Queries over kept exports and requests for them: a supplier is a job, what it shipped by flag and status its invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import export, export_requests, export_store
from ..shared import own_path
from .queries import query

_DAY = "20260131"
#: Items of all jobs; one job in four has a single invoice, one in eleven none.
_ITEMS = """select l_suppkey as job_id, concat(l_returnflag, l_linestatus) as group_id, cast(row_number() over (partition by l_suppkey, l_returnflag, l_linestatus order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as int) as line_number,
    concat('Part ', cast(l_partkey as string), ', "', l_returnflag, '"') as item_description, l_quantity as quantity, l_extendedprice as taxable_value
  from {} where l_suppkey % 11 <> 0 and (l_suppkey % 4 <> 0 or concat(l_returnflag, l_linestatus) = 'AF')"""
_BOM, _CRLF = "chr(65279)", "chr(13) || chr(10)"
#: SQL of the fields that the items have, as CSV.
_FIELDS = {"line_number": "line_number::varchar", "item_description": """'"' || replace(item_description, '"', '""') || '"'""", "quantity": "quantity::varchar", "taxable_value": "taxable_value::varchar"}


def _body(fields, items: str) -> str:
    """SQL of the text of each group's CSV."""
    line = " || ',' || ".join(_FIELDS.get(f, "''") for f in fields)
    head = ",".join(C.ITEM_COLUMNS[f] for f in fields)
    return f"(select job_id, group_id, {_BOM} || '{head}' || {_CRLF} || string_agg({line} || {_CRLF}, '' order by line_number) as body from {items} group by 1, 2)"


def _items(t):
    return t["lineitem"].sparkSession.sql(_ITEMS.format("{lineitem}"), lineitem=t["lineitem"])


_CHANGED = "select * replace (case when job_id % 5 = 0 then quantity + 1 else quantity end as quantity) from items"


@query(f"""with items as ({_ITEMS.format("lineitem")}), changed as ({_CHANGED}), b as {_body(C.ITEM_COLUMNS, "changed")},
s as (select job_id, case when job_id % 3 = 0 then 'made' when job_id % 5 = 0 then 'replaced' else 'served' end as state, count(*) as n from b group by 1)
select job_id::varchar as job_id, group_id, 'S' || job_id::varchar || '_' || group_id || '.csv' as filename, octet_length(encode(body))::bigint as size_bytes, sha256(body) as sha256_checksum, state from b join s using (job_id)
union all select job_id::varchar, null, 'invoices_' || job_id::varchar || '_{_DAY}.zip', null, null, state from s where n > 1""")
def export_cache(t):
    """Exports of the items as they are, but for a third of the jobs; then of the items as they have changed: what was kept and still holds is served."""
    items = _items(t)
    spark = items.sparkSession
    named = lambda i: i.select("job_id", "group_id").distinct().withColumn("filename", F.concat(F.lit("S"), F.col("job_id").cast("string"), F.lit("_"), F.col("group_id")))
    where = own_path(spark, "exports")
    first = items.filter("job_id % 3 <> 0")
    export_store.exports(first, named(first), where, _DAY)
    changed = items.withColumn("quantity", F.expr("if(job_id % 5 = 0, quantity + 1, quantity)"))
    files = export_store.exports(changed, named(changed), where, _DAY)
    csv = F.col("group_id").isNotNull()
    return files.select("job_id", "group_id", "filename", F.when(csv, F.col("size_bytes")).alias("size_bytes"), F.when(csv, F.col("sha256_checksum")).alias("sha256_checksum"), "state")


_REQUESTS = """select s_suppkey * 10 + r.r as request_id, if(r.r = 6, -s_suppkey, s_suppkey) as job_id, r.route, if(r.number is null, null, concat('INV/', cast(s_suppkey as string), '/', r.number)) as invoice_number, r.columns
  from {} cross join (values (0, 'export', null, null), (1, 'zip', null, ''), (2, 'number', 'AF', null), (3, 'number', 'XX', null), (4, 'export', null, 'quantity, nothing,item_description'), (5, 'number', 'NO', 'quantity'),
    (6, 'export', null, null), (7, 'zip', null, 'line_number'), (8, 'export', null, 'no_such,neither')) r(r, route, number, columns)"""
_SOME = ("item_description", "quantity"), ("quantity",), ("line_number",)
_IF = _REQUESTS.replace("if(r.r = 6, -s_suppkey, s_suppkey)", "case when r.r = 6 then -s_suppkey else s_suppkey end").replace("if(r.number is null, null, concat('INV/', cast(s_suppkey as string), '/', r.number))", "case when r.number is not null then 'INV/' || s_suppkey::varchar || '/' || r.number end")


@query(f"""with items as ({_ITEMS.format("lineitem")}), requests as ({_IF.format("supplier")}), whole as {_body(C.ITEM_COLUMNS, "items")}, {", ".join(f"c{i} as {_body(f, 'items')}" for i, f in enumerate(_SOME))},
n as (select job_id, count(*) as n from whole group by 1), q as (select r.*, request_id % 10 as r, coalesce(n, 0) as n, s_suppkey is not null as known from requests r left join n using (job_id) left join supplier on s_suppkey = r.job_id),
e as (select *, case when not known then 'job_not_found' when n = 0 then 'no_invoices' when route = 'zip' and n < 2 then 'single_invoice'
  when route = 'number' and not exists (select 1 from whole w where w.job_id = q.job_id and 'INV/' || w.job_id::varchar || '/' || w.group_id = q.invoice_number) then 'invoice_not_found' end as error, route <> 'number' and n > 1 as archived from q),
f as (select request_id, 'Shop_' || e.job_id::varchar || '_01-02-2026_' || right('INV/' || e.job_id::varchar || '/' || w.group_id, 5) as seed, w.group_id, coalesce(c0.body, c1.body, c2.body, w.body) as body
  from e join whole w on w.job_id = e.job_id and (e.route <> 'number' or e.invoice_number = 'INV/' || w.job_id::varchar || '/' || w.group_id)
  left join c0 on e.r = 4 and c0.job_id = w.job_id and c0.group_id = w.group_id left join c1 on e.r = 5 and c1.job_id = w.job_id and c1.group_id = w.group_id left join c2 on e.r = 7 and c2.job_id = w.job_id and c2.group_id = w.group_id where error is null),
g as (select request_id, string_agg(replace(seed, '/', '-') || '.csv=' || sha256(body), '|' order by replace(seed, '/', '-') || '.csv') as files, any_value(replace(seed, '/', '-') || '.csv') as name from f group by 1)
select e.request_id, case when error is null then 200 else 404 end as status, error, case when error is null and archived then 'invoices_' || e.job_id::varchar || '_{_DAY}.zip' else g.name end as filename,
  case when error is null then case when archived then 'application/zip' else 'text/csv' end end as media_type, g.files from e left join g on g.request_id = e.request_id""", name="export_requests")
def export_requests_(t):
    """Nine requests for each supplier, by every route, with and without columns, some of which find nothing; archives are opened again."""
    items = _items(t)
    spark = items.sparkSession
    number = F.concat(F.lit("INV/"), F.col("job_id").cast("string"), F.lit("/"), F.col("group_id"))
    groups = items.select("job_id", "group_id").distinct().withColumns({"invoice_number": number, "group_ord": F.ascii(F.substring("group_id", 1, 1)) * 256 + F.ascii(F.substring("group_id", 2, 1))})
    groups = groups.withColumn("seed", F.concat(F.lit("Shop_"), F.col("job_id").cast("string"), F.lit("_01-02-2026_"), F.right("invoice_number", F.lit(5))))
    requests = spark.sql(_REQUESTS.format("{supplier}"), supplier=t["supplier"])
    jobs = t["supplier"].select(F.col("s_suppkey").alias("job_id"))
    got = export_requests.answers(requests, jobs, groups, items, own_path(spark, "exports"), _DAY)
    held = export_requests.members(got).select("request_id", F.concat_ws("=", "name", F.sha2("content", 256)).alias("f")).groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list("f")), "|").alias("files"))
    return got.drop("content").join(held, "request_id", "left")


def _catalog_sql() -> str:
    rows = ", ".join(f"({i}, '{f}', '{label}')" for i, (f, label) in enumerate(C.ITEM_COLUMNS.items()))
    return f"""with c as (select * from (values {rows}) t(position, field_name, label)), items as ({_ITEMS.format("lineitem")}), n as (select count(line_number) as line_number, count(item_description) as item_description, count(quantity) as quantity, count(taxable_value) as taxable_value from items)
select c.*, case field_name {" ".join(f"when '{f}' then n.{f}" for f in _FIELDS)} else 0 end::bigint as filled from c, n"""


@query(_catalog_sql())
def export_catalog(t):
    """The columns that an export can have, and in how many items each is filled."""
    items = _items(t)
    filled = items.select(*[F.count(c).alias(c) for c in items.columns if c in C.ITEM_COLUMNS])
    pairs = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("filled")) for c in filled.columns])).alias("x")).select("x.*")
    return export.column_catalog(items.sparkSession).join(pairs, "field_name", "left").withColumn("filled", F.coalesce("filled", F.lit(0)).cast("long"))
