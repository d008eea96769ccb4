"""Test relations made from the order tables: an order is an invoice, its lines are items, events are pages of a job.

The expressions are in the SQL that Spark and DuckDB share, so that both engines make the same relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_D = "lpad(cast(day(o_orderdate) as string), 2, '0')"
_M = "lpad(cast(month(o_orderdate) as string), 2, '0')"
_Y = "cast(year(o_orderdate) as string)"
_K = "cast(o_orderkey as string)"

#: The text of an order; every seventh or so leaves out, breaks or moves something.
ORDER_TEXT = f"""
  case o_orderkey % 7 when 0 then 'IRN No. : ' || md5({_K}) || md5('x' || {_K}) when 1 then 'Invoice No: INV/2026/' || {_K}
    when 2 then 'IRN :' || chr(10) || md5({_K}) || md5('x' || {_K}) when 3 then 'Bill No. BX-' || {_K} || '-A'
    when 4 then 'Irn Number 12345' when 5 then 'Invoice # ' || {_K} || '00000' else 'no number here' end
  || chr(10) || case when o_orderkey % 5 = 0 then 'Dated: ' || {_D} || '/' || {_M} || '/' || {_Y} when o_orderkey % 5 = 1 then 'Invoice Date - ' || {_D} || '-' || {_M} || '-' || {_Y}
    when o_orderkey % 5 = 2 then 'Bill Date: August 14, 2026' else 'Date of supply' end
  || chr(10) || 'Ack No. : ' || case when o_orderkey % 3 = 0 then '' else lpad({_K}, 12, '1') end
  || chr(10) || 'E-Way Bill No: ' || case when o_orderkey % 4 = 0 then 'none' else lpad({_K}, 8, '2') end
  || chr(10) || 'E Way Bill Date : ' || case when o_orderkey % 4 = 1 then '' else {_D} || '.' || {_M} || '.' || {_Y} end
  || chr(10) || 'FSSAI No. : ' || lpad({_K}, 10, '3')
  || chr(10) || 'GSTIN No. : ' || case when o_orderkey % 6 = 0 then '' when o_orderkey % 6 = 1 then lpad({_K}, 12, 'A') else lpad({_K}, 15, 'B') end
  || chr(10) || case when o_orderkey % 8 = 0 then 'Customer Details' else 'Bill To: ' || case when o_orderkey % 9 = 0 then '/ none' else 'Customer ' || {_K} end end
  || chr(10) || 'Address: ' || {_K} || ' Main Road' || chr(10) || 'State Code : 27'
  || chr(10) || case when o_orderkey % 10 = 0 then 'Disclaimer: no returns' else 'Taxable Value: ' || cast(o_orderkey % 1000 as string) || '.50' end
  || chr(10) || 'Total Amount : Rs' || chr(10) || 'Discount: 1,2' || cast(o_orderkey % 10 as string) || '0.00' || chr(10) || 'TCS Amount: ' || chr(10) || 'Invoice Amount: 99'
  || chr(10) || 'Adjustment Amount: -0.' || cast(10 + o_orderkey % 80 as string) || chr(10) || 'Net Payable Amount: ' || cast(o_orderkey as string) || '.25'
  || chr(10) || case when o_orderkey % 11 = 0 then 'signed' else 'For Vendor ' || cast(o_custkey as string) || ' Ltd' end
  || chr(10) || 'Terms & Conditions apply' || chr(10) || 'goods once sold stay sold'
""".replace("\n", " ")

#: Pages: the events of a user in order, an error leaving the page without number.
PAGES = """
  select user_id as job_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as page_number,
    nullif(event_type, 'error') as invoice_number,
    case event_type when 'error' then 'not_found' when 'purchase' then 'high' else 'review' end as confidence
  from events
"""

#: Items: the lines of orders, numbered in a total order, with decimal money and blanks where a bill would have them.
ITEMS = """
  select l_orderkey as job_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as int) as line_number,
    l_partkey, l_suppkey, p_name as item_description, p_brand as hsn_sac,
    case when (l_partkey + l_suppkey) % 9 = 0 then null else l_quantity end as quantity,
    case when l_linestatus = 'O' then p_retailprice else 0e0 end as rate_pts, case when l_partkey % 13 = 0 then null else l_extendedprice / l_quantity end as unit_rate,
    case when (l_partkey + l_suppkey) % 9 = 0 then null else cast(cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,2)) as double) end as taxable_value
  from lineitem join part on p_partkey = l_partkey
"""

#: Words of a page: three to a line of an order, a few points off their row.
WORDS = """
  select i.job_id, 1 as page_number, cast(i.line_number * 3 + w.w as int) as word_ord,
    case w.w when 0 then 'P' || cast(i.l_partkey as string) when 1 then 'Q' || cast(i.l_suppkey as string) else 'V' || cast(i.line_number as string) end as text,
    cast(case w.w when 0 then 50 when 1 then 50 + 40 + (i.l_suppkey % 3) * 45 else 410 end as double) as x0,
    cast(i.line_number * 14 + (i.l_partkey * (w.w + 3) + i.l_suppkey) % 11 as double) as y0,
    cast(case w.w when 0 then 86 when 1 then 50 + 40 + (i.l_suppkey % 3) * 45 + 30 else 440 end as double) as x1,
    cast(i.line_number * 14 + (i.l_partkey * (w.w + 3) + i.l_suppkey) % 11 + 8 + i.l_partkey % 5 as double) as y1
  from items i cross join (select 0 as w union all select 1 union all select 2) w
"""

#: More parts than this are never sent to all tasks: their keys compress so well that Catalyst takes many millions for a small table.
SENT_PARTS = 2_000_000
NAMES = ("lineitem", "orders", "part", "customer", "supplier", "events", "documents")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Readers of the tables; nothing is read before it is used."""
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES}


def pages(t: dict[str, DataFrame]) -> DataFrame:
    return t["events"].sparkSession.sql(PAGES.replace("from events", "from {events}"), events=t["events"])


def items(t: dict[str, DataFrame]) -> DataFrame:
    part = t["part"] if t["part"].count() <= SENT_PARTS else t["part"].hint("merge")
    return t["lineitem"].sparkSession.sql(ITEMS.replace("from lineitem join part", "from {lineitem} join {part}"), lineitem=t["lineitem"], part=part)


def words(t: dict[str, DataFrame]) -> DataFrame:
    return t["lineitem"].sparkSession.sql(WORDS.replace("from items i", "from {items} i"), items=items(t))


def order_texts(t: dict[str, DataFrame]) -> DataFrame:
    """The texts of orders. Tasks are cut by bytes, and orders are small but their texts dear to search, so rows are spread by count."""
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.repartition(orders.sparkSession.sparkContext.defaultParallelism).selectExpr("o_orderkey as doc", "o_custkey", f"{ORDER_TEXT} as text")
