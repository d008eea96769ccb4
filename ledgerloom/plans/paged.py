"""Queries over files of pages. Every supplier is a file, its orders' lines are words and tables; files are JSON, which a reader here opens."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..shared import own_path
from ..sources import cache, files, pages
from .queries import query


class JsonDocument:
    """{"pages": [{"rotation", "width", "height", "words", "tables"}]}; "broken" in a page makes it fail."""

    def __init__(self, doc: dict):
        self._all = doc["pages"]

    def _page(self, number: int) -> dict:
        page = self._all[number - 1]
        if page.get("broken"):
            raise ValueError("broken page")
        return page

    def pages(self) -> list[int]:
        return list(range(1, len(self._all) + 1))

    def words(self, number: int) -> dict:
        page = self._page(number)
        return {k: page.get(k) for k in ("rotation", "width", "height")} | {"words": page.get("words") or []}

    def tables(self, number: int) -> list[tuple]:
        return [(t.get("header"), t["rows"]) for t in self._page(number).get("tables") or []]


class JsonPages:
    """The backend that needs no library; "encrypted" at the top makes a file fail."""

    def open(self, content: bytes) -> JsonDocument:
        doc = json.loads(content)
        if doc.get("encrypted"):
            raise pages.Encrypted
        return JsonDocument(doc)


#: Files: a page for each flag and status of what a supplier shipped, with a word and a table row for each kind; some files and pages fail.
_PAGE = """select l_suppkey as file, concat(l_returnflag, l_linestatus) as page, count(*) as n, cast(sum(l_quantity) as bigint) as q from {} group by l_suppkey, concat(l_returnflag, l_linestatus)"""
_CONTENT = """case when file % 13 = 0 then '{"encrypted": true}' when file % 17 = 0 then 'nonsense' else
  concat('{"pages": [', array_join(transform(ps, (p, i) -> concat('{"broken": ', if((file + i) % 7 = 0, 'true', 'false'), ', "rotation": ', cast(file % 4 * 90 as string), ', "width": 600, "height": 800, "words": [["', p.page, '", 10, 20, 40, 30, null], ["',
    cast(p.n as string), '", 60, 20, 80, 35, 96.5]], "tables": [{"rows": [["Item", "Qty"], ["', p.page, '", "', cast(p.q as string), '"]]}]}')), ', '), ']}') end"""
_NUMBERED = f"p as (select *, (row_number() over (partition by file order by page))::int as page_number, (file + row_number() over (partition by file order by page) - 1) % 7 = 0 as broken from ({_PAGE.format('lineitem')})), fine as (select * from p where file % 13 <> 0 and file % 17 <> 0)"


def _files(t):
    of = t["lineitem"].sparkSession.sql(_PAGE.format("{lineitem}"), lineitem=t["lineitem"])
    docs = of.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "n", "q"))).alias("ps"))
    return docs.selectExpr("concat('f', cast(file as string)) as path", "cast(null as string) as file_type", f"encode({_CONTENT}, 'UTF-8') as content")


@query(f"with {_NUMBERED} select 'f' || file::varchar as path, case when file % 13 <> 0 and file % 17 <> 0 then count(*) end::int as page_count, case when file % 13 = 0 then 'encrypted' when file % 17 = 0 then 'unreadable: JSONDecodeError' end as error from p group by file")
def file_page_counts(t):
    """Pages of every file, or why there is no count."""
    return pages.page_counts(_files(t), JsonPages())


@query(f"""with {_NUMBERED}, w as (select *, 0 as word_ord, page as text, 10 as a, 20 as b, 40 as c, 30 as d, null::double as conf from fine where not broken union all select *, 1, n::varchar, 60, 20, 80, 35, 96.5 from fine where not broken), r as (select *, file % 4 as t from w where page_number between 2 and 4)
select 'f' || file::varchar as path, page_number, word_ord, text, (case t when 0 then a when 1 then 800 - d when 2 then 600 - c else b end)::double as x0, (case t when 0 then b when 1 then a when 2 then 800 - d else 600 - c end)::double as y0,
  (case t when 0 then c when 1 then 800 - b when 2 then 600 - a else d end)::double as x1, (case t when 0 then d when 1 then c when 2 then 800 - b else 600 - a end)::double as y1, conf from r""")
def page_word_scan(t):
    """Words of the second to fourth page of every file, as they are seen; other pages are not read."""
    found = _files(t)
    scope = found.select("path", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("page_number"))
    return pages.page_words(pages.read_pages(found, JsonPages(), scope))


@query(f"with {_NUMBERED} select 'f' || file::varchar as path, page_number, 0 as table_index, false as header_external, 'Item|Qty' as header, 'Item,Qty|' || page || ',' || q::varchar as cells from fine where not broken")
def page_table_scan(t):
    """Ruled tables of all pages."""
    found = pages.page_tables(pages.read_pages(_files(t), JsonPages()))
    return found.select("path", "page_number", "table_index", "header_external", F.array_join("header", "|").alias("header"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), "|").alias("cells"))


@query(f"""with {_NUMBERED} select 'f' || file::varchar as path, page_number, 'unreadable: ValueError' as error from fine where broken
union all select distinct 'f' || file::varchar, null, case when file % 13 = 0 then 'encrypted' else 'unreadable: JSONDecodeError' end from p where file % 13 = 0 or file % 17 = 0""")
def page_read_errors(t):
    """Files and pages that could not be read, the others go on."""
    return pages.page_errors(pages.read_pages(_files(t), JsonPages()))


@query("""with p as (select o_orderkey as page_id, o_custkey % 500 as c, o_orderkey % 3 = 0 as first, o_orderkey % 50 = 7 as bare from orders), d as (select c, bool_or(first) as before from p where not bare group by 1)
select page_id, case when not bare and before then 'first ' || p.c::varchar else 'second ' || p.c::varchar end as text, 'ocr' as source from p left join d on d.c = p.c""")
def page_cache(t):
    """Pages read twice over, a third of them first: a content that was read is not read again, a page without digest always is."""
    bare = t["orders"].selectExpr("o_orderkey as page_id", "cast(o_custkey % 500 as string) as content", "if(o_orderkey % 50 = 7, null, sha2(cast(o_custkey % 500 as string), 256)) as digest", "'' as text")
    where = own_path(bare.sparkSession, "pages")
    reader = lambda name: lambda df: df.withColumn("text", F.concat(F.lit(f"{name} "), F.col("content")))
    files.page_sources(bare.filter("page_id % 3 = 0"), cache.cached(reader("first"), where))
    done = files.page_sources(bare, cache.cached(reader("second"), where))
    return done.select("page_id", "text", "source")
