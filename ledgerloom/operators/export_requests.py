"""Downloads asked for by route, number and columns: each request has a projection of its own, or an error that says why there is none."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scalars import sanitize_filename
from .export import GROUP, field_text, unique_names
from .export_store import archive, exports, with_content

ZIP, CSV = "application/zip", "text/csv"
#: Why a request finds nothing, in the order in which it is asked.
ERRORS = ("job_not_found", "no_invoices", "single_invoice", "invoice_not_found")


def resolve(requests: DataFrame, jobs: DataFrame, groups: DataFrame) -> DataFrame:
    """requests with error, archived, wanted (array of group structs) and fields.

    requests: request_id, job_id, route (export, zip or number), invoice_number, columns (names between commas, or null).
    jobs: job_id of all there are. groups: job_id, group_id, group_ord, invoice_number, seed (of the file's name). fields:
    the known ones of columns in the order of an export; null, which means all, if that leaves none. A route of export
    gives the archive if the job has several groups, else its one CSV; number gives the first group of the number.
    """
    held = groups.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("group_ord", "group_id", "invoice_number", "seed"))).alias("_g"))
    known = jobs.select("job_id").distinct().withColumn("_known", F.lit(True))
    out = requests.join(known, "job_id", "left").join(held, "job_id", "left").withColumn("_n", F.coalesce(F.size("_g"), F.lit(0)))
    asked = F.transform(F.split(F.coalesce("columns", F.lit("")), ","), lambda x: F.trim(x))
    fields = F.filter(F.array(*map(F.lit, C.ITEM_COLUMNS)), lambda f: F.array_contains(asked, f))
    hit = F.slice(F.filter("_g", lambda g: g["invoice_number"] == F.col("invoice_number")), 1, 1)
    wanted = F.when(F.col("route") == "number", hit).otherwise(F.col("_g"))
    tests = F.col("_known").isNull(), F.col("_n") < 1, (F.col("route") == "zip") & (F.col("_n") < 2), F.coalesce(F.size(wanted), F.lit(0)) < 1
    error = F.coalesce(*[F.when(test, e) for test, e in zip(tests, ERRORS, strict=True)])
    return out.withColumns({"error": error, "archived": (F.col("route") != "number") & (F.col("_n") > 1), "wanted": wanted, "fields": F.when(F.size(fields) > 0, fields)}).drop("_known", "_g", "_n")


def _cells(items: DataFrame) -> DataFrame:
    """job_id, group_id, lines: each item's fields as CSV text, in the order of an export, by line_number."""
    cells = F.array(*[field_text(items, c) for c in C.ITEM_COLUMNS])
    return items.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("line_number", cells.alias("cells")))).alias("lines"))


def _csv(fields: str, lines: str) -> F.Column:
    """The bytes of a CSV of the fields that a row names, of the items it holds."""
    names = list(C.ITEM_COLUMNS)
    labels = F.create_map(*[F.lit(x) for kv in C.ITEM_COLUMNS.items() for x in kv])
    at = F.transform(F.col(fields), lambda f: F.array_position(F.array(*map(F.lit, names)), f).cast("int") - 1)
    row = lambda cells: F.concat(F.array_join(cells, ","), F.lit("\r\n"))
    body = F.transform(F.coalesce(lines, F.array()), lambda x: row(F.transform(at, lambda i: x["cells"][i])))
    return F.encode(F.concat(F.lit("﻿"), row(F.transform(F.col(fields), lambda f: labels[f])), F.array_join(body, "")), "UTF-8")


def answers(requests: DataFrame, jobs: DataFrame, groups: DataFrame, items: DataFrame, directory: str, day: str) -> DataFrame:
    """request_id, status (200 or 404), error, filename, media_type, content of each request, see ``resolve``.

    Requests for all columns are served from the store under directory, see ``export_store.exports``; others are built from
    the items each time and not kept. A selection that several requests make of one group is built once. Groups, and the
    requests for one job, are few; items are read for jobs that are asked for only.
    """
    found = resolve(requests, jobs, groups)
    fine = found.filter("error is null")
    bad = found.filter("error is not null").select("request_id", F.lit(404).alias("status"), "error", *[F.lit(None).cast(k).alias(n) for n, k in (("filename", "string"), ("media_type", "string"), ("content", "binary"))])
    named = unique_names(groups, "seed", order="group_ord", prefix="invoice").select(*GROUP, "filename")

    kept = fine.filter("fields is null")
    of = kept.select("job_id").distinct()
    files = exports(items.join(of, "job_id", "left_semi"), named.join(of, "job_id", "left_semi"), directory, day)
    asked = kept.select("request_id", F.col("job_id").cast("string").alias("job_id"), F.when(~F.col("archived"), F.col("wanted")[0]["group_id"].cast("string")).alias("_g"))
    served = with_content(asked.join(files, "job_id").filter(F.col("_g").eqNullSafe(F.col("group_id"))).select("request_id", "filename", F.when(F.col("_g").isNull(), ZIP).otherwise(CSV).alias("media_type"), "file_path")).drop("file_path")

    fresh = fine.filter("fields is not null").select("request_id", "job_id", "archived", "fields", F.explode("wanted").alias("g"))
    fresh = fresh.select("request_id", "job_id", F.col("g.group_id").alias("group_id"), F.col("g.seed").alias("seed"), "archived", "fields")
    once = fresh.select(*GROUP, "fields").distinct()
    built = once.join(_cells(items.join(once.select(*GROUP).distinct(), list(GROUP), "left_semi")), list(GROUP), "left").select(*GROUP, "fields", _csv("fields", F.col("lines")).alias("content"))
    parts = fresh.join(built, [*GROUP, "fields"]).join(named, list(GROUP))
    single = parts.filter("NOT archived").select("request_id", F.concat(sanitize_filename(F.col("seed"), F.lit(1), "invoice"), F.lit(".csv")).alias("filename"), F.lit(CSV).alias("media_type"), "content")

    def zipped(table):
        t = table.sort_by("filename")
        whole = archive(list(zip(t["filename"].to_pylist(), t["content"].to_pylist(), strict=True)))
        return pa.table({"request_id": t["request_id"].slice(0, 1), "filename": [f"invoices_{t['job_id'][0].as_py()}_{day}.zip"], "media_type": [ZIP], "content": pa.array([whole], pa.binary())})

    kind = dict(requests.dtypes)["request_id"]
    many = parts.filter("archived").select("request_id", "job_id", F.concat("filename", F.lit(".csv")).alias("filename"), "content").groupBy("request_id").applyInArrow(zipped, f"request_id {kind}, filename string, media_type string, content binary")
    good = served.unionByName(single).unionByName(many)
    return good.select("request_id", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), "filename", "media_type", "content").unionByName(bad)


def members(answered: DataFrame) -> DataFrame:
    """request_id, name, content of every file that the answers hold: an archive's members, or the file itself."""

    def run(batches):
        import io
        import zipfile

        for batch in batches:
            out = []
            for request, name, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == ZIP:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(request, n, z.read(n)) for n in z.namelist()]
                else:
                    out.append((request, name, content))
            ids, names, contents = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["request_id", "name", "content"])

    kind = dict(answered.dtypes)["request_id"]
    return answered.filter("status = 200").select("request_id", "filename", "media_type", "content").mapInArrow(run, f"request_id {kind}, name string, content binary")
