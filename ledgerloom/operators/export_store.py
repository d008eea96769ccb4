"""Exports that are kept: made once for each input, served again while it stays the same, and made anew when it changes.

A store is a folder. Tasks write files, and a manifest of what they wrote, into a staging folder of their own; one rename
of the whole staging folder makes all of them visible. A crash at any time, inside of a file too, leaves a staging folder
that nobody reads, and the next call makes what is missing. Manifests are the only thing that is searched: no call lists the
files themselves.

A job's export is known by its job and the digest of its input, so what is served is always what the input says.
"""

from __future__ import annotations

import hashlib
import io
import time
import uuid
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import config as C
from ..shared import arrow_store, cut
from .export import GROUP, csv_files, selected_columns

MANIFEST = "job_id string, version string, group_id string, filename string, file_path string, size_bytes bigint, sha256_checksum string, made_at double, commit string"
_ROWS = pa.schema([(n, {"bigint": pa.int64(), "double": pa.float64()}.get(k, pa.string())) for n, k in (c.split(" ") for c in MANIFEST.split(", "))])


@dataclass
class Wrote(WriterCommitMessage):
    """The folder of a task's attempt."""

    attempt: str | None


class StoreWriter(DataSourceArrowWriter):
    """Two phases: attempts write to staging/<commit>/<attempt>; the commit drops attempts that don't count and renames staging/<commit> to files/<commit>."""

    def __init__(self, directory: str):
        self.directory, self.commit_id, self.made_at = directory.rstrip("/"), uuid.uuid4().hex, time.time()

    def write(self, iterator):
        from pyarrow import parquet

        store, root = arrow_store(self.directory)
        attempt, rows = uuid.uuid4().hex, []
        for batch in iterator:
            for row in batch.to_pylist():
                name = f"{self.commit_id}/{attempt}/{len(rows):06d}/{row['filename']}"
                path = f"{root}/staging/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(row["content"])
                rows.append({k: row[k] for k in ("job_id", "version", "group_id", "filename")} | {"file_path": f"{self.directory}/files/{name}", "size_bytes": len(row["content"]), "sha256_checksum": hashlib.sha256(row["content"]).hexdigest(), "made_at": self.made_at, "commit": self.commit_id})
        if not rows:
            return Wrote(None)
        with store.open_output_stream(f"{root}/staging/{self.commit_id}/{attempt}/manifest.parquet") as f:
            parquet.write_table(pa.Table.from_pylist(rows, _ROWS), f)
        return Wrote(attempt)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = arrow_store(self.directory)
        staged, counts = f"{root}/staging/{self.commit_id}", {m.attempt for m in messages if m and m.attempt}
        if not counts:
            return
        for info in store.get_file_info(fs.FileSelector(staged)):
            if info.base_name not in counts:
                store.delete_dir(info.path)
        store.create_dir(f"{root}/files", recursive=True)
        store.move(staged, f"{root}/files/{self.commit_id}")

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = arrow_store(self.directory)
        staged = f"{root}/staging/{self.commit_id}"
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class ExportStore(DataSource):
    """The sink ``export_store``: rows (job_id, version, group_id, filename: string, content: binary) as files under path, all or none."""

    @classmethod
    def name(cls):
        return "export_store"

    def writer(self, schema, overwrite):
        return StoreWriter(self.options["path"])


def manifests(spark: SparkSession, directory: str) -> DataFrame:
    """The rows of MANIFEST for all files of a store; an absent one has none."""
    pattern = f"{directory.rstrip('/')}/files/*/*/manifest.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    some = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not some:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(pattern)


def _sums(*cols: Column) -> list[Column]:
    """Two sums that tell bags of rows apart, whatever their order, and are combined before a shuffle. Hashes pass over nulls, so which columns are null is hashed too."""
    cols = (*cols, F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols]))
    return [F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64(F.lit(7), *cols)).cast("string"), F.count(F.lit(1)).cast("string")]


def versions(items: DataFrame, named: DataFrame) -> DataFrame:
    """job_id (string), version: the digest of each job's named groups (job_id, group_id, filename) and of what an export shows of their items."""
    shown = [F.col(c) if c in items.columns else F.lit(None) for c in C.ITEM_COLUMNS]
    job = F.col("job_id").cast("string").alias("job_id")
    of_items = items.groupBy(job).agg(F.concat_ws("|", *_sums(F.col("group_id"), *shown)).alias("_i"))
    of_names = named.groupBy(job).agg(F.concat_ws("|", *_sums(F.col("group_id"), F.col("filename"))).alias("_n"))
    return of_names.join(of_items, "job_id", "left").select("job_id", F.substring(F.sha2(F.concat_ws("#", "_n", F.coalesce("_i", F.lit(""))), 256), 1, 32).alias("version"))


def group_files(items: DataFrame, named: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """job_id, group_id, filename, content: a CSV for each named group; one without items has a header alone."""
    made = csv_files(items, columns).select(*GROUP, "content")
    head = "﻿" + ",".join(C.ITEM_COLUMNS[c] for c in selected_columns(columns)) + "\r\n"
    return named.select(*GROUP, "filename").join(made, list(GROUP), "left").select(*GROUP, F.concat("filename", F.lit(".csv")).alias("filename"), F.coalesce("content", F.encode(F.lit(head), "UTF-8")).alias("content"))


def archive(files: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of (name, content) in the order given; equal files make equal bytes."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def with_archives(files: DataFrame, day: str) -> DataFrame:
    """files (job_id, version, group_id: string, filename, content) and, for each job that has more than one, its archive, without a group_id. A job's files are few and small, and meet once."""

    def kernel(table):
        if table.num_rows < 2:
            return table
        t = table.sort_by("filename")
        whole = archive(list(zip(t["filename"].to_pylist(), t["content"].to_pylist(), strict=True)))
        job = t["job_id"][0].as_py()
        more = pa.table({"job_id": [job], "version": [t["version"][0].as_py()], "group_id": pa.array([None], pa.string()), "filename": [f"invoices_{job}_{day}.zip"], "content": [whole]})
        return pa.concat_tables([table.cast(more.schema), more])

    schema = "job_id string, version string, group_id string, filename string, content binary"
    return files.select("job_id", "version", "group_id", "filename", "content").groupBy("job_id").applyInArrow(kernel, schema)


def exports(items: DataFrame, named: DataFrame, directory: str, day: str) -> DataFrame:
    """The files of every job in named (job_id, group_id, filename): job_id, group_id (string; null for the archive of a job of several groups), filename, file_path, size_bytes, sha256_checksum, version, state.

    state: served if the store had an export of this very input, replaced if it had one of another, made if it had none.
    Those that it lacks are made and kept before this returns; day goes into archives' names. Older exports stay in the
    store. Two calls at once may both make one, of which the earlier counts.
    """
    spark = items.sparkSession
    spark.dataSource.register(ExportStore)
    wanted = versions(items, named)
    there = manifests(spark, directory).select("job_id", "version").distinct()
    same = there.withColumn("_same", F.lit(True))
    known = there.select("job_id").distinct().withColumn("_known", F.lit(True))
    state = F.when(F.col("_same"), "served").when(F.col("_known"), "replaced").otherwise("made")
    states = cut(wanted.join(same, ["job_id", "version"], "left").join(known, "job_id", "left").select("job_id", "version", state.alias("state")))
    new = states.filter("state != 'served'").select(F.col("job_id").alias("_j"), "version")
    of = F.col("job_id").cast("string") == F.col("_j")
    files = group_files(items.join(new, of, "left_semi"), named.join(new, of, "left_semi")).join(new, of)
    files = files.select(F.col("job_id").cast("string").alias("job_id"), "version", F.col("group_id").cast("string").alias("group_id"), "filename", "content")
    with_archives(files, day).write.format("export_store").mode("append").save(directory)
    made = manifests(spark, directory).join(states, ["job_id", "version"])
    first = made.groupBy("job_id").agg(F.min(F.struct("made_at", "commit"))["commit"].alias("commit"))
    return made.join(first, ["job_id", "commit"]).select("job_id", "group_id", "filename", "file_path", "size_bytes", "sha256_checksum", "version", "state")


def with_content(files: DataFrame) -> DataFrame:
    """files (file_path and others) with content, read from the store in tasks."""
    at = files.columns.index("file_path")

    def run(batches):
        for batch in batches:
            got = []
            for path in batch.column(at).to_pylist():
                store, name = arrow_store(path)
                with store.open_input_stream(name) as f:
                    got.append(f.read())
            yield pa.record_batch([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, "content"])

    return files.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in files.dtypes) + ", content binary")


def answer(items: DataFrame, named: DataFrame, directory: str, day: str) -> DataFrame:
    """What a download of each job gives: job_id, filename, media_type, file_path, size_bytes, state: its archive if it has several groups, else its one CSV."""
    files = exports(items, named, directory, day)
    per = files.groupBy("job_id").agg(F.max(F.col("group_id").isNull()).alias("_zip"))
    zipped = F.col("group_id").isNull()
    return files.join(per, "job_id").filter(zipped == F.col("_zip")).select("job_id", "filename", F.when(zipped, "application/zip").otherwise("text/csv").alias("media_type"), "file_path", "size_bytes", "state")


def exported(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """jobs with status exported where files (``exports``) has an export of the job as it is, else the status they have."""
    done = files.select(F.col("job_id").alias("_j")).distinct()
    out = jobs.join(done, F.col("job_id").cast("string") == F.col("_j"), "left")
    return out.withColumn("status", F.when(F.col("_j").isNotNull(), "exported").otherwise(F.col("status"))).drop("_j")
