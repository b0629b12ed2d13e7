"""Page files: one JSON object a file with url, content and encoding."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.session import cut_lineage

SCHEMA = "url STRING, content STRING, encoding STRING, _bad STRING"


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, url, content, encoding, bad) of every ``*.json`` below ``root``. A file that is no JSON object is a row with
    ``bad`` set and no values; missing fields are null."""
    rows = (
        spark.read.schema(SCHEMA)
        .options(recursiveFileLookup=True, pathGlobFilter="*.json", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
        .json(root)
    )
    return rows.select(F.col("_metadata.file_path").alias("path"), "url", "content", "encoding", F.col("_bad").isNotNull().alias("bad"))


def catalogue(pages: DataFrame) -> DataFrame:
    """(doc_id, path, url, ...): pages with the number (from 1) of their path in the order of paths; bad files keep their number, rows
    of one path share it, a null path gives no row.

    The numbers are made in parallel: the distinct paths alone are range-partitioned, sorted and written once to the checkpoint
    folder with their partition, so that every later use sees the same partitions; the sizes of the partitions (one row each) are
    summed up before each partition, paths are numbered within theirs, and the ids are joined back to the pages by path."""
    paths = pages.where(F.col("path").isNotNull()).select("path").distinct()
    parts = cut_lineage(paths.repartitionByRange("path").withColumn("_p", F.spark_partition_id()))
    inside = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("path")))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_p")) - F.col("_size")).select("_p", "_before")
    ids = inside.join(F.broadcast(before), "_p").select("path", (F.col("_n") + F.col("_before")).cast("bigint").alias("doc_id"))
    return pages.join(ids, "path").select("doc_id", *pages.columns)


def first_urls(pages: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """(url, key, more): the first page of every url that isn't empty, by a partial minimum; of its rows the one with the least ``more``."""
    least = F.min(F.struct(key, *more))
    return pages.where(F.col("url").isNotNull() & (F.col("url") != "")).groupBy("url").agg(least.alias("_f")).select("url", *(F.col("_f")[c].alias(c) for c in (key, *more)))


def bad_files(pages: DataFrame) -> DataFrame:
    """One row: files, bad files, files without content."""
    return pages.agg(F.count(F.lit(1)).alias("files"), F.count_if("bad").alias("bad"), F.count_if(~F.col("bad") & F.col("content").isNull()).alias("empty"))


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("path", "url", "content", "encoding", "bad")
    kinds = (*[pa.string()] * 4, pa.bool_())
    for b in batches:
        for archive, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows: list[tuple] = []
            try:
                with zipfile.ZipFile(io.BytesIO(blob.as_buffer())) as z:
                    for entry in sorted(n for n in z.namelist() if n.endswith(".json")):
                        try:
                            page = json.loads(z.read(entry))
                            values = [v if v is None or isinstance(v, str) else json.dumps(v) for v in map(page.get, ("url", "content", "encoding"))]
                            rows.append((f"{archive}!/{entry}", *values, False))
                        except (ValueError, AttributeError, zipfile.BadZipFile):
                            rows.append((f"{archive}!/{entry}", None, None, None, True))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
            except zipfile.BadZipFile:
                rows.append((archive, None, None, None, True))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_zipped_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, url, content, encoding, bad), as of ``read_pages``, of every ``*.json`` in the ``*.zip`` archives below ``root``, which may be in
    an object store. A path is the archive's, ``!/`` and the entry's. An archive is read by one task and must fit into its memory, so a
    crawl is better kept in many; one that is no archive is a bad row."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.zip").load(root).select("path", "content")
    return files.mapInArrow(_unzipped, "path string, url string, content string, encoding string, bad boolean")
