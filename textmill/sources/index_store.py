"""An index on disk: a folder of builds, each a folder of Parquet tables.

``postings`` (range-partitioned and sorted by token, so a lookup reads the row groups whose minimum and maximum enclose it),
``vectors`` (raw counts, hash-partitioned by document; with lemmas also by tag), ``norms``, ``documents``, ``hashes`` (where near
duplicates are left out) and a one-row ``manifest`` with the number of documents, the name and the options.

Every build writes a folder of its own and its manifest last; readers take the newest build that has a manifest. So a build that
replaces another, or extends it in place, never touches what is being read, and one that fails leaves the older build as it is.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IndexOptions:
    """Options of a build. ``target_rows``: postings a file; ``drop_near_duplicates``: leave near copies out; ``lemmatize``: index
    lemmas instead of surface forms; ``plain_text``: contents are text without tags, all of it counted as other."""

    name: str = "index"
    target_rows: int = 5_000_000
    drop_near_duplicates: bool = False
    lemmatize: bool = False
    plain_text: bool = False


TABLES = ("postings", "vectors", "norms", "documents", "manifest")


def _files(spark: SparkSession, path: str):
    """(file system, path) of the driver's file-system library."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def builds(spark: SparkSession, path: str) -> list[str]:
    """The folders of the complete builds at ``path``, oldest first."""
    fs, at = _files(spark, f"{path}/build-*/manifest/*.parquet")
    return sorted({s.getPath().getParent().getParent().toString() for s in fs.globStatus(at) or ()}, key=lambda p: p.rpartition("/")[2])


def newest(spark: SparkSession, path: str) -> str:
    found = builds(spark, path)
    if not found:
        raise FileNotFoundError(f"no complete index at {path}")
    return found[-1]


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def prune(spark: SparkSession, path: str) -> None:
    """Remove all complete builds but the newest."""
    for old in builds(spark, path)[:-1]:
        remove(spark, old)


def facts(options: IndexOptions, documents: DataFrame) -> DataFrame:
    """The manifest: number of documents, name and options."""
    return documents.agg(F.count(F.lit(1)).cast("bigint").alias("n_docs")).select("n_docs", *(F.lit(v).alias(k) for k, v in asdict(options).items()))


def save(path: str, options: IndexOptions, postings: DataFrame, vectors: DataFrame, norms: DataFrame, documents: DataFrame, hashes: DataFrame | None = None) -> str:
    """Write a new build; its folder."""
    spark = postings.sparkSession
    at = f"{path}/build-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    postings.repartitionByRange(partitions, "token").sortWithinPartitions("token", "doc_id").write.option("maxRecordsPerFile", options.target_rows).option("parquet.bloom.filter.enabled#token", "true").parquet(f"{at}/postings")
    vectors.repartition(partitions, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{at}/vectors")
    norms.write.parquet(f"{at}/norms")
    documents.write.parquet(f"{at}/documents")
    if hashes is not None:
        hashes.write.parquet(f"{at}/hashes")
    facts(options, spark.read.parquet(f"{at}/documents")).coalesce(1).write.parquet(f"{at}/manifest")
    return at


def load(spark: SparkSession, build: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{build}/{t}") for t in TABLES}


def load_hashes(spark: SparkSession, build: str) -> DataFrame:
    """SimHashes of all pages of an index without near duplicates, also of those left out."""
    return spark.read.parquet(f"{build}/hashes")


def size_kb(spark: SparkSession, path: str) -> DataFrame:
    """(files, kb) of the newest build's postings on disk."""
    files = spark.read.parquet(f"{newest(spark, path)}/postings").select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), (F.sum("file_size") / 1024).alias("kb"))
