"""What several operators share: inputs, tables in the shared folder, labelled samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a local session, as in tests, takes a
    folder of its own; a cluster is refused, as its executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='wavelane-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder, in folders by a column if asked for, and read back.

    Cuts the lineage: what is read later comes from shared storage, not from an
    executor that may be lost. The shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path).select(df.columns)
    out.stored_at = path
    return out


def discard(table: DataFrame, part: str = "") -> None:
    """Deletes a stored table, or a folder of it, that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.stored_at}/{part}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str, n: int) -> Column:
    """The remainder of crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a text that a model is fitted on, at most; longer ones are not learned from.
LONGEST_LEARNED = 1 << 16


def bounded_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """(doc_id, ``by``) of ``most`` ids at most of each value of ``by``: those with the smallest hashes.

    The number of distinct ids of each value gives a hash below which somewhat more than ``most`` are expected, so only
    these few ids, bounded by ``most`` and the number of values, leave their tasks, and no value's rows meet in one.
    """
    spark = rows.sparkSession
    kind = rows.schema[by].dataType.simpleString()
    hash_ = F.xxhash64("doc_id")
    edges = []
    for r in rows.groupBy(by).agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect():
        share = (1.3 * most + 20) / max(1, 0.9 * r.n)
        edges.append((r[by], 2**63 - 1 if share >= 1 else int(share * 2**64) - 2**63))
    edge = spark.createDataFrame(edges, f"{by} {kind}, _edge long")
    few = rows.select("doc_id", by).join(F.broadcast(edge), by).withColumn("_h", hash_).where(F.col("_h") <= F.col("_edge")).select("doc_id", by, "_h").distinct().collect()
    picked, count = [], {}
    for r in sorted(few, key=lambda r: (r._h, r.doc_id)):
        count[r[by]] = count.get(r[by], 0) + 1
        if count[r[by]] <= most:
            picked.append((r.doc_id, r[by]))
    return spark.createDataFrame(picked, f"doc_id long, {by} {kind}")


def sampled_texts(docs: DataFrame, picked: DataFrame, *columns: str) -> list:
    """Rows (doc_id, text, columns) of the picked ids in order of the ids' hashes, of a repeated id the least one: bounded in number by
    the sample, in bytes by LONGEST_LEARNED."""
    ids = F.broadcast(picked.select("doc_id").distinct())
    own = docs.where(F.octet_length("text") <= LONGEST_LEARNED).join(ids, "doc_id", "left_semi")
    rows = own.groupBy("doc_id").agg(F.min(F.struct("text", *columns)).alias("_s")).select("doc_id", "_s.*", F.xxhash64("doc_id").alias("_h")).collect()
    return sorted(rows, key=lambda r: (r._h, r.doc_id))
