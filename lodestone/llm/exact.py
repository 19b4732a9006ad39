"""Exact dedup against a persistent index of digests, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.words import SPACES, bounded, table, text_or_empty, without
from lodestone.operators.keyed import attach
from lodestone.session import cut, shared_dir

SCHEMA = "digest string, keep_id bigint, keep_chars bigint, group_size bigint"


def digest(text: str = "text") -> Column:
    """SHA-256 (hex) of the text without ASCII white space; null counts as empty."""
    return F.sha2(without(text_or_empty(text), SPACES), 256)


def digest_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_chars, digest) of every row, once computed."""
    return cut(docs.select("doc_id", F.length(text_or_empty(text)).cast("long").alias("n_chars"), digest(text).alias("digest")))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays has most code points, then the smallest doc_id (null after all others)."""
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    best = F.min_by(F.struct("doc_id", "n_chars"), order)
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("group_size")).select("digest", F.col("b.doc_id").alias("keep_id"), F.col("b.n_chars").alias("keep_chars"), "group_size")


class DigestIndex:
    """A table of the digests seen so far, in the shared store, bucketed and sorted by digest.

    A batch of digests is joined with it by sort-merge: the table's side is never shuffled, the batch's side is one
    row per distinct digest. Nothing is held in memory. Each admission appends one sorted file per bucket. While a bucket
    is one file, its order is used as it is; several files are sorted again, in their bucket. compact() merges them, and
    admit() does so after every COMPACT_AFTER appends, so that the cost of rewriting is spread over them.
    """

    COMPACT_AFTER = 16

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets, self.appends, self.version = spark, path, buckets, 0, 0
        self.name = f"digest_index_{uuid.uuid4().hex}"

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = 64) -> DigestIndex:
        """The index at ``path``, which may be new; ``buckets`` must stay as it was made with."""
        index = cls(spark, path, buckets)
        index.version = max([0, *(int(p.getPath().getName()[1:]) for p in index._listed() if p.getPath().getName().startswith("v"))])
        index._define()
        # a bucket of one file is in order; without this setting the order is not used
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        return index

    def _file_system(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _listed(self) -> list:
        system, at = self._file_system()
        return list(system.listStatus(at)) if system.exists(at) else []

    def _folder(self) -> str:
        return f"{self.path}/v{self.version}"

    def _define(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._folder()}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (one per digest) whose digest the index lacks."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def _append(self, rows: DataFrame) -> None:
        slim = rows.select("digest", "keep_id", "keep_chars", "group_size").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        slim.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self._folder()).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        self.appends += 1

    def admit(self, groups: DataFrame) -> DataFrame:
        """Append what is new in ``groups`` and return it. A second call with the same groups appends nothing."""
        new = cut(self.unseen(groups))
        self._append(new)
        if self.appends >= self.COMPACT_AFTER:
            self.compact()
        return new

    def compact(self) -> None:
        """One sorted file per bucket again, in a new folder; the old one goes when the new one is complete."""
        old = self._folder()
        rows = self.spark.read.schema(SCHEMA).parquet(old)  # as plain files: those of a bucketed scan need not meet by bucket
        self.version += 1
        fresh = f"{self.name}_v{self.version}"
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self._folder()).saveAsTable(fresh)
        self.spark.sql(f"DROP TABLE {fresh}")  # its files stay
        self._define()
        self._delete(old)
        self.appends = 1

    def _delete(self, folder: str) -> None:
        system, _ = self._file_system()
        system.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._delete(self.path)


def dedup(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row of ``rows`` (from digest_rows) with ``keep_id, group_size`` and ``kept``.

    The index gets the digests it lacks. A row whose digest was in the index before is not kept; its ``keep_id`` is the
    indexed one and ``group_size`` counts the indexed rows. Rows that repeat a doc_id with the same text all
    carry ``kept`` if that doc_id stays; survivors() leaves one of them.
    """
    groups = cut(groups_of(rows))
    new = index.admit(groups)
    total = rows.count()
    sized = groups.select("digest", F.col("group_size").alias("__rows"))
    known = index.table().join(sized.hint("merge"), "digest")
    known = cut(known.join(new.select("digest", F.lit(True).alias("__new")).hint("merge"), "digest", "left"))
    out = attach(rows, known, "digest", "__rows", total)
    return out.withColumn("kept", F.coalesce("__new", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).drop("__rows", "__new", "keep_chars")


def survivors(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per group, with the columns of ``docs``.

    Where a doc_id stands once, it decides; texts are neither hashed again nor moved, unless more ids go than are broadcast.
    Rows that repeat a doc_id are told apart by digest and length, those with equal ones by their columns as JSON; the smallest stays.
    """
    per_id = decided.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    per_id = cut(per_id.filter("n > 1 OR NOT kept"))
    single = docs.join(bounded(per_id.select("__id")), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    repeated = per_id.filter("n > 1 AND kept").select("__id")
    if not repeated.count():
        return single
    again = docs.join(bounded(repeated), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").withColumns({"__d": digest(), "__c": F.length(text_or_empty()).cast("long")})
    kept = decided.filter("kept").select(F.col("doc_id").alias("__id"), "digest", "n_chars").distinct().join(bounded(repeated.withColumnRenamed("__id", "__i")), F.col("__id").eqNullSafe(F.col("__i")), "left_semi")
    kept = kept.toDF("__id", "__digest", "__chars")
    mine = again.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest")) & (F.col("__c") == F.col("__chars")), "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = mine.select("__d", row.alias("__row")).groupBy(F.col("__row.doc_id"), "__d").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*")
    return single.unionByName(one)


def _fresh_index(spark: SparkSession, rows: int) -> DigestIndex:
    return DigestIndex.open(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets=max(8, min(4096, rows // 50_000)))


def _decided(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` deduplicated against an index that starts empty and goes when all are decided."""
    rows = digest_rows(docs)
    index = _fresh_index(spark, rows.count())
    out = dedup(rows, index)  # what it has read from the index is written by then
    index.drop()
    return out


def op7_exact_dedup(spark, folder: str) -> DataFrame:
    """Every document with its group; null texts are empty ones, rows without doc_id come last, an empty table gives no rows."""
    return _decided(spark, table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: one document of each group of equal texts; null, empty and blank texts are one group. See survivors() for repeated ids."""
    return survivors(docs, _decided(spark, docs))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS d FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY d ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id, count(*) OVER (PARTITION BY d) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d AS text_sha256 FROM r
"""

