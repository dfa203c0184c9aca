"""Exact deduplication with a log-structured merge index of digests.

Every task is a memtable: it sorts the digests of its rows and flushes them as runs of at most ``RUN`` rows, Parquet
files with a Bloom filter on the digest, without a shuffle. Compaction merges the runs that were flushed since the last
one with the level that it made: a row for each digest, with the row that stays (most code points in the original text,
then smallest doc_id) and the number of copies, in sorted runs again. A bitmap filter over the level's repeated digests
tells which rows can be copies; only their texts are read again and verified byte by byte. Should different texts share
a digest, their rows are grouped by the texts themselves.

Texts are equal when identical without tab, line feed, vertical tab, form feed, carriage return and blank; null counts
as empty. Rows with equal doc_id and text all stay if one does. A null doc_id stays only if no row with an id can. A
very long text is hashed whole; if it has copies, two texts of a digest are held by a task at a time. Other columns are
not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.llm.common import SPACES, looked_up, marked, scratch, text_of


def normalised() -> Column:
    return F.translate(text_of(), SPACES, "")


def digest_of(text: Column, bits: int = 256) -> Column:
    """SHA-256 in lower-case hex, cut to ``bits`` (tests make digests collide)."""
    return F.substring(F.sha2(text, 256), 1, bits // 4)


#: Rows of a run, at most.
RUN = 4_000_000
LEVEL = "digest string, n_chars long, keep_id long, group_size long"


class DigestIndex:
    """Runs of (text_sha256, doc_id, n_chars) and the level that compaction makes of them, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, bits: int = 256):
        self.spark, self.path, self.bits = spark, path or scratch(spark, "digests"), bits
        self.flushed, self.merged = 0, 0

    def _write(self, rows: DataFrame, key: str, folder: str) -> None:
        writer = rows.sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("maxRecordsPerFile", RUN)
        writer.option("compression", "zstd").parquet(f"{self.path}/{folder}")

    def flush(self, docs: DataFrame) -> None:
        """Add the rows of ``docs``: each task writes sorted runs with filters."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).cast("long").alias("n_chars"), F.sha2(normalised(), 256).alias("text_sha256"))
        self._write(rows, "text_sha256", f"runs-{self.flushed}")
        self.flushed += 1

    def runs(self, since: int = 0) -> DataFrame:
        """(doc_id, n_chars, text_sha256, digest) of the rows flushed, from flush number ``since`` on."""
        paths = [f"{self.path}/runs-{k}" for k in range(since, self.flushed)]
        found = self.spark.read.schema("doc_id long, n_chars long, text_sha256 string").parquet(*paths)
        return found.withColumn("digest", F.substring("text_sha256", 1, self.bits // 4))

    def level(self) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(f"{self.path}/level-{self.merged}")

    def contains(self, digest: str) -> bool:
        """Whether the level has the digest; filters spare the other runs."""
        return not self.level().where(F.col("digest") == digest).isEmpty()

    def compact(self) -> DataFrame:
        """Merge all runs since the last compaction with its level; returns the new one."""
        rows = self.runs(self.merged).select("digest", "n_chars", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        if self.merged:
            rows = rows.unionByName(self.level())
        best = F.max(F.struct("n_chars", (-F.col("keep_id")).alias("order")))
        rows = rows.groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        self._write(rows.select("digest", "best.n_chars", (-F.col("best.order")).alias("keep_id"), "group_size"), "digest", f"level-{self.flushed}")
        self.merged = self.flushed
        return self.level()


def exact_dedup(docs: DataFrame, bits: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    index = DigestIndex(docs.sparkSession, bits=bits)
    index.flush(docs)
    runs = index.runs()
    total = runs.count()
    repeated = index.compact().where("group_size > 1").select("digest", "keep_id", "group_size")
    count = repeated.count()
    # byte verification: the texts under a digest are equal if the least and the greatest are
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).cast("long").alias("n_chars"), normalised().alias("normal"), digest_of(normalised(), bits).alias("digest"))
    texts = marked(texts, repeated, count, "digest", "maybe").where("maybe").drop("maybe")
    checked = texts.groupBy("digest").agg(F.min("normal").alias("least"), F.max("normal").alias("greatest"))
    path = f"{index.path}/collided"
    checked.where("least <> greatest").select("digest").write.parquet(path)
    collided = docs.sparkSession.read.schema("digest string").parquet(path)
    flagged = marked(runs, repeated, count, "digest", "maybe")
    out = [F.col("doc_id"), F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("text_sha256")]
    single = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    if collided.isEmpty():
        found = looked_up(flagged.where("maybe"), repeated, "digest", total).select(out)
    else:
        plain = flagged.where("maybe").join(collided, "digest", "left_anti")
        mixed = texts.join(collided, "digest", "left_semi")
        groups = mixed.groupBy(F.col("normal").alias("text_key")).agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("order"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
        own = mixed.join(groups.select("text_key", (-F.col("best.order")).alias("keep_id"), "group_size"), F.col("normal") == F.col("text_key"))
        found = looked_up(plain, repeated, "digest", total).select(out).unionByName(own.withColumn("text_sha256", F.sha2("normal", 256)).select(out))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return single.unionByName(found).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents
), k AS (
  SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM k
"""
