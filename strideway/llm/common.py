"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: tab, line feed, vertical tab, form feed, carriage return, blank.
SPACES = "\t\n\x0b\x0c\r "


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables below the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only in a local session, as in tests, a local one is made;
    on a cluster without that setting there is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    path = f"{context.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Folders that :func:`scratch` has named and :func:`release` has not removed, oldest first.
_made: list[str] = []


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove scratch folders, from number ``since`` of those that are left on, but for those that ``keep`` reads.

    Results are lazy: call this when all that was computed from them is written elsewhere.
    """
    kept = {f.rpartition("/")[0].rpartition(":")[2].lstrip("/") for f in keep.inputFiles()} if keep is not None else set()
    for path in _made[since:]:
        if path.rpartition(":")[2].lstrip("/") in kept:
            continue
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _made.remove(path)


def made() -> int:
    return len(_made)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on the session sends at most ``rows`` rows at once to Python: ten thousand long texts fill memory twice."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def in_groups(batches: Iterable[pa.RecordBatch], column: str, most: int, rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Arrow batches cut and joined into tables of about ``most`` bytes of ``column`` and ``rows`` rows at most (a row is
    never cut)."""
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, length in enumerate(lengths):
            if size and size + length > most or count == rows:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, count, start = [], 0, 0, i
            size += int(length)
            count += 1
        if len(lengths) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


#: A key with more than this share of all rows is looked up by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000
#: Filter bits for each key; bits in a bitmap row; the most bits of a filter (16 MB), which is broadcast.
BITS_EACH, BITMAP, MOST_BITS = 16, 32768, 1 << 27


def marked(rows: DataFrame, keys: DataFrame, count: int, key: str, flag: str) -> DataFrame:
    """``rows`` with the column ``flag``: false if ``key`` is surely none of the ``count`` rows of ``keys``.

    The filter is a bitmap of hashed keys, broadcast in rows of 4 KB, of ``BITS_EACH`` bits a key and ``MOST_BITS`` at
    most. With more keys it fills up, and spares less work; results don't depend on it. ``flag`` must be no column yet.
    """
    bits = min(BITMAP * -(-max(count, 1) * BITS_EACH // BITMAP), MOST_BITS)
    at, bucket, bitmap = unused(rows, "_place", "_bucket", "_bitmap")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    filters = keys.select(place(key).alias(at)).groupBy(F.floor(F.col(at) / BITMAP).alias(bucket)).agg(F.bitmap_construct_agg(F.col(at) % BITMAP).alias(bitmap))
    byte = f"cast(conv(hex(substring({bitmap}, cast({at} % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"shiftright({byte}, cast({at} % 8 as int)) & 1") == 1
    placed = rows.withColumn(at, place(key)).withColumn(bucket, F.floor(F.col(at) / BITMAP)).join(F.broadcast(filters), bucket, "left")
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(hit, F.lit(False)).alias(flag))


def looked_up(rows: DataFrame, found: DataFrame, key: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``found``, which has a row for each ``key`` and the key's number of rows as ``group_size``.

    Keys with more than HOT_SHARE of ``total`` rows go by broadcast (at most 1 / HOT_SHARE keys), the rest by shuffle.
    """
    hot = found.where(F.col("group_size") > total * HOT_SHARE)
    others = found.where(F.col("group_size") <= total * HOT_SHARE)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(others, key, how))


def sorted_groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The groups of rows with equal ``keys``, which stand together in the partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        new = pa.array([False] * (batch.num_rows - 1))
        for c in columns:
            new = pa.compute.or_(new, pa.compute.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)))
        cuts = [0, *(pa.compute.indices_nonzero(new).to_numpy() + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(c[a].as_py() for c in columns)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)
