"""Removal of byte strings that repeat across documents, with suffix arrays.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id.

1. Documents are packed into shards of a few MB, a bucketed table that later steps read in place.
2. Every 50-byte window has an anchor, the least hash of its 16-byte strings; a window's text decides it, so equal
   windows have equal anchors. Hashes of anchors, one for each shard, are compared in buckets; windows whose anchor is
   in one document only are unique. What is left goes on.
3. Windows with one anchor form a short string. A shard's distinct strings go to the bucket of their anchor, with the
   smallest doc_id. There, blocks of strings get suffix arrays (Larsson-Sadakane refinement: ranks of suffixes are
   doubled in length, only unsorted groups are sorted again) and common prefixes (Kasai: a suffix shares one byte less
   than its predecessor in the text), all strings in step. Prefixes of 50 bytes give groups of equal windows; the
   groups of several blocks are merged by binary search.
4. Each shard gets, for its strings, the smallest doc_id of each window, and cuts its documents.

Only one row for each shard goes to a bucket for any string, however many documents hold it. A null text is empty. A
null doc_id counts as larger than any. Rows with one doc_id don't touch each other. Documents under 50 bytes stay. A very long text is a shard of its own, whose
windows are worked on in sections. Columns but doc_id and text are carried along as asked. An empty table stays empty.

Suffix arrays are built for shards of candidate strings, not of documents: whole documents' sorted windows would have to
be sent at 50 bytes each to be merged: where a fifth of them can repeat, ten times the text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strideway.llm.common import in_groups, scratch, sorted_groups, text_of
from strideway.llm.segments import mix

#: Bytes of a match and of an anchor, of a shard, and of the strings that get one suffix array.
MATCH, ANCHOR, SHARD, BLOCK = 50, 16, 4 << 20, 1 << 20
STEPS = MATCH - ANCHOR + 1
#: Bytes of the longest string of windows with one anchor, in whole words of eight.
WIDEST = (MATCH - 1 + STEPS + 7) // 8 * 8
LAST = np.iinfo(np.int64).max
ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 14, 1 << 19


# --- anchors and strings of a shard -------------------------------------------------------------------------------


def words_at(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for k in range(min(8, len(data))):
        count = (len(data) - k + 7) // 8
        out[k::8] = np.frombuffer(padded, f"{order}u8", count=min(count, (len(padded) - k) // 8), offset=k)
    return out


class Runs(NamedTuple):
    """Runs of windows with one anchor: first window, number of windows, hash of the anchor, document."""

    start: np.ndarray
    count: np.ndarray
    hash: np.ndarray
    doc: np.ndarray


def window_runs(data: np.ndarray, ends: np.ndarray) -> Runs:
    """All runs of a shard's bytes; ``ends`` are the documents' ends. Some documents are worked on at once."""
    parts, doc, begin = [], 0, 0
    while doc < len(ends):
        last = max(doc + 1, int(np.searchsorted(ends, begin + BYTES_AT_ONCE, side="right")))
        stop = int(ends[last - 1])
        if last == doc + 1:  # a long document goes in sections, each with the windows that begin in it
            for at in range(begin, max(stop - MATCH + 1, begin + 1), BYTES_AT_ONCE):
                piece = data[at : min(at + BYTES_AT_ONCE + MATCH - 1, stop)]
                own = _window_runs(piece, np.array([len(piece)]))
                parts.append(Runs(own.start + at, own.count, own.hash, own.doc + doc))
        else:
            own = _window_runs(data[begin:stop], ends[doc:last] - begin)
            parts.append(Runs(own.start + begin, own.count, own.hash, own.doc + doc))
        doc, begin = last, stop
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else _window_runs(data, ends)


def _window_runs(data: np.ndarray, ends: np.ndarray) -> Runs:
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < MATCH:
        return Runs(empty, empty, empty.astype(np.uint64), empty)
    words = words_at(data, "<")
    kmers = n - ANCHOR + 1
    hashes = mix(words[:kmers] * np.uint64(0x9E3779B97F4A7C15) + mix(words[8 : 8 + kmers]))
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(kmers, dtype=np.uint64)
    span = 1
    while span * 2 <= STEPS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < STEPS:
        least = np.minimum(least[: len(least) - (STEPS - span)], least[STEPS - span :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    open_at = np.zeros(n + 1, np.int32)
    long = ends - begins >= MATCH
    np.add.at(open_at, begins[long], 1)
    np.add.at(open_at, ends[long] - MATCH + 1, -1)
    valid = np.cumsum(open_at)[: len(anchor)] > 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first[begins[long]] = True
    start = np.flatnonzero(first)
    doc = np.searchsorted(ends, start, side="right")
    stop = np.minimum(np.append(start[1:], n), ends[doc] - MATCH + 1)
    # least hashes are small numbers: mixed again, they spread over the buckets
    return Runs(start, stop - start, mix(hashes[anchor[start]] ^ np.uint64(0xD6E8FEB86659FD93)), doc)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def shard_anchors(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order (so by bucket), whether each is in several documents, and each run's index."""
    found, inverse = np.unique(runs.hash, return_inverse=True)
    low, high = np.full(len(found), LAST), np.full(len(found), -1)
    np.minimum.at(low, inverse, runs.doc)
    np.maximum.at(high, inverse, runs.doc)
    return found, low < high, inverse


def string_rows(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The strings of runs as rows of WIDEST bytes, zero after the end."""
    at = start[:, None] + np.arange(WIDEST)
    out = data[np.minimum(at, len(data) - 1)]
    out[np.arange(WIDEST) >= (count + MATCH - 1)[:, None]] = 0
    return out


def distinct_rows(parts: Iterable[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of first occurrences and the number of each row's first; rows with unlike ``counts`` are unlike.

    Rows are grouped by a hash, then compared with their group's first; a clash of hashes groups by the bytes.
    """
    blocks = list(parts)
    hashes = []
    for rows in blocks:
        h = np.zeros(len(rows), np.uint64)
        for word in rows.view(np.uint64).T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1))
        hashes.append(h)
    own = mix(np.concatenate(hashes) + counts.astype(np.uint64)) if hashes else np.zeros(0, np.uint64)
    _, first, number = np.unique(own, return_index=True, return_inverse=True)
    rows = np.concatenate(blocks) if blocks else np.zeros((0, WIDEST), np.uint8)
    for a in range(0, len(rows), ROWS_AT_ONCE):
        head = first[number[a : a + ROWS_AT_ONCE]]
        same = (rows[a : a + ROWS_AT_ONCE] == rows[head]).all(axis=1) & (counts[a : a + ROWS_AT_ONCE] == counts[head])
        if not same.all():
            whole = np.concatenate([rows, counts[:, None].astype(np.uint8)], axis=1)
            _, first, number = np.unique(whole, axis=0, return_index=True, return_inverse=True)
            return first, number.ravel()
    return first, number


class Strings(NamedTuple):
    """A shard's distinct strings with repeated anchors, and their occurrences."""

    runs: Runs  # of the occurrences
    number: np.ndarray  # of each occurrence's string
    first: np.ndarray  # an occurrence of each string
    bucket: np.ndarray  # of each string; strings are sorted by it


def shard_strings(data: np.ndarray, ends: np.ndarray, masks: dict[int, bytes], buckets: int) -> Strings:
    """``masks``: for each bucket, bits that tell which of the shard's anchors there are in several documents."""
    runs = window_runs(data, ends)
    found, _, inverse = shard_anchors(runs)
    repeated = np.zeros(len(found), bool)
    own = bucket_of(found, buckets)
    for bucket, mask in masks.items():
        a, b = np.searchsorted(own, [bucket, bucket + 1])
        repeated[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
    kept = repeated[inverse]
    runs = Runs(*(x[kept] for x in runs))
    rows = (string_rows(data, runs.start[a : a + ROWS_AT_ONCE], runs.count[a : a + ROWS_AT_ONCE]) for a in range(0, len(runs.start), ROWS_AT_ONCE))
    first, number = distinct_rows(rows, runs.count)
    bucket = bucket_of(runs.hash[first], buckets)
    order = np.lexsort((runs.start[first], bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Strings(runs, place[number], first[order], bucket[order])


# --- suffix arrays of a bucket ------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the place of each, by Larsson-Sadakane refinement.

    Suffixes are sorted by eight bytes (and length, near the end). A suffix's rank is its group's first place; groups
    of more than one are then sorted by the rank of the suffix that far on, which doubles the sorted length.
    """
    n = len(data)
    keys = words_at(data, ">")
    tail = np.maximum(8 - n + np.arange(n, dtype=np.int32), 0).astype(np.int8)  # a missing byte is less than a zero byte
    order = (np.lexsort((-tail, keys)) if (data == 0).any() else np.argsort(keys)).astype(np.int32)
    keys, tail = keys[order], tail[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (tail[1:] != tail[:-1]))[:n]
    place = np.flatnonzero(new).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(place, np.diff(np.append(place, n)))
    unsorted = np.flatnonzero(~(new & np.append(new[1:], True)))
    depth = 8
    while len(unsorted):
        suffix = order[unsorted]
        group = rank[suffix]
        far = suffix.astype(np.int64) + depth
        key = (group.astype(np.int64) << 32) | np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[unsorted] = suffix
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        rank[suffix] = np.repeat(unsorted[heads], np.diff(np.append(heads, len(new))))
        unsorted = unsorted[~(new & np.append(new[1:], True))]
        depth *= 2
    return order, rank


def common_prefixes(data: np.ndarray, before: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each window the bytes (up to MATCH) it shares with the window ``before`` it in order (-1: none).

    Windows are ``count`` positions from each ``start``. All runs go in step from their first window on; a window shares
    at least one byte less with its own predecessor than the window before it did, if that one's successor is a window.
    """
    out = np.zeros(len(data), np.int8)
    words = words_at(data, ">")
    window = np.zeros(len(data) + 1, bool)
    window[np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)] = True
    bounds = np.array([1 << (8 * k) for k in range(8)], np.uint64)
    held = np.zeros(len(start), np.int64)
    for t in range(int(count.max(initial=0))):
        chain = np.flatnonzero(count > t)
        at = start[chain] + t
        other = before[at]
        shared = np.where(other >= 0, np.maximum(held[chain] - 1, 0), 0)
        going = np.flatnonzero(other >= 0)
        while len(going):
            differ = words[at[going] + shared[going]] ^ words[other[going] + shared[going]]
            shared[going] += 8 - np.searchsorted(bounds, differ, side="right")
            going = going[(differ == 0) & (shared[going] < MATCH)]
        shared = np.minimum(shared, MATCH)
        out[at] = shared
        held[chain] = np.where((other >= 0) & window[other + 1], shared, 0)
    return out


class Groups(NamedTuple):
    """Groups of equal windows of a block: the windows by group, each one's group, and a window of each group."""

    window: np.ndarray
    group: np.ndarray
    sample: np.ndarray
    least: np.ndarray  # smallest doc_id of each group


def window_groups(data: np.ndarray, start: np.ndarray, count: np.ndarray, doc: np.ndarray) -> Groups:
    order, _ = suffix_array(data)
    string = np.full(len(data), -1, np.int32)
    string[np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)] = np.repeat(np.arange(len(start)), count)
    order = order[string[order] >= 0]
    before = np.full(len(data), -1, np.int32)
    before[order[1:]] = order[:-1]
    first = common_prefixes(data, before, start, count)[order] < MATCH
    heads = np.flatnonzero(first)
    least = np.minimum.reduceat(doc[string[order]], heads) if len(heads) else doc[:0]
    return Groups(order, np.cumsum(first) - 1, order[heads], least)


def merged_least(keys: list[np.ndarray], least: list[np.ndarray]) -> list[np.ndarray]:
    """The smallest doc_id of each block's windows over all blocks, by binary search in the sorted keys of the others."""
    known, value = keys[0], least[0]
    for own, mine in zip(keys[1:], least[1:], strict=True):
        at = np.searchsorted(known, own)
        hit = known[np.minimum(at, len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
        value = value.copy()
        value[at[hit]] = np.minimum(value[at[hit]], mine[hit])
        known, value = np.insert(known, at[~hit], own[~hit]), np.insert(value, at[~hit], mine[~hit])
    return [value[np.searchsorted(known, own)] for own in keys]


def least_docs(rows: np.ndarray, count: np.ndarray, doc: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one smallest doc_id: string, first window, end, doc_id. ``rows``: distinct strings."""
    sizes = count + MATCH - 1
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // block)) + 1
    parts = [(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True) if b > a]
    found, keys = [], []
    for a, b in parts:
        data = rows[a:b][np.arange(WIDEST) < sizes[a:b, None]]
        start = np.cumsum(sizes[a:b]) - sizes[a:b]
        groups = window_groups(data, start, count[a:b], doc[a:b])
        found.append((start, groups, len(data)))
        if len(parts) > 1:
            keys.append(np.ascontiguousarray(data[groups.sample[:, None] + np.arange(MATCH)]).view(f"S{MATCH}").ravel())
    least = merged_least(keys, [g.least for _, g, _ in found]) if keys else [g.least for _, g, _ in found]
    out = []
    for (a, b), (start, groups, n), values in zip(parts, found, least, strict=True):
        value = np.zeros(n, np.int64)
        value[groups.window] = values[groups.group]
        own = np.repeat(np.arange(b - a), count[a:b])
        step = np.arange(len(own)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
        value = value[start[own] + step]
        head = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1]))[: len(own)]
        at = np.flatnonzero(head)
        out.append((own[at] + a, step[at], step[at] + np.diff(np.append(at, len(own))), value[at]))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- the Spark job ------------------------------------------------------------------------------------------------


def packed(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Shards as a table bucketed by their number, so that what comes back to them is joined in place."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for rows in in_groups(batches, "text", SHARD):
            texts = [t.encode() for t in rows.column("text").to_pylist()]
            ids = np.array([LAST if i is None else i for i in rows.column("doc_id").to_pylist()], np.int64)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.drop_columns(["text"]).schema) as writer:
                writer.write_table(rows.drop_columns(["text"]))
            columns = [pa.array([number]), pa.array([ids.tobytes()]), pa.array([np.array([len(t) for t in texts], np.int64).tobytes()]), pa.array([b"".join(texts)], pa.binary()), pa.array([sink.getvalue().to_pybytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "sizes", "bytes", "rest"])
            number += 1

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *[F.col(f"`{c}`").alias(f"extra_{i}") for i, c in enumerate(extra)])
    shards = rows.mapInArrow(run, "shard long, ids binary, sizes binary, bytes binary, rest binary")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"shards_{uuid.uuid4().hex}"
    writer = shards.write.format("parquet").option("path", scratch(spark, "shards")).option("compression", "zstd")
    writer = writer.option("parquet.block.size", 4 * SHARD).option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1)
    writer.bucketBy(count, "shard").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog forgets it; the files stay, and the plan knows them and their buckets
    return table


def _shards(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, dict]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            data = np.frombuffer(row["bytes"].as_buffer() or b"", np.uint8)
            sizes = np.frombuffer(row["sizes"].as_py(), np.int64)
            yield row["shard"].as_py(), data, np.cumsum(sizes), np.frombuffer(row["ids"].as_py(), np.int64), row


def anchor_messages(shards: DataFrame, buckets: int) -> DataFrame:
    """(bucket, shard, low, high, several): a shard's distinct anchors in a bucket, by 48 bits."""

    def run(batches):
        for shard, data, ends, _, _ in _shards(batches):
            found, several, _ = shard_anchors(window_runs(data, ends))
            own = bucket_of(found, buckets)
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))[: len(own)]
            ends_ = [*cuts[1:].tolist(), len(own)]
            parts = list(zip(cuts.tolist(), ends_, strict=True)) if len(own) else []
            low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[cuts]), pa.array([shard] * len(parts), pa.int64()), pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()),
                 pa.array([high[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([np.packbits(several[a:b]).tobytes() for a, b in parts], pa.binary())],
                names=["bucket", "shard", "low", "high", "several"],
            )

    return shards.select("shard", "ids", "sizes", "bytes").mapInArrow(run, "bucket int, shard long, low binary, high binary, several binary")


def repeated_anchors(messages: DataFrame) -> DataFrame:
    """(shard, bucket, mask): which anchors of a message are in several documents."""

    def run(batches):
        for group in sorted_groups(batches, "bucket"):
            low = [np.frombuffer(x, np.uint32) for x in group.column("low").to_pylist()]
            high = [np.frombuffer(x, np.uint16) for x in group.column("high").to_pylist()]
            sizes = [len(x) for x in low]
            keys = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
            several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group.column("several").to_pylist(), sizes, strict=True)]).astype(bool)
            order = np.argsort(keys)
            keys = keys[order]
            next_same = np.append(keys[1:] == keys[:-1], False)
            hit = np.zeros(len(keys), bool)
            hit[order] = next_same | np.append(False, next_same[:-1])
            hit |= several
            parts = np.split(hit, np.cumsum(sizes)[:-1])
            some = [k for k, p in enumerate(parts) if p.any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.column("shard").to_numpy()[some]), pa.array(group.column("bucket").to_numpy()[some]), pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary())],
                names=["shard", "bucket", "mask"],
            )

    rows = messages.repartition("bucket").sortWithinPartitions("bucket", "shard")
    return rows.mapInArrow(run, "shard long, bucket int, mask binary")


def _masks(row: dict) -> dict[int, bytes]:
    return {x["bucket"]: x["mask"] for x in row["masks"].as_py() or []}


def string_messages(shards: DataFrame, buckets: int) -> DataFrame:
    """(bucket, shard, counts, text, low, high): a shard's distinct strings in a bucket, with least and greatest doc_id."""

    def run(batches):
        for shard, data, ends, ids, row in _shards(batches):
            s = shard_strings(data, ends, _masks(row), buckets)
            n = len(s.first)
            low, high = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(low, s.number, ids[s.runs.doc])
            np.maximum.at(high, s.number, ids[s.runs.doc])
            start, count = s.runs.start[s.first], s.runs.count[s.first]
            cuts = np.flatnonzero(np.append(True, s.bucket[1:] != s.bucket[:-1]))[:n].tolist()
            for a, b in zip(cuts, [*cuts[1:], n], strict=True) if n else ():
                rows = string_rows(data, start[a:b], count[a:b])
                text = rows[np.arange(WIDEST) < (count[a:b] + MATCH - 1)[:, None]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.bucket[a : a + 1]), pa.array([shard]), pa.array([count[a:b].astype(np.uint8).tobytes()]), pa.array([text.tobytes()]), pa.array([low[a:b].tobytes()]), pa.array([high[a:b].tobytes()])],
                    names=["bucket", "shard", "counts", "text", "low", "high"],
                )

    columns = ["shard", "ids", "sizes", "bytes", "masks"]
    return shards.select(columns).mapInArrow(run, "bucket int, shard long, counts binary, text binary, low binary, high binary")


def smallest_docs(messages: DataFrame) -> DataFrame:
    """(shard, bucket, string, begin, end, least): for the shard's strings, windows and the smallest doc_id that has them.

    Only windows that a smaller doc_id has than one of the shard's are told.
    """

    def run(batches):
        for group in sorted_groups(batches, "bucket"):
            counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in group.column("counts").to_pylist()]
            count = np.concatenate(counts)
            sizes = count + MATCH - 1
            text = np.frombuffer(b"".join(group.column("text").to_pylist()), np.uint8)
            low, high = (np.concatenate([np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()]) for c in ("low", "high"))
            start = np.cumsum(sizes) - sizes
            rows = np.concatenate([string_rows(text, start[a : a + ROWS_AT_ONCE], count[a : a + ROWS_AT_ONCE]) for a in range(0, len(start), ROWS_AT_ONCE)])
            first, number = distinct_rows([rows], count)
            doc = np.full(len(first), LAST)
            np.minimum.at(doc, number, low)
            string, begin, end, least = least_docs(rows[first], count[first], doc)
            # from distinct strings back to each shard's
            per = np.searchsorted(string, np.arange(len(first) + 1))
            many = np.diff(per)[number]
            source = np.repeat(np.arange(len(number)), many)
            run_ = np.repeat(per[number], many) + np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
            told = least[run_] < high[source]
            source, run_ = source[told], run_[told]
            ends = np.cumsum([len(c) for c in counts])
            bounds = np.searchsorted(source, np.concatenate([[0], ends]))
            for k, shard in enumerate(group.column("shard").to_pylist()):
                a, b = bounds[k], bounds[k + 1]
                if b > a:
                    own = (source[a:b] - (ends[k] - len(counts[k]))).astype(np.uint32)
                    parts = [own, begin[run_[a:b]].astype(np.uint8), end[run_[a:b]].astype(np.uint8), least[run_[a:b]]]
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), group.column("bucket").combine_chunks()[:1], *(pa.array([p.tobytes()]) for p in parts)], names=["shard", "bucket", "string", "begin", "end", "least"])

    rows = messages.repartition("bucket").sortWithinPartitions("bucket", "shard")
    return rows.mapInArrow(run, "shard long, bucket int, string binary, begin binary, end binary, least binary")


def removed_bytes(data: np.ndarray, ends: np.ndarray, ids: np.ndarray, row: dict, buckets: int) -> np.ndarray:
    """Which bytes of a shard go."""
    change = np.zeros(len(data) + 1, np.int32)
    answers = row["answers"].as_py() or []
    if answers:
        s = shard_strings(data, ends, _masks(row), buckets)
        by_string = np.argsort(s.number, kind="stable")
        bounds = np.searchsorted(s.number[by_string], np.arange(len(s.first) + 1))
        for x in answers:
            string = np.frombuffer(x["string"], np.uint32).astype(np.int64) + np.searchsorted(s.bucket, x["bucket"])
            begin, end = (np.frombuffer(x[c], np.uint8).astype(np.int64) for c in ("begin", "end"))
            least = np.frombuffer(x["least"], np.int64)
            many = np.diff(bounds)[string]
            which = np.repeat(np.arange(len(string)), many)
            place = by_string[np.repeat(bounds[string], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
            hit = ids[s.runs.doc[place]] > least[which]
            which, place = which[hit], place[hit]
            np.add.at(change, s.runs.start[place] + begin[which], 1)
            np.add.at(change, s.runs.start[place] + end[which] - 1 + MATCH, -1)
    return np.cumsum(change)[:-1] > 0


def _answered(docs: DataFrame, extra: list[str]) -> tuple[DataFrame, int]:
    shards = packed(docs, extra)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = repeated_anchors(anchor_messages(shards, buckets)).groupBy("shard").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    path = scratch(docs.sparkSession, "masks")
    masks.write.parquet(path)
    masks = docs.sparkSession.read.schema(masks.schema).parquet(path)
    messages = string_messages(shards.join(masks.hint("shuffle_hash"), "shard"), buckets)
    fields = ["bucket", "string", "begin", "end", "least"]
    answers = smallest_docs(messages).groupBy("shard").agg(F.collect_list(F.struct(*fields)).alias("answers"))
    both = answers.join(masks, "shard", "left")
    return shards.join(both.hint("shuffle_hash"), "shard", "left"), buckets


def _rows(row: dict) -> pa.Table:
    return pa.ipc.open_stream(row["rest"].as_py()).read_all()


def remove_repeats(docs: DataFrame, extra: list[str] = (), spans: str | None = "spans") -> DataFrame:
    """(doc_id, text, spans, and the columns ``extra``): what is left of each text, and the removed byte ranges.

    Where a cut leaves part of a character, that part goes as well. ``spans`` names the column of ranges (None: no such
    column).
    """
    extra = list(extra)
    if spans in ("doc_id", "text", *extra):
        raise ValueError(f"the column {spans} is there already")
    shards, buckets = _answered(docs, extra)
    names = ["doc_id", "text", *([spans] if spans else []), *extra]

    def run(batches):
        for _, data, ends, ids, row in _shards(batches):
            gone = removed_bytes(data, ends, ids, row, buckets)
            texts, found, begin = [], [], 0
            for end in ends.tolist():
                own = gone[begin:end]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                texts.append(data[begin:end][~own].tobytes().decode("utf-8", "ignore"))
                found.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                begin = end
            rest = _rows(row)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            ranges = [pa.array(found, kind)] if spans else []
            columns = [rest.column("doc_id"), pa.array(texts, pa.string()), *ranges, *[rest.column(f"extra_{i}") for i in range(len(extra))]]
            yield from pa.Table.from_arrays(columns, names=names).to_batches()

    own = StructType.fromDDL("doc_id long, text string" + f", `{spans}` array<struct<start: long, end: long>>" * bool(spans))
    return shards.mapInArrow(run, StructType([*own, *(docs.schema[c] for c in extra)]))


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): digests of what :func:`remove_repeats` does, byte for byte."""
    shards, buckets = _answered(docs, [])

    def run(batches):
        for _, data, ends, ids, row in _shards(batches):
            gone = removed_bytes(data, ends, ids, row, buckets)
            out, begin = [], 0
            for end in ends.tolist():
                own = gone[begin:end]
                removed = int(own.sum())
                spans = int((own[1:] & ~own[:-1]).sum()) + int(own[:1].sum())
                kept = data[begin:end] if not removed else data[begin:end][~own]
                out.append((end - begin, removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
                begin = end
            sizes, removed, spans, digest = zip(*out, strict=True)
            columns = [_rows(row).column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            yield from pa.Table.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).to_batches()

    return shards.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS p, h FROM d WHERE length(h) >= 100),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM w),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM s),
hit AS (SELECT doc_id, p FROM m WHERE first_doc < doc_id),
gaps AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM gaps),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, span),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY doc_id),
edges AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY doc_id
),
kept AS (SELECT e.doc_id, string_agg(substr(d.h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM edges e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
