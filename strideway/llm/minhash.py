"""Near-duplicate detection: fast similarity sketches, banding, and exact verification.

A document's set holds its distinct shingles of five words (A-Z as a-z; fewer words: the whole sequence; no words or
null: the empty set, linked with nothing). Documents with one word sequence form a class, represented by its smallest
doc_id; all else is done for representatives.

Sketch: in round i each shingle is thrown into one of T bins with a value in [i, i + 1), in the rounds from T on all
into bin i - T, and each bin keeps its least value; a document stops after the round in which its last bin fills. Sets
agree in a bin with the probability of their Jaccard similarity, with concentration as of independent throws.

Banding: a band is ``ROWS`` coordinates; two documents at the threshold share none of ``BANDS`` with probability below
3e-6. Within a band's bucket every member is verified against the bucket's smallest member, which settles groups of
near copies in linear work. In buckets whose members then still lie in different components the members outside the
bucket's largest component are compared with all, in blocks of bounded size: first by sketches and only where two share
no earlier band, then, where the estimate isn't far below the threshold, by exact counts of common shingles. A block
tells only the links that join components, at most one for each member, so that no group is expanded into all its pairs.

Documents are told apart by doc_id and word sequence: rows that agree in both are one node, and rows with one doc_id and
unlike texts are nodes of their own. A null doc_id is linked
with nothing. A very long text is worked on in pieces. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import string
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import in_groups, looked_up, marked, sorted_groups, text_of, written
from strideway.llm.components import connected_components
from strideway.llm.segments import LOWER, mix, shingles, word_hashes

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
#: Pairs are verified if their sketches' estimate is at least this; 5 standard deviations below the threshold.
ESTIMATE = 0.60
#: Bytes and rows of texts that a task works on at once; a row has a sketch of 2 KB.
GROUP, GROUP_ROWS = 2 << 20, 1 << 13
#: Shingles and members of a part of a group, and shingles that are counted at once.
PART_SHINGLES, BLOCK, WIDTH = 200_000, 1024, 2048
UNSET = np.uint64(2**64 - 1)


def sets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (sorted for each text) of all texts in a row, and the size of each set."""
    words, counts = word_hashes(texts)
    found, owner = shingles(words, counts, WORDS)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))[: len(found)]
    return found[new], np.bincount(owner[new], minlength=len(texts))


def sketches(found: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` values for each set; unset for empty sets."""
    out = np.full(len(sizes) * bins, UNSET)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    at = owner * bins
    for i in range(2 * bins):
        if not len(found):
            break
        thrown = mix(found + np.uint64(i + 1) * np.uint64(0x2545F4914F6CDD1D & (2**54 - 1)))
        cell = at + ((thrown >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64) if i < bins else at + (i - bins)
        value = (np.uint64(i) << np.uint64(54)) | (mix(thrown) >> np.uint64(10))
        np.minimum.at(out, cell, value)
        full = (out.reshape(-1, bins) != UNSET).all(axis=1)
        left = ~full[owner]
        found, owner, at = found[left], owner[left], at[left]
    return out.reshape(-1, bins)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A row of BANDS signed 64-bit keys for each sketch."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.astype(np.int64)


def sketch_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key, bands array<long>, brief binary). Map only."""

    def run(batches):
        for rows in in_groups(batches, "text", GROUP, GROUP_ROWS):
            texts = [t.encode() for t in rows.column("text").to_pylist()]
            found, sizes = sets_of(texts)
            sketch = sketches(found, sizes)
            keys = [hashlib.sha256(b" ".join(t.translate(LOWER).split())).digest() if n else None for t, n in zip(texts, sizes.tolist(), strict=True)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(band_keys(sketch).ravel()))
            brief = pa.array([row.tobytes() for row in (sketch & np.uint64(255)).astype(np.uint8)], pa.binary())
            columns = [rows.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(keys, pa.binary()), bands, brief]
            yield from pa.Table.from_arrays(columns, names=["doc_id", "n_shingles", "key", "bands", "brief"]).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, bands array<long>, brief binary")


def texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``needed`` (doc_id) and maybe of some others; only those are moved."""
    return marked(docs, needed, needed.count(), "doc_id", "maybe").where("maybe").drop("maybe")


def verified(pairs: DataFrame, sizes: DataFrame, docs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets are similar. ``sizes`` (doc_id, n_shingles) has all ids of the pairs.

    A document a meets its partners in parts of bounded size; only texts of documents in pairs are moved.
    """
    pairs = written(pairs.join(sizes.select(F.col("doc_id").alias("b"), "n_shingles"), "b"), "pairs")
    weights = pairs.groupBy("a").agg(F.ceil(F.sum("n_shingles") / PART_SHINGLES).cast("int").alias("parts"))
    parted = pairs.join(weights, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = texts_of(docs, needed)
    heads = weights.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.col("a").alias("doc_id"), F.lit(0).alias("role"))
    rows = heads.union(parted.select("a", "part", F.col("b").alias("doc_id"), F.lit(1).alias("role")))
    rows = rows.join(texts, "doc_id").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches):
        head, own = None, None
        for group in in_groups(batches, "text", GROUP):
            found, counts = sets_of([t.encode() for t in group.column("text").to_pylist()])
            ends = np.cumsum(counts)
            linked = []
            columns = [group.column(c).to_pylist() for c in ("a", "doc_id", "role")]
            for a, b, role, end, n in zip(*columns, ends.tolist(), counts.tolist(), strict=True):
                mine = found[end - n : end]
                if role == 0:
                    head, own = a, mine.copy()
                elif head == a and n and len(own):
                    at = np.searchsorted(own, mine)
                    common = int((own[np.minimum(at, len(own) - 1)] == mine).sum())
                    if DENOMINATOR * common >= NUMERATOR * (len(own) + n - common):
                        linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in linked], pa.int64()), pa.array([x[1] for x in linked], pa.int64())], names=["a", "b"])

    return written(rows.select("a", "doc_id", "role", "text").mapInArrow(run, "a long, b long"), "links")


def _could_match(n: str, m: str):
    """Whether set sizes allow the threshold."""
    return F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR


def common_counts(found: np.ndarray, counts: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many shingles the sets ``rows`` share with the sets ``columns``; sets lie in a row in ``found``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    used = np.zeros(len(counts), bool)
    used[rows] = used[columns] = True
    kept = used[owner]
    owner = owner[kept]
    _, number, times = np.unique(found[kept], return_inverse=True, return_counts=True)
    kept = times[number] > 1
    owner, number = owner[kept], (np.cumsum(times > 1) - 1)[number[kept]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    row_of, column_of = (np.full(len(counts), -1) for _ in range(2))
    row_of[rows], column_of[columns] = np.arange(len(rows)), np.arange(len(columns))
    out = np.zeros((len(rows), len(columns)), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, WIDTH):
        i, j = np.searchsorted(number, [a, a + WIDTH])
        parts = []
        for place, size in ((row_of, len(rows)), (column_of, len(columns))):
            at = place[owner[i:j]]
            part = np.zeros((size, WIDTH), np.float32)
            part[at[at >= 0], number[i:j][at >= 0] - a] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def joining_links(rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Of links between members (by index) those that join components that no earlier one joined."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
        a, b = top(int(component[i])), top(int(component[j]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return out


class Block(NamedTuple):
    """Members of one band's bucket that meet: by index their ids, components, set sizes, sketches and keys of all bands."""

    ids: np.ndarray
    component: np.ndarray
    size: np.ndarray
    odd: np.ndarray
    with_big: bool
    brief: np.ndarray
    bands: np.ndarray
    own: int  # the number of the bucket's band


def block_of(group: pa.Table) -> Block:
    ids, component, size = (group.column(c).to_numpy() for c in ("rep", "component", "n_shingles"))
    brief = np.frombuffer(b"".join(group.column("brief").to_pylist()), np.uint8).reshape(len(ids), -1)
    bands = np.concatenate([x.flatten().to_numpy() for x in group.column("bands").chunks]).reshape(len(ids), -1)
    own = int(np.flatnonzero((bands == group.column("band")[0].as_py()).all(axis=0))[0])
    return Block(ids, component, size, np.array(group.column("odd").to_pylist(), bool), group.column("block")[0].as_py().startswith("big"), brief, bands, own)


def likely_pairs(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block (by index; the first is odd) in different components that may reach the threshold, by size and by
    sketch, and share no earlier band, where they meet already."""
    others = np.flatnonzero(~b.odd if b.with_big else b.odd)
    pairs = [np.zeros((2, 0), np.int64)]
    for i in np.flatnonzero(b.odd).tolist():
        near = others if b.with_big else others[others > i]
        near = near[(b.component[near] != b.component[i]) & (np.minimum(b.size[near], b.size[i]) * DENOMINATOR >= np.maximum(b.size[near], b.size[i]) * NUMERATOR)]
        near = near[(b.brief[near] == b.brief[i]).mean(axis=1) >= ESTIMATE]
        near = near[~(b.bands[near, : b.own] == b.bands[i, : b.own]).any(axis=1)]
        pairs.append(np.stack([np.full(len(near), i), near]))
    i, j = np.concatenate(pairs, axis=1)
    return i, j


def remaining_links(members: DataFrame, labels: DataFrame, briefs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): exact links between components, for members of buckets that the first verification left apart.

    ``members`` (band, rep, n_shingles), ``labels`` (id, component), ``briefs`` (doc_id, brief, bands). In a bucket the
    members of its largest component only meet those outside of it, the odd ones. Blocks hold at most about 2 * BLOCK
    members and 2 * PART_SHINGLES shingles. First sketches alone are dealt to the blocks; then texts, of those members
    only that have a likely partner there.
    """
    rows = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("group_size")).where("low < high")
    mixed = written(mixed.select("band", "group_size"), "mixed")
    total = mixed.agg(F.sum("group_size")).first()[0] or 0
    rows = written(looked_up(rows, mixed, "band", total, "inner").select("band", "rep", "component", "n_shingles"), "left")
    shares = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = shares.groupBy("band").agg(F.sum("n").alias("group_size"), F.sum("s").alias("s"), F.max(F.struct("n", "component", "s")).alias("big"))
    parts = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / PART_SHINGLES)).cast("int")
    sizes = sizes.select(
        "band", "group_size", F.col("big.component").alias("big"), parts(F.col("big.n"), F.col("big.s")).alias("big_blocks"),
        parts(F.col("group_size") - F.col("big.n"), F.col("s") - F.col("big.s")).alias("odd_blocks"),
    )
    rows = looked_up(rows, written(sizes, "sizes"), "band", total, "inner")
    odd = F.col("component") != F.col("big")
    own = F.pmod(F.xxhash64("rep"), F.when(odd, F.col("odd_blocks")).otherwise(F.col("big_blocks"))).cast("int")
    name = lambda kind, i, j: F.concat_ws(":", F.lit(kind), i.cast("string"), j.cast("string"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    odd_to = F.concat(F.transform(upto("odd_blocks"), lambda j: name("odd", F.least(F.col("own"), j), F.greatest(F.col("own"), j))), F.transform(upto("big_blocks"), lambda j: name("big", F.col("own"), j)))
    big_to = F.transform(upto("odd_blocks"), lambda i: name("big", i, F.col("own")))
    rows = rows.join(briefs.withColumnRenamed("doc_id", "rep"), "rep").withColumn("odd", odd).withColumn("own", own)
    columns = ["band", "block", "rep", "component", "n_shingles", "odd", "brief", "bands"]
    blocks = rows.withColumn("block", F.explode(F.when(F.col("odd"), odd_to).otherwise(big_to))).select(columns)
    blocks = blocks.repartition("band", "block").sortWithinPartitions("band", "block", "rep")

    def likely(batches):
        for group in sorted_groups(batches, "band", "block"):
            i, j = likely_pairs(block_of(group))
            if len(i):
                yield from group.take(pa.array(np.union1d(i, j))).to_batches()

    def linked(batches):
        for group in sorted_groups(batches, "band", "block"):
            block = block_of(group)
            i, j = likely_pairs(block)
            if len(i):
                found, counts = sets_of([t.encode() for t in group.column("text").to_pylist()])
                mine, other = np.unique(i), np.unique(j)
                common = common_counts(found, counts, mine, other)[np.searchsorted(mine, i), np.searchsorted(other, j)].astype(np.int64)
                good = DENOMINATOR * common >= NUMERATOR * (counts[i] + counts[j] - common)
                links = joining_links(i[good], j[good], block.ids, block.component)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    near = written(blocks.mapInArrow(likely, blocks.schema), "likely")
    needed = written(near.select(F.col("rep").alias("doc_id")).distinct(), "needed")
    texts = texts_of(docs, needed).withColumnRenamed("doc_id", "rep")
    near = near.join(texts, "rep").select(*columns, "text").repartition("band", "block").sortWithinPartitions("band", "block", "rep")
    return written(near.mapInArrow(linked, "a long, b long"), "more")


def _near_dedup(table: DataFrame, docs: DataFrame) -> DataFrame:
    """:func:`near_dedup` for the written sketches of ``docs``, whose doc_ids have one word sequence each."""
    total = table.count()
    filled = table.where("key is not null and doc_id is not null")
    classes = written(filled.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("group_size")), "classes")
    own = filled.select(F.col("doc_id").alias("rep"), "key", "n_shingles", "bands", "brief").dropDuplicates(["rep"])
    reps = own.join(classes.select("rep", "key"), ["rep", "key"])
    bands = written(reps.select("rep", "n_shingles", F.explode("bands").alias("band")), "bands")
    buckets = bands.groupBy("band").agg(F.min("rep").alias("pivot"), F.min(F.struct("rep", "n_shingles")).alias("first"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("group_size"))
    buckets = written(buckets.where("last > pivot").select("band", "pivot", F.col("first.n_shingles").alias("pivot_size"), "group_size"), "buckets")
    members = written(looked_up(bands, buckets, "band", total * BANDS, "inner").select("band", "pivot", "pivot_size", "rep", "n_shingles"), "members")
    sizes = reps.select(F.col("rep").alias("doc_id"), "n_shingles")
    first = written(members.where("rep <> pivot").where(_could_match("n_shingles", "pivot_size")).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "first")
    links = verified(first, sizes, docs)
    labels = connected_components(links)
    more = remaining_links(members.select("band", "rep", "n_shingles"), labels, reps.select(F.col("rep").alias("doc_id"), "brief", "bands"), docs)
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    groups = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "group_size", F.coalesce("component", "rep").alias("component"))
    light = table.select("doc_id", "n_shingles", "key")
    lone = light.where("key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "key")
    found = looked_up(light.where("key is not null and doc_id is not null"), groups, "key", total).select("doc_id", "n_shingles", F.col("component").alias("component_id"), "key")
    return found.union(lone)


def words_sha256(text: Column) -> Column:
    """What :func:`near_dedup` gives as words_sha256, for a text that has words."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.sha2(F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " ")), 256)


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, words_sha256) of every row; the last is null without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    table = written(sketch_table(docs), "sketches")
    torn = table.where("doc_id is not null and key is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    torn = written(torn.where("low <> high").select("doc_id"), "torn")
    if torn.isEmpty():
        found = _near_dedup(table, docs)
    else:  # rows of a doc_id with several texts get ids of their own for the time being
        flagged = marked(docs, torn, torn.count(), "doc_id", "maybe")
        least = docs.agg(F.min("doc_id")).first()[0]
        node = F.lit(least - 1) - F.monotonically_increasing_id()
        odd = written(flagged.where("maybe").join(torn, "doc_id", "left_semi").select("doc_id", "text", node.alias("node")), "odd")
        rest = flagged.where("maybe").join(torn, "doc_id", "left_anti").select("doc_id", "text").union(flagged.where("not maybe").select("doc_id", "text"))
        rows = written(rest.union(odd.select(F.col("node").alias("doc_id"), "text")), "rows")
        found = _near_dedup(written(sketch_table(rows), "sketches"), rows).withColumnRenamed("doc_id", "node")
        found = written(found.join(odd.select("node", "doc_id"), "node", "left").withColumn("doc_id", F.coalesce("doc_id", "node")), "nodes")
        names = found.groupBy("component_id").agg(F.min("doc_id").alias("name"))
        found = found.join(names, "component_id", "left").select("doc_id", "n_shingles", F.col("name").alias("component_id"), "key")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), F.lower(F.hex("key")).alias("words_sha256"))
