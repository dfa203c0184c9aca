"""SimHash fingerprints of documents, and the search for near ones in permuted block tables.

Terms are pairs of adjacent words (a text of one word: that word), A-Z as a-z. Each distinct term votes with its hash
on the signed bits of the fingerprint, with weight 1 + floor(log2(times it occurs)). A bit is set where the votes are
positive. A text without words (null and empty too) has the fingerprint 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.llm.common import in_groups, looked_up, marked, sorted_groups, text_of, written
from strideway.llm.segments import mix, shingles, word_hashes

#: Bits of a fingerprint; the radius of near ones; fingerprints of a part of a key.
BITS, RADIUS, BLOCK = 128, 3, 1024
#: Text bytes that a task holds at once, and terms whose votes are added at once.
GROUP, TERMS = 8 << 20, 1 << 17
EDIT_SCHEMA = "part int, kind string, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def simhash(texts: list[str], bits: int = BITS) -> np.ndarray:
    """A row of bits / 8 bytes for each text."""
    words, counts = word_hashes([t.encode() for t in texts])
    terms, owner = shingles(words, counts, 2)
    order = np.lexsort((terms, owner))
    terms, owner = terms[order], owner[order]
    new = np.append(True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1]))[: len(terms)]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(terms)))
    weight = 1 + np.floor(np.log2(times)).astype(np.int64) if len(first) else times
    terms, owner = np.repeat(terms[first], weight), np.repeat(owner[first], weight)
    votes = np.zeros((len(texts), bits), np.int32)
    lanes = mix(np.arange(1, bits // 64 + 1, dtype=np.uint64))
    for a in range(0, len(terms), TERMS):
        own = owner[a : a + TERMS]
        hashed = np.stack([mix(terms[a : a + TERMS] ^ lane) for lane in lanes], axis=1)
        signs = np.unpackbits(hashed.view(np.uint8), axis=1)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones = np.add.reduceat(signs, starts, axis=0, dtype=np.int32)
        votes[own[starts]] += 2 * ones - np.diff(np.append(starts, len(own)))[:, None].astype(np.int32)
    return np.packbits(votes > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits of fingerprints."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / (8 * a.shape[1])


def fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint): lower-case hex. Map only."""

    def run(batches):
        for rows in in_groups(batches, "text", GROUP):
            marks = simhash(rows.column("text").to_pylist(), bits)
            yield from pa.Table.from_arrays([rows.column("doc_id"), pa.array([m.tobytes().hex() for m in marks], pa.string())], names=["doc_id", "fingerprint"]).to_batches()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def hamming(a: Column, b: Column) -> Column:
    """The Hamming distance of two fingerprints in hex, by words of 60 bits."""
    total = F.lit(0)
    for i in range(0, BITS // 4, 15):
        part = [F.conv(F.substring(x, i + 1, 15), 16, 10).cast("long") for x in (a, b)]
        total = total + F.bit_count(part[0].bitwiseXOR(part[1]))
    return total


def near_fingerprints(marks: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b, distance): all pairs of distinct fingerprints within ``radius``, a < b, and no pair of equal ones.

    ``marks`` has a column ``fingerprint``; its rows stand for classes of equal fingerprints. With radius + 2 blocks,
    two near fingerprints agree in two blocks at least; there is a table for each choice of two blocks, permuted to
    stand first, and only rows of a table that agree in them are compared.
    """
    count = blocks or radius + 2
    digits = BITS // 4
    if count > digits:
        raise ValueError("the radius needs more blocks than there are digits")
    edges = [digits * i // count for i in range(count + 1)]
    own = marks.select("fingerprint").distinct()
    part = lambda i: F.substring("fingerprint", edges[i] + 1, edges[i + 1] - edges[i])
    keys = F.array(*[F.concat(F.lit(f"{i},{j}:"), part(i), part(j)) for i in range(count) for j in range(i + 1, count)])
    tables = own.select("fingerprint", F.explode(keys).alias("key"))
    left, right = tables.withColumnRenamed("fingerprint", "a"), tables.withColumnRenamed("fingerprint", "b")
    pairs = left.join(right, "key").where("a < b").select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))
    return pairs.where(F.col("distance") <= radius).distinct()


def block_edges(radius: int) -> list[int]:
    """Where the radius + 2 blocks of a fingerprint's hex digits begin, and the end."""
    count, digits = radius + 2, BITS // 4
    if count > digits:
        raise ValueError("the radius needs more blocks than there are digits")
    return [digits * i // count for i in range(count + 1)]


def block_counts(digits: np.ndarray, part: np.ndarray, table: int, radius: int) -> np.ndarray:
    """For each fingerprint of a block (a row of hex digits) how many others there are within ``radius``.

    Members of one ``part`` are compared only if all are of that part. A pair counts in the first table (choice of two
    blocks) in which it agrees.
    """
    edges = block_edges(radius)
    choices = [(i, j) for i in range(radius + 2) for j in range(i + 1, radius + 2)]
    alone = (part == part[0]).all()
    found = np.zeros(len(digits), np.int64)
    packed = digits[:, ::2] << 4 | digits[:, 1::2]
    for i in range(len(digits) - 1):
        near = np.flatnonzero(np.bitwise_count(packed[i + 1 :] ^ packed[i]).sum(axis=1) <= radius) + i + 1
        near = near if alone else near[part[near] != part[i]]
        if not len(near):
            continue
        same = digits[near] == digits[i]
        agree = [same[:, a:b].all(axis=1) for a, b in zip(edges, edges[1:], strict=False)]
        first = np.argmax(np.stack([agree[x] & agree[y] for x, y in choices]), axis=0)
        near = near[(first == table) & agree[choices[table][0]] & agree[choices[table][1]]]
        found[near] += 1
        found[i] += len(near)
    return found


def near_counts(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n_near): how many other fingerprints are within ``radius``, where there are any.

    ``marks`` (fingerprint) has each fingerprint once. As in :func:`near_fingerprints`, two near ones agree in two blocks,
    and there is a permuted table for each choice of two. Of the tables' rows only those whose key may occur again are
    moved; a key with many fingerprints is split into blocks of about 2 * BLOCK, each pair of parts in one of them. Pairs
    are counted where they are found, and not sent.
    """
    edges = block_edges(radius)
    part = lambda i: F.substring("fingerprint", edges[i] + 1, edges[i + 1] - edges[i])
    choices = [(i, j) for i in range(radius + 2) for j in range(i + 1, radius + 2)]
    keys = F.array(*[F.xxhash64(F.lit(k), part(i), part(j)) for k, (i, j) in enumerate(choices)])
    tables = marks.select("fingerprint", F.posexplode(keys).alias("table", "key"))
    sizes = written(tables.groupBy("key").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "keys")
    total, count = sizes.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count(F.lit(1))).first()
    rows = looked_up(marked(tables, sizes, count, "key", "maybe").where("maybe").drop("maybe"), sizes, "key", total, "inner")
    parts = F.ceil(F.col("group_size") / BLOCK).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fingerprint"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("key", "table", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fingerprint")
    rows = rows.repartition("key", "table", "low", "high").sortWithinPartitions("key", "table", "low", "high")

    def run(batches):
        for group in sorted_groups(batches, "key", "table", "low", "high"):
            if group.num_rows > 1:
                digits = np.frombuffer(bytes.fromhex("".join(group.column("fingerprint").to_pylist())), np.uint8).reshape(group.num_rows, -1)
                digits = np.stack([digits >> 4, digits & 15], axis=2).reshape(group.num_rows, -1)
                found = block_counts(digits, group.column("part").to_numpy(), group.column("table")[0].as_py(), radius)
                some = pa.array(np.flatnonzero(found))
                yield from pa.table({"fingerprint": group.column("fingerprint").take(some), "n": pa.array(found[found > 0])}).to_batches()

    return rows.mapInArrow(run, "fingerprint string, n long").groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


def _edits(ids, texts: list[str], marks: np.ndarray, nexts: list[str], next_marks: np.ndarray, part: int, kind: str) -> pa.Table:
    sizes = list(map(len, texts))
    edited = [t[: n - n // 2] + u[: n // 2] for t, n, u in zip(texts, sizes, nexts, strict=True)]
    new = simhash(edited)
    hexes = lambda m: pa.array([x.tobytes().hex() for x in m], pa.string())
    count = len(texts)
    return pa.Table.from_arrays(
        [pa.array([part] * count, pa.int32()), pa.array([kind] * count, pa.string()), pa.array(ids, pa.int64()), pa.nulls(count, pa.string()), pa.array(sizes, pa.int64()),
         pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), hexes(marks), hexes(new), pa.array(likeness(marks, new)), pa.array(likeness(marks, next_marks))],
        names=["part", "kind", "doc_id", "text", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _ends(ids, texts: list[str], marks: np.ndarray, part: int, kind: str) -> pa.Table:
    rows = [{"part": part, "kind": kind, "doc_id": i, "text": t, "fingerprint": m.tobytes().hex()} for i, t, m in zip(ids, texts, marks, strict=True)]
    names = [x.split()[0] for x in EDIT_SCHEMA.split(", ")]
    kinds = {"part": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return pa.Table.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=pa.schema([(n, kinds.get(n, pa.string())) for n in names]))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's beginning; see the contract in the README.

    The texts are sorted by doc_id in range partitions, each moved once. A partition pairs its rows with their
    followers as they stream by; only its first and last text are kept for the seams, which are joined by number.
    Rows with one doc_id are in the order of their texts. A single document is its own follower. n_near is how many other
    fingerprints of the table are within RADIUS bits of the text's, by :func:`near_counts`. Columns but doc_id and text are
    not read; an empty table gives an empty result; the texts of a group (a very long one alone) are held at once.
    """

    def run(batches):
        part, last, head = TaskContext.get().partitionId(), None, False
        for rows in in_groups(batches, "text", GROUP):
            ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
            marks = simhash(texts)
            if not head:
                head = True
                yield from _ends(ids[:1], texts[:1], marks[:1], part, "head").to_batches()
            if last:
                ids, texts, marks = last[0] + ids, last[1] + texts, np.concatenate([last[2], marks])
            if len(ids) > 1:
                yield from _edits(ids[:-1], texts[:-1], marks[:-1], texts[1:], marks[1:], part, "inner").to_batches()
            last = ids[-1:], texts[-1:], marks[-1:]
        if last:
            yield from _ends(*last, part, "tail").to_batches()

    def seams(batches):
        for rows in in_groups(batches, "text", GROUP):
            ids, texts, nexts = (rows.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
            marks, next_marks = simhash(texts), simhash(nexts)
            yield from _edits(ids, texts, marks, nexts, next_marks, -1, "inner").select(out).to_batches()

    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ranged = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = written(ranged.mapInArrow(run, EDIT_SCHEMA), "edits")
    parts = rows.where("kind = 'head'").select("part")
    # a row for each partition: the number of the next one that has rows, after the last the first
    order = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    heads = rows.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = rows.where("kind = 'tail'").select("part", "doc_id", "text").join(after, "part").join(heads, "next_part").select("doc_id", "text", "next_text")
    schema = ", ".join(x for x in EDIT_SCHEMA.split(", ") if x.split()[0] in out)
    found = rows.where("kind = 'inner'").select(out).unionByName(tails.mapInArrow(seams, schema).select(out))
    marks = written(rows.where("kind in ('inner', 'tail')").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size")), "marks")
    near = written(near_counts(marks.select("fingerprint")).join(marks, "fingerprint"), "near")
    total, count = marks.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0], near.count()
    flagged = marked(found, near, count, "fingerprint", "maybe")
    hit = looked_up(flagged.where("maybe").drop("maybe"), near, "fingerprint", total).select(*out, F.coalesce("n_near", F.lit(0)).alias("n_near"))
    return hit.unionByName(flagged.where("not maybe").select(*out, F.lit(0).cast("long").alias("n_near")))
