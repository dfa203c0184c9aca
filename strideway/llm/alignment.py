"""Alignment of two tokenizers' tokens over the bytes of each text, and how common each pair of linked ids is.

Tokens of A (byte-level BPE) and of B (pieces with byte fallback) are lists of end offsets over the same bytes. The
shorter list of a document drives a galloping search through the longer one: every end starts from the place of an
earlier one, steps grow by doubling until they pass it, and binary search settles the rest. Ends that both lists have cut
the tokens into groups; from the ranks found follows which range of the other side's tokens each token overlaps.

Documents are worked on in blocks of bounded text. A block keeps, for each document, its distinct linked pairs as numbers
into the block's list of distinct pairs, and for each of these how many of its documents have it. Only the lists are
summed over the corpus: a very common pair has one row for each block. Each pair's count, and whether it is its A id's
highest, goes back to the block, where the documents' sums are made. The highest counts have a row for each id of A and
are broadcast: A's vocabulary bounds them.

Null and empty texts, and texts that the pieces don't give back byte for byte, have no tokens: zeros and an empty string.
Repeated rows count as documents each; a null doc_id is kept. Ties for the highest count all count. Long texts are cut
at lone blanks, where both tokenizers begin a token, so that a task holds one chunk and one document's distinct pairs; a
text without such a blank is one chunk. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm import bpe
from strideway.llm.common import in_groups, text_of, written

TOKENIZER_A = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_B = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text in a block, and in a chunk of it that is aligned at once.
BLOCK, CHUNK = 8 << 20, 1 << 20
#: Ends of the driving list that are searched first, then so many times more of them in each round.
FIRST, FACTOR = 4096, 8
SPACE_PIECE = "▁"


class Pieces:
    """A piece vocabulary with byte fallback: the bytes of each id, and words as ids."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        if SPACE_PIECE not in names or any(SPACE_PIECE in x.lstrip(SPACE_PIECE) for x in names):
            raise ValueError("no piece is a lone blank, or one goes on after a blank: words can't be encoded one by one")
        self.blank = names.index(SPACE_PIECE)
        self.bytes_of = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE_PIECE, " ").encode() for i, x in zip(ids, names, strict=True)]
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        #: Stands for a word whose pieces don't give it back.
        self.wrong = len(names)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that begin with a blank, which the model adds itself, and their number for each word."""
        found = self.model.encode([w[1:].decode() for w in words], num_threads=1)
        found = [[self.blank] if w == b" " else x for x, w in zip(found, words, strict=True)]  # to an empty text nothing is added
        of = self.bytes_of
        found = [x if b"".join([of[i] for i in x]) == w else [self.wrong] for x, w in zip(found, words, strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum())), counts


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.lru_cache(maxsize=4)
def _strings(path_a: str, path_b: str) -> tuple[list[str], int]:
    """Decimal ids of A, then of B, each with the separators of :func:`group_codes`; and B's first place."""
    n_a, n_b = len(bpe.vocabulary(path_a).bytes_of), len(pieces(path_b).bytes_of)
    return [f"{i}{s}" for n in (n_a, n_b) for i in range(n) for s in ",|;"], 3 * n_a


def gallop(keys: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each of the ascending ``keys``, the first place in ``longer``, ascending too, whose value isn't less."""
    place = np.zeros(len(keys), np.int64)
    stride = 1
    while len(keys) > FIRST * stride:
        stride *= FACTOR
    at = np.arange(0, len(keys), stride)
    low = np.zeros(len(at), np.int64)
    while True:
        place[at] = _search(keys[at], longer, low)
        if stride == 1:
            return place
        stride //= FACTOR
        at = np.arange(0, len(keys), stride)
        at = at[at % (stride * FACTOR) != 0]
        low = place[at - at % (stride * FACTOR)]  # the end before it that is placed already


def _search(keys: np.ndarray, longer: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Doubling steps from ``low``, which isn't beyond the place, then binary search; all keys in step."""
    size = len(longer)
    low, high = low.copy(), low.copy()
    open_, step = np.arange(len(keys)), 1
    while len(open_):
        probe = high[open_]
        beyond = (probe >= size) | (longer[np.minimum(probe, size - 1)] >= keys[open_])
        open_ = open_[~beyond]
        low[open_] = high[open_] + 1
        high[open_] += step
        step *= 2
    high = np.minimum(high, size)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = longer[middle] < keys[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def links(ends_a: np.ndarray, ends_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray, a_drives: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of A and of B of every link, tokens of A and of B that end where the other side ends too).

    The ends of all texts in a row ascend; ``docs_a`` and ``docs_b`` are each token's text, ``a_drives`` says of each
    text whether A's list is the shorter one.
    """
    out = []
    for ends, docs, drives, others in ((ends_a, docs_a, a_drives, ends_b), (ends_b, docs_b, ~a_drives, ends_a)):
        own = np.flatnonzero(drives[docs])
        last = gallop(ends[own], others)  # the last token of the other side that overlaps
        common = others[last] == ends[own]
        # the first one: where the token before ends, or the next if the other side ends there too
        first = np.append(0, last + common)[: len(own)]
        gap = np.flatnonzero(np.append(True, np.diff(own) != 1)[: len(own)])  # a text that the other side drives is between
        first[gap] = np.searchsorted(others, np.where(own[gap] > 0, ends[own[gap] - 1], 0), side="right")
        counts = last - first + 1
        total = np.arange(int(counts.sum()))
        theirs = np.repeat(first - (np.cumsum(counts) - counts), counts) + total
        out.append((np.repeat(own, counts), theirs, own[common], last[common]))
    (a1, b1, ca1, cb1), (b2, a2, cb2, ca2) = out
    return np.concatenate([a1, a2]), np.concatenate([b1, b2]), np.sort(np.concatenate([ca1, ca2])), np.sort(np.concatenate([cb1, cb2]))


def group_codes(ids_a: np.ndarray, ids_b: np.ndarray, common_a: np.ndarray, common_b: np.ndarray, first_b: int) -> np.ndarray:
    """The tokens of both sides group by group as places in :func:`_strings`: A's joined by `,`, `|`, B's, `;`."""
    group_a = np.searchsorted(common_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(common_b, np.arange(len(ids_b)))
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    sep_a, sep_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    sep_a[common_a], sep_b[common_b] = 1, 2
    codes[np.arange(len(ids_a)) + np.append(0, common_b + 1)[group_a]] = 3 * ids_a.astype(np.int64) + sep_a
    codes[np.arange(len(ids_b)) + common_a[group_b] + 1] = first_b + 3 * ids_b.astype(np.int64) + sep_b
    return codes


class Aligner:
    """Both tokenizers with the words that a task has met."""

    def __init__(self, path_a: str, path_b: str):
        self.vocab, self.pieces = bpe.vocabulary(path_a), pieces(path_b)
        self.sizes_a = np.array([len(x) for x in self.vocab.bytes_of], np.int64)
        self.sizes_b = np.append(self.pieces.sizes, 0)
        self.strings, self.first_b = _strings(path_a, path_b)
        self.table_a = bpe.WordTable(bpe.pair_index_encoder(path_a))
        self.table_b = bpe.WordTable(self.pieces.encode)

    def ids_of_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of texts that begin with the blank it adds, and their number for each text."""
        coded = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        blank = data == 32
        begins = blank & ~np.append(False, blank[:-1])  # a run of blanks begins a word, and is one with what follows
        begins[np.cumsum(sizes) - sizes] = True
        starts = np.flatnonzero(begins)
        numbers = self.table_b.numbers_of(data, starts)
        self.table_b.resolve()
        flat, counts = self.table_b.spread(numbers)
        sums = np.append(0, np.cumsum(counts))
        ends = np.searchsorted(starts, np.cumsum(sizes))
        self.table_b.forget()
        return flat, np.diff(np.append(0, sums[ends]))

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For texts that begin with the added blank: (tokens of A, of B, groups of each text, their groups, whether B
        gives the text back, the text of each link, the link's pair as a << 32 | b)."""
        ids_a, n_a = bpe.encode_texts(texts, self.table_a, {})
        ids_b, n_b = self.ids_of_b(texts)
        docs_a, docs_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        wrong = np.bincount(docs_b[ids_b == self.pieces.wrong], minlength=len(texts)) > 0
        for docs, ids, of in ((docs_a, ids_a, self.sizes_a), (docs_b, ids_b, self.sizes_b)):
            wrong |= np.bincount(docs, weights=of[ids], minlength=len(texts)).astype(np.int64) != sizes
        keep_a, keep_b = ~wrong[docs_a], ~wrong[docs_b]
        ids_a, docs_a, ids_b, docs_b = ids_a[keep_a], docs_a[keep_a], ids_b[keep_b], docs_b[keep_b]
        n_a, n_b = np.where(wrong, 0, n_a), np.where(wrong, 0, n_b)
        zero = np.zeros(len(texts), np.int64)
        if not len(ids_a):
            return n_a, n_b, zero, [""] * len(texts), ~wrong, zero[:0], zero[:0]
        link_a, link_b, common_a, common_b = links(np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]), docs_a, docs_b, n_a <= n_b)
        codes = group_codes(ids_a, ids_b, common_a, common_b, self.first_b)
        words = list(map(self.strings.__getitem__, codes.tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(words[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        pair = (ids_a[link_a].astype(np.int64) << 32) | ids_b[link_b].astype(np.int64)
        return n_a, n_b, np.bincount(docs_a[common_a], minlength=len(texts)), groups, ~wrong, docs_a[link_a], pair


def _chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts with the added blank in chunks, with the number of each; long ones cut at lone blanks."""
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        text, at = " " + text, 0
        while at < len(text):
            cut = bpe.SAFE.search(text, at + CHUNK) if len(text) - at > 2 * CHUNK else None
            end = cut.start() if cut else len(text)
            owners.append(i)
            held.append(text[at:end])
            size += end - at
            at = end
            if size >= CHUNK:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def _sums(owners: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (owner, pair) as one, ascending, their times added."""
    order = np.lexsort((pairs, owners))
    owners, pairs, times = owners[order], pairs[order], times[order]
    new = np.flatnonzero(np.append(True, (owners[1:] != owners[:-1]) | (pairs[1:] != pairs[:-1]))[: len(owners)])
    return owners[new], pairs[new], np.add.reduceat(times, new) if len(new) else times


class Block:
    """What a block's documents have: tokens, groups, links, and their distinct pairs."""

    def __init__(self, texts: list[str], aligner: Aligner):
        many = len(texts)
        self.n_a, self.n_b, self.n_groups = (np.zeros(many, np.int64) for _ in range(3))
        digests: dict[int, hashlib._Hash] = {}
        right = np.ones(many, bool)
        empty = np.zeros(0, np.int64)
        sums = [(empty, empty, empty)]
        for owners, held in _chunks(texts):
            n_a, n_b, n_groups, groups, ok, link_doc, pair = aligner.chunk(held)
            own = np.array(owners)
            for total, part in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)):
                np.add.at(total, own, part)
            right[own[~ok]] = False
            for i, text in zip(owners, groups, strict=True):
                if i in digests:
                    digests[i].update(b";")
                digests.setdefault(i, hashlib.sha256()).update(text[:-1].encode())
            values, number = np.unique(pair, return_inverse=True)
            key, times = np.unique(own[link_doc] * max(len(values), 1) + number, return_counts=True)
            sums.append((key // max(len(values), 1), values[key % max(len(values), 1)], times))
        owners, pairs, times = _sums(*map(np.concatenate, zip(*sums, strict=True)))
        kept = right[owners]
        self.owners, pairs, self.times = owners[kept], pairs[kept], times[kept]
        self.values, self.numbers, self.n_docs = np.unique(pairs, return_inverse=True, return_counts=True)
        self.n_links = np.bincount(self.owners, weights=self.times, minlength=many).astype(np.int64)
        for x in (self.n_a, self.n_b, self.n_groups):
            x[~right] = 0
        self.digests = [digests[i].hexdigest() if i in digests and right[i] else "" for i in range(many)]

    def packed(self) -> tuple[list[bytes], list[bytes]]:
        """The pairs of each document, as steps from number to number, and how often it has each."""
        cuts = np.searchsorted(self.owners, np.arange(len(self.n_a) + 1)).tolist()
        slices = list(zip(cuts, cuts[1:], strict=False))
        return [np.diff(self.numbers[a:b], prepend=0).astype("<i4").tobytes() for a, b in slices], [self.times[a:b].astype("<i4").tobytes() for a, b in slices]


def aligned_blocks(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """The blocks of all documents, written: rows of documents (``place`` is null) and of a block's distinct pairs."""

    def run(batches):
        aligner = Aligner(path_a, path_b)
        task = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(in_groups(batches, "text", BLOCK)):
            block = Block(rows.column("text").to_pylist(), aligner)
            counts = [pa.array(x, pa.int64()) for x in (block.n_a, block.n_b, block.n_groups, block.n_links)]
            pairs, times = block.packed()
            number = pa.array(np.full(rows.num_rows, task + k), pa.int64())
            yield from _full([number, rows.column("doc_id"), *counts, pa.array(block.digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())], DOC_COLUMNS)
            number = pa.array(np.full(len(block.values), task + k), pa.int64())
            place = pa.array(np.arange(len(block.values)), pa.int32())
            a, b = pa.array(block.values >> 32, pa.int32()), pa.array(block.values & 0xFFFFFFFF, pa.int32())
            yield from _full([number, place, a, b, pa.array(block.n_docs, pa.int64())], PAIR_COLUMNS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return written(rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in COLUMNS.items())), "aligned")


COLUMNS = {"block": "long", "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pairs": "binary", "times": "binary", "place": "int", "a": "int", "b": "int", "n_docs": "long"}
DOC_COLUMNS, PAIR_COLUMNS = list(COLUMNS)[:9], ["block", "place", "a", "b", "n_docs"]
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _full(arrays: list, names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches with all columns, those not among ``names`` null."""
    own = dict(zip(names, arrays, strict=True))
    many = len(arrays[0])
    table = pa.table({c: own[c] if c in own else pa.nulls(many, ARROW[t]) for c, t in COLUMNS.items()}, schema=pa.schema([(c, ARROW[t]) for c, t in COLUMNS.items()]))
    yield from table.to_batches(max_chunksize=rows)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold a linked pair of ids, and whether this is A's id's highest count."""
    counts = written(blocks.where("place is not null").groupBy("a", "b").agg(F.sum("n_docs").alias("count")), "counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    blocks = aligned_blocks(docs, path_a, path_b)
    found = blocks.where("place is not null").select("block", "place", "a", "b").join(pair_counts(blocks), ["a", "b"]).select(F.col("block").alias("of_block"), "place", "count", "best")

    def run(own: pa.Table, counted: pa.Table) -> pa.Table:
        place = counted.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = counted.column("count").to_numpy()
        best[place] = counted.column("best").to_numpy().astype(np.int64)
        n_best, count_sum = [], []
        for pairs, times in zip(own.column("pairs").to_pylist(), own.column("times").to_pylist(), strict=True):
            number, times = np.cumsum(np.frombuffer(pairs, "<i4"), dtype=np.int64), np.frombuffer(times, "<i4").astype(np.int64)
            n_best.append(int(times @ best[number]))
            count_sum.append(int(times @ count[number]))
        kept = [own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), own.column("groups_sha256")], names=[*RESULT])

    schema = ", ".join(f"{c} {t}" for c, t in RESULT.items())
    return blocks.where("place is null").select(DOC_COLUMNS).groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(run, schema)


RESULT = {"doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}
