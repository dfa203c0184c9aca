"""Byte-level BPE over partitions: encoding with a pair occurrence index, and decoding.

A partition's texts are cut into words by array operations, each distinct word is encoded once, and the ids of all
words are spread back over the documents. Distinct words are encoded together by :class:`PairIndex`: every adjacent
pair of symbols is mapped to all its positions; the ranks that occur are applied in ascending order, each to all its
positions at once, and only the lists of the pairs beside a merge are changed.

Null text counts as empty and has no ids; an empty table has no rows; repeated rows are encoded each time. Texts of any
length are whole: long ones are worked on in pieces that are cut where a word begins. No column but doc_id and text is
read. The string of a special token inside a text becomes that token's id.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from strideway.llm.common import in_groups, text_of
from strideway.llm.segments import lane_hashes, lanes

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Texts are cut into words in chunks of about so many bytes, and encoded together in groups of so many.
CHUNK, GROUP = 4 << 20, 32 << 20
#: Distinct words that a task keeps from group to group.
KNOWN_WORDS = 1_000_000
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NONE = np.iinfo(np.int32).max


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    first = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(sys.maxunicode + 1)], np.uint8)
    table = np.where(first == ord("L"), LETTER, np.where(first == ord("N"), NUMBER, OTHER)).astype(np.uint8)
    table[WHITE] = SPACE
    return table


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary: bytes of each id, merges by rank, and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        ids = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for word, i in ids.items():
            if word not in self.special:
                self.bytes_of[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int32)
        self.right = np.array([ids[b] for _, b in merges], np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = (self.left.astype(np.int64) << 32) | self.right
        self._order = np.argsort(keys).astype(np.int32)
        self._keys = np.append(keys[self._order], np.iinfo(np.int64).max)
        self._order = np.append(self._order, NONE).astype(np.int32)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._order[at], NONE)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Encodes many words at once; see the module's docstring."""

    def __init__(self, vocab: Vocabulary, words: list[bytes]):
        self.vocab = vocab
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.cumsum(lengths)
        self.symbol = vocab.byte_ids[data]
        self.after = np.arange(1, len(data) + 1, dtype=np.int32)
        self.before = np.arange(-1, len(data) - 1, dtype=np.int32)
        filled = lengths > 0
        self.after[self.ends[filled] - 1] = -1
        self.before[(self.ends - lengths)[filled]] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._note(np.flatnonzero(self.after >= 0).astype(np.int32))

    def _note(self, at: np.ndarray) -> None:
        """Put the pairs that begin at ``at`` on their ranks' lists."""
        ranks = self.vocab.ranks(self.symbol[at], self.symbol[self.after[at]])
        kept = ranks != NONE
        at, ranks = at[kept], ranks[kept]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, places in zip(ranks[starts].tolist(), np.split(at, cuts), strict=True):
            if rank in self.places:
                self.places[rank].append(places)
            else:
                self.places[rank] = [places]
                heapq.heappush(self.active, rank)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """Apply all ranks; returns the ids of all words and the number of ids of each word."""
        vocab, symbol, after, before = self.vocab, self.symbol, self.after, self.before
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.places.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, made = int(vocab.left[rank]), int(vocab.right[rank]), int(vocab.made[rank])
            second = after[at]
            at = at[(symbol[at] == a) & (second >= 0) & (symbol[second] == b)]
            if a == b and len(at) > 1:  # in a run of equal symbols every other pair goes, from the left
                joined = np.append(False, after[at[:-1]] == at[1:])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            if not len(at):
                continue
            second = after[at]
            following = after[second]
            symbol[at] = made
            symbol[second] = -1
            after[at] = following
            has = following >= 0
            before[following[has]] = at[has]
            previous = before[at]
            self._note(np.concatenate([previous[previous >= 0], at[has]]))
        alive = symbol >= 0
        counts = np.diff(np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], self.ends])])
        return symbol[alive].astype(np.uint32), counts


def pair_index_encoder(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    vocab = vocabulary(path)
    return lambda words: PairIndex(vocab, words).merge()


def word_starts(chars: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the words of byte-level pre-tokenization start, in code points of joined non-empty documents.

    Words are contractions, and runs of letters, of numbers or of other signs with at most one blank before them; of
    other white space all but the last character before a word is one word.
    """
    kinds = char_classes()[chars]
    first = np.empty(len(chars), bool)
    first[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    first[doc_starts] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(chars))
    opens = np.zeros(len(chars), bool)
    opens[doc_starts] = True
    last_in_doc = np.append(opens[start[1:]], True)
    kind = kinds[start]
    blank_before = np.append(False, (kind[:-1] == SPACE) & (chars[end[:-1] - 1] == 0x20)) & ~opens[start]
    word = kind != SPACE
    marks = np.zeros(len(chars) + 1, bool)
    marks[start[word] - blank_before[word]] = True
    # contractions: a lone apostrophe without a blank, followed by letters of the same document
    lone = np.flatnonzero(word & (chars[start] == ord("'")) & (end - start == 1) & ~blank_before & ~last_in_doc)
    if len(lone):
        lone = lone[kind[lone + 1] == LETTER]
        one = chars[start[lone] + 1]
        length = end[lone + 1] - start[lone + 1]
        two = np.where(length >= 2, chars[np.minimum(start[lone] + 2, len(chars) - 1)], 0)
        size = np.zeros(len(lone), np.int64)
        for text in ("re", "ve", "ll"):
            size[(one == ord(text[0])) & (two == ord(text[1]))] = 2
        for text in "stmd":
            size[one == ord(text)] = 1
        took = size > 0
        lone, size, length = lone[took], size[took], length[took]
        marks[start[lone + 1]] = False
        more = length > size
        marks[start[lone + 1][more] + size[more]] = True
    gap = ~word
    final = gap & last_in_doc
    marks[start[final]] = True
    inner = gap & ~last_in_doc
    long = inner & (end - start >= 2)
    marks[start[long]] = True
    alone = inner & (chars[end - 1] != 0x20)
    marks[end[alone] - 1] = True
    return np.flatnonzero(marks[:-1])


class WordTable:
    """The distinct words that a task has met, with the ids of each. Words are found by a hash and told apart by their bytes."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lanes, self.lane_starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.clashes: dict[bytes, int] = {}
        self.waiting: list[bytes] = []

    def _add(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers for new words, which wait until :meth:`resolve`."""
        values, begins, _ = lanes(data, starts, sizes)
        self.lane_starts = np.concatenate([self.lane_starts, begins + len(self.lanes)])
        self.lanes = np.concatenate([self.lanes, values])
        self.sizes = np.concatenate([self.sizes, sizes])
        whole = data.tobytes()
        self.waiting += [whole[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        return np.arange(len(self.sizes) - len(sizes), len(self.sizes), dtype=np.int32)

    def numbers_of(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each word of ``data``, UTF-8 bytes that are cut at ``starts``."""
        sizes = np.diff(np.append(starts, len(data)))
        values, begins, place = lanes(data, starts, sizes)
        own, first, inverse = np.unique(lane_hashes(values, begins, place, sizes), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, own)
        found = np.zeros(len(own), bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == own[inside]
        numbers = np.empty(len(own), np.int32)
        numbers[found] = self.numbers[at[found]]
        new = ~found
        numbers[new] = self._add(data, starts[first[new]], sizes[first[new]])
        self.hashes = np.insert(self.hashes, at[new], own[new])
        self.numbers = np.insert(self.numbers, at[new], numbers[new])
        numbers = numbers[inverse]
        if len(begins):  # words with one hash may still differ
            known = self.lane_starts[numbers]
            other = np.minimum(np.repeat(known - begins, np.diff(np.append(begins, len(values)))) + np.arange(len(values)), len(self.lanes) - 1)
            same = np.logical_and.reduceat(self.lanes[other] == values, begins) & (self.sizes[numbers] == sizes)
            for i in np.flatnonzero(~same).tolist():
                word = data[starts[i] : starts[i] + sizes[i]].tobytes()
                if word not in self.clashes:
                    self.clashes[word] = int(self._add(data, starts[i : i + 1], sizes[i : i + 1])[0])
                numbers[i] = self.clashes[word]
        return numbers

    def resolve(self) -> None:
        if self.waiting:
            ids, counts = self.encode(self.waiting)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids = np.concatenate([self.ids, ids])
            self.counts = np.concatenate([self.counts, counts])
            self.waiting = []

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and the count of each."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        shift = self.starts[numbers] - (ends - counts)
        return self.ids[np.repeat(shift, counts) + np.arange(total)], counts

    def forget(self, most: int = KNOWN_WORDS) -> None:
        if len(self.sizes) > most or len(self.lanes) > 4 * most:
            self._clear()


#: Where a long text can be cut: a lone blank always begins a word.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def _segments(texts: list[str], special: dict[str, int], chunk: int = CHUNK) -> tuple[list[str], list[int], list[int]]:
    """Texts cut at special tokens, and long ones at blanks: the segments, the document of each, and the id that follows
    each (-1: none)."""
    some = any(s in t for s in special for t in texts)
    if not some and max(map(len, texts), default=0) <= 2 * chunk:
        return texts, list(range(len(texts))), [-1] * len(texts)
    marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
    pieces, docs, then = [], [], []

    def add(i: int, piece: str, mark: int) -> None:
        at = 0
        while len(piece) - at > 2 * chunk and (found := SAFE.search(piece, at + chunk)):
            pieces.append(piece[at : found.start()])
            docs.append(i)
            then.append(-1)
            at = found.start()
        pieces.append(piece[at:])
        docs.append(i)
        then.append(mark)

    for i, text in enumerate(texts):
        at = 0
        for m in marks.finditer(text):
            add(i, text[at : m.start()], special[m[0]])
            at = m.end()
        add(i, text[at:], -1)
    return pieces, docs, then


def _cut(texts: list[str], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of all texts, and how many words each text has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    counts = np.zeros(len(texts), np.int64)
    if not joined:
        return np.zeros(0, np.int32), counts
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begins = np.cumsum(sizes) - sizes
    starts = word_starts(chars, begins[sizes > 0])
    counts = np.searchsorted(starts, begins + sizes) - np.searchsorted(starts, begins)
    data = np.frombuffer(joined.encode(), np.uint8)
    if len(data) > len(chars):
        width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
        starts = (np.cumsum(width, dtype=np.int64) - width)[starts]
    return table.numbers_of(data, starts), counts


def encode_texts(texts: list[str], table: WordTable, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and the number of ids of each text."""
    pieces, docs, then = _segments(texts, special)
    cut, at, size = [], 0, 0
    for i, piece in enumerate(pieces):
        size += len(piece)
        if size >= CHUNK or i == len(pieces) - 1:
            cut.append(_cut(pieces[at : i + 1], table))
            at, size = i + 1, 0
    table.resolve()
    ids, per_piece = [], []
    for numbers, words in cut:
        flat, counts = table.spread(numbers)
        ids.append(flat)
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(words)
        per_piece.append(sums[ends] - sums[ends - words])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    counts = np.concatenate(per_piece) if per_piece else np.zeros(0, np.int64)
    marked = np.array(then, np.int64)
    if (marked >= 0).any():
        ends = np.cumsum(counts)
        flat = np.insert(flat, ends[marked >= 0], marked[marked >= 0].astype(np.uint32))
        counts = counts + (marked >= 0)
    table.forget()
    return flat, np.bincount(np.array(docs, np.int64), weights=counts, minlength=len(texts)).astype(np.int64)


def encoded_groups(batches: Iterable[pa.RecordBatch], path: str, group: int = GROUP) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The tables of a partition with the ids of the column ``text`` in a row and their number for each row."""
    table = WordTable(pair_index_encoder(path))
    for rows in in_groups(batches, "text", group):
        texts = [x or "" for x in rows.column("text").to_pylist()]
        yield rows, *encode_texts(texts, table, vocabulary(path).special)


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): every text's ids and their decoded text. Map only."""

    def run(batches):
        vocab = vocabulary(path)
        for rows, flat, counts in encoded_groups(batches, path):
            ends = np.cumsum(counts)
            texts = [decode(flat[e - n : e].tolist(), vocab) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.astype(np.int32)))
            yield from pa.Table.from_arrays([rows.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]).to_batches()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of :func:`encode_documents`, made where the ids are."""

    def run(batches):
        vocab = vocabulary(path)
        sha = hashlib.sha256
        for rows, flat, counts in encoded_groups(batches, path):
            coded, decoded, end = [], [], 0
            for n in counts.tolist():
                ids = flat[end : end + n].tolist()
                end += n
                coded.append(sha(",".join(map(vocab.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha(decode(ids, vocab).encode()).hexdigest())
            yield from pa.Table.from_arrays([rows.column("doc_id"), pa.array(counts), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).to_batches()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
