"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME`` bytes, with the number of lines that end, of code
points and of bytes before each frame. To cut a text after so many lines, the frame that holds the cut is found by its
counts and only that one is decompressed; whole sections are streamed frame by frame, so that a task holds one frame of
text, however long the text. The transformed text is stored as frames too; the original is rebuilt from these alone.

Null counts as empty. Empty texts and texts that contain a mark are left as they are (`plain`). Ties don't occur: equal
rows get equal results, as the cut depends on doc_id and text only; a null doc_id is drawn as an empty string. Other
columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import in_groups, text_of, written

#: Bytes of text in a frame; bytes of texts, or of frames, that are worked on together.
FRAME, GROUP = 64 << 10, 8 << 20
LEVEL = 1
#: Marks before prefix, suffix and middle; the seed of the draws; of 100 texts, how many are transformed, and how many of these suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

FRAMES = "frames array<binary>, lines array<long>, chars array<long>, bytes array<long>"
STORE = f"doc_id long, {FRAMES}, n long, marked boolean"
TRANSFORMED = f"doc_id long, {FRAMES}, n long, form string, prefix_chars long, middle_chars long"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Shared by all texts of a process: each holds buffers of its own."""
    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


class Frames:
    """A text as frames: ``lines``, ``chars`` and ``bytes`` are counts before each frame, and of the whole at the end."""

    def __init__(self, frames: list[bytes], lines: list[int], chars: list[int], sizes: list[int]):
        self.frames, self.lines, self.chars, self.bytes = frames, lines, chars, sizes
        self._held: tuple[int, bytes] = (-1, b"")

    @classmethod
    def of(cls, pieces: Iterable[bytes], size: int = FRAME) -> Frames:
        """Pieces of UTF-8 as frames of at most ``size`` bytes, cut after a line where one ends, else between code points."""
        writer = _codec()[0]
        out = cls([], [0], [0], [0])

        def add(data: bytes) -> None:
            out.frames.append(writer.compress(data))
            out.lines.append(out.lines[-1] + data.count(b"\n"))
            out.chars.append(out.chars[-1] + len(data.decode()))
            out.bytes.append(out.bytes[-1] + len(data))

        held = b""
        for piece in pieces:
            held = held + piece if held else piece
            at = 0
            while len(held) - at > size:
                end = held.rfind(b"\n", at, at + size) + 1
                if end <= at:
                    end = at + size
                    while held[end] & 0xC0 == 0x80:
                        end -= 1
                add(held[at:end])
                at = end
            held = held[at:]
        if held:
            add(held)
        return out

    def read(self, k: int) -> bytes:
        if self._held[0] != k:
            self._held = (k, _codec()[1].decompress(self.frames[k], max_output_size=self.bytes[k + 1] - self.bytes[k]))
        return self._held[1]

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the end of line number ``units``; a last line without an end ends with the text."""
        if not units:
            return 0, 0
        if units > self.lines[-1]:
            return self.bytes[-1], self.chars[-1]
        k = bisect_left(self.lines, units) - 1
        data, at = self.read(k), 0
        for _ in range(units - self.lines[k]):
            at = data.index(b"\n", at) + 1
        return self.bytes[k] + at, self.chars[k] + len(data[:at].decode())

    def stream(self, start: int, end: int) -> Iterator[bytes]:
        """Bytes ``start`` to ``end``, frame by frame."""
        k = bisect_right(self.bytes, start) - 1
        while start < end:
            stop = min(end, self.bytes[k + 1])
            yield self.read(k)[start - self.bytes[k] : stop - self.bytes[k]]
            start, k = stop, k + 1

    def find(self, mark: bytes, start: int = 0) -> int:
        """Where ``mark`` first is from byte ``start`` on, or -1; it may lie across frames."""
        tail, at = b"", start
        for data in self.stream(start, self.bytes[-1]):
            if (found := (tail + data).find(mark)) >= 0:
                return at - len(tail) + found
            at += len(data)
            tail = (tail + data)[1 - len(mark) :]
        return -1

    def row(self) -> tuple:
        self._held = (-1, b"")
        return self.frames, self.lines, self.chars, self.bytes


def units(text: Frames) -> int:
    """The number of lines; text after the last line's end is a line."""
    if not text.frames:
        return 0
    return text.lines[-1] + (text.read(len(text.frames) - 1)[-1:] != b"\n")


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits."""
    code = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(code[i : i + 8], 16) for i in range(0, 32, 8)]


def choose(doc_id: int | None, n: int, has_mark: bool, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, int]:
    """The form, and after how many units the prefix and the middle end."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not n or has_mark or h3 % 100 >= rate else "spm" if h4 % 100 < suffix_first else "psm"
    return form, first, second


def transform(text: Frames, form: str, first: int, second: int) -> tuple[Frames, int | None, int | None]:
    """The output, and the code points of prefix and middle."""
    if form == "plain":
        return text, None, None
    (a, a_chars), (b, b_chars) = text.cut(first), text.cut(second)
    prefix, middle, suffix = (0, a), (a, b), (b, text.bytes[-1])
    order = [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)] if form == "psm" else [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)]

    def pieces() -> Iterator[bytes]:
        for mark, part in order:
            yield mark.encode()
            yield from text.stream(*part)

    return Frames.of(pieces()), a_chars, b_chars - a_chars


def restore(output: Frames, form: str) -> Iterator[bytes]:
    """The original text, from the output alone."""
    size = output.bytes[-1]
    if form == "plain":
        yield from output.stream(0, size)
        return
    marks = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    at, starts = 0, {}
    for mark in marks:
        at = output.find(mark.encode(), at)
        starts[mark] = at
        at += len(mark)
    ends = dict(zip(marks, [*(starts[m] for m in marks[1:]), size], strict=True))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(starts[mark] + len(mark), ends[mark])


def _slices(text: str) -> Iterator[bytes]:
    for i in range(0, len(text), FRAME):
        yield text[i : i + FRAME].encode()


def _frames_in(rows: pa.Table) -> Iterator[Frames]:
    for row in zip(*(rows.column(c).to_pylist() for c in ("frames", "lines", "chars", "bytes")), strict=True):
        yield Frames(*row)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _out(columns: list, ddl: str) -> Iterator[pa.RecordBatch]:
    schema = _arrow(ddl)
    yield from pa.Table.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, schema.types, strict=True)], schema=schema).to_batches()


def frame_store(docs: DataFrame) -> DataFrame:
    """(doc_id, frames, lines, chars, bytes, n, marked) of every row: the texts as frames with their counts, written."""

    def run(batches):
        for rows in in_groups(batches, "text", GROUP):
            stored = [Frames.of(_slices(t or "")) for t in rows.column("text").to_pylist()]
            has = [any(f.find(m) >= 0 for m in MARKS) for f in stored]
            yield from _out([rows.column("doc_id"), *map(list, zip(*(f.row() for f in stored), strict=True)), list(map(units, stored)), has], STORE)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, STORE), "frames")


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Stored rows in tables of about ``GROUP`` bytes of frames."""
    for batch in batches:
        at, size = 0, 0
        for i, frames in enumerate(batch.column("frames")):
            size += sum(len(x.as_py()) for x in frames.values) if frames.values is not None else 0
            if size >= GROUP:
                yield pa.Table.from_batches([batch.slice(at, i + 1 - at)])
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield pa.Table.from_batches([batch.slice(at)])


def transformed(store: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, output as frames, n, form, prefix_chars, middle_chars) of every stored text."""

    def run(batches):
        for rows in _grouped(batches):
            out = []
            ids, counts, has = (rows.column(c).to_pylist() for c in ("doc_id", "n", "marked"))
            for text, doc_id, n, m in zip(_frames_in(rows), ids, counts, has, strict=True):
                form, first, second = choose(doc_id, n, m, seed, rate, suffix_first)
                output, prefix_chars, middle_chars = transform(text, form, first, second)
                out.append((*output.row(), n, form, prefix_chars, middle_chars))
            yield from _out([rows.column("doc_id"), *map(list, zip(*out, strict=True))], TRANSFORMED)

    return store.mapInArrow(run, TRANSFORMED)


def fim_texts(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, form, output string): whole transformed texts."""

    def run(batches):
        for rows in _grouped(batches):
            texts = [b"".join(f.stream(0, f.bytes[-1])).decode() for f in _frames_in(rows)]
            yield from _out([rows.column("doc_id"), rows.column("form"), texts], "doc_id long, form string, output string")

    return transformed(frame_store(docs), seed, rate, suffix_first).mapInArrow(run, "doc_id long, form string, output string")


def fim_digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row; digests are of the
    streamed output and of the text rebuilt from it."""

    def run(batches):
        for rows in _grouped(batches):
            digests = []
            for output, form in zip(_frames_in(rows), rows.column("form").to_pylist(), strict=True):
                whole, original = hashlib.sha256(), hashlib.sha256()
                for data in output.stream(0, output.bytes[-1]):
                    whole.update(data)
                for data in restore(output, form):
                    original.update(data)
                digests.append((whole.hexdigest(), original.hexdigest()))
            kept = [rows.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
            yield from _out([*kept, *map(list, zip(*digests, strict=True))], DIGESTS)

    return transformed(frame_store(docs), seed, rate, suffix_first).mapInArrow(run, DIGESTS)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), e AS (
  SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS UBIGINT) FOR k IN range(0, 4)] AS h FROM d
), f AS (
  SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= {RATE} THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM e
), g AS (
  SELECT doc_id, t, n, form, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM g
"""
