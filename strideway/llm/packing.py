"""Cost-balanced packing of documents into training sequences.

A document is its token ids and a final id 0. It is cut into full sequences of ``capacity`` ids and a rest. The rests
of a group of documents go, longest first, to the sequence of lowest estimated cost (linear in its tokens plus
quadratic in each piece, for attention within documents) that has room; if none has room for a whole rest, the cheapest
open sequence is filled and what is left goes on. The group's sequences have as many places as its rests have ids: full
ones, and powers of two for what remains, as those are not padded. So no sequence has padding.

Groups lie within a partition: nothing is shuffled. Null text counts as empty (one id, the final 0). Equal lengths go
in the order of the rows; repeated rows are packed each time; an empty table has no pieces. No column but doc_id and text is
read. A very long document fills sequences of its own, of which only the rest is packed with others.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strideway.llm.bpe import DEFAULT_TOKENIZER, encoded_groups
from strideway.llm.common import text_of

CAPACITY = 1024
#: Estimated cost of a piece of n ids: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Text bytes of a group, at most (a longer document is a group of its own).
GROUP = 16 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def open_sequences(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Capacities of sequences with ``total`` places: full ones, then a power of two for each bit of what remains."""
    rest = total % capacity
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * (total // capacity) + tail, np.int64)


def pack_rests(rests: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (index in ``rests``, start in it, length, sequence, offset in it) of lengths below ``capacity``.

    Open sequences wait in a heap by cost for each room, so that a rest looks at no more than ``capacity`` of them. Of
    sequences with one cost that with the least room is taken, then the first.
    """
    size = open_sequences(int(rests.sum()), capacity)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    for k, room in enumerate(size.tolist()):
        heaps[room].append((0.0, k))  # equal costs: already a heap
    least = np.array([h[0][0] if h else np.inf for h in heaps])
    least[0] = np.inf
    out = []
    for i in np.argsort(-rests, kind="stable").tolist():
        start, left = 0, int(rests[i])
        while left:
            room = left + int(np.argmin(least[left:]))
            if least[room] == np.inf:  # no room for all of it: the cheapest open sequence is filled
                room = int(np.argmin(least))
            cost, k = heapq.heappop(heaps[room])
            least[room] = heaps[room][0][0] if heaps[room] else np.inf
            n = min(left, room)
            out.append((i, start, n, k, int(size[k]) - room))
            if room > n:
                cost += LINEAR * n + QUADRATIC * n * n
                heapq.heappush(heaps[room - n], (cost, k))
                least[room - n] = heaps[room - n][0][0]
            start, left = start + n, left - n
    return out


def pack_documents(docs: DataFrame, path: str = DEFAULT_TOKENIZER, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Map only."""

    def run(batches):
        sequence = TaskContext.get().partitionId() << 40
        for rows, flat, counts in encoded_groups(batches, path, group):
            ids = np.insert(flat, np.cumsum(counts), 0).astype("<u4")
            lengths = counts + 1
            begins = np.cumsum(lengths) - lengths
            full = lengths // capacity
            doc = np.repeat(np.arange(len(lengths)), full)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * capacity
            parts = [np.stack([doc, start, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64)])]
            rest = np.flatnonzero(lengths % capacity)
            packed = np.array(pack_rests(lengths[rest] % capacity, capacity), np.int64).reshape(-1, 5).T
            if packed.size:
                parts.append(np.stack([rest[packed[0]], full[rest[packed[0]]] * capacity + packed[1], packed[2], packed[3] + len(doc), packed[4]]))
            doc, start, size, number, offset = np.concatenate(parts, axis=1)
            view = memoryview(ids.tobytes())
            at = (begins[doc] + start) * 4
            crc = [zlib.crc32(view[a : a + 4 * n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
            table = pa.Table.from_arrays(
                [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(number + sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += int(number.max(initial=-1)) + 1
            yield from table.to_batches()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA)
