"""Array operations on the words of many texts at once."""

from __future__ import annotations

import re

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Where a long text may be cut without cutting a word.
BREAK = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Masks for the first so many bytes of a lane.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lanes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each word as numbers of eight bytes, zero-filled; where each word's lanes begin; each lane's place in
    its word. A word has one lane at least."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    count = np.maximum((sizes + 7) // 8, 1)
    begins = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(begins, count)
    left = np.clip(np.repeat(sizes, count) - 8 * place, 0, 8)
    return eights[np.minimum(np.repeat(starts, count) + 8 * place, len(data))] & MASKS[left], begins, place


def lane_hashes(values: np.ndarray, begins: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word. Each lane is mixed with its place before the sum, so that no two places weigh alike."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    mixed = mix(values + mix(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(mixed, begins) + mix(sizes.astype(np.uint64)))


def word_hashes(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in a row, and the number of words of each text.

    Words are maximal runs without tab, line feed, vertical tab, form feed, carriage return and blank; A-Z count as a-z.
    Long texts are cut at white space, so that about ``chunk`` bytes are worked on at once.
    """
    hashes, counts, owner, waiting, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal size
        found = _word_hashes(waiting)
        hashes.append(found[0])
        counts.append(found[1])
        waiting.clear()
        size = 0

    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not len(text):
            cut = BREAK.search(text, at + chunk) if len(text) - at > 2 * chunk else None
            end = cut.start() if cut else len(text)
            waiting.append(text[at:end])
            owner.append(i)
            size += end - at + 1
            at = end
            if size >= chunk:
                flush()
            if not len(text):
                break
    if waiting:
        flush()
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.bincount(owner, weights=np.concatenate(counts), minlength=len(texts)).astype(np.int64)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts).translate(LOWER), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    word = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    return lane_hashes(*lanes(data, starts, sizes), sizes), np.diff(np.searchsorted(starts, begins))


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` adjacent words within a text and their text's index; a shorter text with words is one whole."""
    ends = np.cumsum(counts)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), many)
    if not len(owner):
        return np.zeros(0, np.uint64), owner
    start = (ends - counts)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    stop = np.minimum(start + size, ends[owner])
    out = np.zeros(len(owner), np.uint64)
    for k in range(size):
        at = np.minimum(start + k, len(words) - 1)
        out = np.where(start + k < stop, mix(out * np.uint64(0x9E3779B97F4A7C15) + words[at] + np.uint64(1)), out)
    return out, owner
