"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three letters in a row binds (multiplies) the first
letter's vector rotated twice, the second's rotated once and the third's. A text's vector bundles (adds) the vectors of
its n-grams; a language's prototype bundles those of its training texts, less the mean of all prototypes scaled to one
length, which is what all languages share. A text gets the language whose prototype has the largest cosine with its own
vector; the score is (1 + cosine) / 2.

Text is lower-cased; letters beyond the first ``LETTERS`` classes share classes by their code point; any run of other
characters is one gap. A text that is null or has no letter is `und` with score 0. Texts with null `lang` teach nothing.
If nothing was learned, all texts are `und`. Repeated rows count each time. Ties go to the first language by name. An
empty table gives an empty result. More than ``LANGUAGES`` languages are an error, as a vector for each is held by the
driver and every task. A text of any length is read whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strideway.llm.bpe import LETTER, char_classes
from strideway.llm.common import in_groups

LETTERS, DIMENSIONS, SEED = 64, 1024, 20240229
#: Texts counted together (by code points), n-grams bundled together, and the most languages that are compared.
GROUP, BUNDLE, LANGUAGES = 2 << 20, 8192, 1000
UNKNOWN, CLASSES = "und", 32


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@functools.cache
def letter_vectors() -> list[np.ndarray]:
    """For each place in an n-gram the (rotated) vectors of the letters."""
    vectors = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))
    return [np.roll(vectors, k, axis=1) for k in (2, 1, 0)]


def ngram_vectors(codes: np.ndarray) -> np.ndarray:
    first, second, third = letter_vectors()
    return (first[codes // LETTERS**2] * second[codes // LETTERS % LETTERS] * third[codes % LETTERS]).astype(np.float32)


@functools.cache
def letter_codes() -> np.ndarray:
    """0 for what is no letter, and a class for each letter."""
    points = np.arange(len(char_classes()))
    return np.where(char_classes() == LETTER, 1 + points % (LETTERS - 1), 0).astype(np.uint8)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all n-grams, the index of the text of each, and which texts have a letter."""
    lowered = ["\n" + t.lower() + "\n" for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    letters = letter_codes()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    kept = np.append(True, (letters[1:] != 0) | (letters[:-1] != 0) | (owner[1:] != owner[:-1]))[: len(letters)]
    letters, owner = letters[kept].astype(np.int32), owner[kept]
    if len(letters) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(texts), bool)
    codes = (letters[:-2] * LETTERS + letters[1:-1]) * LETTERS + letters[2:]
    inside = owner[:-2] == owner[2:]
    some = np.bincount(owner[letters > 0], minlength=len(texts)) > 0
    return codes[inside], owner[:-2][inside], some


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and which texts have a letter."""
    codes, owner, some = ngrams(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    present = np.flatnonzero(np.bincount(codes, minlength=LETTERS**3)) if len(codes) else codes
    number = np.zeros(LETTERS**3, np.int32)
    number[present] = np.arange(len(present))
    at = number[codes]
    for a in range(0, len(present), BUNDLE):
        width = min(BUNDLE, len(present) - a)
        own = (at >= a) & (at < a + width) if len(present) > BUNDLE else slice(None)
        counts = np.bincount(owner[own].astype(np.int64) * width + (at[own] - a), minlength=len(texts) * width)
        out += counts.reshape(len(texts), width).astype(np.float32) @ ngram_vectors(present[a : a + width])
    return out, some


def _blocks(rows: pa.Table):
    """Slices of at most 256 rows."""
    for a in range(0, rows.num_rows, 256):
        yield rows.slice(a, 256)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): how often each n-gram occurs in the texts of each language."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for rows in in_groups(batches, "text", GROUP):
            langs = np.array(rows.column("lang").to_pylist(), object)
            texts = rows.column("text").to_pylist()
            codes, owner, _ = ngrams(texts)
            names, index = np.unique(langs.astype(str), return_inverse=True)
            for k, name in enumerate(names):
                found = np.bincount(codes[index[owner] == k], minlength=LETTERS**3)
                totals[name] = totals[name] + found if name in totals else found
        for name, found in totals.items():
            codes = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(found[codes])], names=["lang", "code", "n"])

    learned = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, code int, n long")
    return learned.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their profiles of one length, not centred, from labelled texts.

    A language's n-grams are at most LETTERS ** 3 rows, whatever the size of the corpus; a vector for each language,
    and no more than ``LANGUAGES`` of them, comes to the driver.
    """

    def bundle(key, rows):
        total = np.zeros(DIMENSIONS)
        codes, n = rows["code"].to_numpy(), rows["n"].to_numpy(np.float64)
        for a in range(0, len(codes), BUNDLE):
            total += n[a : a + BUNDLE] @ ngram_vectors(codes[a : a + BUNDLE])
        import pandas as pd

        return pd.DataFrame({"lang": [key[0]], "vector": [total]})

    found = ngram_counts(docs).groupBy("lang").applyInPandas(bundle, "lang string, vector array<double>").limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found = sorted(found, key=lambda r: r.lang)
    vectors = np.array([r.vector for r in found]).reshape(-1, DIMENSIONS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return [r.lang for r in found], vectors


def centred(vectors: np.ndarray) -> np.ndarray:
    if len(vectors) > 1:
        vectors = vectors - vectors.mean(axis=0)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from labelled texts."""
    languages, vectors = profiles(docs)
    return languages, centred(vectors)


def identify(docs: DataFrame, languages: list[str], vectors: np.ndarray, plain: np.ndarray | None = None) -> DataFrame:
    """(row, lang_pred, score) of every text; ``row`` is a struct of the columns of ``docs``. Map only.

    With ``plain`` profiles also likeness, the greatest cosine with one of them, and length_class, by powers of two.
    """

    def run(batches):
        weights = vectors.astype(np.float32).T
        for group in in_groups(batches, "_text", GROUP):
            for rows in _blocks(group):
                own, some = bundles(rows.column("_text").to_pylist())
                some &= len(languages) > 0
                best, score, likeness = np.zeros(len(own), np.int64), np.zeros(len(own)), np.zeros(len(own))
                if some.any():
                    cosine = (own @ weights) / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
                    best = cosine.argmax(axis=1)
                    score = np.clip((1 + cosine.max(axis=1).astype(np.float64)) / 2, 0, 1)
                names = [languages[k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist(), strict=True)]
                out = {"row": rows.column("row"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(some, score, 0.0))}
                if plain is not None:
                    if some.any():
                        likeness = ((own @ plain.astype(np.float32).T) / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).max(axis=1).astype(np.float64)
                    sizes = [min(len(t).bit_length(), CLASSES - 1) for t in rows.column("_text").to_pylist()]
                    out |= {"likeness": pa.array(np.where(some, likeness, 0.0)), "length_class": pa.array(sizes, pa.int32())}
                yield from pa.table(out).to_batches()

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    own = StructType.fromDDL("lang_pred string, score double" + ", likeness double, length_class int" * (plain is not None))
    return rows.mapInArrow(run, StructType([rows.schema["row"], *own]))


def usual_likeness(docs: DataFrame, languages: list[str], plain: np.ndarray) -> list[float]:
    """For each class of length the median likeness of the labelled texts in it, or of the next class that has some."""
    found = identify(docs.where("lang is not null").select("text"), languages, centred(plain), plain).where(F.col("lang_pred") != UNKNOWN)
    medians = {r.length_class: r.m for r in found.groupBy("length_class").agg(F.percentile_approx("likeness", 0.5, 10_000).alias("m")).collect()}
    return [medians[min(medians, key=lambda k: abs(k - c))] if medians else 0.0 for c in range(CLASSES)]


def language_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the texts that are not held out."""
    languages, vectors = prototypes(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), languages, vectors)
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
