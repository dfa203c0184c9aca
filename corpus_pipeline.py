"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame that
is written and read again as the next stage's documents. All but the last return the columns of documents; columns
beyond those are carried along, whatever their names. Null texts count as empty, and go in the first stage like all
without a letter. A null doc_id is kept apart from all others. Rows that share a doc_id but not their text are documents
of their own. Very long texts are whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.llm import exact_dedup, language_id, minhash, packing, suffix_dedup
from strideway.llm.common import made, marked, read_table, release, small_batches, text_of, unused, written

#: A document goes if its greatest cosine with a language's profile is less than this part of what is usual (the median of
#: all labelled training documents) at its length. Random letters have about a sixth at 500 characters.
LEAST_SCORE = 0.25


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _without(docs: DataFrame, dropped: DataFrame, digest: Column) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``digest`` are in ``dropped`` (doc_id, digest); only rows that may be
    are moved."""
    dropped = written(dropped.select("doc_id", "digest").distinct(), "dropped")
    maybe, key = unused(docs, "maybe", "key")
    flagged = marked(docs, dropped.select("doc_id"), dropped.count(), "doc_id", maybe)
    rest = flagged.where(maybe).withColumn(key, digest)
    same = rest["doc_id"].eqNullSafe(dropped["doc_id"]) & (rest[key] == dropped["digest"])
    return flagged.where(f"not {maybe}").select(columns_of(docs)).union(rest.join(dropped, same, "left_anti").select(columns_of(docs)))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like no language, go; a missing lang is filled in.

    Where nothing was learned, as no text has a label, no text can be said to be like no language: all with letters stay,
    with a null lang. As this is the first stage, it also bounds the batches that go to Python, for the whole session.
    """
    small_batches(spark)
    training = docs.where(~language_id.held_out())
    languages, plain = language_id.profiles(training)
    if not languages:
        return docs.where(text_of().rlike(r"\p{L}"))
    found = language_id.identify(docs, languages, language_id.centred(plain), plain)
    least = F.array(*[F.lit(LEAST_SCORE * m) for m in language_id.usual_likeness(training, languages, plain)])
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("likeness") >= F.get(least, F.col("length_class"))))
    lang = F.coalesce("row.lang", "lang_pred").alias("lang")
    return kept.select([lang if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays; of repeated rows of that document one. Null texts are empty ones, of which one
    stays; of rows without a doc_id all stay whose text no row with one has."""
    found = written(exact_dedup.exact_dedup(docs), "exact")
    digest = F.sha2(exact_dedup.normalised(), 256)
    once = _without(docs, found.where("not kept").select("doc_id", F.col("text_sha256").alias("digest")), digest)
    twice = written(found.where("kept and doc_id is not null").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id").distinct(), "twice")
    if twice.isEmpty():
        return once
    (key,) = unused(docs, "key")
    repeated = once.join(twice, "doc_id", "left_semi").withColumn(key, digest).dropDuplicates(["doc_id", key])
    return once.join(twice, "doc_id", "left_anti").select(columns_of(docs)).union(repeated.select(columns_of(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; of rows with one doc_id those go
    whose own text has a near-duplicate with a smaller one."""
    found = minhash.near_dedup(docs).where("not kept").select("doc_id", F.col("words_sha256").alias("digest"))
    return _without(docs, found, minhash.words_sha256(text_of()))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat what an earlier document has are cut out; documents of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(docs, [c for c in docs.columns if c not in ("doc_id", "text")], spans=None)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(F.length(F.trim(text_of())) > 0).select(columns_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages leave, packed. What a stage wrote for itself is removed once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    since = made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, since, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Token ids and learned languages can't be had in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
