"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Documents are cut into words; every occurrence of a word of the benchmark is a posting (term, document, position). Each
task writes the postings of its documents as one sorted segment. A phrase (10 consecutive words of a benchmark text) is
looked up from its rarest terms on: the lists of its rarest term, shifted by the term's place in the phrase, give where
the phrase could start; the second rarest term's lists are intersected with these, and what is left, hardly more than
the true occurrences, is held against all other terms. :func:`proximity_matches` finds terms near each other instead.

A document is known by its doc_id and a hash of its text, so that rows that share a doc_id but not the text stay apart;
repeated rows get the same result each. A null text has no words; a null doc_id is a document like any other. Texts of
any length are whole: a task holds the words of one text at a time. A benchmark text of fewer words than a phrase is one
phrase, without words it is none; repeated benchmark texts and ids count once, a null item_id counts as an id without
letters. An empty benchmark hits nothing; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import marked, text_of, written

#: What stands between words, once A-Z are a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a phrase; rows of a table that may be broadcast (of terms and phrases, of some 200 bytes each).
PHRASE, BROADCAST_ROWS = 10, 250_000
KEY = ["doc", "text_key"]


def lowered(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """The words with an empty string before or after them, where the text starts or ends with none."""
    return F.split(lowered(text), BETWEEN)


def word_count(parts: Column) -> Column:
    """The number of words in what :func:`split_words` gives."""
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - first - last).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text_key, text) of every row."""
    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(-1)).alias("doc"), F.xxhash64(text_of(), ids).alias("text_key"), text_of().alias("text"))


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a broadcast if its ``rows`` rows are few; otherwise both sides are shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc, text_key, position) of every word of every text."""
    parts = keyed(docs).select(*KEY, split_words(F.col("text")).alias("parts"))
    skip = F.when(F.get("parts", F.lit(0)) == "", 1).otherwise(0)
    words = parts.select(*KEY, skip.alias("skip"), F.posexplode("parts").alias("at", "term")).where("term <> ''")
    return words.select("term", *KEY, (F.col("at") - F.col("skip")).alias("position"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of ``terms`` (term), written as segments that are sorted by term."""
    terms = terms.select("term").distinct()
    own = postings(docs).join(if_small(terms, terms.count()), "term", "left_semi")
    return written(own.sortWithinPartitions("term"), "postings")


def benchmark_phrases(items: DataFrame, size: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """(phrase_id, terms) of all distinct phrases, and (item_id, phrase_id)."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.filter(split_words(text_of()), lambda w: w != "").alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    own = words.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start"), size).alias("terms"))
    own = written(own.distinct(), "items")
    phrases = written(own.select("terms").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    return phrases.select("phrase_id", "terms"), own.join(phrases, "terms").select("item_id", "phrase_id").distinct()


def by_rarity(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, size, terms array<struct<n, place, term>>): the terms of each phrase, rarest first, of those phrases
    whose terms all occur."""
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    single = phrases.select("phrase_id", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term"))
    found = single.join(counts, "term").groupBy("phrase_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("terms"))
    return written(found.where("size(terms) = size"), "rarest")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, size, doc, text_key, start) of every occurrence of every phrase (phrase_id, terms)."""
    ranked = by_rarity(index, phrases)
    many = ranked.count()
    first = ranked.select("phrase_id", "size", F.col("terms")[0].alias("rare"), F.col("terms"))
    # where the rarest term puts the phrase
    rare = first.select(F.col("rare.term").alias("term"), F.col("rare.place").alias("place"), "phrase_id", "size", F.get("terms", F.lit(1)).alias("next"))
    begun = index.join(if_small(rare, many), "term").withColumn("start", F.col("position") - F.col("place")).where("start >= 0").select("phrase_id", "size", *KEY, "start", "next")
    begun = written(begun, "begun")
    # of these, where the second rarest stands in its place
    second = begun.where("size > 1").select("phrase_id", "size", *KEY, "start", F.col("next.term").alias("term"), (F.col("start") + F.col("next.place")).alias("position"))
    wanted = ranked.where("size > 1").select(F.col("terms")[1]["term"].alias("term")).distinct()
    two = _standing(second, index.join(if_small(wanted, many), "term", "left_semi")).select("phrase_id", "size", *KEY, "start").distinct()
    two = written(two, "two")
    # the other terms of what is left
    others = ranked.where("size > 2").select("phrase_id", F.explode(F.slice("terms", 3, F.col("size"))).alias("other"))
    rest = two.where("size > 2").join(others, "phrase_id").select("phrase_id", "size", *KEY, "start", F.col("other.term").alias("term"), (F.col("start") + F.col("other.place")).alias("position"))
    whole = _standing(written(rest, "rest"), index).groupBy("phrase_id", "size", *KEY, "start").agg(F.count(F.lit(1)).alias("n")).where("n = size - 2")
    single = begun.where("size = 1").select("phrase_id", "size", *KEY, "start").distinct()
    return whole.select(single.columns).unionByName(two.where("size = 2")).unionByName(single)


def _standing(expected: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``expected`` whose term is at its position; a filter of bounded size spares most postings the shuffle."""
    place = F.xxhash64("term", *KEY, "position")
    near = marked(index.withColumn("at", place), expected.select(place.alias("at")), expected.count(), "at", "maybe").where("maybe")
    return expected.join(near.select("term", *KEY, "position"), ["term", *KEY, "position"], "left_semi")


def proximity_matches(index: DataFrame, phrases: DataFrame, width: int) -> DataFrame:
    """(phrase_id, doc, text_key, start): where ``width`` consecutive words of a document, the first of them a term of
    the phrase, have all its terms, in any order, each once at least."""
    ranked = by_rarity(index, phrases.select("phrase_id", F.array_distinct("terms").alias("terms")))
    many = ranked.count()
    rare = ranked.select("phrase_id", F.col("terms")[0]["term"].alias("term"))
    anchors = index.join(if_small(rare, many), "term").select("phrase_id", *KEY, F.col("position").alias("anchor"), F.explode(F.array(*[F.floor(F.col("position") / width) + k for k in (-1, 0, 1)])).alias("cell"))
    terms = ranked.select("phrase_id", "size", F.explode("terms").alias("t")).select("phrase_id", "size", F.col("t.term").alias("term"))
    other = index.withColumn("cell", F.floor(F.col("position") / width)).join(if_small(terms, many * PHRASE), "term")
    near = anchors.distinct().join(other, ["phrase_id", *KEY, "cell"]).where(f"abs(position - anchor) < {width}")
    # per start: which terms the next words have; the anchor is among them, as it is a term itself
    starts = near.select("phrase_id", "size", *KEY, "anchor", F.col("position").alias("start")).where("start <= anchor").distinct()
    met = starts.join(near.drop("size"), ["phrase_id", *KEY, "anchor"]).where(f"position >= start and position < start + {width}")
    return met.groupBy("phrase_id", "size", *KEY, "anchor", "start").agg(F.count_distinct("term").alias("n")).where("n = size").select("phrase_id", *KEY, "start").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    phrases, owners = benchmark_phrases(items, size)
    index = build_index(docs, phrases.select(F.explode("terms").alias("term")))
    found = written(phrase_matches(index, phrases), "found")
    hits = found.select(*KEY, F.explode(F.expr("sequence(start, start + size - 1)")).alias("position")).distinct().groupBy(KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    owners = written(owners, "owners")
    named = found.select(*KEY, "phrase_id").distinct().join(if_small(owners, owners.count()), "phrase_id")
    named = named.groupBy(KEY).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = keyed(docs).select("doc_id", *KEY, word_count(split_words(F.col("text"))).alias("n_words"))
    return rows.join(written(hits.join(named, KEY), "hits"), KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
p AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), {PHRASE}) AS size, array_to_string(w[s + 1 : s + {PHRASE}], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {PHRASE - 1}, 1))) AS s FROM b WHERE len(w) > 0)
), g AS MATERIALIZED (
  SELECT r, s, size, array_to_string(w[s + 1 : s + size], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM d, (SELECT DISTINCT size FROM p) AS sizes WHERE len(w) >= size)
), o AS MATERIALIZED (SELECT r, s, g.size, item_id FROM g JOIN p ON g.phrase = p.phrase AND g.size = p.size),
h AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(s, s + size)) AS at FROM o) AS x GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT item_id)) AS items FROM o GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
