"""Operators held against brute force on a whole table, and reports of token counts."""

import collections
import math
import os
import re

import pytest

from strideway.llm import minhash, token_counts

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
def test_recall_of_near_duplicates_on_a_whole_table(spark):
    """All pairs of documents with a common shingle: every link is found, and nothing else."""
    docs = spark.read.parquet(SF)
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = 0
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in holders[s] if j < i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                links += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    found = {r.doc_id: r for r in minhash.near_dedup(docs).collect()}
    assert links > 50 and len(found) == len(sets)
    assert all((found[i].n_shingles, found[i].component_id, found[i].kept) == (len(sets[i]), top(i), i == top(i)) for i in sets)


def test_reports_have_any_limit_and_quantiles(spark):
    texts = ["a b c", "", None, "one two three four five six seven", "x " * 40, "a b c", "word"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_docs int, quantiles int")
    lengths = sorted(r.n_tokens for r in token_counts.document_lengths(docs).collect())
    shares = [0.1, 0.5, 0.75, 0.999, 1.0]
    rows = {r.context_limit: r for r in token_counts.token_report(docs, limits=[2, 5, 1000], shares=shares).collect()}
    assert set(rows) == {*lengths, 2, 5, 1000}
    for limit, r in rows.items():
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths) and r.docs_at_least == sum(n >= limit for n in lengths) and r.n_docs == lengths.count(limit)
        assert r.share_at_most == pytest.approx(sum(n <= limit for n in lengths) / len(lengths)) and r.total_tokens == sum(lengths)
        assert list(r.quantiles) == [q for q in shares if lengths[math.ceil(q * len(lengths)) - 1] == limit]
    assert token_counts.token_report(docs.limit(0)).count() == 0
