"""The text operators against brute force, on small texts with nulls, empty and odd texts, ties and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideway.llm import bpe, exact_dedup, fingerprints, html_extract, language_id, minhash, packing, suffix_dedup, token_counts, warc
from strideway.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, component string"
WORDS = "the of and über été niño it's can't x1 12 ½ 漢字 tail . , !? \t \n\n  <|endoftext|> they're".split(" ")


def make(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s", None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    passage = "a passage of more than fifty bytes that many of the documents repeat word for word. "
    copies = [base[3], base[3] + " ", base[5].replace(" ", "  "), "  ", "", None, "short", "short"]
    near = [" ".join(w for i, w in enumerate((passage * 6 + base[k]).split()) if i % 97 != k) for k in range(8)]
    return [*base, *copies, *near, passage + base[1], "x" * 70_000, "aé" * 400, passage]


def test_bpe(spark, texts):
    tokenizer = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    found = {r.doc_id: r for r in bpe.bpe_digests(make(spark, texts)).collect()}
    whole = {r.doc_id: r for r in bpe.encode_documents(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert whole[i].ids == ids and whole[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)
        assert found[i].n_tokens == len(ids) and found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(whole[i].decoded.encode()).hexdigest()
    assert bpe.bpe_digests(make(spark, [])).count() == 0


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    rows = packing.pack_documents(make(spark, texts)).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        size = sum(r.length for r in rows)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert size == 1024 or size & (size - 1) == 0
    assert packing.pack_documents(make(spark, [])).count() == 0


def test_token_counts(spark, texts):
    tokenizer = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = {r.context_limit: r for r in token_counts.token_counts(make(spark, texts)).collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths) and r.docs_at_least == sum(n >= limit for n in lengths)
        assert r.share_at_most == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    for r in token_counts.totals_at(token_counts.length_histogram(token_counts.document_lengths(make(spark, texts))), [5, 100]).collect():
        assert r.truncated_tokens == sum(min(n, r.context_limit) for n in lengths) and r.docs_over == sum(n > r.context_limit for n in lengths)


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(spark, texts, bits):
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(make(spark, texts), bits).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            assert (found[i].keep_id, found[i].group_size, found[i].kept) == (keep, len(ids), i == keep)
            assert found[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_dedup(make(spark, [])).count() == 0


def cut(texts):
    first = {}
    raw = [(t or "").encode() for t in texts]
    for i, b in enumerate(raw):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        yield b, gone


def test_suffix_dedup(spark, texts, monkeypatch):
    found = {r.doc_id: r for r in suffix_dedup.repeat_digests(make(spark, texts)).collect()}
    whole = {r.doc_id: r for r in suffix_dedup.remove_repeats(make(spark, texts), ["lang", "source"]).collect()}
    for i, (b, gone) in enumerate(cut(texts)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), len(edges) // 2)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and whole[i].text == kept.decode("utf-8", "ignore") and whole[i].lang == "en"
    assert suffix_dedup.repeat_digests(make(spark, [])).count() == 0


def test_suffix_array_and_merge():
    rng = np.random.default_rng(1)
    for _ in range(20):
        data = rng.integers(0, 3, rng.integers(1, 300)).astype(np.uint8)
        order, _ = suffix_dedup.suffix_array(data)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data.tobytes()[i:])
    text = b"".join(rng.choice([b"one ", b"two ", b"six "], 400).tolist())
    starts = rng.integers(0, len(text) - 90, 200)
    count = np.full(200, 30)
    rows = suffix_dedup.string_rows(np.frombuffer(text, np.uint8), starts, count)
    docs = rng.integers(0, 1000, 200)
    whole, parts = (suffix_dedup.least_docs(rows, count, docs, b) for b in (1 << 20, 900))  # one block, many blocks
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    best = {}
    for s, d in zip(starts, docs, strict=True):
        for p in range(s, s + 30):
            best[text[p : p + 50]] = min(best.get(text[p : p + 50], 10**9), d)
    for i, a, b, least in zip(*whole, strict=True):
        assert all(best[text[starts[i] + k : starts[i] + k + 50]] == least for k in range(a, b))


def near_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    return sets, top


def test_near_dedup(spark, texts):
    rng = random.Random(2)
    hub = [f"w{i}" for i in range(100)]
    spokes = []  # near copies that resemble the hub more than each other
    for _ in range(40):
        own = list(hub)
        for k in rng.sample(range(100), 2):
            own[k] = f"n{rng.random()}"
        spokes.append(" ".join(own))
    more = [*texts, *spokes, " ".join(hub).upper()]
    sets, top = near_groups(more)
    found = {r.doc_id: r for r in minhash.near_dedup(make(spark, more)).collect()}
    for i in range(len(more)):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(sets[i]), top[i], top[i] == i)
    assert minhash.near_dedup(make(spark, [])).count() == 0


def test_fingerprints(spark, texts):
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(make(spark, texts)).collect()}
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(make(spark, texts)).collect()}
    own = [t or "" for t in texts]
    for i, t in enumerate(own):
        n, after = len(t), own[(i + 1) % len(own)]
        edited = t[: n - n // 2] + after[: n // 2]
        mark = fingerprints.simhash([edited])
        assert found[i].n_chars == n and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i].fingerprint == plain[i] and found[i].edited_fingerprint == mark[0].tobytes().hex()
        assert found[i].near_next == pytest.approx(float(fingerprints.likeness(fingerprints.simhash([t]), fingerprints.simhash([after]))[0]))
    single = fingerprints.edited_fingerprints(make(spark, ["only one text"])).collect()
    assert len(single) == 1 and single[0].near_next == 1 and fingerprints.edited_fingerprints(make(spark, [])).count() == 0
    marks = spark.createDataFrame([(x,) for x in set(plain.values())], "fingerprint string")
    bits = lambda x: int(x, 16)
    want = {(a, b) for a in plain.values() for b in plain.values() if a < b and (bits(a) ^ bits(b)).bit_count() <= 12}
    assert {(r.a, r.b) for r in fingerprints.near_fingerprints(marks, 12).collect()} == want


def test_language_id(spark):
    rng = random.Random(4)
    stock = {"en": "the and of that with this have from they which would there their".split(), "fr": "le la les des est dans pour que qui avec sur une plus été".split(), "de": "der die und das nicht mit ist auch auf für eine sich wird".split()}
    langs = [rng.choice(list(stock)) for _ in range(120)]
    rows = [" ".join(rng.choice(stock[g]) for _ in range(rng.randrange(3, 40))) for g in langs]
    found = {r.doc_id: r for r in language_id.language_ids(make(spark, [*rows, None, "", "123 !?"], [*langs, "en", "en", "en"])).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found)
    assert sum(found[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (120, 121, 122)) and all(0 <= r.score <= 1 for r in found.values())
    assert language_id.language_ids(make(spark, [])).count() == 0


PAGE = """<html><head><title>t</title><script>x = "<p>no</p>"</script></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav><div class="ad">Buy the best of it and be glad that it is so</div>
<article><h1>The &amp; title</h1><p>It was the best of times and it was   the worst of times, and all of it was in the book that he had.</p><p>Short.</p><div class="comments"><p>I like this one and the other, it is the best of them all.</p></div></article><footer>&copy; all of it</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (2, None, None, 9), (3, "u", "", 9), (4, "u", "<article><p>cut", 9)], "page_id long, url string, html string, text int")
    found = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    assert found[1].text == "The & title\nIt was the best of times and it was the worst of times, and all of it was in the book that he had.\nShort."
    assert found[2].text == "" and found[3].n_chars == 0 and found[4].text == "cut" and found[1].n_chars == len(found[1].text)


def test_warc(spark):
    bodies = ["<p>a</p>", "<p>a</p>", None, "", "<p>é\r\n\r\nb</p>", "x" * 200_000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://e/{i} é", b, "clash") for i, b in enumerate(bodies)], "page_id long, url string, html string, payload string")
    path = scratch(spark, "warc")
    warc.write_warc(pages, path)
    rows = {r.page_id: r for r in warc.read_warc(spark, path, verify=True).collect()}
    for i, b in enumerate(bodies):
        payload = (b or "").encode()
        last = max(k for k, x in enumerate(bodies) if (x or "").encode() == payload)
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))
        assert r.url == (None if i == 4 else f"http://e/{i} é")
        assert i != last or bytes(r.payload) == payload
    wanted = warc.read_warc(spark, path).where((F.col("record_type") == "response") & (F.col("payload_bytes") > 100))
    assert [r.page_id for r in wanted.collect()] == [5]
    empty = scratch(spark, "warc")
    warc.write_warc(pages.where("false"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    docs = make(spark, texts).drop("digest", "component")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    _, top = near_groups(texts)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = stages["language_id"](spark, docs, str(tmp_path))
    lettered = {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in known.collect()} <= lettered and known.columns == docs.columns
    exact = stages["exact_dedup"](spark, docs, str(tmp_path))
    kept = {min((j for j, u in enumerate(texts) if re.sub(r"\s", "", u or "") == re.sub(r"\s", "", t or "")), key=lambda j: (-len(texts[j] or ""), j)) for t in texts}
    assert {r.doc_id for r in exact.collect()} == kept
    near = stages["near_dedup"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in near.collect()} == {i for i, t in enumerate(top) if i == t}
    left = {r.doc_id: r for r in stages["suffix_dedup"](spark, docs, str(tmp_path)).collect()}
    for i, (b, gone) in enumerate(cut(texts)):
        text = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        assert (i in left) == bool(text.strip(" ")) and (i not in left or left[i].text == text and left[i].n_chars == len(text))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and math.isfinite(corpus_pipeline.LEAST_SCORE)
