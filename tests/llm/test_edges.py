"""Words that a weak hash confuses, rows that share an id, clashing columns, very long and very many texts, broken archives."""

import gzip
import hashlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strideway.llm import bpe, common, exact_dedup, fingerprints, minhash, packing, segments, suffix_dedup, token_counts, warc

FLIP = str.maketrans("ab", "ba")


def thue_morse(n=1024):
    text = "a"
    while len(text) < n:
        text += text.translate(FLIP)
    return text


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)


def test_words_that_polynomial_hashes_confuse(spark, tokenizer):
    one = thue_morse()
    two = one.translate(FLIP)
    texts = [one, two, " ".join([one] * 3 + ["x", "y", "z"]), " ".join([two] * 3 + ["x", "y", "z"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [r.ids for r in bpe.encode_documents(docs).orderBy("doc_id").collect()] == ids
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    assert [r.ids_sha256 for r in bpe.bpe_digests(docs).orderBy("doc_id").collect()] == digests
    assert {r.context_limit for r in token_counts.token_counts(docs).collect()} == {len(x) for x in ids}
    assert packing.pack_documents(docs).agg(F.sum("length")).first()[0] == sum(len(x) + 1 for x in ids)
    assert [(r.component_id, r.kept) for r in minhash.near_dedup(docs).orderBy("doc_id").collect()] == [(i, True) for i in range(4)]
    marks = {r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert len(marks) == 4


def test_words_with_one_hash_are_told_apart(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "lane_hashes", lambda values, begins, place, sizes: (sizes % 3).astype(np.uint64))
    texts = ["the cat sat on the mat", "a dog ate the cat, it's über", "", "the cat <|endoftext|> sat"]
    table = bpe.WordTable(bpe.pair_index_encoder(bpe.DEFAULT_TOKENIZER))
    for _ in range(2):
        flat, counts = bpe.encode_texts(texts, table, bpe.vocabulary(bpe.DEFAULT_TOKENIZER).special)
        ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert flat.tolist() == [i for x in ids for i in x] and counts.tolist() == list(map(len, ids)) and table.clashes


def test_long_texts_are_worked_on_in_pieces(monkeypatch, tokenizer):
    rng = random.Random(3)
    words = ["the", "über", "it's", "x" * 50, "12", "漢字", "\n", "\t ", " ", "𝒳𝒴", "<|endoftext|>", "a.b"]
    text = " ".join(rng.choice(words) for _ in range(4000))
    vocab = bpe.vocabulary(bpe.DEFAULT_TOKENIZER)
    pieces, docs, _ = bpe._segments([text, "", text], vocab.special, 500)
    assert len(pieces) > 40 and max(map(len, pieces)) < 1500 and set(docs) == {0, 1, 2}
    monkeypatch.setattr(bpe._segments, "__defaults__", (500,))
    flat, counts = bpe.encode_texts([text, "", text], bpe.WordTable(bpe.pair_index_encoder(bpe.DEFAULT_TOKENIZER)), vocab.special)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert flat.tolist() == ids + ids and counts.tolist() == [len(ids), 0, len(ids)]
    raw = [text.encode(), b"", b"one", text.encode()]
    for chunk in (100, 1 << 20):
        hashes, count = segments.word_hashes(raw, chunk)
        assert count.tolist() == [len(x.split()) for x in raw]
        assert (hashes[: count[0]] == hashes[-count[3] :]).all() and len(set(hashes.tolist())) == len({w.lower() for x in raw for w in x.split()})
    data = np.frombuffer(raw[0], np.uint8)
    whole = suffix_dedup.window_runs(data, np.array([len(data)]))
    monkeypatch.setattr(suffix_dedup, "BYTES_AT_ONCE", 3000)
    parts = suffix_dedup.window_runs(data, np.array([len(data)]))
    anchors = lambda r: np.repeat(r.hash, r.count).tolist()
    assert len(parts.start) > len(whole.start) and anchors(parts) == anchors(whole) and parts.count.sum() == len(data) - 49


def test_fifty_megabytes_in_one_text(tokenizer):
    text = " ".join(["the cat sat on the mat, and it's über"] * 1_300_000)
    flat, counts = bpe.encode_texts([text], bpe.WordTable(bpe.pair_index_encoder(bpe.DEFAULT_TOKENIZER)), bpe.vocabulary(bpe.DEFAULT_TOKENIZER).special)
    one = tokenizer.encode(" the cat sat on the mat, and it's über", add_special_tokens=False).ids
    assert len(text) > 45_000_000 and counts[0] == 1_300_000 * len(one) and (flat[len(one) :].reshape(-1, len(one)) == one).all()
    found, sizes = minhash.sets_of([text.encode()])
    assert sizes.tolist() == [9]


def test_very_many_empty_texts_make_bounded_groups():
    batch = pa.record_batch({"text": pa.array([""] * 300_000)})
    groups = list(common.in_groups([batch] * 4, "text", 1 << 20))
    assert sum(g.num_rows for g in groups) == 1_200_000 and max(g.num_rows for g in groups) <= 1 << 17


def test_documents_with_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    x, y, near = " ".join(words), " ".join(reversed(words)), " ".join([*words[:-1], "other"])
    rows = [(3, x), (5, x), (5, y), (7, near), (5, y), (None, x), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(minhash.near_dedup(docs).select("doc_id", "component_id", "kept", "n_shingles").collect(), key=str)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found if r.doc_id is not None) == [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (7, 3, False), (9, 9, True), (9, 9, True)]
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert sorted((r.doc_id, r.text or "") for r in exact.collect()) == sorted([(3, x), (5, y), (7, near), (9, "")])
    left = corpus_pipeline.drop_near_copies(spark, exact, "")
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted([(3, x), (5, y), (9, "")])


def test_pipeline_carries_columns_of_any_name(spark, tmp_path):
    words = "der die und das nicht mit ist auch auf eine sich wird haben sein werden".split()
    rng = random.Random(1)
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    rows = [(i, t, "de", "s", len(t), "a", "b", True, "c", 1, "d", "e", "f") for i, t in enumerate([*texts, texts[0], texts[1] + " und"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, digest string, maybe boolean, spans string, _place int, component string, `a.b` string, key string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
        assert {(r[5], r[6], r[7], r[8], r[9], r[10], r[11], r[12]) for r in kept.collect()} == {("a", "b", True, "c", 1, "d", "e", "f")}, name
        assert {k for k, _ in kept.dtypes} == {k for k, _ in docs.dtypes}
        assert stage(spark, docs.where("false"), "").count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.countDistinct("doc_id")).first()[0] == 30


def test_index_merges_new_runs_with_its_level(spark):
    index = exact_dedup.DigestIndex(spark)
    index.flush(spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string"))
    first = {r.keep_id: r.group_size for r in index.compact().collect()}
    index.flush(spark.createDataFrame([(1, "ab"), (2, "a  b"), (3, "d")], "doc_id long, text string"))
    second = {r.keep_id: r.group_size for r in index.compact().collect()}
    assert first == {5: 1, 6: 1} and second == {2: 3, 6: 1, 3: 1}
    assert index.contains(hashlib.sha256(b"ab").hexdigest()) and not index.contains(hashlib.sha256(b"e").hexdigest())


def test_packing_takes_the_cheapest_sequence_with_room():
    rests = np.array([900, 700, 600, 300, 300, 100, 100, 72])
    pieces = packing.pack_rests(rests, 1024)
    assert {i: sum(n for k, _, n, _, _ in pieces if k == i) for i in range(len(rests))} == dict(enumerate(rests.tolist()))
    room = packing.open_sequences(int(rests.sum()), 1024)
    used = np.zeros(len(room), np.int64)
    cost = np.zeros(len(room))
    for i, start, n, k, offset in pieces:
        left = int(rests[i]) - start
        assert offset == used[k] and n <= room[k] - used[k]
        fits = (room - used >= left) if (room - used >= left).any() else room > used
        assert fits[k] and cost[k] == cost[fits].min()
        used[k] += n
        cost[k] += packing.LINEAR * n + packing.QUADRATIC * n * n
    assert (used == room).all()


@pytest.mark.parametrize("compress", [True, False])
def test_archives_that_are_cut_off(compress):
    record = warc.record_bytes(1, "http://e/", "response", 3000, warc.payload_digest(b"x" * 3000), None, b"x" * 3000)
    whole = gzip.compress(record) if compress else record

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    assert [r["page_id"] for r in warc.records(File(whole), [], True)] == [1]
    for n in (20, 60, len(whole) // 2, len(whole) - 9):
        with pytest.raises(ValueError, match="cut off"):
            list(warc.records(File(whole[:n]), [], True))


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(Conf)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Session, "x")


def test_scratch_is_removed(spark):
    import os

    since = common.made()
    one, two = common.written(spark.range(3), "one"), common.written(spark.range(4), "two")
    paths = list(common._made[since:])
    common.release(spark, since, keep=two)
    assert two.count() == 4 and [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, True] and one is not None


def test_fingerprints_are_votes_of_weighted_terms():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    for _ in range(5):
        text = [rng.choice(words) for _ in range(80)]
        pairs = [" ".join(p) for p in zip(text, text[1:], strict=False)]
        votes = np.zeros(fingerprints.BITS, int)
        for pair in set(pairs):  # a text of one term has that term's hash as its fingerprint
            bits = np.unpackbits(fingerprints.simhash([pair])[0]).astype(int)
            votes += (2 * bits - 1) * (1 + int(np.log2(pairs.count(pair))))
        assert (np.unpackbits(fingerprints.simhash(["x y", " ".join(text).upper(), "x"])[1]) == (votes > 0)).all()


def test_near_fingerprints_are_counted_with_hot_keys(spark, monkeypatch):
    rng = random.Random(6)
    whole = (1 << fingerprints.BITS) - 1
    base = rng.getrandbits(fingerprints.BITS)
    marks = {base, 0, whole} | {rng.getrandbits(fingerprints.BITS) for _ in range(60)}
    for _ in range(150):  # one dense group, with hot keys
        mark = base
        for _ in range(rng.randrange(1, 5)):
            mark ^= 1 << rng.randrange(fingerprints.BITS)
        marks.add(mark)
    want = {a: sum((a ^ b).bit_count() <= 3 for b in marks if b != a) for a in marks}
    rows = spark.createDataFrame([(f"{a:032x}",) for a in marks], "fingerprint string")
    for block in (1024, 17):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        found = {int(r.fingerprint, 16): r.n_near for r in fingerprints.near_counts(rows).collect()}
        assert found == {a: n for a, n in want.items() if n}


def test_edited_fingerprints_tell_near_ones(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " end", base, "", None, "quite another text with words of its own", base.replace("w7 ", "x7 ")]
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    marks = {r.fingerprint for r in found.values()}
    bits = lambda x: int(x, 16)
    for i, t in enumerate(texts):
        r = found[i]
        assert r.n_near == sum((bits(r.fingerprint) ^ bits(m)).bit_count() <= 3 for m in marks if m != r.fingerprint)
        assert r.near_edited == pytest.approx(1 - (bits(r.fingerprint) ^ bits(r.edited_fingerprint)).bit_count() / 128)
        assert r.near_next == pytest.approx(1 - (bits(r.fingerprint) ^ bits(found[(i + 1) % len(texts)].fingerprint)).bit_count() / 128)
        assert t or r.fingerprint == "0" * 32
