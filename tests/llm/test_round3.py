"""Token alignment, decontamination and fill-in-middle against brute force, with nulls, odd and long texts and repeated rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideway.llm import alignment, decontamination, fill_in_middle

SCHEMA = "doc_id long, text string, term string, n long, block long, size int"
ODD = ["", None, "  ", "a", " a", "a  ", "\n", "\n\n", "a\r\nb\tc", "▁ piece ▁▁", "x▁y", "<0x0A> <s> </s> <unk> <|endoftext|>", "\x00a\x01", "漢字 かな ½ ﬁ é ñ", "😀😀 👩‍👩‍👧", "it's they'LL 'tis", "a" * 500, "no newline at the end", "line\n" * 50, "a<P>b\nc", "<S>", "x\n<M>\ny", "<", "<P", "\n<\nS>\n", "ends with <\n"]


def make(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = "The of, and über été niño it's 1234 tail . ( ) Straße\n x\n y\n\n  <|endoftext|> naïve K İ".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 150))) for _ in range(40)]
    return [*enumerate([*ODD, *texts]), (2, "  "), (30, texts[4]), (30, texts[4]), (None, texts[5]), (None, None), (31, texts[4] + " x")]


def aligned(rows):
    """Links by trying all tokens of both sides."""
    a_model, b_model = Tokenizer.from_file(alignment.TOKENIZER_A), sentencepiece.SentencePieceProcessor(model_file=alignment.TOKENIZER_B)
    a_model.encode_special_tokens = True
    vocab = alignment.bpe.vocabulary(alignment.TOKENIZER_A)
    docs, holds = [], collections.Counter()
    for i, t in rows:
        whole = (" " + t).encode() if t else b""
        a = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        pieces = [bytes([int(p[3:5], 16)]) if b_model.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [b_model.id_to_piece(k)]]
        words = [vocab.bytes_of[k] for k in a]
        if b"".join(pieces) != whole or b"".join(words) != whole:
            a, b, pieces, words = [], [], [], []
        ea, eb = np.cumsum([0, *map(len, words)]), np.cumsum([0, *map(len, pieces)])
        links = [(x, y) for j, x in enumerate(a) for k, y in enumerate(b) if ea[j] < eb[k + 1] and eb[k] < ea[j + 1]]
        common = sorted(set(ea[1:].tolist()) & set(eb[1:].tolist()))
        groups, low = [], 0
        for end in common:
            groups.append([[str(x) for j, x in enumerate(ids) if low < e[j + 1] <= end] for ids, e in ((a, ea), (b, eb))])
            low = end
        text = ";".join("|".join(",".join(side) for side in g) for g in groups)
        docs.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
        holds.update(set(links))
    best = collections.Counter()
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    return sorted((str(i), na, nb, g, len(ls), sum(holds[p] == best[p[0]] for p in ls), sum(holds[p] for p in ls), d) for i, na, nb, g, ls, d in docs)


def aligned_rows(frame):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


def test_alignment(spark, rows):
    assert aligned_rows(alignment.align(make(spark, rows).repartition(3))) == aligned(rows)
    assert alignment.align(make(spark, [])).count() == 0


def test_alignment_of_blocks_and_chunks(spark, rows, monkeypatch):
    """Long texts in many chunks, and many blocks, give what whole texts give."""
    aligner = alignment.Aligner(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    texts = [t for _, t in rows if t]
    long = " ".join(texts)
    whole = alignment.Block([long, *texts], aligner)
    monkeypatch.setattr(alignment, "CHUNK", 64)
    cut = alignment.Block([long, *texts], alignment.Aligner(alignment.TOKENIZER_A, alignment.TOKENIZER_B))
    assert whole.digests == cut.digests and whole.packed() == cut.packed()
    for x in ("n_a", "n_b", "n_groups", "n_links", "values", "n_docs"):
        assert (getattr(whole, x) == getattr(cut, x)).all()


def test_gallop(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(alignment, "FIRST", 4)
    for n, m in ((0, 5), (1, 1), (3, 1000), (700, 40), (900, 3000)):
        keys, longer = np.sort(rng.integers(0, 2000, n)), np.unique(rng.integers(0, 2000, m))
        assert (alignment.gallop(keys, longer) == np.searchsorted(longer, keys)).all()


ITEMS = [("7", "the of and über été niño it s 1234 tail straße x"), ("12", "The x Y"), ("12", "The x Y"), ("a", ""), ("b", None), (None, "naïve k"), ("c", "x"), ("d", "zzz the"), ("e", "y y y y y y y y y y y y")]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def decontaminated(rows, items, size=10):
    out = []
    for i, t in rows:
        w, hit, found = words_of(t), set(), set()
        for item, text in items:
            v = words_of(text)
            for k in range(max(len(v) - size + 1, 1)) if v else ():
                phrase = v[k : k + size]
                for s in range(len(w) - len(phrase) + 1):
                    if w[s : s + len(phrase)] == phrase:
                        hit |= set(range(s, s + len(phrase)))
                        found.add(item or "")
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def decontaminated_rows(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())


@pytest.fixture(scope="module")
def leaked(rows):
    passage = ITEMS[0][1]
    more = [f"x {passage} x y", passage.upper(), passage.rsplit(" ", 1)[0].replace(" ", "--"), passage.replace("été", "ete"), "y " * 25, "Y y", "(The) X! y", "the\x00X\x7fy"]
    return [*rows, *enumerate(more, 100)]


def test_decontamination(spark, leaked, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    expected = decontaminated(leaked, ITEMS)
    assert any(r[2] for r in expected) and decontaminated_rows(decontamination.contamination(make(spark, leaked).repartition(3), items)) == expected
    assert decontaminated_rows(decontamination.contamination(make(spark, leaked), items, 3)) == decontaminated(leaked, ITEMS, 3)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert decontaminated_rows(decontamination.contamination(make(spark, leaked), items)) == expected


def test_decontamination_of_empty_tables(spark, leaked):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontamination.contamination(make(spark, []), items).count() == 0
    assert decontaminated_rows(decontamination.contamination(make(spark, leaked), items.limit(0))) == decontaminated(leaked, [])


def test_proximity(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(60))) for i in range(30)]
    phrases = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["d", "d"]), (2, ["a", "zz"]), (3, list("efgh"))], "phrase_id long, terms array<string>")
    index = decontamination.build_index(make(spark, docs), phrases.select(F.explode("terms").alias("term")))
    for width in (3, 6):
        found = {(r.phrase_id, r.doc, r.start) for r in decontamination.proximity_matches(index, phrases, width).collect()}
        expected = {
            (p, i, s) for p, terms in ((0, "abc"), (1, "d"), (3, "efgh")) for i, t in docs for w in [t.split()] for s in range(len(w)) if w[s] in terms and set(terms) <= set(w[s : s + width])
        }
        assert expected and found == expected


def middle(rows):
    out = []
    for i, t in rows:
        t = t or ""
        u = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
        a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) else "spm" if h4 % 100 < 50 else "psm"
        output = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((str(i), len(u), form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(output), sha(t), output))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [64 << 10, 5, 40])
def test_fill_in_middle(spark, rows, size):
    """Frames of any size give the same result."""
    rng = random.Random(2)
    lines = "".join(rng.choice(["é", "漢字", "word ", "\n", "<", "P>", "<S", "M"]) for _ in range(3000))
    rows = [*rows, (900, lines.replace("<P>", "")), (901, lines), (902, "x" * 300_000 + "\n" + "y" * 10)]
    texts = [t or "" for _, t in rows if t is None or len(t) < 5000]
    for text in texts:
        frames = fill_in_middle.Frames.of([text.encode()], max(size, 4))
        assert b"".join(frames.stream(0, frames.bytes[-1])).decode() == text and frames.chars[-1] == len(text)
        u = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert fill_in_middle.units(frames) == len(u)
        for k in range(0, len(u) + 1, max(1, len(u) // 7)):
            start = "".join(u[:k])
            assert frames.cut(k) == (len(start.encode()), len(start))
        assert all(frames.find(m) == text.encode().find(m) for m in fill_in_middle.MARKS)
    if size == 64 << 10:
        found = fill_in_middle.fim_digests(make(spark, rows)).collect()
        assert sorted([(str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in found], key=str) == [x[:7] for x in middle(rows)]
        outputs = sorted((str(r.doc_id), r.form, r.output) for r in fill_in_middle.fim_texts(make(spark, rows)).collect())
        assert outputs == sorted((x[0], x[2], x[7]) for x in middle(rows))
        assert fill_in_middle.fim_digests(make(spark, [])).count() == 0
        assert {r.form for r in fill_in_middle.fim_texts(make(spark, rows), rate=0).collect()} == {"plain"}
