"""Cross-tokenizer alignment against whole texts encoded one by one and all pairs of tokens."""

import hashlib
from collections import Counter

import pytest

from manyview.llm import align

from . import messy

ODD = [
    "", " ", "  two  blanks ", "\t\ttabs\r\n\n x\n", "don't we'll I'M 12th ½ x² ", "é é ñ ß Ÿ ɏ", "日本 a😀b", "ʰ modifier Ａ wide",
    "a▁b", "a\xa0b\x85c", "a\x00b\x1c\x1d", "<s> </s> <unk> <0x41> <|endoftext|> <pad>", "Ω≈ç√ ﬁ", "x" * 700, "ab " * 400, "ค วาม สุข", "'s 's", "a  'll",
]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{align.FOLDER}/{align.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.PIECES}")


def whole(sides, text):
    """((id, start, end) of A, of B) of a whole text, or nothing."""
    a, b = sides
    if not text:
        return [], []
    want, of = (" " + text).encode(), align.byte_alphabet()
    tokens = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    parts = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    out = []
    for side in (tokens, parts):
        if b"".join(x for _, x in side) != want:
            return [], []
        at, placed = 0, []
        for i, x in side:
            placed.append((i, at, at + len(x)))
            at += len(x)
        out.append(placed)
    return out


def brute(sides, rows):
    each, links = [], Counter()
    for ident, text in rows:
        a, b = whole(sides, text)
        met = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else sweep(a, b)
        links.update(met)
        each.append((ident, a, b, met))
    top = Counter()
    for (_, y), n in links.items():
        top[y] = max(top[y], n)
    out = []
    for ident, a, b, met in each:
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, at = [], 0
        for e in both:
            part = [",".join(str(i) for i, s, t in side if at <= s and t <= e) for side in (a, b)] if len(a) < 3000 else None
            groups.append("|".join(part) if part else "")
            at = e
        shown = hashlib.sha256(";".join(groups).encode()).hexdigest() if a and len(a) < 3000 else ("" if not a else None)
        out.append((ident, len(a), len(b), len(both), len(met), sum(links[m] == top[m[1]] for m in met), sum(links[m] for m in met), shown))
    return out


def sweep(a, b):
    met, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            met.append((i, b[k][0]))
            k += 1
    return met


def rows_of(spark, rows, block=align.BLOCK):
    df = spark.createDataFrame(rows, "doc_id long, text string, block long, slot string").repartition(3)
    return [tuple(r) for r in align.align(df, block=block).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def same(got, want):
    key = lambda r: tuple(str(x) for x in r[:7])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want))


@pytest.mark.parametrize("block", [align.BLOCK, 500])
def test_against_whole_texts(spark, sides, block):
    texts = ODD + messy.texts() + ODD[4:8]
    data = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    same(rows_of(spark, [(*r, 7, "clash") for r in data], block), brute(sides, data))


def test_documents(spark, sides):
    from manyview.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op12_tokenizer_alignment"](spark, "/root/testdata/sf0.001").collect()]
    same(got, brute(sides, [tuple(r) for r in docs]))


def test_units_split_like_the_tokenizer(sides):
    """Units give the ids and ends of the whole text."""
    import random

    rng = random.Random(4)
    chars = [chr(c) for c in [*range(9, 11), 13, *range(32, 127), *range(161, 0x250)]]
    aligner = align.Aligner(align.FOLDER)
    for n in range(300):
        common = chars if n % 2 else list("ab 'stl\n\t 1é²-")
        text = "".join(rng.choice(common) for _ in range(rng.randrange(1, 60)))
        a, b = whole(sides, text)
        for side, want in ((aligner.a, a), (aligner.b, b)):
            ids, ends, _ = side.tokens(side.numbers([" " + text])[0])
            if want:
                assert list(zip(ids.tolist(), ends.tolist())) == [(i, e) for i, _, e in want], repr(text)


def test_full_memory_changes_nothing(sides, monkeypatch):
    """Tokens stay the same once no more units are remembered."""
    aligner = align.Aligner(align.FOLDER)
    texts = [t for t in messy.texts() if t] * 2
    want = aligner.align(texts)
    monkeypatch.setattr(align, "REMEMBERED", 100)
    small = align.Aligner(align.FOLDER)
    got = [small.align([t]) for t in texts]
    assert small.a.full and small.b.full and len(small.a.ids) < 40_000
    assert [d for g in got for d in g[1]] == want[1]
    assert [g[0].tolist()[0] for g in got] == want[0].tolist()


def test_empty_table(spark):
    assert rows_of(spark, []) == []
