"""Small documents with everything that can go wrong: nulls, empties, long texts, ties, repeats, odd characters."""

import random
import re

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Names that operators use inside.
CLASH = (
    "size", "copies", "node", "h", "pos", "first", "block", "_quality_", "site", "term", "kind", "key", "count",
    "_id", "_gone", "_n", "_kept", "_left", "_away", "_of", "_node", "_pattern", "_good", "_pattern_of", "_before", "_row", "none",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = sentence(rng, 120)
    passage = sentence(rng, 60)
    out = [None, "", "   \n\t ", "one", "Two words", "a b c d", "A B C D", "a b c d e", "é ü x 日本 語", "\x1c\x1d x\x0by", base, base, base.upper()]
    for _ in range(6):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 30) for _ in range(4)]
    out += [sentence(rng, rng.randint(5, 80)) for _ in range(12)]
    out += ["\n".join(["same line here"] * 5), "common footer line\n" + sentence(rng, 30)]
    out.append(sentence(rng, 6000))
    out.append("x" * 50_000)
    out.append("1" * 20_000 + " " + "9 " * 3_000)
    return out


def rows(seed=1):
    out = []
    for i, t in enumerate(texts(seed)):
        lang = None if i % 7 == 3 else "en"
        source = None if i % 5 == 4 else f"s{i % 3}"
        out.append((i, t, lang, source, len(t or ""), *[f"{c}{i}" for c in CLASH]))
    out.append(out[10])  # a repeated row
    out.append((None, "row without an id " + sentence(random.Random(9), 30), "en", "s1", 5, *[None] * len(CLASH)))
    return out


def docs(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = W.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def classes(pairs_of_id_text):
    """Smallest id reachable over links of similarity 0.75, by comparing all pairs."""
    items = [(i, shingles(t)) for i, t in pairs_of_id_text]
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in items}
