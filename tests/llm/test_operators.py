"""Operators on messy rows against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from manyview.llm import decontam, licenses, lines, lm, mixing, pii, quality, substring

from . import messy
from .messy import LOWER, W

ROWS = messy.rows()
BY_ID = {r[0]: r[1] for r in ROWS}


# --- 10: quality rules


def base_counts(text):
    text = text or ""
    w = W.findall(text)
    held = [x for x in text.split("\n") if W.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(held) - len(set(held)), len(repeated)


def test_quality_counts(spark):
    docs = messy.docs(spark)
    out = quality.assess(docs)
    assert out.columns == [*docs.columns, "_quality"]
    got = out.collect()
    assert len(got) == len(ROWS)
    for r in got:
        q = r["_quality"]
        n, chars, symbols, dup, rep = base_counts(r["text"])
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert q["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (q["base_failed"] and q["kept"])
    assert quality.assess(messy.empty(spark)).count() == 0
    assert quality.filter_quality(docs).columns == docs.columns


def test_quality_verdicts(spark):
    rng = random.Random(2)

    def clean(n=80):
        words = [rng.choice(quality.STOP[:20]) if rng.random() < 0.3 else messy.sentence(rng, 1) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 20]).capitalize() + "." for i in range(0, n, 20))

    data = [(i, clean(), "clean") for i in range(300)]
    data += [(1000 + i, " ".join(w + rng.choice(["###", "%%%"]) for w in clean().split()), "symbols") for i in range(12)]
    data += [(2000 + i, " ".join(w.upper() + "!!" for w in clean().split()), "shouting") for i in range(6)]
    data += [(3000 + i, clean().replace(" ", " | "), "list") for i in range(5)]
    data += [(4000 + i, " ".join(w for x in clean(40).split() for w in [x] * 4), "stutter") for i in range(4)]
    data += [(5000 + i, clean() + " you stupid idiot, you moron", "insults") for i in range(3)]
    out = quality.assess(spark.createDataFrame(data, "doc_id long, text string, what string")).select("what", "_quality.kept").collect()
    share = defaultdict(list)
    for r in out:
        share[r["what"]].append(r["kept"])
    assert all(share.pop("clean"))
    assert not any(k for v in share.values() for k in v), {w: sum(v) for w, v in share.items()}


def test_expectation_maximisation():
    """Defects of very different frequency are told from good documents; abstaining isn't held against one."""
    rows = np.array([[2, 2, 2, 0], [0, 2, 2, 0], [2, 0, 0, 0], [1, 2, 2, 0], [2, 1, 2, 0], [2, 2, 1, 0], [1, 1, 2, 0]])
    for scale in (1, 1000):
        count = np.array([500, 60, 20, 90, 5, 1, 2], float) * scale
        good = quality.posterior(rows, quality.expectation_maximisation(rows, count))[:, 0]
        assert (good[:3] > 0.99).all() and (good[3:] < 0.1).all()


def test_rare_defects_count_at_any_size():
    """One low vote weighs the same however rare its kind and however large the corpus is."""
    votes = np.full((5, 10), 2)
    votes[:, 9] = 0
    votes[1, 1] = votes[2, 5] = votes[3, 7] = 1
    votes[4, [0, 2]] = 0
    for n in (1e4, 1e5, 1e6, 1e8):
        for rate in (1e-3, 1e-4, 1e-5, 1e-6):
            rare = max(n * rate, 1)
            count = np.array([n, rare, rare, 5 * rare, n / 5])
            good = quality.posterior(votes, quality.expectation_maximisation(votes, count))[:, 0]
            assert good[0] > 0.99 and good[4] > 0.99 and (good[1:4] < 0.1).all(), (n, rate, good)


# --- 9: line dedup


def test_line_dedup(spark):
    docs = [(r[0], r[1], r[3]) for r in ROWS] + [
        (100 + i, f"only here {i} x\n  shared footer \nends {i}", f"site{i % 12}" if i % 13 else None) for i in range(60)
    ] + [(200 + i, "shared footer", "site1") for i in range(3)] + [(300 + i, f"on nine {i}\nnine sites", f"site{i % 9}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    out = {(r["doc_id"]): r for r in lines.dedup_lines(df).collect()}
    blanks = " \t\n\x0b\x0c\r"
    sites, first = defaultdict(set), {}
    for i, t, s in docs:
        for p, x in enumerate((t or "").split("\n")):
            k = x.strip(blanks)
            if k:
                sites[k].add(s)
                if i is not None:
                    first[k] = min(first.get(k, (i, p)), (i, p))
    common = {k for k, v in sites.items() if len(v) >= lines.MIN_SITES}
    assert common == {"shared footer"}
    for i, t, _ in docs:
        if t is None:
            assert out[i]["text"] is None
            continue
        kept = [x for p, x in enumerate(t.split("\n")) if i is None or x.strip(blanks) not in common or first[x.strip(blanks)] == (i, p)]
        assert out[i]["text"] == "\n".join(kept)
    assert out[200]["_lines"]["emptied"] and not out[100]["_lines"]["emptied"] and not out[1]["_lines"]["emptied"]
    full = messy.docs(spark)
    assert lines.dedup_lines(full).columns == [*full.columns, "_lines"]
    assert lines.dedup_lines(full).count() == len(ROWS) and lines.dedup_lines(messy.empty(spark)).count() == 0


# --- 8: mixing


def test_mixing(spark):
    docs = messy.docs(spark)
    out = mixing.copies(mixing.sized(docs)).collect()
    size = [len(W.findall(r[1] or "")) for r in ROWS]
    assert sorted(r["size"] for r in out) == sorted(size)
    per = defaultdict(int)
    for r, n in zip(ROWS, size, strict=True):
        per[r[3]] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(per), 1.5 * sum(per.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * per[s]}
        if not above:
            break
        for s in above:
            target[s] = 2.0 * per[s]
            left -= target[s]
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == per[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
    largest = defaultdict(int)
    for r, n in zip(ROWS, size, strict=True):
        largest[r[3]] = max(largest[r[3]], n)
    for s in per:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.copies(mixing.sized(docs.repartition(7))).collect()
    assert sorted((r["doc_id"] or -1, r["copies"], r["size"]) for r in out) == sorted((r["doc_id"] or -1, r["copies"], r["size"]) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_copy"]
    assert mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(messy.empty(spark)).count() == 0


# --- 4: decontamination


def test_decontamination(spark):
    rng = random.Random(5)
    items = [messy.sentence(rng, n) for n in (20, 30, 45, 60, 5, 3, 1)] + ["", None]
    one_off = items[2].split()
    one_off[0] = "other"  # an end word: 40 of 42 shingles left
    half = " ".join(items[3].split()[:30])
    texts = {
        1: messy.sentence(rng, 50) + " " + items[0].upper() + "\n" + messy.sentence(rng, 20),
        2: items[1],
        3: messy.sentence(rng, 200) + " " + " ".join(one_off),
        4: messy.sentence(rng, 30) + " " + half + " " + messy.sentence(rng, 40),
        5: messy.sentence(rng, 100),
        6: None,
        7: "",
        8: "x " + items[5] + " y",
        9: messy.sentence(rng, 5000) + " " + items[0] + " " + items[3],
    }
    bench = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()] * 2, "doc_id long, text string, item_id string").repartition(3)
    found = {r["doc_id"]: r["_leak"] for r in decontam.leaks(docs, bench).collect()}
    assert {i: v and v["item_id"] for i, v in found.items()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None, 7: None, 8: 5, 9: 0}
    assert found[9]["n_items"] == 2 and found[1]["similarity"] == 1.0 and 0.75 <= found[3]["similarity"] < 1
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted([4, 5, 6, 7] * 2)
    assert decontam.decontaminate(docs, bench.filter("false")).count() == docs.count()
    assert decontam.leaks(messy.empty(spark), bench).count() == 0


def test_groups_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    items = [messy.sentence(rng, 25) for _ in range(9)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, messy.sentence(rng, 30) + " " + (items[i % 9] if i % 2 else "") + " " + items[(i * 2) % 9]) for i in range(20)], "doc_id long, text string")
    one = sorted(decontam.leaks(docs, bench).collect())
    monkeypatch.setattr(decontam, "GROUP_WORDS", 150)
    assert len(list(decontam._groups(bench))) > 2
    assert sorted(decontam.leaks(docs, bench).collect()) == one


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = decontam.Items(list(range(50)), [messy.sentence(random.Random(i), 20) for i in range(50)])
    prints = items.print_[rng.integers(0, 50, 200)] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 20), replace=False)) for _ in range(200)], np.uint64)
    win, item = items.within(prints)
    want = {(i, k) for i in range(200) for k in range(50) if int(prints[i] ^ items.print_[k]).bit_count() <= decontam.RADIUS}
    assert set(zip(win.tolist(), item.tolist(), strict=True)) == want


def best_similarities(items, text):
    """Weighted Jaccard of each item and the best window of its length, by every window."""
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [shingles(x.split()) for x in items]
    many = Counter(s for x in sets for s in x)
    weigh = lambda x: sum(1 / many[s] if s in many else 1 for s in x)
    w, out = text.split(), []
    for x, own in zip(items, sets, strict=True):
        n = len(x.split())
        wins = [shingles(w[i : i + n]) for i in range(len(w) - n + 1)]
        out.append(max((weigh(own & v) / weigh(own | v) for v in wins), default=0))
    return out


def test_windows_near_the_threshold(spark):
    """Words changed in a row, or in a lead-in of all items, turn many bits; all are found."""
    rng = random.Random(11)
    lead = messy.sentence(rng, 9)
    items = [messy.sentence(rng, n) for n in (40, 50, 100, 200)] + [lead + " " + messy.sentence(rng, 31) for _ in range(12)]
    texts = []
    for _ in range(60):
        for x, cut in zip(items[:5], (5, 6, 13, 27, 7), strict=True):
            words = x.split()
            at = 0 if x.startswith(lead) else rng.choice((0, len(words) - cut))
            words[at : at + cut] = messy.sentence(rng, cut).split()
            texts.append(" ".join(words))  # more text would hold other windows as similar
    want = []
    for t in texts:
        sims = best_similarities(items, t)
        k = max(range(len(items)), key=lambda j: (round(sims[j], 9), -j))
        want.append((k, round(sims[k], 6), sum(v >= 0.75 for v in sims)) if sims[k] >= 0.75 else None)
    assert all(want)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = decontam.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).orderBy("doc_id").collect()
    assert [v and (v["item_id"], round(v["similarity"], 6), v["n_items"]) for v in (r["_leak"] for r in got)] == want


def test_texts_shorter_than_their_item(spark):
    rng = random.Random(12)
    item = messy.sentence(rng, 40)
    w = item.split()
    texts = [w[:-1], w[:-2], w[1:], w[1:-1], w[:31], w[:30], w[:4], [*w[:20], "x", *w[20:38]]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = decontam.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).orderBy("doc_id").collect()
    want = [35 / 36, 34 / 36, 35 / 36, 34 / 36, 27 / 36, None, None, 30 / 41]
    for r, v in zip(got, want, strict=True):
        if v is None or v < 0.75:
            assert r["_leak"] is None
        else:
            assert r["_leak"]["similarity"] == pytest.approx(v) and r["_leak"]["first_word"] == 0 and r["_leak"]["n_items"] == 1


# --- 6: personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(k, m.group())]
    return ",".join(f"{PATTERNS[i][0]}:{a}:{b}" for a, i, b in sorted(found))


def test_personal_data(spark, tmp_path):
    rng = random.Random(8)
    parts = ["a.b@c.de_f@g.h", "x@y", "é@ü.com", "und.34@mail7.example.com", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.1.2.3", "1.2.3", "4111 1111 1111 1111",
             "4111-1111-1111-1111-", "4111  1111", "4111111111111112", "+1 (017) 555-7713", "+1234567890123456", "+12.34.56.78.90.", "日本 +49 30 1234567", 'token = "908038b7daaf91e730d2f64001"',
             "call tel: 555-123-4567", "1" * 19, "12 34", "0" * 14, "+", "@", "@@a@b.cc", "-" * 5]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += ["".join(rng.choice("ab0123456789.@+- ()\n") for _ in range(300)) for _ in range(100)]
    texts += ["7" * 30_000 + "@" + "a." * 20_000, "1.2.3.4 " * 3000, "a" * 40_000]
    data = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in ROWS[:12]] + [(None, "p@q.rs")]
    spark.createDataFrame(data, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op6_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    want = Counter((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in data)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    texts_of = dict(data)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] >= len(ROWS):
            base = base_spans(texts_of[r["doc_id"]])
            spans = [s for s in r["spans"].split(",") if s]
            assert set(filter(None, base.split(","))) <= set(spans)
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s.startswith(k + ":") for s in base.split(",")) for k, _ in PATTERNS)
    assert pii.personal_data(messy.empty(spark)).count() == 0


def test_added_spans(spark):
    """On the smallest table: stated tokens are found, and texts without digits or @ stay clean."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    secret = pii.KINDS.index("secret")
    for i, t in text.items():
        said = {m.start() for m in re.finditer(r'\btoken = "[0-9a-f]{40}', t)}
        assert said == {s["start"] for s in out[i] if s["kind"] == secret}
        assert out[i] == [] or re.search("[0-9@]", t)


# --- 7: language model


def test_lm_base_and_probabilities(spark):
    got = lm.score_documents(messy.docs(spark), block_chars=4000).collect()
    assert len(got) == len(ROWS)
    toks = [(r[0], W.findall((r[1] or "").translate(LOWER)) + [None]) for r in ROWS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter((i if i is not None else -1, held(i), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 5)) for i, t in toks)
    assert Counter((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score_documents(messy.empty(spark)).count() == 0


def test_lm_classes_sum_to_one():
    rng = np.random.default_rng(0)
    w = lm.Weights(rng.normal(size=(lm.FEATURES, 16)).astype(np.float32), rng.normal(size=(lm.FEATURES, 16, 16)).astype(np.float32))
    h, at = lm.tokens(pa.array(["a b c d a b", "", "a"]))
    f = lm.features(h, at)
    total = sum(np.exp(w.log_classes(f, np.full(len(f), a), np.full(len(f), b))) for a in range(16) for b in range(16))
    assert np.allclose(total, 1, atol=1e-4)
    assert (f[0] == f[7]).all() and (f[7] == f[8]).all()  # every text starts alike


def test_lm_learns(spark):
    """Held-out texts of a source with word order are likelier under the model than by counts."""
    rng = random.Random(4)
    nexts = {i: [rng.randrange(60) for _ in range(3)] for i in range(60)}

    def text():
        x, out = rng.randrange(60), []
        for _ in range(200):
            out.append(f"w{x}")
            x = rng.choice(nexts[x])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string").repartition(2)
    out = [r for r in lm.score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.9 * sum(r["base_score"] for r in out)


# --- 2: substring dedup


def gear_chunks(data: bytes):
    h = [0] * len(data)
    for i in range(len(data)):
        h[i] = sum(int(substring._GEAR[data[i - k]]) << (2 * k) for k in range(16) if i - k >= 0) % (1 << 32)
    top = (1 << 32) - 1
    for i in range(len(data)):
        if i < 15 or (i + 1 < len(data) and data[i + 1] & 0xC0 == 0x80):
            h[i] = top
    cuts = [0]
    for i in range(len(data)):
        before, after = h[max(0, i - 15) : i], h[i + 1 : i + 16]
        if h[i] != top and all(h[i] < x for x in before) and all(h[i] <= x for x in after) and i + 1 < len(data):
            cuts.append(i + 1)
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)] if data else []


def test_chunks_equal_the_definition():
    texts = ["", "short", *[t for t in messy.texts() if t][3:20], "é" * 40, "ab" * 100]
    raw, offs = substring.buffers(pa.array(texts))
    c = substring.chunks(raw, offs)
    got = defaultdict(list)
    for s, e, d in zip(c.start, c.end, c.doc, strict=True):
        got[int(d)].append(raw[s:e].tobytes())
    for i, t in enumerate(texts):
        assert got[i] == gear_chunks(t.encode())


def test_passages(spark):
    rng = random.Random(11)
    passages = [messy.sentence(rng, 60) for _ in range(3)]
    data = [(i, messy.sentence(rng, 70) + " " + passages[i % 3] + " " + messy.sentence(rng, 50)) for i in range(30)]
    data += [(100 + i, messy.sentence(rng, 150)) for i in range(30)]
    data += [(200 + i, messy.sentence(rng, 40) + " a short line that many have in common here") for i in range(10)]
    data += [(r[0] + 1000 if r[0] is not None else None, r[1]) for r in ROWS]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r for r in substring.dedup_passages(df, block_chars=6000).collect()}
    assert substring.dedup_passages(df, block_chars=6000).count() == len(data)
    for i in range(30):
        r = out[i]
        assert 40 <= r["repeated_words"] <= 62
        assert (r["removed_words"] > 0) == (i >= 3)
        if i < 3:
            assert r["text"] == dict(data)[i]
        else:
            left = r["text"].split()
            assert len(dict(data)[i].split()) - len(left) >= 35 and left[:65] == dict(data)[i].split()[:65]
    assert not any(out[i]["repeated_words"] for i in [*range(100, 130), *range(200, 210)])
    assert out[1010]["removed_words"] == 0 and out[1011]["text"] == "" and out[1000]["text"] is None and out[1001]["text"] == ""
    one = sorted((r["doc_id"] or -1, r["text"] or "") for r in substring.dedup_passages(df).collect())
    assert one == sorted((r["doc_id"] or -1, r["text"] or "") for r in substring.dedup_passages(df, block_chars=6000).collect())
    assert substring.dedup_passages(messy.empty(spark)).count() == 0


# --- 1: license scans


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
        ("a/b/c/x.py", "print(1)"),
        ("a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/y.py", "# " + apache + "\n" + "code words " * 50),
        ("a/z.py", None),
        ("other/n.py", "nothing is said of a licence to kill here at all, at length"),
        ("top.py", ""),
        (None, "Released under the MIT License."),
        (None, "no"),
        ("a/b/c/x.py", "print(1)"),
    ]
    df = spark.createDataFrame(files, "path string, text string").repartition(3)
    out = licenses.scan_licenses(df).collect()
    assert len(out) == len(files)
    got = Counter((r["path"], r["license"], r["effective"], r["inherited_from"]) for r in out)
    assert got == Counter(
        [
            ("a/LICENSE", "MIT", "MIT", None),
            ("a/b/c/x.py", None, "GPL-3.0", "a/b"),
            ("a/b/c/x.py", None, "GPL-3.0", "a/b"),
            ("a/b/LICENSE.txt", "GPL-3.0", "GPL-3.0", None),
            ("a/b/c/y.py", "Apache-2.0", "Apache-2.0", None),
            ("a/z.py", None, "MIT", "a"),
            ("other/n.py", None, None, None),
            ("top.py", None, None, None),
            (None, "MIT", "MIT", None),
            (None, None, None, None),
        ]
    )
    assert licenses.scan_licenses(df.filter("false")).count() == 0


def test_license_cosine(spark):
    said = ["Licensed under CC BY-NC 4.0.", "All rights reserved by the author", "the MIT license was released"]
    df = spark.createDataFrame([(s, i + 1) for i, s in enumerate(said)], "statement string, files long")
    got = {r["statement"]: (r["license"], r["score"]) for r in licenses.template_scores(df, 6).collect()}
    terms = lambda s: re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", s.lower())
    files = Counter()
    for i, s in enumerate(said):
        for t in set(terms(s)):
            files[t] += i + 1
    vector = lambda s: {t: n * (math.log(7 / (min(files[t], 6) + 1)) + 1) for t, n in Counter(terms(s)).items()}
    cos = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    for s in said:
        best = min((-round(cos(vector(s), vector(t)), 9), name) for name, ts in licenses.TEMPLATES.items() for t in ts)
        assert got[s] == (best[1], pytest.approx(-best[0]))
