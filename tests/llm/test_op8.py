import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cartlens.llm import op8_substrings as s
from cartlens.llm.words import prefix_hash


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(d) else 0
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [prose(rnd.randrange(5, 150)) for _ in range(60)]
    for _ in range(12):  # near copies with edits
        w = rnd.choice(out[:60]).split(" ")
        for _ in range(rnd.randrange(1, 4)):
            w[rnd.randrange(len(w))] = "XX"
        out.append(" ".join(w))
    passage = prose(60)
    out += [prose(rnd.randrange(0, 40)) + passage[rnd.randrange(3) :] + prose(rnd.randrange(0, 40)) for _ in range(25)]
    out += [passage[:199], passage[:200], passage[5:205] + "q" + passage[205:330]]
    out += ["a" * 500, "ab" * 300, "b" + "ab" * 90, "z" * 200, "z" * 199]
    twice = prose(50)
    out += [twice + "--" + twice, None, "", "short"]
    out += [out[0], out[0], out[70], "é" * 150]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("group", [64, 3])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(s, "GROUP", group)
    rows = corpus(group)
    df = spark.createDataFrame([(i if i % 50 else None, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, t int").repartition(5)
    got = Counter(tuple(r) for r in s.digest_rows(df).collect())
    assert got == Counter((i if i % 50 else None, *b) for i, b in enumerate(brute(rows)))


def test_suffix_order_and_extensions():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 30))).encode() for _ in range(200)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    cut = np.cumsum([0, *map(len, texts)])
    group = np.sort(np.array([rnd.randrange(30) for _ in texts]))
    order = s.suffix_order(raw, prefix_hash(raw), group, cut[:-1], np.diff(cut))
    assert [(group[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(group, texts))


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.digest_rows(df).count() == 0
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(2_500_000))
    r = s.digest_rows(spark.createDataFrame([(1, long + long[:1000])], "doc_id long, text string")).first()
    assert (r.n_removed, r.n_spans) == (2000, 2)


def test_large_group_takes_few_rows(spark):
    rnd = random.Random(8)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = prose(700)
    rows = [prose(300) + passage[rnd.randrange(40) :] + prose(300) for _ in range(150)]
    rows += [prose(300) + passage[:350] + "#" + passage[351:] + prose(300), *["".join(p) for p in zip(["x" * 150] * 3, [passage[200:450]] * 3, "pqr")]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in s.digest_rows(df).collect()) == [(i, *b) for i, b in enumerate(brute(rows))]
    regions = s.region_rows(s.named(df, "text")).groupBy("g").count().filter(f"count > {s.GROUP}")
    assert regions.count() > 0
    _, marked = s.repeated_bytes(s.named(df, "text"))
    held = [len(r.marks) for r in marked.collect()]
    # a run of windows is a few tiles: a row per window would give more than 500 a text
    assert max(held) < 100


@pytest.mark.parametrize("seed", range(2))
def test_tiles_of_close_groups(spark, seed):
    """All regions of an anchor run share it, but differ at either end by little."""
    rnd = random.Random(seed)
    base = "".join(rnd.choice("ab ") for _ in range(420))
    rows = []
    for _ in range(120):
        a, b = sorted(rnd.sample(range(420), 2))
        rows.append(base[:a] + rnd.choice("ab ") + base[a + 1 : b] + rnd.choice("abz") + base[b + 1 : rnd.randrange(300, 420)])
    rows += rows[:5]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in s.digest_rows(df).collect()) == [(i, *b) for i, b in enumerate(brute(rows))]
