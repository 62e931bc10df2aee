import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cartlens.llm import op4_suffix_tree as p

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def folded(t):
    """Symbols with gaps as one, their allowed contexts, and (byte before, kind) of the gaps."""
    raw = [*lower(t).encode(), 256]
    sym = [p.GAP if s in p.GAPS else s for s in raw]
    padded, out, gaps, letters = [p.GAP] * p.BORDER + sym, [], [], 0
    for i, s in enumerate(sym):
        depth = min(letters + 1, p.DEPTH) if letters else p.BORDER
        out.append((tuple(padded[i + p.BORDER - depth : i + p.BORDER]), s))
        if s == p.GAP:
            gaps.append((padded[i + p.BORDER - 1], p.GAPS.index(raw[i])))
        letters = 0 if s == p.GAP else letters + 1
    return out, gaps


def brute(rows, least, bits):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words, grams, kinds = Counter(), defaultdict(Counter), Counter()
    for (_, t), h in zip(rows, held):
        if h:
            continue
        words.update(WORD.findall(lower(t)) + ["\n"])
        runs, gaps = folded(t)
        kinds.update(gaps)
        for c, s in runs:
            for d in range(len(c) + 1):
                grams[c[len(c) - d :]][s] += 1
    kept = {()}
    for c, nxt in list(grams.items()):
        if c and sum(nxt.values()) >= least:
            n, up = sum(nxt.values()), grams[c[1:]]
            m = sum(up.values())
            if sum(k / n * math.log2((k / n) / (up[s] / m)) for s, k in nxt.items()) >= bits:
                kept |= {c[i:] for i in range(len(c) + 1)}

    def chance(c, s):
        nxt = grams[c]
        n = sum(nxt.values())
        return (nxt[s] + p.PRIOR * chance(c[1:], s)) / (n + p.PRIOR) if c else (nxt[s] + 1) / (n + p.SYMBOLS)

    def kind(before, k):
        whole = sum(kinds.values())
        here = sum(n for (b, _), n in kinds.items() if b == before)
        general = (sum(n for (_, x), n in kinds.items() if x == k) + 1) / (whole + len(p.GAPS))
        return (kinds[before, k] + p.PRIOR * general) / (here + p.PRIOR)

    big_n, big_v = sum(words.values()), len(words)
    out = []
    for (i, t), h in zip(rows, held):
        own = WORD.findall(lower(t)) + ["\n"]
        base = sum(math.log10((words[w] + 1) / (big_n + big_v + 1)) for w in own)
        runs, gaps = folded(t)
        score = sum(math.log10(kind(*g)) for g in gaps)
        for c, s in runs:
            score += math.log10(chance(next(c[k:] for k in range(len(c) + 1) if c[k:] in kept), s))
        out.append((i, h, len(own), sum(words[w] > 0 for w in own), big_n, base, score))
    return out


def corpus():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(80)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "Abc \t dÉ"), (202, "Zzz unseen zzz")]
    return rows + rows[:3]


@pytest.mark.parametrize("hot_state,hot_share", [(0.0, 1e-6), (0.02, 5e-3), (2.0, 2.0)])
def test_against_brute_force(spark, hot_state, hot_share):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = p.lm_scores(df, least_count=6, least_bits=0.3, hot_state=hot_state, hot_share=hot_share).collect()
    want = sorted(brute(rows, 6, 0.3), key=str)
    for g, w in zip(sorted((tuple(r) for r in got), key=str), want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert p.lm_scores(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = p.lm_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0)
    assert r.score == pytest.approx(-3 * math.log10(p.SYMBOLS) - math.log10(len(p.GAPS)))


def test_states_grow_with_the_input_and_held_out_texts_gain(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")

    def states(df):
        counts = p.counts_of(df.select("text", F.lit(False).alias("held_out")))
        model, others = p.learned(counts, (p.LEAST_COUNT, p.LEAST_BITS), p.HOT_STATE)
        return len(model.node) + others.count()

    assert states(docs) > 1.4 * states(docs.filter("doc_id % 4 = 0"))
    total = lambda **k: p.lm_scores(docs, **k).filter("held_out").agg({"score": "sum"}).first()[0]
    deep, flat = total(), total(least_bits=1e9)
    assert deep > 0.75 * flat
    assert deep == pytest.approx(total(hot_state=1e-3), rel=1e-9)


def test_a_very_long_text_and_word(spark):
    rows = [(1, "abcdefgh " * 100_000), (3, "abcdefgh" * 100_000), (5, "abcdefgh abcdefgh")]
    got = {r.doc_id: r for r in p.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), hot_share=0.5).collect()}
    assert [got[i].n_tokens for i in (1, 3, 5)] == [100_001, 2, 3]
    assert all(r.score < 0 for r in got.values()) and got[5].score > got[3].score
