import random
import re

from pyspark.sql import Row

from cartlens.llm import op6_quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen = {}
    for i in range(n - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    rep = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    longest, covered = 0, set()
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        longest = max(longest, best)
        if best >= q.LEAST_REPEAT:
            covered |= set(range(i, i + best))
    failed = n < 20 or 100 * len(rep) > 30 * n
    kept = not failed and len(covered) <= q.MOST_COVERED * n and longest <= q.LONGEST_REPEAT
    return dict(
        n_words=n, word_chars=sum(map(len, words)), n_symbols=sum(text.count(c) for c in "#*$%&|<>"),
        n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(rep), base_failed=failed, kept=kept,
        covered_words=len(covered), longest_repeat=longest,
    )


def texts():
    rnd = random.Random(5)
    out = [None, "", " \n\t", "one", "é ü x # <b>", "a b\na b\n a b\na b", "w " * 200, "\n\n x\n\nx\n"]
    for size in (15, 25, 60, 120):
        for vocabulary in (2, 5, 40, 1000):
            words = [f"v{rnd.randrange(vocabulary)}" for _ in range(size)]
            if rnd.random() < 0.5:
                words += words[: size // 2]
            out.append("".join(w + rnd.choice([" ", "\n", "  ", "\t"]) for w in words))
    out.append(" ".join(f"q{i}" for i in range(300)) + " " + " ".join(f"q{i}" for i in range(150)))
    return out


def test_against_brute_force(spark):
    rows = texts()
    rows += rows[5:9]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r.asDict() for r in q.quality_scores(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert {k: v for k, v in got[i].items() if k != "doc_id"} == brute(t), t


def test_kept_rows_keep_their_columns(spark):
    good = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame(
        [(1, good, "a"), (1, good, "a"), (2, None, "b"), (3, "w " * 90, None), (None, good, None)],
        "doc_id long, text string, kept string",
    )
    got = sorted(q.keep_good(df).collect(), key=str)
    assert got == sorted([Row(1, good, "a"), Row(1, good, "a"), Row(None, good, None)], key=str)
    assert q.keep_good(df.filter("doc_id = 99")).columns == df.columns
    assert q.quality_scores(df.filter("doc_id = 99")).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "same words again " * 200_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in q.quality_scores(df).collect()}
    assert got[1].n_words == 600_000 and got[1].n_repeat_words == 600_000 and not got[1].kept
    assert got[1].longest_repeat == 599_997
    assert got[2].n_words == 1 and got[2].base_failed
