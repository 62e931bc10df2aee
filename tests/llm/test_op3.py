import random
import re

import pytest

from cartlens.llm import op3_minhash as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, shingle=3, percent=85):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(root(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        c = min((x for x in ids[root(i)] if x is not None), default=None)
        if not sets[i]:
            c = r[0]
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return sorted(out, key=str)


def corpus(families=6, copies=12, edits=4, words=90, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(500)]
    rows = []
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    rows += [None, "", " \t\n", "one", "One", "two words", "two  WORDS", "a b c", rows[0], rows[0].upper()]
    rnd.shuffle(rows)
    return [(i * 3 if i % 41 else None, t, "x") for i, t in enumerate(rows)]


SCHEMA = "doc_id long, text string, component_id string"


@pytest.mark.parametrize("small", [8, 2])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(m, "SMALL", small)
    monkeypatch.setattr(m, "BLOCK", 3)
    rows = corpus()
    got = sorted((tuple(r) for r in m.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_one_row_of_each_stays(spark):
    rows = corpus(3, 5)
    rows += [rows[4], rows[9], (7_000, None, "y"), (7_000, "", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = m.one_of_each(df, shingle=5, percent=80, rows=4, bands=30)
    assert out.columns == df.columns
    want = {(i, c) for i, n, c, k in brute(rows, 5, 80) if n and k}
    got = [r for r in out.collect() if WORD.search(r.text or "")]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, _ in want if i is not None)
    assert m.one_of_each(df.filter("false")).count() == 0
    assert m.near_duplicates(df.filter("false")).count() == 0


def test_unrelated_rows_without_own_id_stay(spark):
    rnd = random.Random(5)
    prose = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    alone, shared, copied = [prose() for _ in range(12)], [prose() for _ in range(4)], prose()
    rows = [(None, t, "null") for t in alone] + [(5, t, "same") for t in shared] + [(9, copied, "copy"), (None, copied, "copy"), (9, copied, "copy")]
    rows += [(None, None, "blank"), (None, " ", "blank"), (5, "", "blank")]
    rnd.shuffle(rows)
    out = m.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    text = lambda k: sorted(r.text for r in out if r.component_id == k)
    assert text("null") == sorted(alone) and text("same") == sorted(shared)
    assert [(r.doc_id, r.text) for r in out if r.component_id == "copy"] == [(9, copied)]
    assert sum(r.component_id == "blank" for r in out) == 3


def test_rows_that_repeat_an_id_are_one_set_each(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    near = words[:-3] + ["x", "y", "z"]
    rows = [(1, " ".join(words))] * 200 + [(2, " ".join(near))] * 200 + [(None, " ".join(near[::-1]))] * 50 + [(None, " ".join(words[::-1]))] * 50
    sizes, plain = [], m.confirmed

    def confirmed(pairs, sets, percent):
        sizes.append((sets.count(), sets.select("node").distinct().count()))
        return plain(pairs, sets, percent)

    monkeypatch.setattr(m, "confirmed", confirmed)
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "component_id").count().collect()
    assert sizes == [(4, 4)]
    assert {tuple(r) for r in got} == {(1, 1, 200), (2, 1, 200), (None, None, 100)}


def test_a_very_long_text(spark):
    long = " ".join(f"w{i * 7919 % 400_009}" for i in range(400_000))
    rows = [(5, long), (6, long + " and a little more"), (7, "short text of its own")]
    got = {r.doc_id: (r.component_id, r.kept) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: (5, True), 6: (5, False), 7: (7, True)}
