import itertools
import random
import re

from pyspark.sql import functions as F

from cartlens.llm import op10_mixing as m


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in rest}
        capped |= {s: 2.0 * sizes[s] for s in over}


def docs(spark, n=400):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        source = "a" if rnd.random() < 0.4 else rnd.choice(["b", "c", "dé", "e", None])
        text = None if i % 50 == 7 else " ".join("w" * rnd.randrange(1, 5) for _ in range(rnd.randrange(0, 60)))
        rows.append((i if i % 60 else None, text, source, i))
    rows += rows[10:14]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_and_taken(spark, tmp_path):
    rows, df = docs(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = m.op10_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = expected_targets(sizes)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = m.op10_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_rows_are_repeated(spark):
    rows, df = docs(spark, 150)
    out = m.mix_rows(df)
    assert out.columns == df.columns
    chosen, _ = m.mixed(df)
    want = chosen.agg(F.sum(F.col("_n") * F.col("_copies"))).first()[0]
    assert out.count() == want
    assert m.mix_rows(df.filter("false")).count() == 0


def test_flow_is_cheapest_on_overlaps():
    rnd = random.Random(1)
    for _ in range(40):
        n_s = rnd.randrange(1, 4)
        members = [sorted(rnd.sample(range(n_s), rnd.randrange(1, n_s + 1))) for _ in range(rnd.randrange(1, 4))]
        sizes = [rnd.randrange(0, 4) for _ in members]
        quotas = [rnd.randrange(0, 5) for _ in range(n_s)]
        flow = m.min_cost_flow(sizes, members, quotas, 2)
        given = [sum(f.values()) for f in flow]
        assert all(g <= 2 * z for g, z in zip(given, sizes))
        cost = lambda gs: sum(max(0, g - z) for g, z in zip(gs, sizes))
        best = None
        options = [
            [c for c in itertools.product(*[range(quotas[s] + 1) for s in ms]) if sum(c) <= 2 * z] for ms, z in zip(members, sizes)
        ]
        for pick in itertools.product(*options):
            into = [0] * n_s
            for ms, c in zip(members, pick):
                for s, x in zip(ms, c):
                    into[s] += x
            if all(i <= q for i, q in zip(into, quotas)):
                key = (-sum(map(sum, pick)), cost(list(map(sum, pick))))
                best = key if best is None else min(best, key)
        assert (-sum(given), cost(given)) == best


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["x", "y"] if i % 3 else ["x"], None) for i in range(90)] + [(500, "w", [None, "x"], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held array<string>, _x string")
    chosen, goals = m.mixed(df, memberships="held", weights=(1, 1))
    assert {r.source: r.source_size for r in goals.collect()} == {"x": 901, "y": 600, None: 1}
    assert chosen.filter("_copies > 2 or _copies < 0").count() == 0
