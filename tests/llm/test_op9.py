import random
import zlib

import numpy as np

from cartlens.llm import op9_toxicity as o


def rows(n=400):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdehilmnorst") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 80))]
        toxic = rnd.random() < 0.3
        if toxic:
            text.insert(rnd.randrange(len(text)), "zukq" + rnd.choice(words))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark, tmp_path):
    docs, labels = rows(900)
    docs += [(2900, None, "x"), (2901, "", "x"), (2902, "zukq" + "y" * 100_000 + " fine words" * 20_000, "x"), (None, "no id", "x"), docs[5]]
    labels += [(7, None), (9999, 1), (8, labels[8][1])]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = o.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, t in labels if t is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 0 < len(held) < 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2900].score == by_id[2901].score and not by_id[None].held_out


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in o.score(docs, o.fit(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int")
    assert [r.score for r in o.score(docs, o.fit(docs, one)).collect()] == [1.0, 1.0]
    assert o.score(docs.filter("false"), o.fit(docs, none)).count() == 0


def test_swaps_and_penalty():
    assert o.swapped("The Women and a womanly man") == "The men and a womanly girl"
    assert o.swapped("nobody here") is None
    code = lambda *x: np.array(x, np.int32).tobytes()
    # feature 0 names a group, 1 stands for its swap, 2 is abuse that comes with 0 only
    own = [code(0, 2)] * 30 + [code(0)] * 3 + [code(3)] * 40
    label = np.array([1.0] * 30 + [0.0] * 43)
    twin = [code(1, 2)] * 30 + [code(1)] * 3 + [None] * 40
    free = o.descend(own, [None] * 73, label, {0: 1.0, 1: 1.0}, 4)
    held = o.descend(own, twin, label, {0: 1.0, 1: 1.0}, 4)
    assert abs(held[0] - held[1]) < 0.5 * abs(free[0] - free[1])
    assert held[2] > 1


def test_repeated_ids_stay_within_the_bound(spark):
    docs, labels = rows(60)
    frame = spark.createDataFrame([d[:2] for d in docs] + [(1, f"copy {k}") for k in range(500)] + [(2, None)] * 300, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    sample, sizes = o.sample_of(frame, known, 10)
    taken = [tuple(r) for r in sample.collect()]
    texts = {}
    for i, t in frame.collect():
        texts.setdefault(i, []).append(t)
    training = [(min((t for t in texts[i] if t is not None), default=None), label) for i, label in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert [sum(label == k for _, label in taken) for k in (0, 1)] == [10, 10] and set(taken) <= set(training)
    assert sizes == {k: sum(label == k for _, label in training) for k in (0, 1)}
    everything = o.sample_of(frame, known, 1000)[0].collect()
    assert sorted(map(tuple, everything), key=str) == sorted(training, key=str)


def test_descent_reaches_the_optimum_of_the_whole_loss():
    rnd = np.random.default_rng(8)
    n, features = 120, 6
    x = (rnd.random((n, features)) < 0.4).astype(float)
    label = (rnd.random(n) < 1 / (1 + np.exp(1 - 2 * x[:, 0] - x[:, 1]))).astype(float)
    twin = x.copy()
    twin[:, [0, 5]] = x[:, [5, 0]]
    has_twin = rnd.random(n) < 0.5
    weight = {0: 1.5, 1: 0.5}
    each = np.where(label > 0, weight[1], weight[0])
    each /= each.sum()
    gap = np.c_[x - twin, np.zeros(n)][has_twin]
    full = np.c_[x, np.ones(n)]
    ridge = np.diag([o.RIDGE] * features + [0.0])

    def loss(v):
        z = full @ v
        return (each * (np.logaddexp(0, z) - label * z)).sum() + v @ ridge @ v / 2 + o.SWAP_PENALTY * (each[has_twin] * (gap @ v) ** 2).sum()

    best = np.zeros(features + 1)
    for _ in range(60):  # Newton's method on all weights
        p = 1 / (1 + np.exp(-full @ best))
        slope = full.T @ (each * (p - label)) + ridge @ best + 2 * o.SWAP_PENALTY * gap.T @ (each[has_twin] * (gap @ best))
        bend = full.T * (each * p * (1 - p)) @ full + ridge + 2 * o.SWAP_PENALTY * (gap.T * each[has_twin]) @ gap
        best = best - np.linalg.solve(bend, slope)
    lists = lambda m: [np.flatnonzero(r).astype(np.int32).tobytes() for r in m]
    got = o.descend(lists(x), [t if k else None for t, k in zip(lists(twin), has_twin)], label, weight, features)
    assert loss(got) - loss(best) < 1e-5 < loss(np.zeros(features + 1)) - loss(best)
    assert np.abs(got - best).max() < 0.05
