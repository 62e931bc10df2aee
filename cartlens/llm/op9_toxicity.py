"""Toxicity: a logistic classifier regularised by counterfactual identity swaps.

Features are presences of hashed words, word beginnings and byte n-grams inside words, so that inflected and
compounded forms share evidence. The classifier is fitted on a bounded sample of the labelled rows (``SAMPLE_ROWS``
per class, in seeded hash order): document frequencies per class are counted in Spark, the ``FEATURES`` with the
clearest log odds stay, and one task fits the weights on the sample's short feature lists. Texts of the sample that
name a group of people are also taken with that term swapped for another one of the same language; the loss holds
the squared difference of the two scores, which takes the weight off the terms themselves and so spares
neutral mentions. Class weights restore the label shares of all training rows, so scores are probabilities.

Scoring is one pass over the texts with a table of at most ``FEATURES`` weights broadcast; no shuffle.

Defined results: null and empty texts have no features and get the score of the bias. Rows are scored one by
one, so repeated rows repeat. A label that is null doesn't count, several labels of one id count as the largest, and of
several texts of one id the least is learned from, so repeated ids can't pass the bound of the sample. Without
labels of both classes every score is the share of label 1 (0 without labels). A null id counts as not held out.
Very long texts are read whole; only doc_id, text and toxic are read, so other columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.registry import query, table
from cartlens.llm.words import Words, counted, mix, range_hash, word_slices
from cartlens.session import written

#: Labelled rows of each class that the fit sees at most.
SAMPLE_ROWS = 12_000
FEATURES = 8192
LEAST_DOCS = 3
BITS = 22
BEGINNINGS = (3, 4, 5, 6, 7, 8)
INSIDE = (4, 5)
ROUNDS = 400
RIDGE = 1e-4
SWAP_PENALTY = 1.0
THRESHOLD = 0.3

#: Neutral names of groups of people, by language; a term is swapped for another one of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees"),
    ("woman", "man", "girl", "boy", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "immigrant", "refugee"),
    ("black", "white", "asian", "african", "european", "american", "mexican", "arab", "gay", "lesbian", "straight", "transgender"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "homosexuels"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "homosexuelle"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "homosexuales"),
)


def swapped(text: str) -> str | None:
    """The text with each identity term replaced by the next of its row, or None if it has none."""
    follower = {t: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i, t in enumerate(row)}
    pattern = regex.compile(r"(?<!\w)(" + "|".join(follower) + r")(?!\w)", regex.IGNORECASE)
    out, n = pattern.subn(lambda m: follower[m[0].lower()], text)
    return out if n else None


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every feature in the texts, repeats included. ``w`` in lower case."""
    texts, size = w.text_of_word(), w.end - w.start
    shift = np.uint64(64 - BITS)
    found = [(texts, mix(w.hashes() + np.uint64(1)) >> shift)]
    for n in BEGINNINGS:
        own = size >= n
        start = w.start[own]
        found.append((texts[own], mix(range_hash(w.prefix, start, start + n) + np.uint64(2)) >> shift))
    if len(texts):
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + w.start[word]
        left = w.end[word] - place
        inner = (place > w.start[word]) & ((w.raw[place] & 0xC0) != 0x80)
        for n in INSIDE:
            own = inner & (left >= n)
            start = place[own]
            found.append((texts[word[own]], mix(range_hash(w.prefix, start, start + n) + np.uint64(3)) >> shift))
    return np.concatenate([t for t, _ in found]), np.concatenate([f for _, f in found]).astype(np.int64)


def chosen_lists(w: Words, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chosen features by text: (text number, place in the weight list), in order."""
    text, feature = features(w)
    place = number[feature]
    own = place >= 0
    keys, _ = counted(text[own] * FEATURES + place[own])
    return keys // FEATURES, keys % FEATURES


def numbers_of(ids: list[int]) -> np.ndarray:
    out = np.full(1 << BITS, -1, np.int32)
    out[ids] = np.arange(len(ids))
    return out


def remainder(key: Column, by: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % by


def sample_of(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """text and label of at most ``rows`` training ids of each class, and how many training ids each class has."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_label"))
    known = written(known.filter(remainder(F.col("doc_id"), 4) != 2), "labels")
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    parts = [
        known.filter(F.col("_label") == label).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(rows) for label in (0, 1)
    ]
    few = parts[0].unionByName(parts[1]).withColumnRenamed("doc_id", "_labelled")
    texts = docs.select("doc_id", "text")
    found = texts.join(F.broadcast(few), texts["doc_id"] == few["_labelled"])
    return found.groupBy("_labelled", "_label").agg(F.min("text").alias("text")).select("text", "_label"), sizes


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """{"ids": chosen features, "weights": theirs, "bias": float}."""
    sample, sizes = sample_of(docs, labels, rows)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return {"ids": [], "weights": np.zeros(0), "bias": None, "share": share}
    sample = written(sample, "sample")
    taken = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    if len(taken) < 2:
        return {"ids": [], "weights": np.zeros(0), "bias": None, "share": share}

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, w in word_slices(batch.column(0), lower=True):
                text, feature = features(w)
                keys, _ = counted((text << BITS) | feature)
                own = label[a:b][keys >> BITS]
                for k in (0, 1):
                    seen[k] += np.bincount(keys[own == k] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(seen.sum(axis=0))
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0][part].astype(np.int64)), pa.array(seen[1][part].astype(np.int64))], ["f", "c", "t"])

    counts = sample.mapInArrow(count, "f long, c long, t long").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    odds = F.log((F.col("t") + 0.5) / (taken[1] + 1.0)) - F.log((F.col("c") + 0.5) / (taken[0] + 1.0))
    clear = F.abs(odds) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counts.filter(F.col("c") + F.col("t") >= LEAST_DOCS).orderBy(clear.desc(), "f").limit(FEATURES).select("f").collect()
    ids = [r["f"] for r in best]

    def lists(batches):
        number = numbers_of(ids)

        def of(column):
            out = []
            for a, b, w in word_slices(column, lower=True):
                text, place = chosen_lists(w, number)
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                out += [place[x:y].astype(np.int32) for x, y in zip(cuts[:-1], cuts[1:])]
            return out

        for batch in batches:
            other = [swapped(t or "") for t in batch.column(0).to_pylist()]
            twin = [x if o is not None else None for x, o in zip(of(pa.array(other, pa.string())), other)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in of(batch.column(0))], pa.binary()), pa.array([None if x is None else x.tobytes() for x in twin], pa.binary()), batch.column(1)],
                ["own", "twin", "label"],
            )

    weight = {k: sizes[k] / taken[k] for k in (0, 1)}

    def solve(batches):
        own, twin, label = [], [], []
        for batch in batches:
            own += batch.column(0).to_pylist()
            twin += batch.column(1).to_pylist()
            label += batch.column(2).to_pylist()
        if own:
            w = descend(own, twin, np.array(label, float), weight, len(ids))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    lists_of = written(sample.mapInArrow(lists, "own binary, twin binary, label int"), "lists")
    fitted = lists_of.coalesce(1).mapInArrow(solve, "w binary").collect()
    w = np.frombuffer(bytes(fitted[0]["w"]))
    return {"ids": ids, "weights": w[:-1], "bias": float(w[-1]), "share": share}


def descend(own: list[bytes], twin: list[bytes | None], label: np.ndarray, weight: dict[int, float], n: int) -> np.ndarray:
    """Weights and bias by Nesterov descent on weighted log loss + ridge + penalty on swapped scores."""
    order = sorted(range(len(own)), key=lambda i: (own[i], label[i]))  # rows come in no fixed order
    own, twin, label = [own[i] for i in order], [twin[i] for i in order], label[order]

    def matrix(lists):
        size = np.array([len(x) // 4 for x in lists], np.int64)
        return np.repeat(np.arange(len(lists)), size), np.frombuffer(b"".join(lists), np.int32)

    row, col = matrix(own)
    pairs = [i for i, t in enumerate(twin) if t is not None]
    swap_row, swap_col = matrix([twin[i] for i in pairs])
    pair_of = np.full(len(own), -1)
    pair_of[pairs] = np.arange(len(pairs))
    first = pair_of[row] >= 0
    base_row, base_col = pair_of[row[first]], col[first]
    each = np.where(label > 0, weight[1], weight[0])
    each = each / each.sum()
    w, last, bias, last_bias = np.zeros(n), np.zeros(n), 0.0, 0.0
    bias = last_bias = math.log(max(1e-6, (each * label).sum()) / max(1e-6, (each * (1 - label)).sum()))

    def swap_pull(v):
        gap = np.bincount(base_row, v[base_col], len(pairs)) - np.bincount(swap_row, v[swap_col], len(pairs))
        pull = 2 * SWAP_PENALTY * gap * each[pairs]
        return np.bincount(base_col, pull[base_row], n) - np.bincount(swap_col, pull[swap_row], n)

    def curved(v, v_bias):  # bounds the loss's second derivative in the direction v
        bent = 0.25 * each * (np.bincount(row, v[col], len(own)) + v_bias)
        return np.bincount(col, bent[row], n) + RIDGE * v + (swap_pull(v) if pairs else 0.0), bent.sum()

    v, v_bias = np.ones(n), 1.0
    for _ in range(40):
        size = math.sqrt(float(v @ v) + v_bias**2)
        v, v_bias = curved(v / size, v_bias / size)
    rate = 0.8 / max(1e-9, math.sqrt(float(v @ v) + v_bias**2))
    for k in range(ROUNDS):
        ahead = w + (k / (k + 3.0)) * (w - last)
        ahead_bias = bias + (k / (k + 3.0)) * (bias - last_bias)
        z = np.bincount(row, ahead[col], len(own)) + ahead_bias
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        slope = each * (p - label)
        g = np.bincount(col, slope[row], n) + RIDGE * ahead
        if pairs:
            g += swap_pull(ahead)
        last, last_bias = w, bias
        w, bias = ahead - rate * g, ahead_bias - rate * slope.sum()
    return np.append(w, bias)


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and score (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(key, text)

    def run(batches):
        m = sent.value
        number = numbers_of(m["ids"])
        for batch in batches:
            for a, b, w in word_slices(batch.column(1), lower=True):
                if m["bias"] is None:
                    p = np.full(b - a, m["share"])
                else:
                    at, place = chosen_lists(w, number)
                    z = np.bincount(at, m["weights"][place], b - a) + m["bias"]
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], [key, "score"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, score double")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels").select("doc_id", "toxic"))
    return score(docs, model).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
