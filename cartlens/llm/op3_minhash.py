"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its word shingles. Rows with equal sets (128-bit digest of the sorted set) form one class before
anything is compared. Two permutations of the 32-bit numbers make all signature coordinates: coordinate k of a set is
the least pi(sigma(x) - k), pi shifted circularly by k. Bands of the signature are hashed to buckets.

* Buckets of up to ``SMALL`` classes give all their pairs.
* In larger ones every class is paired with a leader, the class whose buckets are largest in sum over all bands: the
  common origin of a family of copies, and the same one in all bands.
* Pairs are confirmed on the full sets; components of confirmed links give labels.
* Where the large buckets of a leader hold several labels, their classes are compared in packed blocks that carry the full
  sets: pairs of different label that share two bands or more are confirmed on the spot and only links come out, so a
  group whose members are not all near the leader loses no link. Pairs within the main label need no comparison.

Nothing is paired within a class, no bucket is capped, and no group is held whole in a task.

Defined results: null, empty and blank texts have an empty set, n_shingles 0 and are linked with nothing. Equal rows
fall in one class; a component's id is its smallest non-null document id (null if it has none), and ``kept`` means that
the row has this id, so rows that repeat a kept id are all kept (``one_of_each`` keeps one row of each component, whatever
the ids are). A very long text is one set of all its shingles; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.components import connected
from cartlens.llm.registry import query, table
from cartlens.llm.words import Words, mix, word_slices
from cartlens.session import written

SHINGLE = 3
PERCENT = 85
ROWS, BANDS = 5, 26
SMALL = 8
BLOCK = 32
LEAST_SHARED = 2


def fmix32(h: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    h, cuts, out = w.hashes(), w.of_text, []
    rolled = h.copy()
    for k in range(1, size):
        rolled[:-k or None] = mix(rolled[:-k or None] * np.uint64(3) + mix(h[k:] + np.uint64(k)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b == a:
            out.append(h[:0])
        elif b - a < size:
            whole = hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def band_hashes(sets: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """A row of band hashes for each (non-empty) set."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    sigma = fmix32((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    out = np.zeros((len(sets), bands), np.uint64)
    for k in range(rows * bands):
        least = np.minimum.reduceat(fmix32(sigma - np.uint32(k)), starts)
        band = k // rows
        out[:, band] = mix(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64) + np.uint64(k))
    return out.view(np.int64)


def classed(docs: DataFrame, key: str, text: str, shingle: int, rows: int, bands: int) -> DataFrame:
    """Written: doc_id, n, node (16 bytes; null for an empty set), bands."""

    def run(batches):
        for batch in batches:
            for a, b, w in word_slices(batch.column(1), lower=True):
                sets = shingle_sets(w, shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                hashes = band_hashes([sets[i] for i in full], rows, bands) if full else np.zeros((0, bands), np.int64)
                cuts = np.concatenate(([0], np.cumsum([bands if len(s) else 0 for s in sets])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.ravel())),
                    ],
                    ["doc_id", "n", "node", "bands"],
                )

    rows_ = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows_.schema["doc_id"].dataType.simpleString()
    return written(rows_.mapInArrow(run, f"doc_id {kind}, n long, node binary, bands array<bigint>"), "classed")


def alike(n: str, m: str, percent: int) -> str:
    """Sizes that allow the similarity."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def leaders_of(members: DataFrame) -> DataFrame:
    """Written: band, h, leader, m (its size) of the large buckets."""
    top = F.max(F.struct("weight", "node", "n"))
    large = members.filter(F.col("size") > SMALL).groupBy("band", "h").agg(top.alias("top"))
    return written(large.select("band", "h", F.col("top.node").alias("leader"), F.col("top.n").alias("m")), "leaders")


def first_pairs(members: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """a, b: a the class with larger buckets. ``members``: band, h, node, n, size, weight."""
    small = members.filter(F.col("size") <= SMALL)
    other = small.select("band", "h", F.col("node").alias("b"), F.col("n").alias("m"))
    near = small.join(other, ["band", "h"]).filter(F.col("node") < F.col("b")).filter(alike("n", "m", percent)).select(F.col("node").alias("a"), "b")
    large = members.filter(F.col("size") > SMALL)
    star = large.join(leaders, ["band", "h"]).filter(F.col("node") != F.col("leader")).filter(alike("n", "m", percent))
    star = star.select(F.col("leader").alias("a"), F.col("node").alias("b"))
    return near.unionByName(star).distinct()


def sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, repeated: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """Written: one row of node and items (its sorted shingle hashes) for each of ``nodes``.

    One text of each class is read again by its id. Where the id stands on several rows (``repeated``), all of its texts are
    read, only wanted classes are kept, and equal ones are reduced to one row before they can meet in a join.
    """
    wanted = written(nodes.join(classes.select("node", "rep"), "node"), "wanted")
    reps = wanted.select("rep").distinct()

    def run(batches):
        for batch in batches:
            for a, b, w in word_slices(batch.column(0), lower=True):
                sets = shingle_sets(w, shingle)
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])

    texts = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    texts = texts.join(reps, texts["_id"].eqNullSafe(reps["rep"]), "left_semi")
    several = texts["_id"].eqNullSafe(repeated["many"])
    once = texts.join(repeated, several, "left_anti").select("_text").mapInArrow(run, "node binary, items binary")
    often = texts.join(repeated, several, "left_semi").select("_text").mapInArrow(run, "node binary, items binary")
    often = often.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return written(once.unionByName(often), "sets")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough.

    The second node's set is joined first; then rows gather at the first, a leader perhaps of very many, where
    the rows with their sets are what skew handling splits.
    """

    def compare(batches):
        for batch in batches:
            keep = [similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("_of_b")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("items").alias("_of_a")), "a").select("a", "b", "_of_a", "_of_b")
    return written(two.mapInArrow(compare, "a binary, b binary"), "links")


def families(members: DataFrame, leaders: DataFrame, labels: DataFrame) -> DataFrame:
    """leader, node, label and block numbers for the leaders whose large buckets hold several labels.

    Two classes that share a large bucket share its leader. ``rest`` marks classes outside the main label.
    """
    large = members.filter(F.col("size") > SMALL)
    family = large.join(leaders, ["band", "h"]).select("leader", "node").distinct()
    family = written(family.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "families")
    parts = family.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("own"))
    mixed = parts.groupBy("leader").agg(F.max(F.struct("own", "label")).alias("main"), F.sum("own").alias("whole"), F.count(F.lit(1)).alias("labels"))
    mixed = mixed.filter("labels > 1").select(
        "leader", F.col("main.label").alias("main"),
        F.ceil(F.col("main.own") / BLOCK).alias("main_blocks"), F.ceil((F.col("whole") - F.col("main.own")) / BLOCK).alias("rest_blocks"),
    )
    rows = family.join(mixed, "leader").withColumn("rest", (F.col("label") != F.col("main")).cast("int"))
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("rest") == 1, F.col("rest_blocks")).otherwise(F.col("main_blocks")))
    return written(rows.withColumn("block", spread).drop("main"), "mixed_families")


def later_links(rows: DataFrame, sets: DataFrame, classes: DataFrame, percent: int, shared: int) -> DataFrame:
    """Confirmed links between classes of different label in the families, from packed blocks with their sets.

    Only links leave a task. Where two labels have met in a pair of blocks, their other pairs there need no comparison.
    """
    whole = rows.join(classes.select("node", "n", "bands"), "node").join(sets, "node")
    blocks = whole.groupBy("leader", "rest", "block").agg(
        F.collect_list(F.struct("node", "label", "n", "bands", "items")).alias("items"), F.first("main_blocks").alias("main_blocks"), F.first("rest_blocks").alias("rest_blocks")
    )
    blocks = written(blocks, "blocks")
    rest = blocks.filter("rest = 1")
    others = lambda first, count, is_rest: rest.select(
        "leader", "items", F.lit(is_rest).alias("rest"), F.explode(F.sequence(first, F.col(count) - 1)).alias("other")
    )
    left = others(F.col("block"), "rest_blocks", 1).unionByName(others(F.lit(0).cast("long"), "main_blocks", 0))
    right = blocks.select("leader", "rest", F.col("block").alias("other"), F.col("items").alias("others"))
    met = left.join(right, ["leader", "rest", "other"]).select("items", "others")

    def unpack(items):
        v = items.values
        return (
            v.field("node").to_pylist(), np.array(v.field("label").to_pylist(), object), v.field("n").to_numpy(),
            v.field("bands").flatten().to_numpy().reshape(len(v), -1), v.field("items").to_pylist(),
        )

    def compare(batches):
        for batch in batches:
            out = []
            for r in range(len(batch)):
                (x, lx, nx, bx, sx), (y, ly, ny, by, sy) = unpack(batch.column(0)[r]), unpack(batch.column(1)[r])
                common = (bx[:, None, :] == by[None, :, :]).sum(axis=2)
                low, high = np.minimum(nx[:, None], ny[None, :]), np.maximum(nx[:, None], ny[None, :])
                i, j = np.nonzero((common >= shared) & (lx[:, None] != ly[None, :]) & (100 * low >= percent * high))
                order = np.argsort(-common[i, j], kind="stable")
                up: dict[bytes, bytes] = {}

                def root(label):
                    while label in up:
                        label = up[label]
                    return label

                for p, q in zip(i[order], j[order]):
                    one, two = root(lx[p]), root(ly[q])
                    if one != two and similar(sx[p], sy[q], percent):
                        up[one] = two
                        out.append((x[p], y[q]))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([q for _, q in out], pa.binary())], ["a", "b"])

    return written(met.mapInArrow(compare, "a binary, b binary"), "later_links")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    base = classed(docs, key, text, shingle, rows, bands)
    classes = written(
        base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    repeated = written(base.groupBy(F.col("doc_id").alias("many")).count().filter("count > 1").select("many"), "repeated")
    spread = classes.select("node", "n", F.posexplode("bands").alias("band", "h"))
    # written first, so that both sides of the join are plain shuffles and a hot bucket is split; leaders likewise
    sizes = written(spread.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    shared_ = written(spread.join(sizes, ["band", "h"]), "buckets")
    weights = shared_.groupBy("node").agg(F.sum("size").alias("weight"))
    members = written(shared_.join(weights, "node"), "members")
    leaders = leaders_of(members)
    pairs = written(first_pairs(members, leaders, percent), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = confirmed(pairs, sets_of(asked, docs, classes, repeated, key, text, shingle), percent)
    labels = connected(links)
    mixed = families(members, leaders, labels)
    if mixed.limit(1).count():
        sets = sets_of(mixed.select("node").distinct(), docs, classes, repeated, key, text, shingle)
        more = later_links(mixed, sets, classes, percent, LEAST_SHARED)
        if more.limit(1).count():
            labels = connected(links.unionByName(more))
    found = classes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = found.groupBy("label").agg(F.min("rep").alias("component_id"))
    placed = found.join(least, "label").select(F.col("node").alias("_node"), "component_id")
    with_id = base.select("doc_id", "n", "node").join(placed, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return with_id.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents with one row of each component kept, with all their columns; texts without words all stay.

    Rows are told apart by a key of their own, so ids may be null or repeat. The row with the smallest id stays,
    a null id last; of equal ids the first row.
    """
    names, docs = docs.columns, docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])  # no name can clash
    key, text = f"_in{names.index(key)}", f"_in{names.index(text)}"
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered", compression="zstd")
    found = near_duplicates(rows, "_row", text, **settings).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_row").alias("row"))
    first = found.join(rows.select("_row", key), "_row").groupBy("_component").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.row").alias("_row")), "_row", "left_semi").select(*docs.columns).toDF(*names)


@query("op3_minhash")
def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
