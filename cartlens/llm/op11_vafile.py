"""Centroid clustering over a VA-file: vectors as few-bit cells per dimension, full vectors fetched only where needed.

``write_file`` cuts every dimension into at most 2 ** BITS cells at quantiles of all vectors. The tasks that read the vectors
write them, as 32-bit integers, to files in the shared folder, and return per block of ``BLOCK`` vectors a row with the
file, the place in it, the ids and the cells (a byte per dimension, a quarter of the vector). A round of clustering
scans the cells only: tables looked up by (centroid, dimension, cell) give the least and the largest squared distance
to each centroid, and tables by (pair of centroids, dimension, cell) the largest lead one centroid can have over
another, which is exact in every dimension and so decides most of what the plain intervals leave open. Where more than
one centroid may still be nearest, the full vector is read by its place, neighbouring places in one read.

Centroids need exact sums, so a round adds up the differences only: it assigns under the last and the new centroids and
fetches a vector where the answer differs, to take it off one sum and put it on another. Before the first round all
vectors count for centroid 0, whose sums the writing tasks make. What meets the driver each round is a count and a sum
per centroid and dimension. All distances and sums are integers, so neither order nor partitioning matters.

Files that a lost task leaves are never read: only rows that Spark commits name files.

Defined results: vectors that are null, hold null or non-finite components or have another number of components take
no part. Rows with a null id take part but start no centroid; repeated rows count as often as they are there, and of
equal hashes the smaller vector starts first. With fewer vectors than centroids there are fewer centroids, with none
an empty result. Ties go to the smaller number. Components beyond 2 ** 27 after scaling raise OverflowError. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.registry import query, table
from cartlens.session import scratch_path, written

BITS = 8
BLOCK = 4096
GAP = 16  # vectors between two wanted ones that are read along
LARGEST = 1 << 27
SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"


def integer_vectors(rows: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """id, v: array of floor(scale * x)."""
    v = F.col(f"`{vector}`")
    sound = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.filter(F.coalesce(sound, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("id"), scaled.alias("v"))


def cell_edges(vectors: DataFrame, size: int, bits: int) -> np.ndarray | None:
    """Ascending edges per dimension; cell c holds the integers from edge c to edge c + 1, less one. None without vectors."""
    inner = [i / (1 << bits) for i in range(1, 1 << bits)]
    parts = []
    for j in range(size):
        x = F.get("v", F.lit(j))
        parts += [F.min(x).alias(f"a{j}"), F.max(x).alias(f"b{j}"), F.percentile_approx(x, inner, 4 << bits).alias(f"q{j}")]
    found = vectors.agg(*parts).first()
    if found["a0"] is None:
        return None
    if max(max(-found[f"a{j}"], found[f"b{j}"]) for j in range(size)) > LARGEST:
        raise OverflowError("a component is too large for exact distances")
    return np.array([[found[f"a{j}"], *np.maximum.accumulate(found[f"q{j}"]), found[f"b{j}"] + 1] for j in range(size)], np.int64)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def cells_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component; among empty cells at one edge the last, which holds it."""
    return np.stack([np.searchsorted(e[1:-1], x[:, j], side="right") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def write_file(vectors: DataFrame, size: int, edges: np.ndarray, folder: str | None = None) -> DataFrame:
    """The written VA-file: file, offset (in vectors), ids, cells, sums — a row per block."""
    folder = folder or scratch_path(vectors.sparkSession, "vectors")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.i32", None, 0
        try:
            for batch in batches:
                for first in range(0, len(batch), BLOCK):
                    part = batch.slice(first, BLOCK)
                    x = matrix(part.column(1), size)
                    out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(x.astype("<i4").tobytes())
                    sums = pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))
                    ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
                    cells = pa.array([cells_of(x, edges).tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at]), ids, cells, sums], ["file", "offset", "ids", "cells", "sums"])
                    at += len(x)
        finally:
            if out is not None:
                out.close()

    blocks = vectors.mapInArrow(run, "file string, offset long, ids array<long>, cells binary, sums array<long>")
    return written(blocks, "va_file").withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def fetched(file: str, offset: int, wanted: np.ndarray, size: int) -> np.ndarray:
    """The full vectors at ascending places of a block, neighbours in one read."""
    out = np.empty((len(wanted), size), np.int64)
    if not len(wanted):
        return out
    store, path = fs.FileSystem.from_uri(file)
    breaks = np.flatnonzero(np.diff(wanted) > GAP) + 1
    with store.open_input_file(path) as source:
        for run in np.split(np.arange(len(wanted)), breaks):
            a, b = int(wanted[run[0]]), int(wanted[run[-1]]) + 1
            raw = np.frombuffer(source.read_at((b - a) * size * 4, (offset + a) * size * 4), "<i4").reshape(-1, size)
            out[run] = raw[wanted[run] - a]
    return out


class Bounds:
    """Lookup tables of one set of centroids."""

    def __init__(self, centroids: np.ndarray, edges: np.ndarray):
        self.centroids = centroids
        low, high = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])  # dimension, cell
        c = centroids[:, :, None]
        self.least = np.maximum(0, np.maximum(low - c, c - high)) ** 2  # centroid, dimension, cell
        self.most = np.maximum(np.abs(low - c), np.abs(high - c)) ** 2
        step = 2 * (centroids[None, :, :, None] - c[:, None])  # of (x - a)² - (x - b)² along x
        base = c[:, None] ** 2 - centroids[None, :, :, None] ** 2
        self.lead = base + np.maximum(step * low, step * high)  # a, b, dimension, cell: the largest (x - a)² - (x - b)²

    def nearest(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, whether it is surely the nearest), by intervals and then by leads."""
        n, k = len(cells), len(self.centroids)
        least, most = np.zeros((k, n), np.int64), np.zeros((k, n), np.int64)
        for j in range(cells.shape[1]):
            least += self.least[:, j, cells[:, j]]
            most += self.most[:, j, cells[:, j]]
        first = most.argmin(axis=0)
        rivals = least <= most.min(axis=0)
        rivals[first, np.arange(n)] = False
        for a in range(k):
            for b in range(k):
                rows = np.flatnonzero((first == a) & rivals[b])
                if a != b and len(rows):
                    lead = self.lead[a, b, np.arange(cells.shape[1]), cells[rows]].sum(axis=1)
                    rivals[b, rows] = lead >= (0 if b < a else 1)  # a tie goes to the smaller number
        return first, ~rivals.any(axis=0)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assigned(bounds: Bounds, block: dict, size: int, moved_from: Bounds | None = None):
    """(cluster, cluster before, places fetched, their vectors). Without ``moved_from``, clusters before are all 0."""
    cells = np.frombuffer(block["cells"], np.uint8).reshape(-1, size)
    now, sure = bounds.nearest(cells)
    before, sure_before = moved_from.nearest(cells) if moved_from is not None else (np.zeros_like(now), np.ones_like(sure))
    open_ = np.flatnonzero(~sure | ~sure_before | (now != before))
    x = fetched(block["file"], block["offset"], open_, size)
    now[open_] = distances(x, bounds.centroids).argmin(axis=1)
    if moved_from is not None:
        before[open_] = distances(x, moved_from.centroids).argmin(axis=1)
    return now, before, open_, x


def blocks_of(batches):
    for batch in batches:
        for r in range(len(batch)):
            row = batch.slice(r, 1)
            yield {n: row.column(i)[0].as_py() if n != "ids" else row.column(i)[0].values for i, n in enumerate(row.schema.names)}


def changes(file: DataFrame, size: int, edges: np.ndarray, new: np.ndarray, old: np.ndarray | None) -> dict[int, tuple[int, list[int]]]:
    """What the sums gain from the last round's assignment to this one's: cluster -> (vectors, sum per dimension)."""

    def run(batches):
        bounds, last = Bounds(new, edges), None if old is None else Bounds(old, edges)
        n, sums = np.zeros(len(new), np.int64), np.zeros((len(new), size), np.int64)
        for block in blocks_of(batches):
            now, before, places, x = assigned(bounds, block, size, last)
            for k in range(len(new)):
                here, there = now[places] == k, before[places] == k
                n[k] += here.sum() - there.sum()
                sums[k] += x[here].sum(axis=0) - x[there].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(new)), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["k", "n", "sums"])

    gains = file.select("file", "offset", "cells").mapInArrow(run, "k int, n long, sums array<long>")
    return {r["k"]: (int(r["n"]), [int(x) for x in r["sums"]]) for r in totals(gains, size, "k")}


def totals(rows: DataFrame, size: int, *keys: str) -> list:
    """n and sums added up by key, without overflow."""
    parts = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")) for j in range(size)]
    return rows.groupBy(*keys).agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.array(*parts).alias("sums")).collect()


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose hashes come first."""
    hashed = vectors.filter("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(k).collect()], np.int64)


def clusters(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE,
    k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, bits: int = BITS,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance — squared — of every vector that takes part; the final centroids)."""
    if not 1 <= bits <= 8:
        raise ValueError("a cell takes 1 to 8 bits")
    spark = rows.sparkSession
    vectors = integer_vectors(rows, key, vector, size, scale)
    edges = cell_edges(vectors, size, bits)
    centroids = starts(vectors, k, seed) if edges is not None else np.zeros((0, size), np.int64)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    file = write_file(vectors, size, edges)
    whole = totals(file.withColumn("n", F.octet_length("cells") / F.lit(size)), size)[0]
    counts = [int(whole["n"])] + [0] * (len(centroids) - 1)
    sums = [[int(x) for x in whole["sums"]]] + [[0] * size for _ in centroids[1:]]
    old = None
    for _ in range(rounds):
        for c, (n, gained) in changes(file, size, edges, centroids, old).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], gained)]
        old = centroids
        centroids = np.array([[s // n for s in own] if n else c.tolist() for own, n, c in zip(sums, counts, centroids)], np.int64)

    def final(batches):
        bounds = Bounds(centroids, edges)
        for block in blocks_of(batches):
            cells = np.frombuffer(block["cells"], np.uint8).reshape(-1, size)
            x = fetched(block["file"], block["offset"], np.arange(len(cells)), size)  # the distance itself needs all of it
            now, sure = bounds.nearest(cells)
            now[~sure] = distances(x[~sure], centroids).argmin(axis=1)
            far = ((x - centroids[now]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([block["ids"], pa.array(now, pa.int32()), pa.array(far)], ["id", "cluster", "distance"])

    return written(file.select("file", "offset", "ids", "cells").mapInArrow(final, "id long, cluster int, distance long"), "clusters"), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def oracle(rounds: int = ROUNDS) -> str:
    """The rounds written out one after the other."""
    nearest = """
  SELECT vec_id, r, x, arg_min(k, (d, k)) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, r, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, {c}
  ) GROUP BY vec_id, r, x"""
    text = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS k, x AS c FROM kept WHERE vec_id IS NOT NULL
  ORDER BY k LIMIT {CENTROIDS}
)"""
    for i in range(rounds):
        text += f""", a{i} AS MATERIALIZED ({nearest.format(c=f"c{i}")}
), s{i} AS (
  SELECT cluster, j, sum(x[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {SIZE + 1}) t(j) GROUP BY cluster, j
), c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM s{i} GROUP BY cluster) ON cluster = k
)"""
    return text + f""", a AS MATERIALIZED ({nearest.format(c=f"c{rounds}")}
)
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c{rounds} ON k = cluster"""


@query("op11_vafile", sql=oracle())
def op11_vafile(spark: SparkSession, folder: str) -> DataFrame:
    found, centroids = clusters(table(spark, folder, "embeddings"))
    own = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(k, own.get(k, 0), sum(own.values()), centroid_digest(c)) for k, c in enumerate(centroids)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
