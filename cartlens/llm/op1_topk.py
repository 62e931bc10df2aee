"""Exact top-k inner products by a three-phase uniform threshold.

Every vector's components are dealt to ``PARTS`` nodes; a node's local score of a vector for a query is the inner product
over its components, and the score is the sum over nodes.

1. Each node lists its highest local scores per query; the listed vectors' full scores are gathered per query, and the
   k-th best of them is a safe cutoff t: nothing below it can be among the k best.
2. The cutoff travels back with the queries. A vector can reach t only if some node gives it at least t / PARTS, so each
   node collects its entries from there on: sufficient, whatever the signs of the scores.
3. The collected entries that can still reach t by the sum of what is known and of t / PARTS (less than that, where a
   node did not collect them) are resolved exactly; the k best of each block meet for the final ranking.

Size: equal vectors are scored once; of each vector only the k + 1 smallest ids can ever be returned, so copies
beyond them are left out by an exact, salted ranking. Vectors and queries are packed in blocks of bounded size; each
vector block meets each party of ``PARTY`` query blocks in a group of its own (the stated query set against all rows, in blocks),
so what reaches Python at once is bounded and no pair of blocks is ever a row. What is ranked per query is at most k entries
per block, in groups that window ranking limits before the shuffle.

Defined results: vectors that are null, or hold null or non-finite components, take no part. Shorter vectors count as
filled up with zeros; an empty one scores 0 with all. Rows with a null id take no part. Rows that repeat id and vector
count once; an id with several vectors takes part with the smallest (component by component). Scores beyond 64 bits raise OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.registry import query, table
from cartlens.session import written

K = 20
SCALE = 64
QUERY_EVERY = 20
PARTS = 2
LIST_DEPTH = 5  # a node lists so many times k entries in the first phase
VECTOR_BLOCK = 4096
QUERY_BLOCK = 512
PARTY = 16  # query blocks that meet a vector block in one group
MOST_TASKS = 2000
SALTS = 64


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, v (array of floor(scale * x)) of the rows that take part."""
    v = F.col(f"`{vector}`")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.filter(F.coalesce(sound, F.lit(False)) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), scaled.alias("v"))


def distinct_vectors(rows: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """(vectors: v, ids — the k + 1 smallest; askers: id, v)."""
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "vectors")
    few = rows
    for group in (["v", "_salt"], ["v"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("id"))
        few = few.withColumn("_place", place).filter(F.col("_place") <= k + 1).drop("_place")
    vectors = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return vectors, rows.filter(F.col("id") % every == 0).select("id", "v")


def packed(vectors: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` vectors: block, items (array of structs)."""
    n = max(1, -(-vectors.count() // size))
    blocks = vectors.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n))).groupBy("block").agg(
        F.collect_list(F.struct("v", "ids")).alias("items")
    )
    return written(blocks, name), n


def matrix(items: pa.ListScalar, width: int) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors as rows, filled up with zeros, and their ids."""
    values = items.values
    v = values.field("v")
    size = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, values.field("ids").to_pylist()


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: floating point while it is exact, then 64-bit, then unbounded integers."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    bound = float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1]
    if bound < 2**24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    if any(abs(s) >= 2**63 for s in exact.ravel()):
        raise OverflowError("a score does not fit in 64 bits")
    return exact.astype(np.int64)


def node_scores(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    cuts = [q.shape[1] * j // PARTS for j in range(PARTS + 1)]
    return [products(q[:, a:b], x[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def highest(scores: np.ndarray, n: int) -> np.ndarray:
    """Column numbers of the n highest of each row, ties at the end in any order."""
    if scores.shape[1] <= n:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, n - 1, axis=1)[:, :n]


def top_k(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` the k best of all other ids."""
    spark = rows.sparkSession
    vectors, askers = distinct_vectors(integer_vectors(rows, key, vector, scale), k, every)
    vectors = written(vectors, "distinct")
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    asked = written(vectors.join(askers.select("v").distinct(), "v", "left_semi").withColumn("q", F.monotonically_increasing_id()), "asked")
    blocks, n_blocks = packed(vectors, VECTOR_BLOCK, "vector_blocks")

    n_asks = max(1, -(-asked.count() // QUERY_BLOCK))
    parties = -(-n_asks // PARTY)
    tasks = min(n_blocks * parties, MOST_TASKS)
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def ask_blocks(extra: DataFrame | None) -> DataFrame:
        own = asked if extra is None else asked.join(extra, "q", "left")
        own = own.withColumn("cutoff", F.col("cutoff") if extra is not None else F.lit(None).cast("long"))
        return own.withColumn("ask", F.pmod(F.xxhash64("q"), F.lit(n_asks))).groupBy("ask").agg(
            F.collect_list(F.struct("v", F.array("q").alias("ids"), "cutoff")).alias("questions")
        ).withColumn("party", F.floor(F.col("ask") / F.lit(PARTY)))

    def met(extra: DataFrame | None, search, schema: str) -> DataFrame:
        """``search`` on every party of query blocks and every vector block."""
        meeting = ["block", "party"]
        left = ask_blocks(extra).withColumn("block", copies(n_blocks)).select(*meeting, "questions")
        right = blocks.withColumn("party", copies(parties)).select(*meeting, "items")
        left, right = (side.repartition(tasks, *meeting).groupBy(*meeting) for side in (left, right))
        return left.cogroup(right).applyInArrow(search, schema)

    def read(party: pa.Table, block: pa.Table):
        for items in block.column("items"):
            x, members = matrix(items, width)
            for questions in party.column("questions"):
                q, ids = matrix(questions, width)
                yield np.array([i[0] for i in ids]), q, x, members, questions.values.field("cutoff")

    def gather(party: pa.Table, block: pa.Table) -> pa.Table:
        out_q, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for asks, q, x, _, _ in read(party, block):
            nodes = node_scores(q, x)
            total = sum(nodes)
            listed = np.zeros(total.shape, bool)
            for local in nodes:
                np.put_along_axis(listed, highest(local, LIST_DEPTH * k), True, axis=1)
            # the query's own vector may hold the query alone, so it can't vouch for the cutoff
            low = np.iinfo(np.int64).min
            sums = np.where(listed & ~own_vector(q, x), total, low)
            best = np.take_along_axis(sums, highest(sums, k), axis=1)
            at, col = np.nonzero(best > low)
            out_q.append(asks[at])
            out_s.append(best[at, col])
        return pa.table({"q": np.concatenate(out_q), "score": np.concatenate(out_s)})

    listed = met(None, gather, "q long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    cutoff = listed.withColumn("_place", place).filter(F.col("_place") <= k).groupBy("q").agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias("cutoff")
    )
    cutoff = written(cutoff, "cutoffs")

    def resolve(party: pa.Table, block: pa.Table) -> pa.Table:
        low = np.iinfo(np.int64).min
        out_q, out_v, out_s = [], [], []
        for asks, q, x, members, bar in read(party, block):
            none = bar.is_null().to_numpy(zero_copy_only=False)
            t = bar.fill_null(0).to_numpy(zero_copy_only=False).astype(float)[:, None]
            t = (t - 1.0 - np.abs(t) * 1e-12) / PARTS  # rounding may lower the cutoff, never raise it
            nodes = node_scores(q, x)
            collected = [(local >= t) | none[:, None] for local in nodes]
            hope = sum(np.where(c, local, t) for c, local in zip(collected, nodes))
            open_ = np.logical_or.reduce(collected) & ((hope >= t * PARTS) | none[:, None])
            total = np.where(open_, sum(nodes), low)
            for i in range(len(asks)):
                some = np.flatnonzero(open_[i])
                score = total[i, some]
                if len(some) > k + 1:
                    # equal scores at the end all stay: their ids decide
                    some = some[score >= np.partition(score, -(k + 1))[-(k + 1)]]
                found = sorted((-int(total[i, c]), m) for c in some for m in members[c])[: k + 1]
                out_q += [asks[i]] * len(found)
                out_s += [-s for s, _ in found]
                out_v += [m for _, m in found]
        return pa.table({name: pa.array(values, pa.int64()) for name, values in (("q", out_q), ("vec_id", out_v), ("score", out_s))})

    found = met(cutoff, resolve, "q long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("place", place).filter(F.col("place") <= k + 1)
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    answers = written(asked.select("q", "v").join(lists, "q"), "answers")
    own = askers.select(F.col("id").alias("query_id"), "v").join(answers.select("v", "found"), "v")
    others = F.slice(F.filter("found", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score")
    )


def own_vector(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where a query and a vector are equal (as filled up with zeros)."""
    code = {row.tobytes(): [] for row in q}
    for i, row in enumerate(q):
        code[row.tobytes()].append(i)
    out = np.zeros((len(q), len(x)), bool)
    for j, row in enumerate(x):
        for i in code.get(row.tobytes(), ()):
            out[i, j] = True
    return out


@query("op1_topk", sql=f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs
)
SELECT query_id, place::INT AS rank, vec_id, score FROM ranked WHERE place <= {K}
""")
def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))
