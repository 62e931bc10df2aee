"""Language-model scores from a probabilistic suffix tree over the bytes of the texts.

The text is read as symbols: its bytes, with every gap (a space or control byte that ends words, and the text's end) as one
symbol, whose kind is chosen after it given the byte before. Contexts reach back at most to the gap before the current
word, ``DEPTH`` symbols at most; the symbol after a gap sees up to ``BORDER`` symbols, so into the word before.
So what the tree gives inside a word depends on the word alone, and is worked out once for each distinct word.

Learning: tasks count the words of all texts; the distinct words with their training counts give the runs of a context
and its next symbol. Runs meet by their last three context bytes, where every longer context is settled: it is a candidate
if it occurs at least ``LEAST_COUNT`` times, however large the input, and is retained if the divergence (bits) of its
next-symbol distribution from that of its suffix is at least ``LEAST_BITS``, together with all its suffixes.
Distributions are smoothed towards their suffix's, the root's towards equal chances. A longer corpus thus retains more
states. They are a written table: those with at least ``HOT_STATE`` of all symbols (at most 1 / HOT_STATE a depth) and those of
one or two bytes (bounded by the alphabet) are broadcast; distinct words are joined with the others by context, where
the broadcast part says that the next longer context is a state.

Scoring adds up, for each text, the scores of its words to their longest suffix states, of the symbols after gaps and
of the kinds of gaps. Words of at least ``HOT_SHARE`` of all tokens (at most 1 / HOT_SHARE) are broadcast with their score and
count; the others of each text are joined with them by word, where none can be a hot key.

Defined results: null and empty texts are a single end. A null id counts as training. Rows are scored one by
one (repeated rows repeat and count twice in training). Without training texts N and V are 0 and all symbols are
equally likely; an empty table gives an empty one. A-Z count as lower case throughout, also in ``score``. Very long texts and
words are read whole; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.registry import query, table
from cartlens.llm.words import SPACE, Words, word_slices
from cartlens.session import written

DEPTH = 6
BORDER = 3
LEAST_COUNT = 100
LEAST_BITS = 0.02
PRIOR = 20.0
HOT_STATE = 2e-6
HOT_SHARE = 1e-6
GAP = 0x20
#: The kinds of a gap, the text's end last.
GAPS = (0x20, 9, 10, 11, 12, 13, 256)
SYMBOLS = 256 - len(GAPS) + 2
SHALLOW = 2
MERGE_KEYS = 1_000_000
CHUNK = 100_000

KIND = np.zeros(256, np.int64)
KIND[list(GAPS[:-1])] = np.arange(len(GAPS) - 1)
FOLDED = np.where(SPACE, GAP, np.arange(256)).astype(np.uint8)


class Tally:
    """Weighted counts of keys, held as sorted arrays."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        k, n = summed(keys, counts)
        self.keys.append(k), self.counts.append(n)
        self.waiting += len(k)
        if self.waiting > MERGE_KEYS:
            self.merge()
            self.waiting = 0

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            k, n = summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts = [k], [n]
        return (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def chunks(*columns: np.ndarray):
    for at in range(0, len(columns[0]), CHUNK):
        yield tuple(c[at : at + CHUNK] for c in columns)


def mask(depth) -> np.ndarray | int:
    return (1 << 8 * depth) - 1


def before(symbol: np.ndarray, place: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` symbols before those at ``at``, the latest in the lowest bits; gaps stand before the first (``place`` 0)."""
    out = np.zeros(len(at), np.int64)
    for d in range(1, depth + 1):
        out |= np.where(place >= d, symbol[np.maximum(at - d, 0)], GAP).astype(np.int64) << (8 * (d - 1))
    return out


def borders(w: Words) -> tuple[np.ndarray, ...]:
    """Of the texts of a slice: context, symbol and text of the symbols after gaps; byte before, kind and text of the gaps."""
    cuts = np.concatenate(([0], np.cumsum(np.diff(w.offsets) + 1)))
    ending = np.zeros(cuts[-1], bool)
    ending[cuts[1:] - 1] = True
    raw = np.full(cuts[-1], GAP, np.uint8)
    raw[~ending] = w.raw
    symbol = FOLDED[raw]
    last = np.concatenate((np.array([GAP], np.uint8), symbol[:-1]))  # a text's end is a gap before the next text
    after, gap = np.flatnonzero(last == GAP), np.flatnonzero(symbol == GAP)
    kind = np.where(ending[gap], len(GAPS) - 1, KIND[raw[gap]])
    of, of_gap = (np.searchsorted(cuts, x, side="right") - 1 for x in (after, gap))
    return before(symbol, after - cuts[of], after, BORDER), symbol[after].astype(np.int64), of, last[gap].astype(np.int64), kind, of_gap


def of_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as a binary column."""
    cuts = np.concatenate(([0], np.cumsum(end - start)))
    flat = raw[np.repeat(start - cuts[:-1], end - start) + np.arange(cuts[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def counts_of(docs: DataFrame) -> DataFrame:
    """Written: kind, k, word, n (training), m (all). Kind 0 words (k: hash), 1 runs after gaps, 2 texts, 3 gaps (byte before, kind)."""

    def run(batches):
        runs, gaps, texts = Tally(), np.zeros(256 * len(GAPS), np.int64), 0
        for batch in batches:
            learn = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, w in word_slices(batch.column(0), lower=True):
                own = learn[a:b]
                texts += int(own.sum())
                h = w.hashes().view(np.int64)
                if len(h):
                    order = np.argsort(h)
                    s = h[order]
                    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                    n = np.add.reduceat(own[w.text_of_word()][order].astype(np.int64), first)
                    m = np.diff(np.append(first, len(s)))
                    one = order[first]
                    words = of_ranges(w.raw, w.start[one], w.end[one])
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(one), np.int32)), pa.array(s[first]), words, pa.array(n), pa.array(m)], ["kind", "k", "word", "n", "m"])
                context, symbol, of, last, kind, of_gap = borders(w)
                keep = own[of]
                keys = (BORDER << 57 | context << 9 | symbol)[keep]
                runs.add(keys, np.ones(len(keys), np.int64))
                gaps += np.bincount((last * len(GAPS) + kind)[own[of_gap]], minlength=len(gaps))
        seen = np.flatnonzero(gaps)
        for kind, k, n in ((1, *runs.merge()), (2, np.zeros(1, np.int64), np.array([texts])), (3, seen, gaps[seen])):
            for own, count in chunks(k, n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), kind, np.int32)), pa.array(own), pa.nulls(len(own), pa.binary()), pa.array(count), pa.array(count)], ["kind", "k", "word", "n", "m"]
                )

    parts = docs.select("text", "held_out").mapInArrow(run, "kind int, k long, word binary, n long, m long")
    return written(parts.groupBy("kind", "k", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm_counts")


class Inner:
    """The symbols inside the words of a batch: all but the first letter, and the gap behind."""

    def __init__(self, words: pa.Array):
        data, cuts = np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int32)
        cuts = cuts[words.offset : words.offset + len(words) + 1].astype(np.int64)
        size = np.diff(cuts) + 2
        ends = np.concatenate(([0], np.cumsum(size)))
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(ends[-1]) - ends[:-1][word]
        symbol = np.full(ends[-1], GAP, np.uint8)
        symbol[(place > 0) & (place < (size - 1)[word])] = data[cuts[0] : cuts[-1]]
        at = np.flatnonzero(place >= 2)
        self.word, self.place, self.symbol = word[at], place[at], symbol[at].astype(np.int64)
        self.depth = np.minimum(self.place, DEPTH)
        self.context = before(symbol, self.place, at, DEPTH) & np.array([mask(d) for d in range(DEPTH + 1)])[self.depth]


def runs_of(units: DataFrame) -> DataFrame:
    """Written: k (depth, longest context, next symbol), n over the training words."""

    def run(batches):
        tally = Tally()
        for batch in filter(len, batches):
            x = Inner(batch.column(0))
            tally.add(x.depth << 57 | x.context << 9 | x.symbol, batch.column(1).to_numpy()[x.word])
        for k, n in chunks(*tally.merge()):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    return written(units.filter("n > 0").select("word", "n").mapInArrow(run, "k long, n long"), "lm_runs")


def levels(runs: DataFrame, deepest: int) -> DataFrame:
    """k, n of the run's contexts of up to ``deepest`` symbols."""
    depth, context = F.shiftright("k", 57), F.shiftright("k", 9).bitwiseAND(F.lit(mask(DEPTH)))
    cut = F.expr("shiftleft(1L, cast(8 * _d as int)) - 1")
    parts = runs.select(F.explode(F.sequence(F.lit(0), F.least(F.lit(deepest), depth).cast("int"))).alias("_d"), context.alias("_c"), F.col("k").bitwiseAND(F.lit(511)).alias("_s"), "n")
    key = F.shiftleft(F.col("_d").cast("long"), 57).bitwiseOR(F.shiftleft(F.col("_c").bitwiseAND(cut), 9)).bitwiseOR(F.col("_s"))
    return parts.select(key.alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n"))


class Level:
    """The contexts of one depth: sorted (context, symbol) keys with counts; contexts with sizes and their first key."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n, self.chance, self.kept = keys, n, np.zeros(0), np.zeros(0, bool)
        context = keys >> 9
        self.first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.context = context[self.first]
        self.size = np.add.reduceat(n, self.first) if len(keys) else n
        self.of_key = np.repeat(np.arange(len(self.context)), np.diff(np.append(self.first, len(keys))))

    def settle(self, depth: int, upper: "Level", limits: tuple[int, float]) -> None:
        """Chances smoothed to the suffix's, and which contexts pass the test. ``upper``: one symbol less."""
        short = self.keys >> 9 & mask(depth - 1)
        at = np.searchsorted(upper.keys, short << 9 | self.keys & 511)
        node = upper.of_key[at]
        size = self.size[self.of_key]
        self.chance = (self.n + PRIOR * upper.chance[at]) / (size + PRIOR)
        share = self.n / size
        bits = share * np.log2(share / (upper.n[at] / upper.size[node]))
        bits = np.add.reduceat(bits, self.first) if len(self.first) else bits
        self.kept = (self.size >= limits[0]) & (bits >= limits[1])

    def close(self, contexts: np.ndarray) -> None:
        self.kept |= np.isin(self.context, contexts)

    def states(self, depth: int) -> tuple[np.ndarray, ...]:
        """The retained contexts: node and size, number of seen symbols; all these symbols and their log10 chances."""
        of = self.kept[self.of_key]
        count = np.diff(np.append(self.first, len(self.keys)))[self.kept]
        return depth << 48 | self.context[self.kept], self.size[self.kept], count, self.keys[of] & 511, np.log10(self.chance[of])


def shallow_levels(k: np.ndarray, n: np.ndarray, limits: tuple[int, float]) -> list[Level]:
    """The levels of summed counts, settled from the root on."""
    depth, rest = k >> 57, k & ((1 << 57) - 1)
    found = []
    for d in range(int(depth.max()) + 1 if len(k) else 1):
        own = depth == d
        level = Level(*summed(rest[own], n[own]))
        if d == 0:
            level.chance, level.kept = (level.n + 1) / (level.n.sum() + SYMBOLS), np.ones(len(level.context), bool)
        else:
            level.settle(d, found[-1], limits)
        found.append(level)
    return found


STATE = "node long, size long, symbols array<smallint>, logs array<double>"


def deep_states(runs: DataFrame, shallow, limits: tuple[int, float]) -> DataFrame:
    """Written: the retained contexts of three symbols and more. ``shallow``: the broadcast level above."""

    def run(batches):
        tally = Tally()
        for batch in batches:
            tally.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        k, n = tally.merge()
        depth, upper, own = k >> 57, shallow.value, []
        for d in range(SHALLOW + 1, DEPTH + 1):
            of = depth >= d
            level = Level(*summed((k[of] >> 9 & mask(d)) << 9 | k[of] & 511, n[of]))
            level.settle(d, upper, limits)
            own.append(level)
            upper = level
        for d in range(DEPTH, SHALLOW + 1, -1):
            longer = own[d - SHALLOW - 1]
            own[d - SHALLOW - 2].close(longer.context[longer.kept] & mask(d - 1))
        for d, level in enumerate(own, SHALLOW + 1):
            node, size, count, symbols, logs = level.states(d)
            cuts = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (symbols.astype(np.int16), logs)]
            whole = pa.RecordBatch.from_arrays([pa.array(node), pa.array(size), *lists], ["node", "size", "symbols", "logs"])
            for at in range(0, len(node), CHUNK):
                yield whole.slice(at, CHUNK)

    deep = runs.filter(F.shiftright("k", 57) > SHALLOW).repartition(F.shiftright("k", 9).bitwiseAND(F.lit(mask(SHALLOW + 1))))
    return written(deep.mapInArrow(run, STATE), "lm_states")


class SuffixTree:
    """The broadcast states: sorted nodes, what an unseen symbol costs there, log10 chances of the seen ones."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], root: Level, asked: np.ndarray):
        """``parts``: as from ``Level.states``."""
        node, size, count, symbols, logs = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.argsort(node)
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        self.node = node[order]
        self.back = np.log10(PRIOR / (size[order] + PRIOR))
        entry = np.repeat(place, count) << 9 | symbols.astype(np.int64)
        order = np.argsort(entry)
        self.entry, self.log = entry[order], logs[order]
        self.root = np.full(257, -math.log10(float(root.n.sum()) + SYMBOLS))
        self.root[root.keys & 511] = np.log10(root.chance)
        self.asked = np.sort(asked)  # states outside the broadcast whose suffix is inside

    def walk(self, context: np.ndarray, symbol: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 chances, and the depth reached."""
        out, reached = self.root[symbol], np.zeros(len(symbol), np.int64)
        active = np.arange(len(symbol))
        for d in range(1, DEPTH + 1):
            active = active[depth[active] >= d]
            if not len(active) or not len(self.node):
                break
            node = d << 48 | context[active] & mask(d)
            at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
            go = self.node[at] == node
            active, at = active[go], at[go]
            key = at << 9 | symbol[active]
            e = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
            out[active] = np.where(self.entry[e] == key, self.log[e], out[active] + self.back[at])
            reached[active] = d
        return out, reached

    def open(self, context: np.ndarray, depth: np.ndarray, reached: np.ndarray) -> np.ndarray:
        """Which positions have a longer state outside the broadcast."""
        if not len(self.asked):
            return np.zeros(0, np.int64)
        some = np.flatnonzero(depth > reached)
        cut = np.array([mask(d) for d in range(DEPTH + 2)])[reached[some] + 1]
        node = (reached[some] + 1) << 48 | context[some] & cut
        at = np.minimum(np.searchsorted(self.asked, node), len(self.asked) - 1)
        return some[self.asked[at] == node]


def from_table(rows: DataFrame) -> tuple[np.ndarray, ...]:
    found = rows.select("node", "size", F.size("symbols").cast("long").alias("count"), "symbols", "logs").toArrow()
    flat = [pc.list_flatten(found.column(c)) for c in ("symbols", "logs")]
    return tuple(c.to_numpy() for c in (*[found.column(c) for c in ("node", "size", "count")], *flat))


def learned(counts: DataFrame, limits: tuple[int, float], hot_state: float) -> tuple[SuffixTree, DataFrame]:
    """The broadcast part of the tree, and the written table of all states of three symbols and more."""
    spark = counts.sparkSession
    runs = runs_of(counts.filter("kind = 0"))
    ends = counts.filter("kind = 1").select("k", "n")
    low = levels(runs, SHALLOW).unionByName(levels(ends, BORDER)).groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    found = shallow_levels(low.column("k").to_numpy(), low.column("n").to_numpy(), limits)
    above = found[SHALLOW] if len(found) > SHALLOW else Level(np.zeros(0, np.int64), np.zeros(0, np.int64))
    states = deep_states(runs, spark.sparkContext.broadcast(above), limits)
    hot = F.col("size") >= hot_state * float(found[0].n.sum())
    parts = [from_table(states.filter(hot))]
    held = states.select(F.col("node").bitwiseAND(F.lit(mask(SHALLOW))).alias("c")).distinct().toArrow().column("c").to_numpy()
    for d in range(len(found) - 1, 0, -1):
        if d == SHALLOW:
            found[d].close(held)
        if d > 1:
            found[d - 1].close(found[d].context[found[d].kept] & mask(d - 1))
        parts.append(found[d].states(d))
    inside = states.filter(hot).select(F.col("node").alias("_suffix"))
    depth = F.shiftright("node", 48)
    suffix = F.shiftleft(depth - 1, 48).bitwiseOR(F.col("node").bitwiseAND(F.expr("shiftleft(1L, cast(8 * (shiftright(node, 48) - 1) as int)) - 1")))
    outside = states.filter(~hot).select("node", depth.alias("_depth"), suffix.alias("_suffix"))
    asked = outside.filter(F.col("_depth") == SHALLOW + 1).select("node").unionByName(outside.filter(F.col("_depth") > SHALLOW + 1).join(inside, "_suffix", "left_semi").select("node"))
    return SuffixTree(parts, found[0], asked.toArrow().column("node").to_numpy()), states.filter(~hot)


def scored_words(units: DataFrame, found, others: DataFrame) -> DataFrame:
    """Written: k, n, m and score, the log10 chances inside the word. ``units``: k, word, n, m."""

    def run(batches):
        model = found.value
        for batch in filter(len, batches):
            x = Inner(batch.column(1))
            log, reached = model.walk(x.context, x.symbol, x.depth)
            open_ = model.open(x.context, x.depth, reached)
            log_in = np.bincount(x.word, log, len(batch)).astype(np.float64)
            cuts = np.searchsorted(x.word[open_], np.arange(len(batch) + 1))
            pieces = [x.place, x.depth << 57 | x.context << 9 | x.symbol, reached, log]
            asked = pa.StructArray.from_arrays([pa.array(p[open_]) for p in pieces], ["place", "run", "reached", "log"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(log_in), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), asked)], ["k", "n", "m", "score", "asked"])

    asks = "array<struct<place: bigint, run: bigint, reached: bigint, log: double>>"
    first = written(units.select("k", "word", "n", "m").mapInArrow(run, f"k long, n long, m long, score double, asked {asks}"), "lm_words")
    place = first.select("k", F.explode("asked").alias("a")).select("k", "a.place", "a.log", "a.run", F.explode(F.sequence(F.col("a.reached") + 1, F.shiftright("a.run", 57))).alias("d"))
    cut = F.expr("shiftleft(1L, cast(8 * d as int)) - 1")
    node = F.shiftleft("d", 48).bitwiseOR(F.shiftright("run", 9).bitwiseAND(cut))
    place = place.select("k", "place", "log", "d", F.col("run").bitwiseAND(F.lit(511)).cast("smallint").alias("symbol"), node.alias("node"))
    seen = F.element_at("logs", F.nullif(F.array_position("symbols", F.col("symbol")), F.lit(0)).cast("int"))
    met = place.join(others, "node").select("k", "place", "log", F.struct("d", seen.alias("seen"), F.log10(PRIOR / (F.col("size") + PRIOR)).alias("back")).alias("s"))
    folded = F.aggregate(F.array_sort("s"), F.col("log"), lambda a, s: F.coalesce(s["seen"], a + s["back"]))
    more = met.repartition("k").groupBy("k", "place").agg(F.collect_list("s").alias("s"), F.first("log").alias("log")).select("k", (folded - F.col("log")).alias("more"))
    more = more.groupBy("k").agg(F.sum("more").alias("more"))
    whole = first.drop("asked").join(more, "k", "left")
    return written(whole.select("k", "n", "m", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")), "lm_scored")


def gap_logs(counts: np.ndarray) -> np.ndarray:
    """log10 chances of the kind of a gap (columns) given the byte before (rows)."""
    whole = (counts.sum(axis=0) + 1) / (counts.sum() + len(GAPS))
    return np.log10((counts + PRIOR * whole) / (counts.sum(axis=1, keepdims=True) + PRIOR))


def lm_scores(
    docs: DataFrame, key: str = "doc_id", text: str = "text", held_out=None,
    least_count: int = LEAST_COUNT, least_bits: float = LEAST_BITS, hot_state: float = HOT_STATE, hot_share: float = HOT_SHARE,
) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held_out = F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2 if held_out is None else held_out
    rows = docs.select(F.col(f"`{key}`"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("text"))
    counts = counts_of(rows)
    sums = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count_if(F.col("n") > 0).alias("keys"))
    of_kind = {r["kind"]: (r["n"], r["m"], r["keys"]) for r in sums.collect()}
    texts = of_kind.get(2, (0, 0, 0))[0]
    words_n, words_m, words_k = of_kind.get(0, (0, 0, 0))
    tokens, distinct = words_n + texts, words_k + (texts > 0)
    floor = math.log10(tokens + distinct + 1)
    gaps = np.zeros(256 * len(GAPS))
    for r in counts.filter("kind = 3").select("k", "n").collect():
        gaps[r["k"]] = r["n"]
    gap = gap_logs(gaps.reshape(256, len(GAPS)))
    model, others = learned(counts, (least_count, least_bits), hot_state)
    found = spark.sparkContext.broadcast(model)
    words = scored_words(counts.filter("kind = 0"), found, others)
    hot = words.filter(F.col("m") >= max(1.0, hot_share * words_m)).toArrow()
    order = np.argsort(hot.column("k").to_numpy())
    of_hot = [hot.column(c).to_numpy()[order] for c in ("k", "n", "score")]
    known = spark.sparkContext.broadcast((of_hot[0], np.log10(of_hot[1] + 1.0), of_hot[1] > 0, of_hot[2]))
    ending = math.log10(texts + 1)

    def run(batches):
        tree = found.value
        keys, logs, seen, scores = known.value
        for batch in batches:
            for a, b, w in word_slices(batch.column(2), lower=True):
                h = w.hashes().view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                of_word, own = w.text_of_word()[hit], at[hit]
                add = lambda of, x: np.bincount(of, x, b - a).astype(np.float64)
                context, symbol, of, last, kind, of_gap = borders(w)
                log, _ = tree.walk(context, symbol, np.full(len(symbol), BORDER))
                score = add(of, log) + add(of_gap, gap[last, kind]) + add(of_word, scores[own])
                rare = np.concatenate(([0], np.cumsum(~hit)))[w.of_text]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(w.counts + 1), pa.array(add(of_word, seen[own]).astype(np.int64)),
                        pa.array(add(of_word, logs[own])), pa.array(score), pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(h[~hit])),
                    ],
                    [key, "held_out", "n_tokens", "hot_known", "hot_sum", "hot_score", "rare"],
                )

    kind = rows.schema[key].dataType.simpleString()
    passed = rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, n_tokens long, hot_known long, hot_sum double, hot_score double, rare array<bigint>")
    passed = written(passed.withColumn("_row", F.monotonically_increasing_id()), "lm_rows")
    seldom = passed.select("_row", F.explode("rare").alias("k")).join(words.select("k", "n", "score"), "k").groupBy("_row").agg(
        F.sum(F.log10(F.col("n") + 1.0)).alias("_sum"), F.count_if(F.col("n") > 0).alias("_known"), F.sum("score").alias("_score")
    )
    end_known = 1 if texts else 0
    return passed.drop("rare").join(seldom, "_row", "left").select(
        key, "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("_sum", F.lit(0.0)) + ending - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("hot_score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


@query("op4_suffix_tree")
def op4_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))
