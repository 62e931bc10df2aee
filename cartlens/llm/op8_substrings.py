"""Removal of repeated byte strings, found by hash-compared suffix sorting of sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere in the corpus. Sorting every suffix would
move the corpus many times over, so suffixes are sampled by content: each window of LENGTH bytes names the byte run
of ``GRAM`` bytes in it with the least hash as its anchor (equal windows name the same anchor), and neighbouring windows
that share an anchor form one region. Then, for all regions of the corpus:

1. An anchor run that occurs once has no repeated window. Where a run occurs more often and all its regions are
   equal, all their windows are repeated. Both are settled by one aggregation over runs.
2. In the other groups, regions that occur twice or more are settled alike; one copy of each distinct region is fetched.
   The suffixes that start at the anchors are sorted by mergesort; two suffixes are compared by their longest common
   prefix, found by binary search over prefix polynomial hashes, so a comparison takes logarithmic time. Neighbours'
   common prefixes give those of all pairs of the group, the same search to the left gives the rest of the extension, and
   a pair of regions shares the windows between. Every extension that marks bytes is verified on the bytes themselves.
3. Groups of more than ``GROUP`` distinct regions (a passage in very many surroundings) are settled without holding them
   in one place: their windows become rows, counted by anchor run, place and content hash; first tiles of 64 windows, then only
   where a tile is neither wholly repeated nor without a partner smaller ones, down to single windows.

Texts are named by a 64-bit hash, window contents by two (run and region). Marks come back to the texts that
are neither clean nor wholly repeated; only those are read again.

Defined results: null and empty texts have no bytes. Texts that occur twice or more and have LENGTH bytes lose all.
Texts shorter than LENGTH are kept. Repeated rows are copies of each other. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.registry import query, table
from cartlens.llm.words import mix, prefix_hash, range_hash, slices, text_bytes
from cartlens.session import written

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1  # places of a run in a window
GROUP = 64
#: Windows of a tile in groups of more than GROUP: all of a region's, then fewer, at last one.
TILES = (256, 64, 8, 1)
PLACE_BITS = np.uint64(28)


def regions(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, run hash, region hash) of every region of a slice of texts."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if not (sizes >= LENGTH).any():
        return none, none, none, none, none, none
    if len(raw) >= 1 << int(PLACE_BITS):
        raise ValueError("a text of 256 MiB or more must be split first")
    prefix = prefix_hash(raw)
    place = np.arange(len(raw) - GRAM + 1)
    run = range_hash(prefix, place, place + GRAM)
    n = len(place)
    blocks = -(-n // SPAN)
    keys = np.full(blocks * SPAN, np.iinfo(np.uint64).max, np.uint64)
    keys[:n] = (run >> PLACE_BITS) << PLACE_BITS | place.astype(np.uint64)  # of equal runs the first counts
    keys = keys.reshape(blocks, SPAN)
    upto = np.minimum.accumulate(keys, axis=1).ravel()
    since = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.maximum(sizes - LENGTH + 1, 0)
    start = np.arange(windows.sum()) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    text = np.repeat(np.arange(len(sizes)), windows)
    anchor = (np.minimum(since[start], upto[start + SPAN - 1]) & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(first[1:], len(start)) - 1
    low, high, at = start[first], start[last], anchor[first]
    region = mix(range_hash(prefix, low, high + LENGTH) + mix((at - low).astype(np.uint64) + np.uint64(1)))
    base = offsets[:-1][text[first]]
    return text[first], low - base, high - base, at - base, run[at].view(np.int64), region.view(np.int64)


def region_rows(docs: DataFrame) -> DataFrame:
    """g (run), r (region), t (text), p: first window << 16 | windows - 1 << 8 | anchor - first window."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            names = batch.column(0).to_numpy()
            for a, b in slices(offsets):
                text, low, high, at, g, r = regions(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p = low << 16 | (high - low) << 8 | (at - low)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(r), pa.array(names[a:b][text]), pa.array(p)], ["g", "r", "t", "p"])

    return docs.select("t", "text").mapInArrow(run, "g long, r long, t long, p long")


def common(prefix: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, left: bool = False) -> np.ndarray:
    """How many bytes are equal from i and j on (or before them), at most ``most``: binary search on hashes."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64).copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        a, b = (i - mid, j - mid) if left else (i, j)
        equal = range_hash(prefix, a, a + mid) == range_hash(prefix, b, b + mid)
        low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
    return low


def suffix_order(raw: np.ndarray, prefix: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the suffixes [start, start + size) by group and then bytes: mergesort, comparing by common prefixes.

    Groups come in order. Each round merges runs of the same group: an element's new place is its own place in its run plus
    the number of elements of the other run before it, found by binary search for all elements at once.
    """
    order = np.arange(len(group))
    if not len(group):
        return order
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    count = np.diff(np.append(head, len(group)))
    begin, own_count = np.repeat(head, count), np.repeat(count, count)

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix y sorts before x; equal ones if ``ties``."""
        c = common(prefix, start[x], start[y], np.minimum(size[x], size[y]))
        end_x, end_y = c == size[x], c == size[y]
        byte_x = raw[np.minimum(start[x] + c, len(raw) - 1)].astype(int)
        byte_y = raw[np.minimum(start[y] + c, len(raw) - 1)].astype(int)
        return np.where(end_x | end_y, np.where(end_x & end_y, ties, end_y & ~end_x), byte_y < byte_x)

    width = 1
    while width < count.max():
        place = np.arange(len(group)) - begin
        run = place // width
        sibling = begin + (run ^ 1) * width
        low = np.minimum(sibling, begin + own_count)
        first = low.copy()
        high = np.minimum(sibling + width, begin + own_count)
        ties = run % 2 == 1
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            smaller = before(order[open_], order[mid], ties[open_])
            low[open_] = np.where(smaller, mid + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], mid)
        new = begin + (run // 2) * 2 * width + (place - run * width) + (low - first)
        moved = np.empty_like(order)
        moved[new] = order
        order = moved
        width *= 2
    return order


def shared_windows(batch_groups: list[list[dict]]) -> list[tuple[int, int, int]]:
    """(text, first byte, end) of repeated bytes among the distinct regions of each group."""
    rows = [(k, x) for k, g in enumerate(batch_groups) for x in g]
    if not rows:
        return []
    raw = np.frombuffer(b"".join(x["bytes"] for _, x in rows), np.uint8)
    cut = np.cumsum([0, *(len(x["bytes"]) for _, x in rows)])
    p = np.array([x["p"] for _, x in rows], np.int64)
    group = np.array([k for k, _ in rows])
    off, more = p & 255, p >> 8 & 255
    start = cut[:-1] + off
    size = cut[1:] - start
    prefix = prefix_hash(raw)
    order = suffix_order(raw, prefix, group, start, size)
    same = group[order[1:]] == group[order[:-1]]
    near = np.zeros(len(order), np.int64)  # common prefix with the one before in order
    x, y = order[1:][same], order[:-1][same]
    near[1:][same] = common(prefix, start[x], start[y], np.minimum(size[x], size[y]))
    found, step = [], 1
    least = near.copy()
    while True:
        # pairs `step` apart in order share the least of the common prefixes between them
        at = np.arange(step, len(order))
        at = at[group[order[at]] == group[order[at - step]]]
        if not len(at):
            break
        if step > 1:
            least[at] = np.minimum(least[at], near[at - step + 1])
        i, j, right = order[at], order[at - step], least[at]
        left = common(prefix, start[i], start[j], np.minimum(off[i], off[j]), left=True)
        for x, y in ((i, j), (j, i)):
            # windows that start o bytes before the anchor: the text's own, and within both extensions
            most = np.minimum(left, off[x])
            fewest = np.maximum(LENGTH - right, off[x] - more[x])
            for k in np.flatnonzero(fewest <= most):
                found.append((x[k], y[k], int(most[k]), int(fewest[k])))
        step += 1
    out = []
    for x, y, most, fewest in found:
        a, b = start[x] - most, start[x] - fewest + LENGTH
        c = start[y] - most
        if not np.array_equal(raw[a:b], raw[c : c + b - a]):
            raise ValueError("equal hashes of different bytes; change BYTE_CODE")
        low = int(p[x] >> 16) + int(a - cut[x])
        out.append((rows[x][1]["t"], low, low + int(b - a)))
    return out


def fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """g, t, p, n and bytes of the wanted regions. ``wanted``: g, t, p, n."""
    lists = wanted.groupBy("t").agg(F.collect_list(F.struct("g", "p", "n")).alias("own"))

    def run(batches):
        for batch in batches:
            g, t, p, n, content = [], [], [], [], []
            for name, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_buffer()
                for x in own.as_py():
                    low, more = x["p"] >> 16, x["p"] >> 8 & 255
                    g.append(x["g"]), t.append(name), p.append(x["p"]), n.append(x["n"])
                    content.append(bytes(text[low : low + more + LENGTH]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.int64()), pa.array(t, pa.int64()), pa.array(p, pa.int64()), pa.array(n, pa.int64()), pa.array(content, pa.binary())],
                ["g", "t", "p", "n", "bytes"],
            )

    return texts.join(lists, "t").select("t", "text", "own").mapInArrow(run, "g long, t long, p long, n long, bytes binary")


def small_groups(rows: DataFrame) -> DataFrame:
    """t, low, high: repeated bytes among the regions of groups of at most GROUP regions."""
    packed = rows.groupBy("g").agg(F.collect_list(F.struct("t", "p", "n", "bytes")).alias("members"))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                groups = [[m for m in g] for g in batch.column(0).slice(at, 500).to_pylist()]
                marks = shared_windows(groups)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*marks) if marks else ((), (), ()))], ["t", "low", "high"])

    return packed.select("members").mapInArrow(run, "t long, low long, high long")


def large_groups(rows: DataFrame) -> DataFrame:
    """t, low, high: repeated bytes among the regions of larger groups, by tiles of windows instead of single ones.

    Every distinct region is there once, so equal windows of two rows are in two places. Windows are told apart by how far
    before the anchor they start; a tile is a range of these distances. Where a region's part of a tile is there twice, all
    its windows are repeated, and one copy of it stays to be compared with. Where the bytes that all windows of a tile share
    are followed and preceded by one content only, no other window can be repeated. The rest is cut into smaller tiles.
    """
    rows = written(rows.select("g", "t", "p", "bytes", (F.col("n") == 1).alias("open")), "large_regions")
    own = F.array(F.struct(F.lit(0).alias("tile"), F.col("open")))
    state, found, size = rows.withColumn("own", own), [], TILES[0]
    for smaller in TILES[1:]:
        if state.isEmpty():
            break
        tiles = written(tiled(state, size, smaller), "tiles")
        classes = tiles.groupBy("k", "core", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "p", "tile", "open")).alias("rep"))
        classes = written(classes, "tile_classes")
        twice = classes.filter("n > 1").select("k", "core", "c")
        found.append(tiles.filter("open").join(twice, ["k", "core", "c"], "left_semi").select("t", "low", "high"))
        mixed = classes.groupBy("k", "core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("k", "core")
        left = classes.join(mixed, ["k", "core"], "left_semi").select("rep.t", "rep.p", "rep.tile", (F.col("rep.open") & (F.col("n") == 1)).alias("open"))
        left = left.groupBy("t", "p").agg(F.collect_list(F.struct("tile", "open")).alias("own"))
        if smaller != TILES[-1]:
            state = written(rows.select("g", "t", "p", "bytes").join(left, ["t", "p"]), "open_regions")
        size = smaller
    none = rows.select("t", F.col("p").alias("low"), F.col("p").alias("high")).limit(0)
    return reduce(DataFrame.unionByName, found, none)


def tiled(state: DataFrame, size: int, smaller: int) -> DataFrame:
    """The tiles of ``smaller`` windows in the regions' own tiles of ``size``.

    k: group and tile, c: the bytes of the region's windows in it, core: the bytes that any window of the tile has, t, p, tile, open, low, high.
    """
    ways = size // smaller

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                raw, cut = _joined(part.column(3))
                p = part.column(2).to_numpy()
                lists = part.column(4)
                many = np.diff(lists.offsets.to_numpy())
                held = lists.flatten()
                which = np.repeat(np.repeat(np.arange(len(p)), many), ways)
                tile = (held.field("tile").to_numpy()[:, None] * ways + np.arange(ways)).ravel()
                open_ = np.repeat(held.field("open").to_numpy(zero_copy_only=False), ways)
                off, more = (p & 255)[which], (p >> 8 & 255)[which]
                near, far = np.maximum(tile * smaller, off - more), np.minimum(tile * smaller + smaller - 1, off)
                keep = near <= far
                which, tile, open_, off, near, far = which[keep], tile[keep].astype(np.int64), open_[keep], off[keep], near[keep], far[keep]
                anchor = cut[:-1][which] + off
                prefix = prefix_hash(raw)
                c = mix(range_hash(prefix, anchor - far, anchor - near + LENGTH) + mix(near.astype(np.uint64) + np.uint64(1)))
                core = range_hash(prefix, anchor - tile * smaller, anchor - (tile * smaller + smaller - 1) + LENGTH)
                k = mix(part.column(0).to_numpy()[which].view(np.uint64) + tile.astype(np.uint64))
                low = (p >> 16)[which] + off
                columns = [k.view(np.int64), core.view(np.int64), c.view(np.int64), part.column(1).to_numpy()[which], p[which], tile, open_, low - far, low - near + LENGTH]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k", "core", "c", "t", "p", "tile", "open", "low", "high"])

    kinds = "k long, core long, c long, t long, p long, tile long, open boolean, low long, high long"
    return state.select("g", "t", "p", "bytes", "own").mapInArrow(run, kinds)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def removed(text: bytes, lows: np.ndarray, highs: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left)."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, lows, 1)
    np.add.at(change, highs, -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def low_of(p: Column) -> Column:
    return F.shiftright(p, 16)


def more_of(p: Column) -> Column:
    return F.shiftright(p, 8).bitwiseAND(F.lit(255))


def repeated_bytes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, whole) and (t, lows, highs): texts repeated as a whole, and the marked bytes of the others. ``docs``: t, text."""
    rows = region_rows(docs)
    runs = rows.groupBy("g").agg(F.count(F.lit(1)).alias("total"), F.min("r").alias("least"), F.max("r").alias("most"))
    # written first, so that both sides of the join are plain shuffles and a hot run is split
    runs = written(runs.filter("total > 1").select("g", (F.col("least") != F.col("most")).alias("mixed")), "runs")
    known = rows.join(runs, "g").select(F.when(F.col("mixed"), F.col("g")).alias("g"), F.when(F.col("mixed"), F.col("r")).alias("r"), "t", "p", "mixed")
    again = written(known, "repeated_runs")
    mixed = again.filter("mixed").groupBy("g", "r").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "p")).alias("rep"))
    mixed = written(mixed, "mixed_regions")
    counts = mixed.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    twice = again.filter("mixed").join(mixed.filter("n > 1").select("g", "r"), ["g", "r"], "left_semi")
    settled = again.filter("not mixed").select("t", "p").unionByName(twice.select("t", "p"))
    marks = written(settled.groupBy("t").agg(F.collect_set("p").alias("ps")), "settled")
    windows = F.aggregate("ps", F.lit(0).cast("long"), lambda a, p: a + more_of(p) + 1)
    marks = marks.select("t", "ps", windows.alias("windows"))
    wanted = mixed.join(counts, "g").select("g", F.col("rep.t").alias("t"), F.col("rep.p").alias("p"), "n", "m")
    wanted = written(wanted, "wanted")
    sizes = docs.select("t", F.octet_length("text").alias("size")).groupBy("t").agg(F.max("size").alias("size"))
    whole = written(marks.join(sizes, "t").filter(F.col("windows") == F.col("size") - (LENGTH - 1)).select("t"), "whole")
    needed = written(wanted.select("t").unionByName(marks.select("t").join(whole, "t", "left_anti")).distinct(), "needed")
    # copies meet in each task first, so a text held by very many rows is moved once per task
    texts = docs.groupBy("t").agg(F.first(F.col("text").cast("binary")).alias("text"))
    texts = written(texts.join(needed, "t", "left_semi"), "texts")
    parts = written(fetched(texts, wanted.filter(f"m <= {GROUP}")).transform(small_groups), "small_marks")
    large = large_groups(fetched(texts, wanted.filter(f"m > {GROUP}")))
    fresh = parts.unionByName(large).groupBy("t").agg(F.collect_set(F.struct("low", "high")).alias("more"))
    marked = texts.join(marks.select("t", "ps"), "t", "left").join(fresh, "t", "left").join(whole, "t", "left_anti")
    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))), 1, 0)
    from_ps = F.transform(F.coalesce(F.col("ps"), F.slice(F.array(F.lit(0).cast("long")), 1, 0)), lambda p: F.struct(low_of(p).alias("low"), (low_of(p) + more_of(p) + LENGTH).alias("high")))
    marked = marked.withColumn("marks", F.concat(from_ps, F.coalesce("more", none))).filter(F.size("marks") > 0)
    return whole, marked.select("t", "text", "marks")


def named(docs: DataFrame, text: str) -> DataFrame:
    """docs with t (a hash of the text) in front and text never null."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.xxhash64(content, F.octet_length(content)).alias("t"), content.alias("text"))


def digest_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256."""
    whole, marked = repeated_bytes(named(docs, text))

    def run(batches):
        for batch in batches:
            out = []
            for t, content, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                lows, highs = (marks.values.field(c).to_numpy() for c in ("low", "high"))
                n, spans, kept = removed(content, lows, highs)
                out.append((t, n, spans, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 4, kinds)], ["t", "n_removed", "n_spans", "kept"])

    cut = marked.mapInArrow(run, "t long, n_removed long, n_spans long, kept string").withColumn("all_gone", F.lit(False))
    gone = whole.select("t", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept"), F.lit(True).alias("all_gone"))
    changes = written(cut.unionByName(gone), "changes")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`"), F.xxhash64(content, F.octet_length(content)).alias("t"), F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("own")
    )
    return rows.join(changes, "t", "left").select(
        key, "n_bytes", F.when(F.col("all_gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept", "own").alias("kept_sha256"),
    )


@query("op8_substrings")
def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return digest_rows(table(spark, folder, "documents"))
