"""Quality rules from repeated text: word suffix arrays, LCP intervals, spans of maximal repeats.

The words of a slice of texts are sorted as suffixes by prefix doubling (ranks of 1, 2, 4, ... words; only
suffixes that still share their rank are sorted again). A text's number is part of the first rank, so no
repeat crosses texts. Each neighbouring pair's longest common prefix comes from the stored ranks, from the
highest power down. The LCP interval with the longest common prefix that holds suffix i gives the longest
repeated substring at i; the union of those spans is what is covered.

Everything is local to a text: no shuffle, memory of one slice (about two million bytes or one text).

Defined results: null and empty texts have no words, all counts are 0, ``base_failed`` is true and ``kept``
false. Rows are judged one by one, so repeated rows give repeated equal rows; an empty table gives an empty
one. Only the named id and text columns are read for scores; ``keep_good`` passes all columns through as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cartlens.llm.registry import query, table
from cartlens.llm.words import SPACE, Words, mix, range_hash, segment_sum, word_slices

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # of 100 words, in windows found twice

#: The method's limits: repeats of at least so many words count as covered, the share that may be covered,
#: and the longest repeat (in words) that a text may hold.
LEAST_REPEAT = 5
MOST_COVERED = 0.30
LONGEST_REPEAT = 100

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, covered_words long, longest_repeat long"
)


def repeat_lengths(keys: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each word the length in words of the longest substring that starts there and occurs again.

    ``keys``: word hashes that differ between texts; ``left``: words from here to the text's end, itself included.
    """
    n = len(keys)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    levels, step = [rank], 1
    alone = np.zeros(n, bool)
    alone[order] = fresh & np.append(fresh[1:], True)
    active = np.flatnonzero(~alone)
    while len(active):
        inside = left[active] > step
        second = np.where(inside, rank[np.minimum(active + step, n - 1)] + 1, 0)
        head = rank[active]
        key = head * (n + 1) + second
        order = np.argsort(key)
        key, who = key[order], active[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, len(key)))
        head = head[order]
        group = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
        group_start = np.repeat(group, np.diff(np.append(group, len(head))))
        rank = rank.copy()
        rank[who] = head + np.repeat(first, sizes) - group_start
        levels.append(rank)
        active = who[np.repeat(sizes, sizes) > 1]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left_one, right_one = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][left_one] == levels[0][right_one])
    i, j = left_one[near].copy(), right_one[near].copy()
    common = np.zeros(len(near), np.int64)
    rest_i, rest_j = left[i], left[j]
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        can = (rest_i - common >= width) & (rest_j - common >= width)
        same = can.copy()
        same[can] = levels[k][(i + common)[can]] == levels[k][(j + common)[can]]
        common[same] += width
    np.maximum.at(longest, i, common)
    np.maximum.at(longest, j, common)
    return longest


def union_sizes(starts: np.ndarray, lengths: np.ndarray, n: int, cuts: np.ndarray) -> np.ndarray:
    """Words in the union of the spans, between each two cuts; spans do not cross cuts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return segment_sum(np.cumsum(change)[:n] > 0, cuts)


def duplicate_lines(w: Words) -> np.ndarray:
    """For each text the lines that hold a word and equal an earlier line of the text."""
    n_texts = len(w.counts)
    breaks = np.flatnonzero(w.raw == 10)
    starts = np.concatenate((w.offsets[:-1], breaks + 1))
    text = np.concatenate((np.arange(n_texts), np.searchsorted(w.offsets, breaks, side="right") - 1))
    order = np.argsort(starts, kind="stable")
    starts, text = starts[order], text[order]
    ends = np.append(starts[1:], len(w.raw))
    ends = np.minimum(np.where(np.append(text[1:] == text[:-1], False), ends - 1, ends), w.offsets[text + 1])
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    h = mix(range_hash(w.prefix, starts, ends) ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    again[order[1:]] = h[order][1:] == h[order][:-1]
    return np.bincount(text[again], minlength=n_texts)


def measures(w: Words) -> dict[str, np.ndarray]:
    texts = w.text_of_word()
    n = len(texts)
    solid = ~SPACE[w.raw]
    keys = mix(w.hashes() ^ mix(texts.astype(np.uint64) + np.uint64(1)))
    left = w.of_text[1:][texts] - np.arange(n)
    longest = repeat_lengths(keys, left)
    windows = np.flatnonzero(longest >= WINDOW)
    repeats = np.flatnonzero(longest >= LEAST_REPEAT)
    most = np.zeros(len(w.counts), np.int64)
    np.maximum.at(most, texts, longest)
    n_words = w.counts.astype(np.int64)
    n_repeat = union_sizes(windows, np.full(len(windows), WINDOW), n, w.of_text)
    covered = union_sizes(repeats, longest[repeats], n, w.of_text)
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
    good = ~failed & (covered <= MOST_COVERED * n_words) & (most <= LONGEST_REPEAT)
    return {
        "n_words": n_words,
        "word_chars": segment_sum(solid & ((w.raw & 0xC0) != 0x80), w.offsets),
        "n_symbols": segment_sum(SYMBOL[w.raw], w.offsets),
        "n_dup_lines": duplicate_lines(w),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": good,
        "covered_words": covered,
        "longest_repeat": most,
    }


def quality_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the measures of each row."""

    def run(batches):
        for batch in batches:
            for a, b, w in word_slices(batch.column(1)):
                found = measures(w)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *map(pa.array, found.values())], [key, *found]
                )

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {METRICS}")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for a, b, w in word_slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(measures(w)["kept"]))

    return docs.mapInArrow(run, docs.schema)


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"))
