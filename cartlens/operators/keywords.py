"""Words of low-scored and high-scored comments."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.fixed_values import STOPWORDS
from cartlens.functions.scalars import not_blank
from cartlens.operators.reviews import HIGH, LOW
from cartlens.session import written

HAN = "一-龥"
#: Bytes of text whose words one task counts, on average.
TASK_TEXT = 8_000_000


def words(text: Column) -> Column:
    """Runs of two and more Latin letters, and all neighbouring pairs inside runs of Han characters.

    Everything else separates words. Whole texts are read; order inside the text is not kept.
    """
    latin = F.regexp_extract_all(text, F.lit("[a-zA-Z]{2,}"), F.lit(0))
    pairs = F.regexp_extract_all(text, F.lit(f"(?=([{HAN}]{{2}}))"), F.lit(1))
    return F.concat(latin, pairs)


def review_tokens(
    rows: DataFrame, segmenter: Callable[[Column], Column] = words, stopwords: Sequence[str] = tuple(STOPWORDS),
    keep: Sequence[str] = (),
) -> DataFrame:
    """(review, group, word, w) and the columns to keep: one row per word of a non-blank comment, without the stop words.

    ``segmenter`` maps a text column to an array of words; a ``pandas_udf`` may take its place.
    """
    said = rows.filter(not_blank(F.col("review_comment_message")))
    return said.select(
        "review_id", "score_group", "w", *keep, F.explode(segmenter(F.col("review_comment_message"))).alias("word")
    ).filter((F.length("word") > 1) & ~F.col("word").isin(*dict.fromkeys(stopwords)))


def review_words(
    rows: DataFrame, segmenter: Callable[[Column], Column] = words, stopwords: Sequence[str] = tuple(STOPWORDS)
) -> DataFrame:
    """(review, group, word, n): how often each word stands in a review's comments, weighed.

    Nearly every word of a review is a group of its own, so a task holds all words it is given: tasks are as many as
    TASK_TEXT asks for, not as the session's shuffles have. Comments are counted one by one first, so that
    reviews without an id don't meet in one task before their words are told apart.
    """
    text = F.col("review_comment_message")
    said = written(rows.filter(not_blank(text)).select("review_id", "score_group", "w", text, F.xxhash64(text).alias("_text")), "said")
    size = said.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = max(1, -(-size // TASK_TEXT))
    own = ["review_id", "score_group", "_text"]
    tokens = review_tokens(said.repartition(tasks, *own), segmenter, stopwords, keep=("_text",))
    counts = tokens.groupBy(*own, "word").agg(F.sum("w").alias("n")).drop("_text")
    key = ["review_id", "score_group", "word"]
    return counts.repartition(tasks, *key).groupBy(*key).agg(F.sum("n").alias("n"))


def keyword_counts(tokens: DataFrame) -> DataFrame:
    return (
        tokens.filter(F.col("score_group").isin(LOW, HIGH))
        .groupBy("score_group", "word").agg(F.sum("w").alias("n"))
    )


def keyword_top(counts: DataFrame, top: int = 50) -> DataFrame:
    """Most common words per group, ties by word. The rank filter cuts each task's rows before the shuffle."""
    order = Window.partitionBy("score_group").orderBy(F.desc("n"), "word")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def keyword_compare(tops: DataFrame) -> DataFrame:
    """Both lists side by side; a word outside one list counts zero there."""
    side = lambda g, name: tops.filter(F.col("score_group") == g).select("word", F.col("n").alias(name))
    low, high = F.coalesce("low_score_count", F.lit(0)), F.coalesce("high_score_count", F.lit(0))
    return (
        side(LOW, "low_score_count")
        .join(side(HIGH, "high_score_count"), "word", "full_outer")
        .select(
            "word", low.alias("low_score_count"), high.alias("high_score_count"),
            ((low - high).cast("double") / (low + high + 1)).alias("diff_ratio"),
        )
        .orderBy(F.desc("diff_ratio"), "word")
    )


def keyword_report(compared: DataFrame, low_top: int = 15, high_top: int = 10) -> DataFrame:
    """Words that mark low scores, in order, and words found only in high scores, by count."""
    bad = (
        compared.filter(F.col("diff_ratio") > 0)
        .orderBy(F.desc("diff_ratio"), "word").limit(low_top)
        .select(F.lit(LOW).alias("section"), "*")
    )
    good = (
        compared.filter(F.col("diff_ratio") < -0.99)
        .orderBy(F.desc("high_score_count"), "word").limit(high_top)
        .select(F.lit(HIGH).alias("section"), "*")
    )
    return bad.unionByName(good)
