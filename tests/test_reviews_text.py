import datetime as dt
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens import fixed_values as fv
from cartlens.functions.tails import chi2_tail, normal_tail, rank_sum_counts
from cartlens.operators import explore, keywords, recode, reviews
from cartlens.sources import tables


def test_tails(spark):
    df = spark.createDataFrame([(3.841458820694124, 1.0), (30.0, 19.0), (1000.0, 19.0), (0.5, 4.0)], "s double, k double")
    got = [r[0] for r in df.select(chi2_tail("s", "k")).collect()]
    # even degrees of freedom have a closed form
    assert got[0] == pytest.approx(0.05, rel=1e-9) and got[3] == pytest.approx(math.exp(-0.25) * 1.25, rel=1e-12)
    grid = np.linspace(30.0, 400.0, 2_000_001)
    density = np.exp((19 / 2 - 1) * np.log(grid) - grid / 2 - 19 / 2 * math.log(2) - math.lgamma(19 / 2))
    assert got[1] == pytest.approx(np.trapezoid(density, grid), rel=1e-7) and 0 < got[2] < 1e-190
    z = [r[0] for r in spark.createDataFrame([(1.959963984540054,), (0.0,), (None,)], "z double").select(normal_tail("z")).collect()]
    assert z[0] == pytest.approx(0.025, rel=1e-9) and z[1] == 0.5 and z[2] is None


def review_frames(spark, rows):
    """(review, score, delivery days, lines, message)"""
    day = dt.datetime(2020, 1, 1)
    orders = spark.createDataFrame(
        [(i, i, day, None if d is None else day + dt.timedelta(days=d), day + dt.timedelta(days=10)) for i, _, d, _, _ in rows],
        "order_id bigint, customer_id bigint, order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    )
    revs = spark.createDataFrame([(i, i, s, m) for i, s, _, _, m in rows], "review_id bigint, order_id bigint, review_score int, review_comment_message string")
    items = spark.createDataFrame([(i, j, i % 3, i % 4, 10.0 * (j + 1)) for i, _, _, n, _ in rows for j in range(n)],
                                  "order_id bigint, order_item_id bigint, product_id bigint, seller_id bigint, price double")
    return revs, orders, items.withColumn("price", F.col("price").cast("decimal(18,2)"))


def test_rank_sum_counts_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(1, 6)), int(rng.integers(0, 9)) if rng.random() < 0.9 else None, int(rng.integers(0, 4)), None) for i in range(120)]
    lines = reviews.review_lines(*review_frames(spark, rows))
    got = reviews.review_mwu(lines).first()
    spread = [(s, d) for _, s, d, n, _ in rows if d is not None for _ in range(max(n, 1))]
    low, high = [d for s, d in spread if s <= 2], [d for s, d in spread if s >= 4]
    u = sum((a > b) + 0.5 * (a == b) for a in low for b in high)
    assert (got.n_low, got.n_high, got.u) == (len(low), len(high), u)


@pytest.mark.parametrize("m, n", [(1, 1), (1, 9), (3, 4), (5, 2), (4, 4)])
def test_rank_sum_distribution_is_that_of_all_orders(m, n):
    want = [0] * (m * n + 1)
    for places in itertools.combinations(range(m + n), m):
        want[sum(p - i for i, p in enumerate(places))] += 1
    assert rank_sum_counts(m, n) == want


def test_small_rank_sums_are_exact_unless_tied(spark):
    days = {1: [3, 9, 11], 5: [1, 2, 4, 8]}
    rows = [(i, s, d, 1, None) for i, (s, d) in enumerate((s, d) for s, ds in days.items() for d in ds)]
    got = reviews.review_mwu(reviews.review_lines(*review_frames(spark, rows))).first()
    orders = list(itertools.combinations(range(7), 3))
    above = [sum(p - i for i, p in enumerate(places)) >= got.u for places in orders]
    assert got.u == 10 and got.p_value == pytest.approx(sum(above) / len(orders), rel=1e-15)
    tied = reviews.review_mwu(reviews.review_lines(*review_frames(spark, [*rows, (9, 5, 9, 1, None)]))).first()
    assert tied.p_value == pytest.approx(0.5 * math.erfc(tied.z / math.sqrt(2)), rel=1e-12)


def test_unknown_score_is_in_the_middle(spark):
    df = spark.createDataFrame([(None,), (1,), (3,), (4,)], "s int")
    assert [r[0] for r in df.select(reviews.score_group(F.col("s"))).collect()] == ["mid", "low", "mid", "high"]


def test_words(spark):
    text = [("Good, good QUALITY x 很好用2天！质量 很",), ("",)]
    got = [r[0] for r in spark.createDataFrame(text, "t string").select(keywords.words(F.col("t"))).collect()]
    assert got[0] == ["Good", "good", "QUALITY", "很好", "好用", "质量"] and got[1] == []
    row = spark.createDataFrame([(1, "low", 1, "这个一点")], "review_id int, score_group string, w int, review_comment_message string")
    assert [r.word for r in keywords.review_tokens(row).collect()] == ["个一"]


def test_keywords_weigh_lines_and_keep_outsiders(spark):
    rows = [(1, 1, 3, 3, "bad slow"), (2, 5, 3, 1, "nice"), (3, 5, 3, 2, "   "), (4, 3, 3, 1, "ignored"), (5, 5, 3, 1, "nice slow")]
    lines = reviews.review_lines(*review_frames(spark, rows), extra=("review_comment_message",))
    counts = keywords.keyword_counts(keywords.review_tokens(lines))
    got = {r.word: (r.low_score_count, r.high_score_count) for r in keywords.keyword_compare(keywords.keyword_top(counts)).collect()}
    assert got == {"bad": (3, 0), "slow": (3, 1), "nice": (0, 2)}
    one = keywords.keyword_compare(keywords.keyword_top(counts, 1))
    assert {r.word: (r.low_score_count, r.high_score_count) for r in one.collect()} == {"bad": (3, 0), "nice": (0, 2)}
    groups = {r.score_group: (r.reviews, r.with_comment) for r in reviews.review_group_counts(lines).collect()}
    assert groups == {"low": (3, 3), "high": (4, 2), "mid": (1, 1)}


def test_review_words_take_tasks_by_text(spark, monkeypatch):
    rows = [(i % 40 or None, "low" if i % 3 else "high", 1 + i % 2, f"word{'abc'[i % 3]} slow slow {'tail' * (i % 5)}") for i in range(200)]
    rows += [(1, "low", 1, None), (2, "low", 1, "  ")]
    df = spark.createDataFrame(rows, "review_id int, score_group string, w long, review_comment_message string")
    want = {tuple(r) for r in keywords.review_tokens(df).groupBy("review_id", "score_group", "word").agg(F.sum("w")).collect()}
    size = sum(len(r[3]) for r in rows[:200])
    for tasks in (1, 25):
        monkeypatch.setattr(keywords, "TASK_TEXT", -(-size // tasks))
        got = keywords.review_words(df)
        assert got.rdd.getNumPartitions() == tasks
        assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want


def test_shop_name_equals_whole_number_arithmetic(spark):
    ids = [f"s{i}" for i in range(300)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(recode.shop_name(F.col("id"))).collect()]
    for i, name in zip(ids, got):
        h = int(hashlib.md5(i.encode()).hexdigest(), 16)
        assert name == fv.SHOP_REGIONS[h % 8] + fv.SHOP_GOODS[h // 8 % 16] + fv.SHOP_KINDS[h // 128 % 6]


def test_recoding_defaults(spark):
    df = spark.createDataFrame(
        [(" Sao Paulo ", "RJ"), ("nowhere", "MG"), ("nowhere", "??"), (None, None)], "city string, state string"
    )
    got = [tuple(r) for r in df.select(recode.recode_city(F.col("city"), F.col("state")), recode.recode_state(F.col("state"))).collect()]
    assert got == [("上海", "北京"), ("广州", "广东"), ("未知", "未知"), ("未知", "未知")]
    codes = spark.createDataFrame([("pcs",), ("new",), (None,)], "c string")
    assert [r[0] for r in codes.select(recode.recode_category(F.col("c"))).collect()] == ["电脑整机", "其他", None]
    assert [r[0] for r in codes.select(recode.recode_payment(F.col("c"))).collect()] == ["pcs", "new", None]


def test_comments(spark):
    rows = [(1, 5, "ok"), (2, 3, "ok"), (3, 1, "ok"), (4, 5, " "), (5, 5, None), (6, None, "ok")]
    df = spark.createDataFrame(rows, "review_id int, s int, m string")
    got = [r[0] for r in df.select(recode.comment_for(F.col("s"), F.col("m"), F.col("review_id"))).collect()]
    assert got[0] in fv.POSITIVE_COMMENTS and got[1] in fv.NEUTRAL_COMMENTS and got[2] in fv.NEGATIVE_COMMENTS
    assert got[3:5] == ["", ""] and got[5] in fv.NEGATIVE_COMMENTS


def test_csv_with_mark_breaks_and_missing_file(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        '﻿"order_id","order_status","customer_id","order_purchase_timestamp"\nA,delivered,C,2020-01-02 03:04:05\nB,,D,bad\n', encoding="utf-8"
    )
    (tmp_path / "order_reviews.csv").write_text(
        'review_id,order_id,review_score,review_comment_message\nR,A,5,"two\nlines, ""quoted"""\n', encoding="utf-8"
    )
    got = tables.read_csv_tables(spark, {n: str(tmp_path / f"{n}.csv") for n in ("orders", "order_reviews", "sellers")})
    assert set(got) == {"orders", "order_reviews"}
    a, b = got["orders"].orderBy("order_id").collect()
    assert (a.order_id, a.customer_id, a.order_purchase_timestamp) == ("A", "C", dt.datetime(2020, 1, 2, 3, 4, 5))
    assert b.order_status is None and b.order_purchase_timestamp is None and b.order_approved_at is None
    assert got["order_reviews"].first().review_comment_message == 'two\nlines, "quoted"'


def test_save_and_append(spark, tmp_path):
    df = spark.range(3).toDF("x")
    tables.save_table(df, "t_saved", "replace", str(tmp_path / "t"))
    tables.save_table(df, "t_saved", "append")
    assert tables.load_table(spark, "t_saved").count() == 6
    assert "t_saved" in [r.table_name for r in tables.list_tables(spark).collect()]
    with pytest.raises(ValueError):
        tables.save_table(df, "t_saved", "fail")


def test_key_check_counts_nulls_and_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1)], "order_id string, order_item_id int")
    row = tables.key_check(df, "order_items").first()
    assert (row.row_count, row.null_keys, row.duplicate_keys, row.surplus_rows) == (4, 1, 1, 1)


def test_describe_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, "b"), (None, "a")], "x int, s string")
    got = {r.column_name: r for r in explore.eda_describe(df).collect()}
    assert (got["x"]["count"], got["x"].top) == (0, None) and (got["s"].top, got["s"].freq) == ("a", 1)


def test_chi2_with_one_column(spark):
    rows = spark.createDataFrame([("a", "high", 3), ("b", "high", 5), ("c", "high", 1)], "product_category_name string, score_group string, w long")
    r = reviews.review_chi2(rows).first()
    assert (r.chi2, r.dof, r.p_value) == (0.0, 0, 1.0)
