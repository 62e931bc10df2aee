import hashlib
import random

import numpy as np
import pytest

from cartlens.llm import op7_bpe as b

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(b.tokenizer_path())


def texts():
    rnd = random.Random(2)
    out = [None, "", " ", "\n\n  x", "it's we'll I'D ' 't", "a<|endoftext|>b <|endoftext|>", "日本語 naïve café 𝒳 🙂🙂", "x​ y՘࢏ z",
           "tab\t\ttab  two   three    ", "1234 5.6,7 ²³ ½", "a\x1cb\x85c d", "x" * 5000, "word " * 3000]
    alphabet = "ab é'ß1 2.\n\t日<|> 🙂s t"
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 80))) for _ in range(200)]
    return out


def test_same_as_library(spark, tmp_path, reference):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += rows[3:6]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = b.op7_bpe(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = reference.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), rows[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_and_broken_ids(spark, reference):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts())], "doc_id long, text string, token_ids string")
    out = b.decode(b.encode(df)).collect()
    assert all(r.decoded == (r.text or "") for r in out)
    ids = [[220, 164], [50256, 0], [], [161], [162, 245, 99]]
    got = b.decode(spark.createDataFrame([(x,) for x in ids] + [(None,)], "token_ids array<int>")).collect()
    assert sorted(r.decoded for r in got if r.decoded is not None) == sorted(reference.decode(x, skip_special_tokens=False) for x in ids)
    assert sum(r.decoded is None for r in got) == 1


def test_empty_table(spark):
    assert b.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_many_batches_are_encoded_once(spark, monkeypatch, tmp_path, reference):
    """Batches of a few texts, many buckets, several Arrow batches, columns named like the operator's own."""
    monkeypatch.setattr(b, "BATCH_BYTES", 50)
    monkeypatch.setattr(b, "BUCKET_WORDS", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, t, "p") for i, t in enumerate(texts() * 2)]
        df = spark.createDataFrame(rows, "_batch long, text string, _words string").repartition(3)
        split = b.split_once(df.select("_batch", "text").toDF("id", "t"), ["id"], "t", b.read_settings(None))
        assert split.count() > 3
        got = b.encode(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r._batch for r in got) == list(range(len(rows)))
    for r in got:
        assert r._words == "p" and r.text == rows[r._batch][1]
        assert r.token_ids == reference.encode(r.text or "", add_special_tokens=False).ids


def test_long_text_and_empty_query(spark, tmp_path, reference):
    bare = b.encode(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.token_ids) for r in bare) == [(1, 0, []), (2, 0, [])]
    long = " ".join(f"w{i % 977} é" for i in range(150_000))
    got = b.encode(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert got.token_ids == reference.encode(long, add_special_tokens=False).ids
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert b.op7_bpe(spark, str(tmp_path)).collect() == []
