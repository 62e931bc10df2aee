import glob
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from cartlens.llm import op2_pii, op3_minhash
from cartlens.session import scratch_root
from tests.llm.test_op2 import base
from tests.llm.test_op3 import brute as near_brute
from tests.llm.test_op6 import brute as quality_brute


def corpus():
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(2, 8))) for _ in range(600)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    rows = []
    for i in range(80):
        w = prose(rnd.randrange(25, 90))
        if i % 9 == 0:
            w[5] = f"user{i}@mail{i}.org"
        rows.append(" ".join(w))
        if i % 4 == 0:
            w[rnd.randrange(10, 20)] = "edited"
            rows.append(" ".join(w))
        if i % 8 == 0:
            rows += [rows[-1]] * 3
    rows += [None, "", "too few words", "again " * 80]
    return [(i, t, "en", "s1" if i % 3 else None, len(t or ""), "extra") for i, t in enumerate(rows)]


def test_every_stage_on_its_input(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _terms string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, tables = docs, []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        tables.append(at.collect())
    good, single, private, mix, coded = tables
    assert all(t[0].__fields__ == docs.columns for t in tables[:-1])
    assert {r.doc_id for r in good} == {i for i, t, *_ in rows if quality_brute(t)["kept"]}
    groups = near_brute([(r.doc_id, r.text) for r in good], 5, 80)
    assert {r.doc_id for r in single} == {i for i, _, _, kept in groups if kept} and len(single) < len(good)
    assert len(private) == len(single) and not any(base(r.text) for r in private)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    count, held = Counter(r.doc_id for r in mix), {r.doc_id: r for r in private}
    assert max(count.values()) <= 2
    total = sum(size(r.text) for r in private)
    assert abs(sum(size(held[i].text) * n for i, n in count.items()) - 1.5 * total) <= 200
    assert len(coded) == len(mix) and all(len(r.token_ids) == r.n_tokens > 0 for r in coded)


def test_run_and_empty_table(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.filter("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 60
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("make, name", [(op3_minhash.one_of_each, "numbered"), (op2_pii.sanitised, "pii")])
def test_scratch_copies_of_texts_are_packed_tightly(spark, make, name):
    """They stay beside the input for as long as the job runs."""
    texts = [(i, f"{i} some words of a text that is long enough to be kept {i * 7} in whole") for i in range(30)]
    copies = lambda: set(glob.glob(f"{scratch_root(spark)}/{name}-*/*.parquet"))
    before = copies()
    assert make(spark.createDataFrame(texts, "doc_id long, text string")).count() == 30
    made = copies() - before
    assert made and all(f.endswith(".zstd.parquet") for f in made)
