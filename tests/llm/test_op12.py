import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cartlens.llm import op12_packing as p
from cartlens.llm.registry import QUERIES


def whole(texts):
    t = Tokenizer.from_file(p.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [p.END_ID] for x in texts]


def check(pieces, docs, limits):
    """Every id in exactly one piece; limits kept; sequences gapless and without padding. ``docs``: key -> ids."""
    spans, rooms = {}, {}
    for r in pieces:
        ids = docs[r["doc_id"]]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        if "ids" in r:
            assert r["ids"] == part
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["loss_tokens"]))
    for key, ids in docs.items():
        at = 0
        for start, length in sorted(spans.get(key, [])):
            assert start == at
            at += length
        assert at == len(ids)
    for own in rooms.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= limits.tokens and (at == limits.tokens or at & (at - 1) == 0)
        assert len(own) <= limits.segments and sum(x for *_, x in own) <= limits.loss
    return rooms


ODD = [
    None, "", " ", "a", "Straße ΑΣ Σίσυφος ΟΔΟΣ", "é café ́ x̀́", "İstanbul IJ ǅ", "½ ² ٣ ௧ x²y 12 3,5 don't I'LL they're 'S",
    "<|endoftext|> <|startoftext|>x<|ENDOFTEXT|> a<|endoftext|>b <|endof text|>", "a\x1cb\x1d \x1e\x1f c\x85d e　f\xa0g​h", "漢字 かな が が 가 가",
    "😀👍🏽 ퟿ � \U0001f1e9\U0001f1ea x_y __ --- ...", "Å Ω ﬁ ̈́ क़ á̧", "tab\tnew\nline\r\x0b\x0c  end ", "ẞ İ̇ ǅ ᾈ ͅ",
]


def test_ids_are_those_of_the_library():
    rnd = random.Random(1)
    alphabet = "abcXYZ éÉßΣσς'0123½.,-_<|>\n\t \x1ćあ漢😀ﬁİ가"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(800)]
    with open(p.tokenizer_path(), encoding="utf-8") as f:
        encoder = p.Encoder(f.read())
    got = encoder.encode(pa.array(texts, pa.string())) + encoder.encode(pa.array([None, *texts, ""], pa.string()).slice(1, len(texts)))
    assert len(got) == 2 * len(texts) and encoder.encode(pa.array([], pa.string())) == []
    for text, ids, want in zip(texts + texts, got, 2 * whole(texts)):
        assert ids.tolist() == want[:-1], repr(text)


def documents():
    rnd = random.Random(5)
    words = [("w%d" % (i * i % 977)) for i in range(400)]
    sizes = [0, 1, 2, 30, 30, 200, 1300, 9000, 20_000]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice(sizes)))) for i in range(150)]
    return rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, "same words again") for i in range(3000)]


def test_pieces_cover_documents_without_padding(spark):
    rows = documents()
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, start string, _body int").repartition(3)
    got = [r.asDict() for r in p.packed(df).collect()]
    rooms = check(got, dict(zip([a for a, _ in rows], whole([b for _, b in rows]))), p.Limits())
    short = [s for s, own in rooms.items() if sum(x for _, x, _ in own) < 4096]
    assert len(short) <= 3 * 13  # a task's tail only
    assert len({r["sequence_id"] for r in got}) == len(rooms)


def test_all_limits_bind_on_instruction_data(spark, monkeypatch):
    monkeypatch.setattr(p, "POOL_ITEMS", 40)
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        n = rnd.choice([0, 1, 3, 8, 40, 300])
        ids = [rnd.randrange(1 << 15) for _ in range(n)]
        mask = None if i % 10 == 0 else [rnd.random() < 0.6 for _ in range(n if i % 7 else n // 2)]
        rows.append((i, ids if i % 50 else None, mask))
    limits = p.Limits(tokens=96, segments=5, loss=40)
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, mask array<boolean>").repartition(2)
    got = [r.asDict() for r in p.packed(df, ids="ids", mask="mask", limits=limits).collect()]
    rooms = check(got, {a: b or [] for a, b, _ in rows}, limits)
    masks = {a: (m or []) for a, _, m in rows}
    for r in got:
        assert r["loss_tokens"] == sum(masks[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    assert max(len(own) for own in rooms.values()) == 5
    assert max(sum(x for *_, x in own) for own in rooms.values()) == 40


def test_placement_follows_the_dot_product():
    out = p.Packer(p.Limits(tokens=16, segments=4, loss=16))
    for k, n in enumerate([3, 10, 6, 5]):
        out.add(p.Example(k, np.arange(n, dtype=np.uint32)))
    out.finish()
    # the largest first, then the largest that still fits whole; 3 + 5 need no padding
    assert [(e.key, a, n, s) for e, a, n, s, _ in out.out] == [(1, 0, 10, 0), (2, 0, 6, 0), (3, 0, 5, 1), (0, 0, 3, 1)]


def test_odd_tables(spark):
    fields = "doc_id long, text string"
    assert p.packed(spark.createDataFrame([], fields)).count() == 0
    same = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None), (1, None)], fields).coalesce(1)
    got = p.packed(same).collect()
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 2 * len(whole(["one two"])[0])
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2
    with pytest.raises(ValueError):
        p.Packer(p.Limits(tokens=0))


def test_very_long_text(spark):
    text = "lorem ipsum dolor " * 150_000
    got = [r.asDict() for r in p.packed(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    check(got, {1: whole([text])[0]}, p.Limits())
    assert len(got) < sum(r["length"] for r in got) / 4096 + 14


def test_query_reads_the_whole_table(spark, data_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = [r.asDict() for r in QUERIES["op12_packing"](spark, data_dir).collect()]
    check(got, dict(zip(docs, whole(docs.values()))), p.Limits())


def test_word_ends_read_from_ids(monkeypatch):
    with open(p.tokenizer_path(), encoding="utf-8") as f:
        encoder = p.Encoder(f.read())
    assert encoder.last is not None
    words = ["a", "the", "</", "w", ">", "zzzxqj" * 9, "é", "数据", "🙂", "'s", "7", "w</w>", "!!!", "\x7f"]
    fast = encoder.plain_ids(words)
    one = [encoder.model.encode([w], is_pretokenized=True, add_special_tokens=False).ids for w in words]
    assert fast[1].tolist() == [len(x) for x in one] and fast[0].tolist() == sum(one, [])
    monkeypatch.setattr(encoder, "last", None)
    slow = encoder.plain_ids(words)
    assert fast[0].tolist() == slow[0].tolist() and fast[1].tolist() == slow[1].tolist()
    assert [len(x) for x in encoder.plain_ids([])] == [0, 0]
