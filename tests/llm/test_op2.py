import hashlib
import math
import random
import re
import time
from collections import defaultdict

from cartlens.llm import op2_pii as p


def base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def spans_of(rows):
    word = re.compile(r"[^\W_]+")
    found, near, n_e, n_t, n_et = [], [], defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in enumerate(rows):
        t = t or ""
        found.append(base(t))
        for w in word.findall(t.lower()):
            n_t[w].add(i)
        for s, k, e in found[i]:
            v = t[s:e].lower() if k < 2 else re.sub("[^0-9]", "", t[s:e])
            n_e[k, v].add(i)
            for a, b in ((0, s), (e, len(t))):
                for m in word.finditer(t[a:b]):
                    x, y = m.start() + a, m.end() + a
                    if (x > a or a == 0) and (y < b or b == len(t)) and not any(q < y and x < r for q, _, r in found[i]):
                        near.append((i, (k, v), m[0].lower(), x, y))
                        n_et[(k, v), m[0].lower()].add(i)
    out = [set(f) for f in found]
    for i, e, w, x, y in near:
        both, total = len(n_et[e, w]), len(rows)
        known = math.log2(total / len(n_e[e]))
        if both >= p.LEAST_DOCS and known > 0 and math.log2(both * total / (len(n_e[e]) * len(n_t[w]))) >= p.DISCLOSURE * known:
            out[i].add((x, 4, y))
    say = lambda xs: ",".join(f"{p.KINDS[k]}:{s}:{e}" for s, k, e in sorted(xs))
    return [(say(f), say(o)) for f, o in zip(found, out)]


def texts():
    rnd = random.Random(9)
    out = [
        None, "", "mail a.b@c.de, x@y, @z.com", "a@b.c%d@e.f é@x.org", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "9" * 400 + ".1.1.1",
        "4111 1111 1111 1111", "x4111-1111-1111-1111-2 4111111111111111", "+1 (212) 555-0100. +1234 ----- +49 30 1234567890123456", "4111  1111 1111 1111",
        "ü" * 50 + " tel +33 1 23 45 67 89, ip 10.0.0.1 " + "é" * 30, "a@b.cc a@b.cc " * 300, "+1" + " " * 2000 + "5",
    ]
    alphabet = "ab1290.. @--+( )5é%\n"
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 120))) for _ in range(300)]
    people = [("ann.lee@corp.org", "lighthouse"), ("10.1.2.3", "gateway77"), ("+1 212 555 0100", "Zürich")]
    for mail, hint in people:
        out += [f"the {hint} of {mail} is here, the end" for _ in range(5)]
    out += ["the is here of end" for _ in range(60)]
    return out


def test_spans_against_brute_force(spark, tmp_path):
    rows = texts()
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, spans string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in p.op2_pii(spark, str(tmp_path)).collect()}
    want = spans_of(rows)
    assert len(got) == len(rows)
    for i, (b, s) in enumerate(want):
        assert got[i].spans == s, rows[i]
        assert got[i].base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in p.KINDS[:4]] == [sum(x.startswith(k) for x in b.split(",")) for k in p.KINDS[:4]]
    assert any("term" in s for _, s in want)


def test_sanitised_text(spark):
    rows = [(1, "call +1 212 555 0100 or a@b.cc!", "k"), (1, "clean é", "k"), (None, None, None), (2, "card +4111 1111 1111 1111 end", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _terms string")
    df = df.withColumnRenamed("_terms", "value")
    out = p.sanitised(df)
    assert out.columns == df.columns
    assert sorted((r.text or "" for r in out.collect())) == sorted(["call [PHONE] or [EMAIL]!", "clean é", "", "card " + ("+[CARD]" if len(base(rows[3][1])) == 1 else "[PHONE]") + " end"])
    assert p.sanitised(df.filter("false")).count() == 0
    hinted = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[-75:])], "doc_id long, text string")
    new = {r.doc_id: r.text for r in p.sanitised(hinted).collect()}
    assert new[0] == "the [WORD] of [EMAIL] is here, the end" and "gateway77" not in new[6]


def test_telling_terms_are_marked_wherever_they_stand(spark, tmp_path):
    far = " of the day and then" * 10
    rows = [f"mail ann.lee@corp.org{far} Lighthouse{far} lighthouse end" for _ in range(6)]
    rows += ["the lighthouse stands alone"] + ["of the day and then mail end stands alone" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spans = {r.doc_id: r.spans for r in p.op2_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(rows):
        terms = {tuple(map(int, x.split(":")[1:])) for x in spans[i].split(",") if x.startswith("term")}
        assert terms == {m.span() for m in re.finditer("lighthouse", t.lower())}
    new = {r.doc_id: r.text for r in p.sanitised(df).collect()}
    assert new[6] == "the [WORD] stands alone" and new[0] == f"mail [EMAIL]{far} [WORD]{far} [WORD] end" and new[7] == rows[7]


def test_many_spans_in_one_long_text(spark):
    """Texts of many blocks and runs, with code points beyond the first plane; time does not go with the square."""
    rnd = random.Random(8)
    gaps = ["x" * rnd.randrange(0, 9) + "\U0001d4b3é\n" * rnd.randrange(1, 5) + " " for _ in range(16_000)]
    text = "".join(f"{g}a{i}@b.c " for i, g in enumerate(gaps))
    wide = "é\U0001d4b3" * 5000 + " +1 (234) 567-8901 " + "y" * 3000
    began = time.monotonic()
    got = {r.doc_id: r.text for r in p.sanitised(spark.createDataFrame([(1, text), (2, wide), (3, "a@b.c")], "doc_id long, text string")).collect()}
    assert got[1] == "".join(g + "[EMAIL] " for g in gaps) and got[3] == "[EMAIL]"
    assert got[2] == wide.replace("+1 (234) 567-8901", "[PHONE]")
    assert time.monotonic() - began < 60
