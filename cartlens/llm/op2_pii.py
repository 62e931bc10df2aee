"""Personal data: fixed patterns, and terms that give protected values away by what the corpus says about them.

Protected entities are the values of the base spans (e-mail, IP, card, phone). The terms of the documents that hold them
are judged by information theory: with p from document frequencies, PMI(entity; term) = log2 p(entity, term) / (p(entity)
p(term)) says how many of the IC(entity) = -log2 p(entity) bits the term discloses. A term whose share PMI / IC reaches
``DISCLOSURE``, with at least ``LEAST_DOCS`` common documents behind the estimate, gives that entity away wherever it
stands, so all its occurrences in all documents are marked; ``sanitised`` generalises it ([WORD], [NUMBER]) or removes it.

DataFrame functions only. Positions come from splitting at the matches and summing lengths, so no text is cut by hand.
A document's entities meet its distinct terms, less those that can't pass: as n_et <= n_e, a telling term has
n_t <= N / (N / n_e) ** DISCLOSURE, and neither entities nor terms of fewer than ``LEAST_DOCS`` documents count. These first
counts take a term anywhere in a document; only pairs that pass are counted again from the terms clear of base spans.
Counts are partial sums before each shuffle, and the joins on entity and term are left to skew handling.

Defined results: a null text is empty. Rows are marked one by one, repeated rows alike, and each counts as a document. An
empty table gives an empty one. Text outside the spans stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.registry import query, table
from cartlens.session import written

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.8
LEAST_DOCS = 3

# The same matches as the plain patterns, with starts that can't match ruled out: a match starts where a run of its
# characters does or where the last match ended, and runs are taken whole.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]+"
CHUNK = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(w: Column) -> Column:
    """Inclusive running sums of a bound array of ints, by chunks, so that long arrays stay cheap."""
    chunk = lambda i: F.floor(i / CHUNK).cast("int")
    add = lambda a, x: a + x
    sums = F.transform(F.sequence(F.lit(0), chunk(F.size(w) - 1)), lambda c: F.aggregate(F.slice(w, c * CHUNK + 1, F.lit(CHUNK)), F.lit(0), add))
    before = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    inside = lambda i: F.aggregate(F.slice(w, chunk(i) * CHUNK + 1, i % CHUNK + 1), F.lit(0), add)
    return let(before, lambda b: F.transform(w, lambda _, i: F.get(b, chunk(i)) + inside(i)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points, end exclusive."""
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(s: Column) -> Column:
        steps = F.transform(s["m"], lambda x, i: F.length(x) + F.length(F.get(s["p"], i)))
        ends = let(steps, running)
        return F.zip_with(s["m"], ends, lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("value")))

    found = let(pair, placed)
    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))), 1, 0)
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), found).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    twice = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def total(d: Column) -> Column:
        figure = lambda i: F.substr(d, -i, F.lit(1)).cast("int")
        return F.aggregate(
            F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, F.get(twice, figure(i))).otherwise(figure(i))
        )

    return let(digits(value), total) % 10 == 0


def small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))))


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end, value>> by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    count = lambda e: F.length(digits(e["value"]))
    found = (
        matches(text, EMAIL),
        F.filter(matches(text, IP), lambda e: small_parts(e["value"])),
        F.filter(matches(text, CARD), lambda e: count(e).between(14, 19) & luhn(e["value"])),
        F.filter(matches(text, PHONE), lambda e: count(e).between(10, 15)),
    )

    def of_kind(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda e: F.struct(e["start"].alias("start"), F.lit(k).alias("k"), e["end"].alias("end"), e["value"].alias("value")))

    return F.array_sort(F.concat(*[of_kind(k, a) for k, a in enumerate(found)]))


def entity(span: Column) -> Column:
    plain = F.when(span["k"].isin(0, 1), F.lower(span["value"])).otherwise(digits(span["value"]))
    return F.concat(span["k"].cast("string"), F.lit(":"), plain)


def found_in(docs: DataFrame, text: str) -> DataFrame:
    """Written: the rows, their columns and _pii (base spans, perhaps none) and _pii_row."""
    return written(docs.withColumn("_pii", base_spans(F.col(f"`{text}`"))).withColumn("_pii_row", F.monotonically_increasing_id()), "pii", compression="zstd")


def disclosing(rows: DataFrame, text: str, share: float = DISCLOSURE, least: int = LEAST_DOCS) -> DataFrame:
    """_pii_row, _terms: array<struct<start, end>> of the terms that disclose an entity. ``rows``: of ``found_in``."""
    old, total = F.coalesce(F.col(f"`{text}`"), F.lit("")), rows.count()
    held = rows.filter(F.size("_pii") > 0).select("_pii_row", F.explode(F.array_distinct(F.transform("_pii", entity))).alias("entity"))
    held = written(held, "entities")
    n_entity = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= least)
    known = F.log2(F.lit(float(total)) / F.col("n_e"))
    most = F.lit(float(total)) / F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(share)) * (1 + 1e-9)
    n_entity = written(n_entity.filter(known > 0).withColumn("most", most), "entity_counts")
    held = written(held.join(n_entity, "entity"), "held")
    highest = n_entity.agg(F.max("most")).first()[0] or 0.0

    terms = F.array_distinct(F.transform(F.regexp_extract_all(old, F.lit(TERM), F.lit(0)), F.lower))
    words = rows.select("_pii_row", F.explode(terms).alias("term"))
    n_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter(F.col("n_t").between(least, highest))
    n_term = written(n_term, "term_counts")
    bits = F.log2(F.col("n_et") * float(total) / (F.col("n_e") * F.col("n_t")))
    passes = (F.col("n_et") >= least) & (bits >= share * known)
    # a row needs its terms only up to what the most frequent of its entities allows
    reach = held.groupBy("_pii_row").agg(F.max("most").alias("_most"))
    of_held = rows.join(reach, "_pii_row").select("_pii_row", "_most", F.explode(terms).alias("term"))
    of_held = written(of_held.join(n_term, "term").filter(F.col("n_t") <= F.col("_most")).drop("_most"), "held_terms")
    pairs = of_held.join(held, "_pii_row").filter("n_t <= most").groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_et"))
    likely = written(pairs.filter(passes).drop("n_et"), "likely")

    own = written(words.join(likely.select("term").distinct(), "term").groupBy("_pii_row").agg(F.collect_set("term").alias("_own")), "own_terms")
    sought = F.filter(matches(old, TERM), lambda t: F.array_contains(F.col("_own"), F.lower(t["value"])))
    clear = F.filter(sought, lambda t: ~F.exists("_pii", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    # the same plan at every size: texts meet the terms sought in them by row, in a merge join
    placed = rows.select("_pii_row", "_pii", F.col(f"`{text}`")).hint("merge").join(own, "_pii_row").select("_pii_row", F.explode(clear).alias("t"))
    placed = written(placed.select("_pii_row", F.lower("t.value").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end")), "placed")

    n_both = placed.select("_pii_row", "term").distinct().join(held.select("_pii_row", "entity"), "_pii_row")
    n_both = n_both.join(likely, ["entity", "term"]).groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_et"))
    telling = written(n_both.filter(passes).select("term").distinct(), "telling")
    marked = placed.join(telling, "term").groupBy("_pii_row").agg(F.collect_list(F.struct("start", "end")).alias("e"))
    return marked.select("_pii_row", F.array_sort("e").alias("_terms"))


def all_spans() -> Column:
    """_pii and _terms as array<struct<start, k, end>> in order."""
    base = F.transform("_pii", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    terms = F.transform(F.coalesce(F.col("_terms"), F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), 1, 0)), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("k"), s["end"].alias("end")))
    return F.array_sort(F.concat(base, terms))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points of a block, and spans of a run, in rebuilding a text.
BLOCK, RUN = 512, 256


def sanitised(docs: DataFrame, text: str = "text", generalise: bool = True, share: float = DISCLOSURE, least: int = LEAST_DOCS) -> DataFrame:
    """The rows with every span replaced by its kind in brackets; disclosing terms by a class, or by nothing."""
    names, docs = docs.columns, docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])  # no name can clash
    text = f"_in{names.index(text)}"
    rows = found_in(docs, text)
    terms = disclosing(rows, text, share, least)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])
    old = F.col(f"`{text}`")

    def rebuilt(blocks: Column, spans: Column, length: Column) -> Column:
        """Pieces between spans and marks, joined once; time goes with the length of the text and the number of spans."""

        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
            return F.when(b > a, F.substr(near, a - first * BLOCK + 1, b - a)).otherwise(F.lit(""))

        def put(state: Column, s: Column) -> Column:
            here = piece(s["start"], s["end"])
            term = F.when(here.rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]")) if generalise else F.lit("")
            mark = F.when(s["k"] < 4, F.get(marks, s["k"])).otherwise(term)
            # a span that starts inside the last one only lengthens what is left out
            fresh = F.when(s["start"] >= state["at"], F.concat(piece(state["at"], s["start"]), mark)).otherwise(F.lit(""))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.array(fresh)).alias("out"))

        def put_some(state: Column, i: Column) -> Column:
            """A run of spans: a list that grows one by one is copied each time, so it is kept short."""
            begin = F.struct(state["at"].alias("at"), F.array().cast("array<string>").alias("out"))
            some = F.aggregate(F.slice(spans, i * RUN + 1, RUN), begin, put)
            return F.transform(F.array(some), lambda x: F.struct(
                x["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(x["out"], ""))).alias("out")))[0]

        runs = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(runs, begin, put_some, lambda a: F.concat(F.array_join(a["out"], ""), piece(a["at"], length)))

    # blocks and spans are bound to a lambda's variable, so they are made once a text and not once a span
    blocks = F.regexp_extract_all(old, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = F.array(F.struct(blocks.alias("blocks"), all_spans().alias("spans"), F.length(old).alias("length")))
    built = F.transform(whole, lambda x: rebuilt(x["blocks"], x["spans"], x["length"]))[0]
    new = F.when(F.size(all_spans()) == 0, old).otherwise(built)
    return rows.join(terms, "_pii_row", "left").select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]).toDF(*names)


@query("op2_pii")
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = found_in(docs, "text")
    marked = rows.drop("text").join(disclosing(rows, "text"), "_pii_row", "left").withColumn("_all", all_spans())
    number = lambda k: F.size(F.filter("_pii", lambda s: s["k"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return marked.select("doc_id", *counts, F.sha2(listed(F.col("_pii")), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"))
