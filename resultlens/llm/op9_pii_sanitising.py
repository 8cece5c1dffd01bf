"""Operator 9, information-theoretic sanitisation of personal data, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers (fixed patterns below; failing matches are dropped, not retried). Each distinct value is a protected
entity. A term (a word of ``TERM_LETTERS`` letters or more) anywhere in a document of an entity may reveal it. Over all distinct texts (copies of a text are no further evidence),
with n texts, df of each term and entity and c of texts that hold both:

  disclosure = log2(c * n / (df_term * df_entity)), at most about IC = log2(n / df_entity), the whole information of the entity.

A term that has ``LEAST`` co-occurrences or more with an entity and discloses at least ``ALPHA`` of its information is reported as kind term wherever it stands in the documents of that entity, outside of base spans. ``sanitised``
generalises spans to their kind, and removes terms.

Entities that stand in the same documents have the same co-occurrences, and so have terms: each such class is counted once, so a list of thousands of addresses, or copies of it, does not
multiply with the words around it. Every step is linear in a text: patterns begin only where a match can begin, and positions are summed in blocks.

Positions are code points, end exclusive. Null text is empty; no text gives no spans and the hash of the empty string. Repeated rows come out repeated, and count once.
Terms and entities are matched lower-cased by 64-bit hash. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, perhaps_among, settle, table

# fixed values: the base patterns, in possessive form where backtracking could find nothing else. Where a run of characters can't begin a match, no later place in it can: a match
# begins at the start of a run, or where the match before ended
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "term")
TERM_LETTERS, ALPHA, LEAST = 4, 0.8, 2
TERM = rf"\p{{L}}{{{TERM_LETTERS},}}"
SPAN = "array<struct<s:bigint,k:int,e:bigint,v:string>>"


def _blocks(values: Column) -> Column:
    """The array in blocks of about the root of its size. `values` is a variable of a lambda, as it is read by element."""

    def block(size: Column) -> Column:
        last = F.size(values) - 1
        return F.transform(F.sequence(F.lit(0), F.floor(last / size).cast("int")), lambda k: F.transform(F.sequence(k * size, F.least(k * size + size - 1, last)), lambda i: F.get(values, i)))

    return _once(F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1)), block)


def _before(values: Column, add) -> Column:
    """add() over all earlier elements (0 before the first) of an array of long, for each element. It goes by blocks, so that no long array is copied for each element."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def inside(x: Column, base: Column) -> Column:
        begin = F.struct(base.alias("at"), none.alias("out"))
        return F.aggregate(x, begin, lambda so_far, n: F.struct(add(so_far["at"], n).alias("at"), F.concat(so_far["out"], F.array(so_far["at"])).alias("out")))["out"]

    def whole(v: Column) -> Column:
        return _once(_blocks(v), lambda p: _once(inside(F.transform(p, lambda x: F.aggregate(x, zero, add)), zero), lambda bases: F.flatten(F.zip_with(p, bases, inside))))

    return _once(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _matches(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans (s, k, e, v) of the leftmost non-overlapping matches that are valid: what lies between matches tells where they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def spans(x: Column) -> Column:
        starts = _before(F.zip_with(x["gap"], x["v"], lambda g, v: (F.length(g) + F.length(v)).cast("long")), lambda a, n: a + n)
        every = F.transform(F.arrays_zip(x["gap"].alias("gap"), x["v"].alias("v"), starts.alias("at")), lambda m: F.struct(m["at"] + F.length(m["gap"]), m["v"]))
        kept = F.filter(F.transform(every, lambda m: F.struct(m["col1"].alias("s"), F.lit(kind).alias("k"), (m["col1"] + F.length(m["v"])).alias("e"), m["v"].alias("v"))), lambda m: valid(m["v"]))
        return kept.cast(SPAN)

    return _once(F.struct(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))).alias("gap"), found.alias("v")), spans)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise((F.substr(d, i, F.lit(1)).cast("int") * 2) % 10 + F.when(F.substr(d, i, F.lit(1)) >= "5", 1).otherwise(0)),
    )
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind. Texts without an at sign, a plus sign or enough digits skip the pattern."""
    none = F.array().cast(SPAN)
    yes = lambda v: F.lit(True)
    every = F.concat(
        F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL, 0, yes)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), _matches(text, IP, 1, lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))).otherwise(none),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _matches(text, CARD, 2, lambda v: F.when(F.length(_digits(v)).between(14, 19), _luhn(v)).otherwise(False))).otherwise(none),
        F.when(F.contains(text, F.lit("+")), _matches(text, PHONE, 3, lambda v: F.length(_digits(v)).between(10, 15))).otherwise(none),
    )
    return F.sort_array(every)


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, hashed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), _term))


def _entity(span: Column) -> Column:
    value = F.when(span["k"] == 0, F.lower(span["v"])).when(span["k"] == 1, span["v"]).otherwise(_digits(span["v"]))
    return F.xxhash64(span["k"], value)


def _classes(pairs: DataFrame, key: str, name: str) -> DataFrame:
    """row, `name` (class: keys that are in the same rows) and its df, from distinct pairs of row and key."""
    alike = F.xxhash64("row", F.lit(1)), F.xxhash64("row", F.lit(2))
    of = pairs.groupBy(key).agg(F.count(F.lit(1)).alias(f"df_{name}"), *(F.bit_xor(h).alias(f"x{k}") for k, h in enumerate(alike)))
    return settle(of.select(key, f"df_{name}", F.xxhash64(f"df_{name}", "x0", "x1").alias(name)), name)


def disclosures(holders: DataFrame, n: int, df_term: DataFrame, alpha: float, least: int) -> DataFrame:
    """row and t: the terms that disclose an entity of the row. holders: row, entities and terms (distinct, hashed) of the rows with entities; df_term: t and the rows that it is in, of all rows."""
    entities = holders.select("row", F.explode("entities").alias("entity"))
    terms = holders.select("row", F.explode("terms").alias("t"))
    of_entity = _classes(entities, "entity", "e")
    of_term = _classes(terms, "t", "c")
    # c of a term and an entity is at most the entity's df, so a term of more documents than this cannot disclose enough
    n_rows = F.lit(n).cast("double")
    most = F.col("df_e") * F.pow(n_rows / F.col("df_e"), 1 - alpha) * (1 + 1e-9)
    widest = of_entity.where(F.col("df_e") >= least).agg(F.max(most)).first()[0] or 0.0
    known = of_term.where(F.col("df_c") >= least).join(df_term.where(F.col("df_term").between(least, widest)), "t")
    known = settle(known.select("t", "df_c", "df_term", F.xxhash64("c", "df_term").alias("c")), "terms")
    e = join_unique(entities, of_entity, ["entity"], "df_e").where(F.col("df_e") >= least).select("row", "e", "df_e").distinct()
    t = settle(join_unique(terms, known, ["t"], "df_c").select("row", "t", "c", "df_term"), "row_terms")
    pairs = settle(e.join(t.select("row", "c", "df_term").distinct(), "row").where(F.col("df_term") <= most), "pairs")
    told = pairs.groupBy("e", "c", "df_e", "df_term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= least)
    told = told.where(F.log2(F.col("both") * n_rows / (F.col("df_term") * F.col("df_e"))) >= alpha * F.log2(n_rows / F.col("df_e")))
    hits = join_unique(pairs.select("row", "e", "c"), settle(told.select("e", "c", "both"), "told"), ["e", "c"], "both").select("row", "c").distinct()
    return hits.join(t, ["row", "c"]).select("row", "t")


def _text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def found_spans(docs: DataFrame, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """doc_id, base (spans) and every (base and term spans, by start, then kind) for each row."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("tag"), text.alias("text"), _text_key(text).alias("h")).withColumn("base", base_spans(F.col("text")))
    own = F.size("base") > 0
    rows = rows.select("doc_id", "tag", "h", "base", F.monotonically_increasing_id().alias("row"), F.when(own, F.col("text")).alias("text"), F.when(own, F.array_distinct(F.transform("base", _entity))).alias("entities"))
    rows = settle(rows, "spans")
    groups = settle(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1"), "copies")
    again = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).first()
    holders = rows.where("entities IS NOT NULL")
    # of equal texts the first row stands for all
    of = settle(join_unique(holders.select("row", "h"), groups, ["h"], "n", "left").select("row", F.coalesce("first", "row").alias("rep"), F.coalesce("n", F.lit(1)).alias("n")), "representatives")
    texts = holders.join(of.where("row = rep").select("row", "n"), "row")
    counts = docs.select(F.explode(_terms(text)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df_term"))
    if again["groups"]:  # less the further copies
        copied = perhaps_among(docs.select(_text_key(text).alias("h"), text.alias("text")), "h", groups.select("h"), again["groups"]).select("h", _terms(F.col("text")).alias("terms"))
        less = copied.dropDuplicates(["h"]).join(groups, "h").select(F.explode("terms").alias("t"), (1 - F.col("n")).alias("df_term"))
        counts = counts.unionByName(less).groupBy("t").agg(F.sum("df_term").alias("df_term"))
    told = disclosures(settle(texts.select("row", "entities", _terms(F.col("text")).alias("terms")), "holders"), rows.count() - again["rows"], counts, alpha, least)
    hits = told.groupBy("row").agg(F.collect_set("t").alias("told"))  # a text's own terms
    more = _matches(F.col("text"), TERM, 4, lambda v: F.array_contains("told", _term(v)))
    more = F.filter(more, lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    more = settle(texts.join(hits, "row").select(F.col("row").alias("rep"), "n", F.transform(more, lambda t: t.withField("v", F.lit(""))).cast(SPAN).alias("more")), "terms_of_texts")
    found = join_unique(holders.select("row", "doc_id", "tag", "base").join(of.drop("n"), "row"), more, ["rep"], "n", "left")
    every = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return found.select("doc_id", "tag", "base", every.alias("every")).unionByName(rows.where("entities IS NULL").select("doc_id", "tag", "base", F.col("base").alias("every")))


def joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans generalised to their kind in brackets, and terms removed; a span that begins within an earlier one is covered by it."""
    kind = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:4]), F.lit(""))

    def piece(block: Column) -> Column:
        """What stands between the spans of a block, and what stands for them; the block's part of the text is cut out once."""
        first, last = F.get(block, 0)["at"], F.element_at(block, -1)["s"]
        return _once(F.substring(text, first + 1, last - first), lambda own: F.array_join(F.transform(block, lambda x: F.concat(F.substring(own, x["at"] - first + 1, x["s"] - x["at"]), F.element_at(kind, x["k"] + 1))), ""))

    def whole(x: Column) -> Column:
        done = F.transform(F.arrays_zip(x.alias("x"), _before(F.transform(x, lambda y: y["e"]), lambda a, n: F.greatest(a, n)).alias("at")), lambda y: F.struct(y["at"].alias("at"), y["x"]["s"].alias("s"), y["x"]["k"].alias("k")))
        joined = _once(F.filter(done, lambda y: y["s"] >= y["at"]), lambda kept: F.array_join(F.transform(_blocks(kept), piece), ""))
        end = F.array_max(F.transform(x, lambda y: y["e"]))
        return F.concat(joined, F.substring(text, end + 1, F.length(text).cast("long")))

    return _once(spans, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(text))


def sanitise(docs: DataFrame, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """The documents, with all columns, and their sanitised text."""
    spans = found_spans(docs, alpha, least).where(F.size("every") > 0).select(F.col("doc_id").alias("__d"), F.col("tag").alias("__g"), "every").dropDuplicates(["__d", "__g"])
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["doc_id"], text) == F.col("__g")), "left")
    return own.select(*[docs[c] for c in docs.columns], sanitised(text, F.coalesce("every", F.array().cast(SPAN))).alias("sanitised"))


def op9_pii_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = found_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return spans.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"),
        (F.size("every") - F.size("base")).cast("long").alias("n_term"),
    )
