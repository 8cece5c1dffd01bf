"""Column functions over text: SQL normalising, completion parsing, word statistics, the quality gate, content ids."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Substrings that make an error one of infrastructure (fixed values).
INFRA = ("timeout", "network", "http", "request", "api", "server", "service unavailable", "timed out", "connection refused", "connection timeout", "database connection", "connection pool")
WRITE_PREFIXES = ("INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "REPLACE", "TRUNCATE", "ATTACH", "DETACH", "VACUUM")
OPEN, CLOSE = "<think>", "</think>"


def strip(s: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def collapse_space(s: Column) -> Column:
    return F.regexp_replace(strip(s), r"(?U)\s+", " ")


def normalize_sql(s: Column) -> Column:
    """Trimmed, without trailing semicolons, white space collapsed."""
    return collapse_space(F.regexp_replace(strip(s), r"(?U)[;\s]+$", ""))


def is_select(sql: Column) -> Column:
    return F.lower(F.regexp_replace(sql, r"(?U)^\s+", "")).rlike(r"^(select|with|explain)")


def statement_type(sql: Column) -> Column:
    first = F.upper(F.element_at(F.split(strip(sql), r"(?U)\s+"), 1))
    return F.when(first == "", "UNKNOWN").otherwise(F.coalesce(first, F.lit("UNKNOWN")))


def is_write(sql: Column) -> Column:
    """Whether read-only mode rejects the statement by its first word."""
    return F.upper(strip(sql)).rlike("^(" + "|".join(WRITE_PREFIXES) + ")")


def execution_mode(sql: Column) -> Column:
    return F.when(is_select(sql), "read_only").otherwise("sandbox_rollback")


def extract_sql(completion: Column) -> Column:
    """Text after the last closing tag; null where there is no tag or nothing after it."""
    return F.when(F.contains(completion, F.lit(CLOSE)), F.nullif(strip(F.substring_index(completion, CLOSE, -1)), F.lit("")))


def extract_thought(completion: Column) -> Column:
    """What stands between the first opening tag and the first closing one; null where there is nothing."""
    return F.nullif(strip(F.regexp_extract(completion, r"(?s)<think>(.*?)</think>", 1)), F.lit(""))


def extract_thought_lenient(completion: Column) -> Column:
    """As extract_thought; the opening tag may be missing."""
    head = F.substring_index(completion, CLOSE, 1)
    return F.when(F.contains(completion, F.lit(CLOSE)), F.nullif(strip(F.regexp_replace(head, r"(?s)^.*?<think>", "")), F.lit("")))


def _times(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part)))) / len(part)).cast("long")


def format_gate(completion: Column, least: int = 100) -> Column:
    """Exactly one opening and one closing tag in this order, only white space before, a thought of more than `least` characters and SQL after it."""
    first, last = F.instr(completion, OPEN), F.instr(completion, CLOSE)
    good = (_times(completion, OPEN) == 1) & (_times(completion, CLOSE) == 1) & (first < last)
    before = strip(F.substring(completion, F.lit(1), F.greatest(first - 1, F.lit(0)))) == ""
    return F.coalesce(good & before & (F.length(extract_thought(completion)) > least) & extract_sql(completion).isNotNull(), F.lit(False))


def is_infra(error: Column) -> Column:
    return F.lower(error).rlike("|".join(INFRA))


def error_class(error: Column) -> Column:
    """infrastructure where the message holds one of INFRA, else syntax."""
    return F.when(is_infra(error), "infrastructure").otherwise("syntax")


def error_taxonomy(error: Column, sql: Column) -> Column:
    """The wider taxonomy: a bare `connection` is infrastructure too; missing SQL has a class of its own."""
    return F.when(strip(F.coalesce(sql, F.lit(""))) == "", "empty").when(error.isNull(), "none").when(F.lower(error).rlike("|".join((*INFRA, "connection"))), "infrastructure").otherwise("syntax")


def result_taxonomy(sql: Column, cached: Column, envelope: Column) -> Column:
    """What became of a candidate by its envelope (JSON): empty, no result where the cache has none, bad format where it is none, success, infrastructure or syntax."""
    parsed = F.from_json(envelope, "ok boolean, error string")
    failed = F.when(F.lower(F.coalesce(parsed["error"], F.lit(""))).rlike("|".join((*INFRA, "connection"))), "infrastructure").otherwise("syntax")
    return F.when(strip(F.coalesce(sql, F.lit(""))) == "", "empty").when(~F.coalesce(cached, F.lit(False)), "no result").when(parsed["ok"].isNull(), "bad format").when(parsed["ok"], "success").otherwise(failed)


def infra_tag(error: Column) -> Column:
    """First match of timeout, aborted connection, other infrastructure."""
    e = F.lower(error)
    return F.when(e.rlike("timeout|timed out"), "timeout").when(e.rlike("connection (aborted|refused|reset)"), "connection_aborted").when(is_infra(error), "infrastructure")


def first_line(s: Column, most: int = 120) -> Column:
    return F.substring(F.substring_index(s, "\n", 1), 1, most)


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")


def word_count(s: Column) -> Column:
    return F.size(tokens(s)).cast("long")


def token_counter(vocabulary: str | None = None) -> Callable[[Column], Column]:
    """What counts a text's tokens: by the tokenizer whose JSON file is named, special tokens taken as plain text, or words where none is named. Null has no count (by a tokenizer) or that of words.

    The driver reads the file and sends it with the job, so executors need no copy of it; each Python worker builds the tokenizer once."""
    if vocabulary is None:
        return word_count
    definition, built = Path(vocabulary).read_text(), []

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        if not built:
            from tokenizers import Tokenizer

            built.append(Tokenizer.from_str(definition))
            built[0].encode_special_tokens = True
        held = texts[texts.notna()]
        found = built[0].encode_batch(list(held), add_special_tokens=False)
        return pd.Series([len(x.ids) for x in found], index=held.index, dtype="Int64").reindex(texts.index)

    return counts


def prompt_columns(prompt: Column) -> Column:
    """Distinct lower-cased column names of `table.column :` mentions."""
    return F.array_distinct(F.transform(F.regexp_extract_all(prompt, F.lit(r"\b([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)\s*:"), F.lit(2)), F.lower))


def column_hits(text: Column, columns: Column) -> Column:
    """Whole-word occurrences of all columns in the lower-cased text."""
    low = F.lower(text)
    return F.aggregate(columns, F.lit(0).cast("long"), lambda a, c: a + F.regexp_count(low, F.concat(F.lit(r"(?U)\b"), c, F.lit(r"\b"))))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def bigram_ttr(s: Column) -> Column:
    """Distinct over all bigrams of lower-cased words; 0 without bigrams."""

    def share(t: Column) -> Column:
        n = F.size(t)
        pairs = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), F.slice(t, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(n < 2, F.lit(0.0)).otherwise(F.size(F.array_distinct(pairs)) / (n - 1))

    return _once(tokens(F.lower(s)), share)


def quality_gate(df: DataFrame, text: str, columns: Column, low: int = 30, high: int = 2000, full: int = 50, hits: int = 2, density: float = 0.05, ttr: float = 0.6) -> DataFrame:
    """The frame with `score` and `accepted` of a thought against the schema columns of its prompt. The parts are columns of their own first, so each is computed once."""
    own = df.withColumns({"__c": columns, "__n": word_count(F.col(text)), "__t": bigram_ttr(F.col(text))}).withColumn("__h", column_hits(F.col(text), F.col("__c")))
    dense = F.col("__h") / F.greatest(F.col("__n"), F.lit(1))
    possible = F.col("__n").between(low, high) & (F.size("__c") > 0)
    score = 0.33 * F.when(F.col("__n") < full, 0.0).otherwise(1.0) + 0.33 * F.least(F.lit(1.0), 10 * dense) + 0.34 * F.col("__t")
    accepted = possible & (F.col("__h") >= hits) & (dense >= density) & (F.col("__t") >= ttr)
    return own.withColumns({"score": F.when(possible, score).otherwise(0.0), "accepted": accepted}).drop("__c", "__n", "__t", "__h")


def content_id(dataset: Column, db: Column, text: Column) -> Column:
    """`mem_` and the SHA-1 of the parts, zero bytes between them."""
    return F.concat(F.lit("mem_"), F.sha1(_joined(dataset, db, text).cast("binary")))


def reasoning_id(dataset: Column, db: Column, text: Column) -> Column:
    return F.concat(F.lit("reasoning_"), db, F.lit("_"), F.substring(F.sha1(_joined(dataset, db, text).cast("binary")), 1, 16))


def path_id(sample: Column, model: Column) -> Column:
    """`reasoning_<sample>_<model>`."""
    return F.concat_ws("_", F.lit("reasoning"), sample.cast("string"), model)


def utc_text(ts: Column) -> Column:
    """A moment in ISO 8601 with its zone."""
    return F.date_format(ts.cast("timestamp_ltz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\x00", *(F.coalesce(p, F.lit("")) for p in parts))


def schema_prompt(messages: Column) -> Column:
    """Content of the first user message that holds a database schema."""
    return F.get(F.filter(messages, lambda m: (m["role"] == "user") & F.contains(m["content"], F.lit("Database Schema:"))), 0)["content"]


def join_messages(messages: Column) -> Column:
    return F.array_join(F.filter(F.transform(messages, lambda m: m["content"]), lambda c: strip(F.coalesce(c, F.lit(""))) != ""), "\n\n")


def map_roles(messages: Column) -> Column:
    """assistant becomes model, every other role user; empty content goes."""
    kept = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.transform(kept, lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), m["content"].alias("content")))


def append_answer(messages: Column, response: Column) -> Column:
    return F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), response.alias("content"))))


def truncate_tokens(s: Column, most: int = 8192) -> Column:
    return F.array_join(F.slice(tokens(s), 1, most), " ")


def model_name(name: Column, effort: Column) -> Column:
    return F.when(effort.isin("low", "medium", "high"), F.concat(name, F.lit("--"), effort)).otherwise(name)


def as_number(token: Column) -> Column:
    """The number that a token is, an optional percent sign aside; null where it is none."""
    body = F.regexp_extract(strip(token), r"^[\s\-+]?([0-9]+(?:\.[0-9]+)?)%?$", 1)
    return F.when(body != "", body.cast("double"))


def all_zero(joined: Column) -> Column:
    """Whether a joined result holds numbers and all are 0; other tokens are ignored."""
    numbers = F.filter(F.transform(F.split(joined, ";"), as_number), lambda x: x.isNotNull())
    return (F.size(numbers) > 0) & F.forall(numbers, lambda x: F.abs(x) < 1e-12)


def export_line(sql: Column) -> Column:
    """One line of SQL; an empty one becomes SELECT 1."""
    one = collapse_space(F.coalesce(sql, F.lit("")))
    return F.when(one == "", "SELECT 1").otherwise(one)


#: Separator of exported pairs, and the database of a pair that is missing (fixed values).
PAIR, NO_DB = "\t----- bird -----\t", "financial"


def export_pair(sql: Column, db: Column) -> Column:
    return F.concat(sql, F.lit(PAIR), db)


def parse_pair(value: Column) -> Column:
    """(sql, db) of an exported pair; null becomes (' ', 'financial')."""
    parts = F.split(value, PAIR)
    return F.when(value.isNull(), F.struct(F.lit(" ").alias("sql"), F.lit(NO_DB).alias("db"))).otherwise(F.struct(F.get(parts, 0).alias("sql"), F.get(parts, 1).alias("db")))


def mapped_name(name: Column, names: dict[str, str]) -> Column:
    """Whitelisted renaming; other names stay."""
    if not names:
        return name
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[name], name)
