"""Preparing description prompts and reading the answers, as tables.

Prompts and answers are rows; nothing here calls a model.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules
from ..functions.exprs import confidence_of, description_of, pct_text, text as T, trim

TABLE = ["schema", "table"]
CACHED = ["schema", "fingerprint"]


# ---------------------------------------------------------------- context
def _quoted(values: Column, n: int | None) -> Column:
    return F.array_join(F.transform(values if n is None else F.slice(values, 1, n), lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")


def _fixed(x: Column, digits: int) -> Column:
    """Two-decimal text, halves away from zero."""
    return F.round(x, digits).cast(f"decimal(38,{digits})").cast("string")


def _is_whole(x: Column) -> Column:
    return x == F.floor(x).cast("double")


def column_hints(columns: DataFrame, top_values: DataFrame, few: int | None = None, some: int | None = None) -> DataFrame:
    """Column profiles with ``hints``: ordered phrases that tell what the values look like.

    ``few`` and ``some`` bound the values named for columns of at most 20 and 200 distinct ones;
    all that the profile holds when not given.
    """
    listed = (top_values.groupBy("table", "ord")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("t"))
              .select("table", "ord", F.col("t.value").alias("values")))
    nulls, distinct = F.col("null_pct"), F.col("distinct_count")
    has_values = F.coalesce(F.size("values"), F.lit(0)) > 0
    many = lambda n: _quoted(F.col("values"), n)
    filled = (F.when(nulls == 0, rules.HINT_FULL)
              .when(nulls >= 95, T(rules.HINT_NEVER, pct_text(nulls, 0)))
              .when(nulls >= 50, T(rules.HINT_OFTEN, pct_text(nulls, 0)))
              .when(nulls > 5, T(rules.HINT_NULL, pct_text(nulls, 0))))
    kinds = (F.when(F.col("is_constant") & has_values, T(rules.HINT_CONSTANT, F.col("values")[0]))
             .when(F.col("is_unique"), rules.HINT_UNIQUE)
             .when(distinct <= 1, F.lit(None))
             .when((distinct <= 20) & has_values, T(rules.HINT_FEW, distinct, many(few)))
             .when((distinct <= 200) & has_values, T(rules.HINT_SOME, distinct, many(some)))
             .otherwise(T(rules.HINT_MANY, F.format_number(distinct, 0), pct_text(F.col("distinct_pct"), 0))))
    lo, hi = F.col("min_val"), F.col("max_val")
    as_int = lambda x: x.cast("decimal(38,0)")
    between = F.when(_is_whole(lo) & _is_whole(hi), T(rules.HINT_RANGE, as_int(lo), as_int(hi))) \
        .otherwise(T(rules.HINT_RANGE, _fixed(lo, 2), _fixed(hi, 2)))
    shortest, longest = F.col("min_length"), F.col("max_length")
    size = F.when(longest > 0, F.when(
        (shortest == longest) & shortest.isin(2, 3, 4), T(rules.HINT_FIXED, shortest))
        .when(longest <= 5, T(rules.HINT_SHORT, shortest, longest)))
    phrases = [filled, kinds, between, T(rules.HINT_DATES, "min_date", "max_date"), size,
               T(rules.HINT_PATTERN, "detected_pattern"), T(rules.HINT_PII, "pii_detected")]
    return (columns.join(listed, ["table", "ord"], "left")
            .withColumn("hints", F.array_compact(F.array(*phrases)))
            .drop("values"))


def column_context(catalog: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``catalog`` with ``line``: name, type, keys, hints, personal data, tags and comment.

    ``catalog`` holds analyzed columns; ``hints`` is the result of :func:`column_hints`.
    """
    if hints is not None:
        catalog = catalog.join(hints.select("table", "column", "hints"), ["table", "column"], "left")
    else:
        catalog = catalog.withColumn("hints", F.array().cast("array<string>"))
    flags = F.array_compact(F.array(
        F.when(F.col("is_primary_key"), "PK"),
        F.when(F.col("is_foreign_key"), F.concat(F.lit("FK→"), "foreign_key_to")),
        F.when(~F.col("nullable"), "required")))
    parts = F.array_compact(F.array(
        T(rules.LINE_COLUMN, "column", "type"),
        F.when(F.size(flags) > 0, T(rules.LINE_KEYS, F.array_join(flags, ", "))),
        F.when(F.size("hints") > 0, T(rules.LINE_HINTS, F.array_join("hints", " | "))),
        T(rules.LINE_PII, F.nullif("pii_type", F.lit(""))),
        F.when(F.size("lineage_tags") > 0, T(rules.LINE_TAGS, F.array_join("lineage_tags", ","))),
        T(rules.LINE_COMMENT, F.nullif("comment", F.lit("")))))
    return catalog.withColumn("line", F.array_join(parts, " "))


def table_context(catalog: DataFrame, overview: DataFrame, issues: DataFrame | None = None,
                  max_columns: int | None = None, max_issues: int | None = None) -> DataFrame:
    """(schema, table, context): what is known about a table, ending with its columns.

    ``overview`` has (table, row_count, table_type) and, for profiled tables, null_pct and
    duplicate_pct.  All columns and issues are named unless a limit is given.
    """
    shown = F.concat("column", F.lit("("), "type", F.lit(")"), F.when(F.col("is_primary_key"), " PK").otherwise(""))
    listed = catalog if max_columns is None else catalog.filter(F.col("ordinal") <= max_columns)
    preview = (listed.groupBy(*TABLE)
               .agg(F.array_sort(F.collect_list(F.struct("ordinal", shown.alias("text")))).alias("c"))
               .select(*TABLE, F.array_join("c.text", ", ").alias("preview")))
    joined = preview.join(overview, "table", "left")
    if issues is not None:
        numbered = issues.withColumn("nr", F.row_number().over(W.partitionBy("table").orderBy("ord", "rule")))
        first = ((numbered if max_issues is None else numbered.filter(F.col("nr") <= max_issues)).groupBy("table")
                 .agg(F.array_sort(F.collect_list(F.struct("nr", "issue"))).alias("i"))
                 .select("table", F.array_join("i.issue", "; ").alias("first_issues")))
        joined = joined.join(first, "table", "left")
    else:
        joined = joined.withColumn("first_issues", F.lit(None).cast("string"))
    share = lambda c: pct_text(F.col(c), 1)
    lines = F.array_compact(F.array(
        T(rules.CONTEXT_ROWS, F.format_number(F.coalesce("row_count", F.lit(0)), 0)),
        F.when(F.col("table_type") != "unknown", T(rules.CONTEXT_CLASS, "table_type")),
        F.when(F.col("null_pct") > 0, T(rules.CONTEXT_NULLS, share("null_pct"))),
        F.when(F.col("duplicate_pct") > 1, T(rules.CONTEXT_DUPLICATES, share("duplicate_pct"))),
        T(rules.CONTEXT_ISSUES, "first_issues"), T(rules.CONTEXT_COLUMNS, "preview")))
    return joined.select(*TABLE, F.array_join(lines, "\n").alias("context"))


TABLE_REQUEST = ("Describe in at most four sentences what this table holds and what it is for. "
                 "End with a line that holds only your confidence from 0 to 100, as in [72].")
COLUMN_REQUEST = ("Describe each column in one sentence. Answer with one JSON object from column name "
                  "to text, each text ending with your confidence from 0 to 100, as in [85].")


def prompt_batches(context: DataFrame, lines: DataFrame, pending: DataFrame | None = None,
                   table_request: str = TABLE_REQUEST, column_request: str = COLUMN_REQUEST,
                   budget: int = 4096) -> DataFrame:
    """(schema, table, target, columns, max_tokens, prompt): one row per table, and for its
    columns left to describe as many rows as their answers need.

    ``pending`` restricts the columns (see :func:`pending_columns`).  An answer takes 150 tokens a
    column and 500 more; the columns of a table, in order, are split into prompts within ``budget``.
    """
    per_prompt = max(1, (budget - 500) // 150)
    head = F.concat(F.lit("Table: "), "table", F.lit("\n"))
    per_table = context.select(
        *TABLE, F.lit("table").alias("target"), F.lit(0).cast("bigint").alias("columns"),
        F.lit(400).cast("bigint").alias("max_tokens"),
        F.concat(head, "context", F.lit("\n\n" + table_request)).alias("prompt"))
    if pending is not None:
        lines = lines.join(pending.select(*TABLE, "column"), [*TABLE, "column"], "left_semi")
    place = F.row_number().over(W.partitionBy(*TABLE).orderBy("ordinal")) - 1
    batch = (lines.withColumn("part", F.call_function("div", place, F.lit(per_prompt))).groupBy(*TABLE, "part").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "line", "column"))).alias("c")))
    n = F.size("c").cast("bigint")
    per_batch = batch.select(
        *TABLE, F.lit("columns").alias("target"), n.alias("columns"),
        (n * 150 + 500).cast("bigint").alias("max_tokens"),
        F.concat(head, F.lit("Columns:\n"), F.array_join("c.line", "\n"), F.lit("\n\n" + column_request + "\nNames: "),
                 F.array_join("c.column", ", ")).alias("prompt"))
    return per_table.unionByName(per_batch)


ONE_COLUMN_REQUEST = ("Describe this column in exactly one sentence and end with your confidence from 0 to 100, "
                      "as in [85].")


def single_prompts(missing: DataFrame, hints: DataFrame | None = None,
                   request: str = ONE_COLUMN_REQUEST, max_hints: int | None = None) -> DataFrame:
    """(schema, table, column, max_tokens, prompt): one row per column still without an answer.

    The hints of the column go with it, all of them unless a limit is given.
    """
    if hints is not None:
        missing = missing.join(hints.select("table", "column", "hints"), ["table", "column"], "left")
    else:
        missing = missing.withColumn("hints", F.array().cast("array<string>"))
    known = F.when(F.size("hints") > 0, T("Known: {}\n", F.array_join("hints" if max_hints is None else F.slice("hints", 1, max_hints), " | "))).otherwise("")
    return missing.select(*TABLE, "column", F.lit(120).cast("bigint").alias("max_tokens"),
                          T("Table: {}\nColumn: {} [{}]\n{}{}", "table", "column", "type", known, F.lit(request))
                          .alias("prompt"))


# ---------------------------------------------------------------- resuming
def fingerprints(columns: DataFrame, enriched: bool = False) -> DataFrame:
    """(schema, table, fingerprint): 16 hex digits over the table and its sorted column names."""
    mode = "enriched:" if enriched else "basic:"
    return (columns.groupBy(*TABLE).agg(F.array_sort(F.collect_list("column")).alias("c"))
            .select(*TABLE, F.substring(F.sha2(
                T(rules.FINGERPRINT, F.lit(mode), "table", F.array_join("c", ",")).cast("binary"), 256),
                1, rules.FINGERPRINT_HEX).alias("fingerprint")))


def pending_columns(columns: DataFrame, cache: DataFrame, enriched: bool = False) -> DataFrame:
    """Columns without a description under the current fingerprint of their table.

    ``cache`` holds (schema, fingerprint, column, text); a table whose columns changed has a new
    fingerprint and is described anew.  Tables of the same name in other schemas have answers of their own.
    """
    current = columns.join(fingerprints(columns, enriched), TABLE)
    done = cache.filter("column IS NOT NULL").select(*CACHED, "column").distinct()
    return current.join(done, [*CACHED, "column"], "left_anti")


def pending_tables(columns: DataFrame, cache: DataFrame, enriched: bool = False) -> DataFrame:
    """Tables without a non-empty description of their own; empty answers are asked for again."""
    done = cache.filter("column IS NULL AND text <> ''").select(*CACHED).distinct()
    return fingerprints(columns, enriched).join(done, CACHED, "left_anti")


# ---------------------------------------------------------------- answers
_ENTRIES = "array<map<string,variant>>"
_STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}


def _parsed(text: Column) -> Column:
    """Entries of a JSON object as (key, kind, value); NULL when the text is not just one object.

    The brackets around the text make the parser reject anything after the object.
    """
    root = F.from_json(F.concat(F.lit("["), text, F.lit("]")), _ENTRIES, _STRICT)
    entry = F.when(F.size(root) == 1, F.map_entries(root[0]))
    return F.transform(entry, lambda e: F.struct(
        e.key.alias("key"),
        F.regexp_extract(F.schema_of_variant(e.value), "^[A-Z]+", 0).alias("kind"),
        F.try_variant_get(e.value, "$", "string").alias("value")))


def _pairs(text: Column) -> Column:
    """Whatever ``"key": "text"`` pairs can be read in broken JSON."""
    found = [F.regexp_extract_all(text, F.lit(rules.JSON_PAIR), F.lit(i)) for i in (1, 2)]
    return F.zip_with(*found, lambda k, v: F.struct(
        k.alias("key"), F.lit("STRING").alias("kind"), v.alias("value")))


def _without_fences(text: Column) -> Column:
    bare = trim(text)
    inside = trim(F.regexp_replace(trim(F.regexp_replace(bare, rules.FENCE_OPEN, "")), rules.FENCE_CLOSE, ""))
    return F.when(bare.contains(rules.FENCE), inside).otherwise(bare)


def extract_entries(responses: DataFrame, text: str = "response") -> DataFrame:
    """``responses`` with ``entries``: what could be read of a JSON object in the text.

    Tried in turn: the text without code fences; its outermost braces; these without
    trailing commas; the pairs that can be found one by one.  Each text is parsed whole.
    """
    step = responses.withColumn("_bare", _without_fences(F.col(text)))
    step = step.withColumn("_block", F.nullif(F.regexp_extract("_bare", rules.JSON_BLOCK, 0), F.lit("")))
    return (step.withColumn("entries", F.coalesce(
        _parsed(F.col("_bare")), _parsed(F.col("_block")),
        _parsed(F.regexp_replace("_block", rules.TRAILING_COMMA, "$1")), _pairs(F.col("_block"))))
        .drop("_bare", "_block"))


def parse_responses(responses: DataFrame, columns: DataFrame, text: str = "response") -> DataFrame:
    """(schema, table, column, raw, description, confidence) from answers about many columns.

    ``responses`` has (schema, table, response).  Keys are matched to the real columns
    without regard to case and unknown ones are dropped; of a repeated key the last counts.
    A nested answer is flattened to ``text [confidence]``.
    """
    # the outer form keeps Spark from testing the array in a filter, which would parse twice
    entries = (extract_entries(responses, text)
               .select(*TABLE, F.posexplode_outer("entries").alias("at", "e"))
               .filter("e.kind IN ('STRING', 'OBJECT')"))
    pick = lambda a, b: F.coalesce(F.get_json_object("e.value", a), F.get_json_object("e.value", b), F.lit(""))
    said, sure = pick("$.description", "$.d"), pick("$.confidence", "$.c")
    raw = F.when(F.col("e.kind") == "STRING", F.col("e.value")).otherwise(
        F.when(sure.isin("", "0", "false"), said).otherwise(T("{} [{}]", said, sure)))
    known = (columns.groupBy(*TABLE, F.lower("column").alias("low"))
             .agg(F.max_by("column", "ordinal").alias("column")))
    answers = (entries.select(*TABLE, "at", F.lower("e.key").alias("low"), raw.alias("raw"))
               .groupBy(*TABLE, "low").agg(F.max_by("raw", "at").alias("raw")))
    return (answers.join(known, [*TABLE, "low"])
            .select(*TABLE, "column", "raw", description_of(F.col("raw")).alias("description"),
                    confidence_of(F.col("raw")).alias("confidence")))


def missing_descriptions(columns: DataFrame, answers: DataFrame,
                         per_table: int | None = None) -> DataFrame:
    """Columns without an answer; with ``per_table`` the first so many of each table in column order."""
    open_columns = columns.join(answers.select(*TABLE, "column"), [*TABLE, "column"], "left_anti")
    if per_table is None:
        return open_columns
    order = W.partitionBy(*TABLE).orderBy("ordinal")
    return (open_columns.withColumn("nr", F.row_number().over(order))
            .filter(F.col("nr") <= per_table).drop("nr"))


# ---------------------------------------------------------------- cache
def extend_cache(cache: DataFrame, columns: DataFrame, answers: DataFrame, enriched: bool = False) -> DataFrame:
    """``cache`` with new answers under the current fingerprints; a new answer replaces an old one.

    ``answers`` holds (schema, table, column, raw), with a NULL column for the table itself.
    Empty answers are not kept, so that they are asked for again; of equally old answers the last in
    order of their text counts.
    """
    new = (answers.filter("raw <> ''").join(fingerprints(columns, enriched), TABLE)
           .select(*CACHED, "column", F.col("raw").alias("text"), F.lit(1).alias("age")))
    old = cache.select(*CACHED, "column", "text", F.lit(0).alias("age"))
    return (old.unionByName(new).groupBy(*CACHED, "column").agg(F.max(F.struct("age", "text")).alias("last"))
            .select(*CACHED, "column", F.col("last.text").alias("text")))


def cached_descriptions(columns: DataFrame, cache: DataFrame, enriched: bool = False) -> DataFrame:
    """(schema, table, column, description, confidence) of what the cache knows of these columns,
    in the form the reports take."""
    current = fingerprints(columns, enriched).join(cache.filter("text <> ''"), CACHED)
    return current.select(*TABLE, "column", description_of(F.col("text")).alias("description"),
                          confidence_of(F.col("text")).alias("confidence"))
