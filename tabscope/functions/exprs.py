"""Column expressions shared by the operators; all of them stay inside the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import rules


def col(name: str) -> Column:
    """Reference a column whose name may contain dots or other special characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def first_match(value: Column, patterns) -> Column:
    """Label of the first pattern found in ``value``; NULL when none is."""
    return F.coalesce(*[F.when(value.rlike(p), F.lit(label)) for label, p in patterns])


# ------------------------------------------------------------------ percentages
def _scaled(n: Column, total: Column, digits: int) -> Column:
    """``round(10^digits * 100 * n / total)`` in integers, halves up; NULL for no rows."""
    scale = 2 * 100 * 10 ** digits
    wide = n.cast("decimal(25,0)") * F.lit(scale).cast("decimal(9,0)") + total.cast("decimal(25,0)")
    return F.call_function("div", wide, F.nullif(total * 2, F.lit(0)).cast("decimal(26,0)"))


def pct(n: Column, total: Column, digits: int = 2) -> Column:
    """Percentage of ``n`` in ``total``, rounded half-up exactly; 0 when ``total`` is 0.

    The arithmetic is integral so that the result does not depend on how a double
    happens to represent the ratio (deviation V7: exact halves go up).
    """
    return F.coalesce(_scaled(n, total, digits).cast("double") / (10 ** digits), F.lit(0.0))


def hundredths(pct_value: Column) -> Column:
    """A percentage with two decimals as an exact number of hundredths."""
    return F.round(pct_value * 100).cast("bigint")


def pct_text(pct_value: Column, digits: int) -> Column:
    """Percentage with ``digits`` (0 or 1) decimals as text, without the sign."""
    if digits == 0:
        return F.call_function("div", hundredths(pct_value) + 50, F.lit(100)).cast("string")
    tenths = F.call_function("div", hundredths(pct_value) + 5, F.lit(10))
    return F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"))


def stat(x: Column) -> Column:
    """Statistic rounded to 6 decimals; NULL for NaN and infinities."""
    finite = (~F.isnan(x)) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, F.round(x, 6))


def share_reaches(hits: Column, total: Column, percent: int) -> Column:
    """``hits / total >= percent%`` in integers."""
    return hits * 100 >= total * percent


def timestamp_text(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` with six digits of fraction when there is one."""
    text = ts.cast("timestamp_ntz").cast("string")
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)


def month_of(ts: Column) -> Column:
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 7)


def double_text(x: Column) -> Column:
    """A double as text, positional between 1e-4 and 1e16 (``10000000.0``, not ``1.0E7``)."""
    plain = x.cast("string")
    shifted = F.regexp_replace(plain.cast("decimal(38,21)").cast("string"), r"0+\z", "")
    shifted = F.when(shifted.endswith("."), F.concat(shifted, F.lit("0"))).otherwise(shifted)
    return F.when(plain.contains("E") & (F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), shifted).otherwise(plain)


def two_digits(x: Column) -> Column:
    """A double with two significant digits: ``0.05``, ``12``, ``1.5e+03``."""
    science = F.format_string("%.1e", x)
    power = F.substring_index(science, "e", -1).cast("int")
    bare = lambda t: F.regexp_replace(t, r"\.?0+\z", "")
    plain = bare(science.cast("decimal(38,10)").cast("string"))
    return (F.when(x == 0, "0").when(power.between(-4, 1), plain)
            .otherwise(F.concat(F.regexp_replace(F.substring_index(science, "e", 1), r"\.0\z", ""), F.lit("e"),
                                F.substring_index(science, "e", -1))))


# ------------------------------------------------------------------ catalog names
def pii_from_name(name: Column) -> Column:
    return first_match(F.lower(name), rules.PII_NAME_PATTERNS)


def lineage_tags(name: Column) -> Column:
    """Tags of all matching rules in rule order, each once."""
    parts = [F.when(name.rlike("(?i)" + p), F.array(*[F.lit(t) for t in tags]))
             .otherwise(F.array().cast("array<string>")) for p, tags in rules.LINEAGE_RULES]
    return F.array_distinct(F.flatten(F.array(*parts)))


def naming_style(name: Column) -> Column:
    return first_match(name, [(s, rf"\A(?:{p})\z") for s, p in rules.NAMING_STYLES])


def _contains_any(name: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(w) for w in words])


def table_class(name: Column, n_columns: Column, n_fk_columns: Column) -> Column:
    """Class of a table from its name and key counts; the first rule that holds decides."""
    low = F.lower(name)
    lookup_prefix = reduce(lambda a, b: a | b,
                           [low.startswith(h.rstrip("_")) for h in rules.LOOKUP_HINTS])
    return (
        F.when((n_fk_columns >= 2) & (n_columns <= 5), "junction")
        .when(_contains_any(low, rules.JUNCTION_HINTS), "junction")
        .when(_contains_any(low, rules.AUDIT_HINTS), "audit")
        .when(_contains_any(low, rules.LOOKUP_HINTS) | lookup_prefix, "lookup")
        .when(_contains_any(low, rules.DIMENSION_HINTS), "dimension")
        .when(_contains_any(low, rules.FACT_HINTS), "fact")
        .when(n_fk_columns >= 3, "fact")
        .when((n_columns <= 4) & (n_fk_columns == 0), "lookup")
        .otherwise("unknown")
    )


def reference_prefix(name: Column) -> Column:
    """``customer`` from ``customer_id`` or ``customerid``; NULL when the name has no such form."""
    low = F.lower(name)
    return F.nullif(
        F.when(low.endswith("_id"), F.regexp_replace(low, r"_id\z", ""))
        .when(low.endswith("id") & (F.length(low) > 2), F.regexp_replace(low, r"id\z", "")),
        F.lit(""))


def name_variants(word: Column) -> Column:
    """Table names a column prefix may stand for, best first.

    Order: as written, singular, plural by ``s``, plural by ``ies`` (deviation V5).
    """
    singular = (
        F.when(word.endswith("ies"), F.regexp_replace(word, r"ies\z", "y"))
        .when(word.rlike(r"[sxz]es\z"), F.regexp_replace(word, r"es\z", ""))
        .when(word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, r"s\z", "")))
    by_ies = F.when(word.endswith("y"), F.regexp_replace(word, r"y\z", "ies"))
    return F.array_distinct(F.array_compact(F.array(word, singular, F.concat(word, F.lit("s")), by_ies)))


def matches_filter(name: Column, table_filter: str | None) -> Column:
    """Comma-separated regular expressions; true when any matches the whole name."""
    patterns = [p.strip() for p in (table_filter or "").split(",") if p.strip()]
    if not table_filter:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [name.rlike(rf"(?i)\A(?:{p})\z") for p in patterns], F.lit(False))


# ------------------------------------------------------------------ descriptions
def trim(text: Column) -> Column:
    """Without white space at either end, of any script."""
    return F.btrim(text, F.lit(rules.WHITE_SPACE))


def _in_brackets(trimmed: Column) -> Column:
    return trimmed.endswith("]") & trimmed.rlike(rules.CONFIDENCE_AT_END)


def confidence_of(text: Column) -> Column:
    """Confidence 0-100 from a trailing ``[NN]`` or a ``confidence: NN`` phrase; else NULL."""
    t = trim(text)
    number = (F.when(_in_brackets(t), F.regexp_extract(t, rules.CONFIDENCE_AT_END, 2))
              .when(t.rlike(rules.CONFIDENCE_PHRASE), F.regexp_extract(t, rules.CONFIDENCE_PHRASE, 1)))
    return F.when(number.isNotNull(), F.least(number.cast("int"), F.lit(100)))


def description_of(text: Column) -> Column:
    """The text without its confidence mark; empty for NULL."""
    t = trim(F.coalesce(text, F.lit("")))
    return (F.when(_in_brackets(t), trim(F.regexp_extract(t, rules.CONFIDENCE_AT_END, 1)))
            .when(t.rlike(rules.CONFIDENCE_PHRASE), trim(F.regexp_replace(t, rules.CONFIDENCE_REMOVED, "")))
            .otherwise(t))


def text(template: str, *values) -> Column:
    """``template`` with its ``{}`` replaced by columns; NULL when one of them is NULL."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        value = F.col(value) if isinstance(value, str) else value
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)
