"""Catalog analysis: rules over the names and keys of columns and tables.

One row per column comes in, keyed by ``schema`` and ``table``; a lake with millions of
columns runs through the same joins and groupings as a small database.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as E, rules

TABLE = ["schema", "table"]


def classify_tables(annotated: DataFrame) -> DataFrame:
    """(schema, table, table_type) from the declared keys; inferred ones do not count."""
    return (annotated.groupBy(*TABLE)
            .agg(F.count(F.lit(1)).alias("n_columns"), F.count_if("is_foreign_key").alias("n_fks"))
            .select(*TABLE, E.table_class(F.col("table"), F.col("n_columns"), F.col("n_fks"))
                    .alias("table_type")))


def infer_foreign_keys(annotated: DataFrame, constraints: DataFrame) -> DataFrame:
    """Foreign keys implied by column names, as constraint rows with ``inferred`` set.

    Only for tables that declare none.  ``customer_id`` refers to a table named like
    ``customer`` in singular or plural; of several the closest name wins (deviation V5).
    """
    declared = constraints.filter("kind = 'fk'").select(*TABLE).distinct()
    wanted = (annotated.filter("NOT is_primary_key AND NOT is_foreign_key")
              .join(declared, TABLE, "left_anti")
              .withColumn("prefix", E.reference_prefix(F.col("column"))).filter("prefix IS NOT NULL")
              .select(*TABLE, "column", "ordinal",
                      F.posexplode(E.name_variants(F.col("prefix"))).alias("choice", "name")))
    first_key = (constraints.filter("kind = 'pk'").groupBy(*TABLE)
                 .agg(F.min_by(F.col("columns")[0], "position").alias("key")))
    targets = (annotated.select(*TABLE).distinct().join(first_key, TABLE, "left")
               .groupBy("schema", F.lower("table").alias("name"))
               .agg(F.max("table").alias("ref_table"), F.max_by("key", "table").alias("key")))
    found = (wanted.join(targets, ["schema", "name"]).filter("ref_table <> table")
             .groupBy(*TABLE, "column", "ordinal")
             .agg(F.min_by(F.struct("ref_table", "key"), "choice").alias("best")))
    return found.select(
        *TABLE, F.lit("fk").alias("kind"), E.text(rules.INFERRED_NAME, "table", "column").alias("name"),
        F.col("ordinal").alias("position"), F.array("column").alias("columns"),
        F.col("best.ref_table").alias("ref_table"),
        F.array(F.coalesce("best.key", F.lit("id"))).alias("ref_columns"), F.lit(True).alias("inferred"))


def pii_by_name(columns: DataFrame, known: str | None = None) -> DataFrame:
    """``columns`` with pii_type by name; a type already in column ``known`` is kept."""
    rule = E.pii_from_name(F.col("column"))
    return columns.withColumn("pii_type", F.coalesce(F.nullif(F.col(known), F.lit("")), rule) if known else rule)


def lineage_tags(columns: DataFrame) -> DataFrame:
    return columns.withColumn("lineage_tags", E.lineage_tags(F.col("column")))


def naming_issues(columns: DataFrame) -> DataFrame:
    """``columns`` with naming_style and naming_issue.

    The dominant style of a table is the most frequent one, of equals the one seen first.
    """
    styled = columns.withColumn("naming_style", E.naming_style(F.col("column")))
    dominant = (styled.filter("naming_style IS NOT NULL").groupBy(*TABLE, "naming_style")
                .agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
                .groupBy(*TABLE).agg(F.max_by("naming_style", F.struct("n", -F.col("first"))).alias("dominant")))
    issue = (F.when(F.col("dominant").isNull(), F.lit(None))
             .when(F.col("naming_style").isNull(), rules.NAMING_NO_STYLE)
             .when(F.col("naming_style") != F.col("dominant"),
                   E.text(rules.NAMING_OTHER_STYLE, "dominant", "naming_style")))
    return styled.join(dominant, TABLE, "left").withColumn("naming_issue", issue).drop("dominant")
