"""One documentation run: catalog, analysis, key checks and profiles of a set of tables."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions import rules
from ..operators import analyze, integrity, tables as T
from ..sources import catalog as cat
from ..sources.scratch import discard, local_frame, own_folder, together, write_once


class Documentation(NamedTuple):
    columns: DataFrame          # analyzed catalog columns
    tables: DataFrame           # schema, table, comment, table_type, row_count, column_count
    constraints: DataFrame      # declared and inferred
    integrity: DataFrame
    profile: T.Profile | None
    samples: DataFrame | None
    descriptions: DataFrame     # schema, table, column (NULL for the table), description, confidence
    folder: str = ""            # where the frames were written

    def close(self) -> None:
        """Delete what the run wrote; its frames cannot be read any more."""
        discard(self.columns.sparkSession, self.folder)
        if self.profile:
            self.profile.close()


DESCRIPTIONS = "schema string, table string, column string, description string, confidence int"


def analyze_catalog(columns: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, table types, constraints) after all catalog rules, in their fixed order.

    Tables are classified by declared keys before further keys are inferred.
    """
    declared = cat.annotate_keys(columns, constraints)
    types = analyze.classify_tables(declared)
    everything = constraints.unionByName(analyze.infer_foreign_keys(declared, constraints))
    annotated = cat.annotate_keys(columns, everything)
    named = analyze.naming_issues(analyze.lineage_tags(analyze.pii_by_name(annotated)))
    return named.join(types, ["schema", "table"]), types, everything


def document(tables: dict[str, DataFrame], constraints: list[dict], schema: str = "",
             top_n: int = rules.TOP_N, check_keys: bool = True, with_profile: bool = True,
             sample_keys: dict[str, list[str]] | None = None, comments: dict[str, str] | None = None,
             descriptions: DataFrame | None = None) -> Documentation:
    """Everything the reports need, each stage optional.

    ``sample_keys`` names, per table, the columns that order its sample rows.  A table that cannot be read
    does not end the run: it counts -1 rows, its keys are ``error`` records, and all else is complete.
    """
    spark = next(iter(tables.values())).sparkSession

    def of_catalog():
        given = cat.constraint_frame(spark, [{"schema": schema, **c} for c in constraints])
        analyzed, _, everything = analyze_catalog(cat.catalog_columns(tables, schema), given)
        analyzed, everything = write_once(analyzed, "catalog"), write_once(everything, "constraints")
        # one row per foreign key, which the check turns into one grouping each
        keys = [r.asDict() for r in everything.filter("kind = 'fk'").orderBy("inferred", "table", "position").collect()]
        return analyzed, everything, write_once(
            integrity.integrity_report(tables, keys if check_keys else []), "integrity")

    with own_folder(spark) as folder:
        (analyzed, everything, checked), profile = together(
            spark, of_catalog, lambda: T.profile_tables(tables, top_n) if with_profile else None)
    counts = (profile.tables.select("table", "row_count") if profile else cat.safe_row_counts(tables))
    noted = local_frame(spark, [(t, (comments or {}).get(t)) for t in tables], "table string, comment string")
    listed = (analyzed.groupBy("schema", "table").agg(
        F.first("table_type").alias("table_type"), F.count(F.lit(1)).alias("column_count"))
        .join(noted, "table").join(counts, "table", "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(-1).cast("bigint"))))
    samples = None
    if sample_keys:
        from ..operators.cells import union_all
        samples = union_all([cat.sample_json(tables[t], t, k) for t, k in sample_keys.items()])
    told = descriptions if descriptions is not None else local_frame(spark, [], DESCRIPTIONS)
    return Documentation(analyzed, listed, everything, checked, profile, samples, told, folder)
