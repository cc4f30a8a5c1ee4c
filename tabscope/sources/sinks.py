"""Writing report datasets as CSV, JSON or Parquet.

Executors write the files in parallel; a dataset is a folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import rules
from ..plans import reports as R
from ..plans.document import Documentation


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, because CSV has no nesting."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """With a header, UTF-8, and only the ``fields`` when they are given."""
    out = df.select(*fields) if fields else df
    _flat(out).write.mode("overwrite").csv(path, header=True, encoding="UTF-8", escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def csv_reports(doc: Documentation) -> dict[str, DataFrame]:
    tables = R.report_tables(doc).withColumnRenamed("description", "llm_description")
    return {"tables": tables, "columns": R.report_columns(doc),
            "profiling": R.report_profiling(doc.profile), "relationships": R.report_relationships(doc),
            "issues": R.report_issues(doc), "pii_report": R.pii_report(doc)}


def json_reports(doc: Documentation, db_name: str | None = None) -> dict[str, DataFrame]:
    """The JSON datasets; the summary says which database it is about and when it was made."""
    summary = R.summary_kpis(doc).select(F.lit(db_name).cast("string").alias("db_name"),
                                         F.current_timestamp().alias("generated_at"), "*")
    return {"schema": R.data_dictionary(doc), "profiling": R.profiling_dataset(doc),
            "erd_nodes": R.erd_nodes(doc), "erd_edges": R.erd_edges(doc.constraints),
            "summary": summary, "summary_items": R.summary_items(doc)}


def export(doc: Documentation, folder: str, formats: tuple[str, ...] = ("csv", "json"),
           db_name: str | None = None) -> None:
    """Write every report dataset below ``folder``."""
    if "csv" in formats:
        for name, df in csv_reports(doc).items():
            write_csv(df, f"{folder}/csv/{name}", rules.CSV_FIELDS[name])
    if "json" in formats:
        for name, df in json_reports(doc, db_name).items():
            write_json(df, f"{folder}/json/{name}")
    if "parquet" in formats:
        for name, df in {**csv_reports(doc), **json_reports(doc, db_name)}.items():
            df.write.mode("overwrite").parquet(f"{folder}/parquet/{name}")
