"""Tables, their columns and their declared keys, as DataFrames.

Parquet and plain DataFrames carry no keys, so constraints are an input: dictionaries
with ``table``, ``kind`` (``pk``, ``unique`` or ``fk``), ``name``, ``columns`` and, for
foreign keys, ``ref_table`` and ``ref_columns``; ``schema`` is optional everywhere and
empty when there is only one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import rules
from ..functions.exprs import col, matches_filter
from ..operators import cells as C
from .scratch import local_frame

CONSTRAINTS = ("schema string, table string, kind string, name string, position int, "
               "columns array<string>, ref_table string, ref_columns array<string>, inferred boolean")
COLUMNS = ("schema string, table string, ordinal int, column string, type string, kind string, "
           "nullable boolean, default string, comment string")
TABLE = ["schema", "table"]


# ---------------------------------------------------------------- reading tables
def list_tables(spark: SparkSession, database: str | None = None,
                table_filter: str | None = None) -> DataFrame:
    """(table, comment) of one schema of the Spark catalog, filtered by name."""
    rows = [(t.name, t.description) for t in spark.catalog.listTables(database)]
    return filter_tables(local_frame(spark, rows, "table string, comment string"), table_filter)


def table_comments(spark: SparkSession, database: str | None = None, table_filter: str | None = None) -> dict[str, str]:
    """The comments of the tables that have one, as a documentation run takes them."""
    listed = list_tables(spark, database, table_filter).filter("comment IS NOT NULL")
    return {r["table"]: r["comment"] for r in listed.toLocalIterator()}


def filter_tables(tables: DataFrame, table_filter: str | None) -> DataFrame:
    """Keep the rows whose ``table`` matches any of the comma-separated patterns in full."""
    return tables.filter(matches_filter(F.col("table"), table_filter))


def open_tables(spark: SparkSession, database: str | None = None, table_filter: str | None = None
                ) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a schema by name, and (table, error) of those that do not open."""
    opened, failed = {}, []
    for row in list_tables(spark, database, table_filter).orderBy("table").toLocalIterator():
        try:
            opened[row["table"]] = spark.table(f"`{database}`.`{row['table']}`" if database else f"`{row['table']}`")
        except Exception as error:
            failed.append((row["table"], str(error)))
    return opened, local_frame(spark, failed, "table string, error string")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A database table; with ``key`` and ``bounds`` it is read in parallel key ranges.

    Any database with a JDBC driver on the class path will do (PostgreSQL, MySQL, SQL
    Server, Oracle, SQLite).
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1],
                                numPartitions=partitions)
    return reader.load()


def jdbc_constraints(spark: SparkSession, url: str, schema: str, **options: str) -> DataFrame:
    """Keys of a database schema from its ``information_schema``, as a constraint frame."""
    def view(name):
        return spark.read.format("jdbc").options(url=url, dbtable=f"information_schema.{name}", **options).load()

    kinds = (F.when(F.col("constraint_type") == "PRIMARY KEY", "pk")
             .when(F.col("constraint_type") == "FOREIGN KEY", "fk")
             .when(F.col("constraint_type") == "UNIQUE", "unique"))
    declared = (view("table_constraints").filter(F.col("table_schema") == schema)
                .select("constraint_name", "table_name", kinds.alias("kind")).filter("kind IS NOT NULL"))
    used = (view("key_column_usage").filter(F.col("table_schema") == schema)
            .groupBy("constraint_name", "table_name")
            .agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("c"))
            .select("constraint_name", "table_name", F.col("c.column_name").alias("columns")))
    targets = (view("referential_constraints").filter(F.col("constraint_schema") == schema)
               .select("constraint_name", F.col("unique_constraint_name").alias("target")))
    referred = used.select(F.col("constraint_name").alias("target"), F.col("table_name").alias("ref_table"),
                           F.col("columns").alias("ref_columns"))
    return (declared.join(used, ["constraint_name", "table_name"])
            .join(targets, "constraint_name", "left").join(referred, "target", "left")
            .select(F.lit(schema).alias("schema"), F.col("table_name").alias("table"), "kind",
                    F.col("constraint_name").alias("name"),
                    F.row_number().over(W.partitionBy("table_name").orderBy("constraint_name"))
                    .alias("position"), "columns",
                    "ref_table", "ref_columns", F.lit(False).alias("inferred")))


# ---------------------------------------------------------------- catalog frames
def catalog_columns(tables: dict[str, DataFrame], schema: str = "") -> DataFrame:
    """One row per column, from the schemas; nothing is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for t, df in sorted(tables.items()):
        for i, f in enumerate(df.schema.fields, 1):
            meta = f.metadata or {}
            rows.append((schema, t, i, f.name, f.dataType.simpleString().upper(), C.kind_of(f.dataType),
                         f.nullable, meta.get("CURRENT_DEFAULT"), meta.get("comment")))
    return local_frame(spark, rows, COLUMNS)


def constraint_frame(spark: SparkSession, constraints: list[dict]) -> DataFrame:
    rows = [(c.get("schema", ""), c["table"], c["kind"], c.get("name"), i, c["columns"],
             c.get("ref_table"), c.get("ref_columns"), c.get("inferred", False))
            for i, c in enumerate(constraints, 1)]
    return local_frame(spark, rows, CONSTRAINTS)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row_count) of every table; Parquet answers from its footers."""
    return C.union_all([df.agg(F.count(F.lit(1)).alias("row_count"))
                        .select(F.lit(t).alias("table"), "row_count") for t, df in tables.items()])


def safe_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """As :func:`row_counts`, with -1 and the error for a table that cannot be counted."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for t, df in tables.items():
        try:
            rows.append((t, df.count(), None))
        except Exception as error:
            rows.append((t, -1, str(error)))
    return local_frame(spark, rows, "table string, row_count bigint, error string")


def sample_rows(df: DataFrame, order_by: list[str], n: int = rules.SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows by a key; without one the choice would change from run to run."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def sample_json(df: DataFrame, table: str, order_by: list[str], n: int = rules.SAMPLE_ROWS) -> DataFrame:
    """(table, position, row) with each sample row as JSON text, NULLs kept."""
    heads = sample_rows(df, order_by, n)
    packed = F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    keys = F.struct(*[col(c) for c in order_by])
    return (heads.agg(F.array_sort(F.collect_list(F.struct(keys.alias("k"), packed.alias("row")))).alias("r"))
            .select(F.lit(table).alias("table"), F.posexplode("r.row").alias("position", "row")))


# ---------------------------------------------------------------- keys
def _keyed(constraints: DataFrame, kinds: list[str]) -> DataFrame:
    return (constraints.filter(F.col("kind").isin(kinds))
            .select(*TABLE, F.explode("columns").alias("column")).distinct())


def annotate_keys(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """``columns`` with is_primary_key, is_foreign_key and foreign_key_to.

    Composite keys pair their columns one by one; where several keys use a column, the
    last one names its target.
    """
    pairs = (constraints.filter("kind = 'fk'")
             .select(*TABLE, "position", "ref_table",
                     F.posexplode(F.arrays_zip("columns", "ref_columns")).alias("at", "pair"))
             .select(*TABLE, "position", "at", F.col("pair.columns").alias("column"),
                     F.concat("ref_table", F.lit("."), "pair.ref_columns").alias("target"))
             .filter("column IS NOT NULL AND target IS NOT NULL")
             .groupBy(*TABLE, "column")
             .agg(F.max_by("target", F.struct("position", "at")).alias("foreign_key_to")))
    primary = _keyed(constraints, ["pk"]).withColumn("pk", F.lit(True))
    return (columns.join(primary, [*TABLE, "column"], "left").join(pairs, [*TABLE, "column"], "left")
            .withColumn("is_primary_key", F.coalesce("pk", F.lit(False)))
            .withColumn("is_foreign_key", F.col("foreign_key_to").isNotNull()).drop("pk"))


def foreign_keys(constraints: DataFrame) -> DataFrame:
    """The foreign keys with their cardinality: 1:1 when the first column is a key itself."""
    single = (_keyed(constraints, ["pk", "unique"])
              .select(*TABLE, F.col("column").alias("first"), F.lit("1:1").alias("one")))
    return (constraints.filter("kind = 'fk'").withColumn("first", F.col("columns")[0])
            .join(single, [*TABLE, "first"], "left")
            .withColumn("cardinality", F.coalesce("one", F.lit("N:1"))).drop("first", "one"))
