"""Views over the given tables, one SQL text for Spark and for the comparison.

The raw tables have no nulls, duplicates or orphans; these views have.  The estate is a
catalog of many database schemas with one table per row of ``part``, so that catalog
queries grow with the data as well.
"""
from __future__ import annotations

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SHOP_VIEWS = {
    # nulls, a constant, boolean words and every value pattern
    "customers": """
SELECT c_custkey AS customer_id,
  CASE WHEN c_custkey % 10 = 0 THEN NULL
       ELSE lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.com' END AS email,
  CASE WHEN c_custkey % 3 = 0 THEN NULL
       ELSE '+1 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS phone,
  '123-45-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS ssn,
  '10.0.' || CAST(c_custkey % 256 AS STRING) || '.' || CAST(c_custkey % 100 AS STRING) AS ip_address,
  substr(md5(CAST(c_custkey AS STRING)), 1, 8) || '-' || substr(md5(CAST(c_custkey AS STRING)), 9, 4)
    || '-' || substr(md5(CAST(c_custkey AS STRING)), 13, 4) || '-' || substr(md5(CAST(c_custkey AS STRING)), 17, 4)
    || '-' || substr(md5(CAST(c_custkey AS STRING)), 21, 12) AS uuid,
  CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS is_active,
  'EU' AS region_code,
  CASE WHEN c_custkey % 20 = 0 THEN c_acctbal END AS credit_limit,
  '{"k": ' || CAST(c_custkey % 5 AS STRING) || '}' AS attrs
FROM customer""",
    # orphans, null keys, date strings with a quarter of junk
    "sales": """
SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 100000000
       WHEN o_orderkey % 51 = 0 THEN NULL ELSE o_custkey END AS customer_id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'n/a'
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date,
  o_totalprice AS total_amount
FROM orders""",
    # NaN and NULL, outliers, no spread
    "lines": """
SELECT l_orderkey AS order_id, l_returnflag, l_linestatus, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE)
       WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 100 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price,
  CAST(3 AS DOUBLE) AS constant_num
FROM lineitem""",
    # no declared keys: what its columns refer to is inferred
    "payments": """
SELECT o_orderkey AS order_id, o_orderkey AS sale_id,
  CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS customer_id,
  o_orderdate AS paid_at, o_totalprice AS amount
FROM orders""",
    # almost every row is a duplicate
    "order_status": "SELECT o_orderstatus, o_orderpriority FROM orders",
    "no_rows": "SELECT o_orderkey AS id, o_orderstatus AS note FROM orders WHERE o_orderkey < 0",
}

OTHER_VIEWS = {
    # both zeros, which are one value
    "signed_zeros": """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE -CAST(0 AS DOUBLE) END AS zero, l_orderkey % 1000 AS bucket FROM lineitem""",
    # keys whose types differ from those of their parents; some are beyond 2^53, some are fractions
    "typed_keys": """
SELECT CAST(o_custkey AS DOUBLE) + CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 0 END AS as_double,
  CAST(o_custkey AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 11 = 0 THEN CAST(0.25 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS as_decimal,
  9007199254740992 + o_custkey AS as_big, CAST(o_orderdate AS DATE) AS as_day FROM orders""",
    "typed_parents": """
SELECT CAST(9007199254740992 + 2 * c_custkey AS DOUBLE) AS big, CAST(c_custkey AS DOUBLE) + 0.25 AS quarter FROM customer""",
    # a NULL among the parents
    "parent_with_null": "SELECT CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey END AS customer_id FROM customer",
}

# ------------------------------------------------------------------ estate
_COLUMNS = [
    # number, table, [(column, type, nullable, key)]
    (0, "album", "album_id:int:k title:nvarchar(160) artist_id:int"),
    (1, "artist", "artist_id:int:k name:nvarchar(120):n"),
    (2, "customer", "customer_id:int:k first_name:nvarchar(40) last_name:nvarchar(20) company:text:n address:text:n "
        "city:text:n state:text:n country:text:n postal_code:text:n phone:text:n fax:text:n email:text employee_id:int:n"),
    (3, "employee", "employee_id:int:k last_name:text first_name:text title:text:n reports_to:int:n birth_date:date:n "
        "hire_date:date:n street:text:n mobile:text:n email:text:n salary:decimal(10,2):n"),
    (4, "genre", "genre_id:int:k name:text:n"),
    (5, "invoice", "invoice_id:int:k customer_id:int invoice_date:timestamp billing_address:text:n total:decimal(10,2) tax:double:n"),
    (6, "invoice_line", "invoice_line_id:int:k invoice_id:int track_id:int unit_price:decimal(10,2) quantity:int"),
    (7, "media_type", "media_type_id:int:k name:text:n"),
    (8, "playlist", "playlist_id:int:k name:text:n"),
    (9, "playlist_track", "playlist_id:int:k track_id:int:k"),
    (10, "track", "track_id:int:k name:text album_id:int:n media_type_id:int genre_id:int:n composer:text:n "
        "milliseconds:int bytes:int:n unit_price:decimal(10,2)"),
    (11, "categories", "category_id:int:k category_name:text description:text:n picture:binary:n"),
    (12, "order", "id:int:k categoryid:int paid:boolean box_id:int:n _id:int:n OrderDate:date:n"),
    (13, "orders", "order_id:int:k customerid:int shipped_date:date:n freight_charge:double:n"),
    (14, "order_details", "order_id:int product_id:int unit_price:double quantity:int discount:double"),
    (15, "boxes", "id:int:k name:text"),
    (16, "user_audit", "id:bigint:k created_at:timestamp created_by:text changed_by:text:n ip_address:text:n"),
    (17, "dim_calendar", "date_key:int:k calendar_date:date fiscal_year:int is_holiday:boolean"),
    (18, "Sales_Xref", "SaleId:int customer_id:int note:text:n"),
    (19, "config_settings", "code:text:k setting_value:text:n is_enabled:boolean version:int updated_at:timestamp:n"),
    (20, "LegacyOrder", "OrderID:int:k order_date:date CUSTOMER_NAME:text x-y:text:n ID:int shipDate:date:n"),
    (21, "territories", "territory_id:int:k description:text region_id:int"),
    (22, "sensor_readings", "reading_id:bigint:k latitude:double longitude:double geo_hash:text created_at:timestamp "
        "updated_at:timestamp:n is_deleted:boolean deleted_at:timestamp:n status:text external_id:text balance:double row_yn:text"),
    (23, "people", "national_id:text:k passport_no:text:n ssn:text:n wage:double:n dob:date:n gender:text:n religion:text:n "
        "password_hash:text tax_id:text:n credit_card_no:text:n home_location:text:n surname:text full_name:text:n "
        "territory_id:int:n company_id:int:n category_id:int:n vat:text:n sin:text:n"),
    (24, "companies", "company_id:int:k legal_name:text category_id:int:n parent_company_id:int:n"),
]
_KEYS = [
    # number, kind, columns, referred table, referred columns
    (0, "fk", "artist_id", "artist", "artist_id"), (2, "fk", "employee_id", "employee", "employee_id"),
    (5, "fk", "customer_id", "customer", "customer_id"), (5, "unique", "customer_id", None, None),
    (6, "fk", "invoice_id", "invoice", "invoice_id"), (6, "fk", "track_id", "track", "track_id"),
    (9, "fk", "playlist_id", "playlist", "playlist_id"), (9, "fk", "track_id", "track", "track_id"),
    (10, "fk", "album_id", "album", "album_id"), (10, "fk", "media_type_id", "media_type", "media_type_id"),
    (10, "fk", "genre_id", "genre", "genre_id"),
    (18, "fk", "SaleId,customer_id", "orders", "order_id,customerid"),
    (18, "fk", "customer_id", "customer", "customer_id"), (18, "fk", "customer_id", "customer", "customer_id"),
    (20, "fk", "OrderID", "orders", "order_id"),
]
N_STEMS = len(_COLUMNS)


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else (
        str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'")
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


def _column_rows():
    for no, _, text in _COLUMNS:
        for at, spec in enumerate(text.split(), 1):
            name, kind, *flags = spec.split(":")
            yield no, at, name, kind, "n" in flags, "k" in flags


def _key_rows():
    for no, _, _ in _COLUMNS:
        keys = [name for n, _, name, _, _, is_key in _column_rows() if n == no and is_key]
        if keys:
            yield no, 0, "pk", ",".join(keys), None, None
    for at, (no, kind, cols, ref_table, ref_cols) in enumerate(_KEYS, 1):
        yield no, at, kind, cols, ref_table, ref_cols


_BLOCK = f"'db' || CAST(CAST((p_partkey - p_partkey % {N_STEMS}) / {N_STEMS} AS BIGINT) AS STRING)"
_STEM_TABLES = (f"(SELECT {_BLOCK} AS schema_name, p_partkey % {N_STEMS} AS stem, p_size, p_name, p_type, p_brand "
                f"FROM part)")

ESTATE_VIEWS = {
    # one row per column of every table
    "estate_columns": f"""
SELECT p.schema_name, CASE WHEN p.p_size % 7 = 3 THEN upper(n.name) ELSE n.name END AS table_name,
  CAST(c.pos AS INT) AS ordinal, c.col AS column_name, upper(c.typ) AS type, c.nullable AND p.p_size % 2 = 0 AS nullable,
  CASE WHEN c.pos = 2 THEN p.p_name END AS comment, c.is_key
FROM {_STEM_TABLES} p
JOIN (SELECT * FROM (VALUES {_values((no, t) for no, t, _ in _COLUMNS)}) AS n(stem, name)) n ON p.stem = n.stem
JOIN (SELECT * FROM (VALUES {_values(_column_rows())}) AS c(stem, pos, col, typ, nullable, is_key)) c ON p.stem = c.stem
WHERE NOT (c.nullable AND p.p_size % 5 = 0)""",
    # declared keys; some of the tables declare no foreign keys
    "estate_keys": f"""
SELECT p.schema_name, CASE WHEN p.p_size % 7 = 3 THEN upper(n.name) ELSE n.name END AS table_name,
  k.kind, CAST(k.pos AS INT) AS position, k.cols, k.ref_table, k.ref_cols
FROM {_STEM_TABLES} p
JOIN (SELECT * FROM (VALUES {_values((no, t) for no, t, _ in _COLUMNS)}) AS n(stem, name)) n ON p.stem = n.stem
JOIN (SELECT * FROM (VALUES {_values(_key_rows())}) AS k(stem, pos, kind, cols, ref_table, ref_cols)) k ON p.stem = k.stem
WHERE k.kind = 'pk' OR (p.p_brand <> 'Brand#3' AND p.p_type <> 'SMALL')""",
    # earlier answers: some columns of some tables, some of them under an outdated fingerprint
    "estate_answered": """
SELECT schema_name, table_name, column_name, ordinal FROM estate_columns
WHERE (ordinal + length(table_name)) % 3 = 0 OR nullable""",
}

# ------------------------------------------------------------------ answers
_ESC = "replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
ANSWER_VIEWS = {
    # answers about the columns title, body, lang and source, one per document, in eight forms
    "answers": f"""
SELECT doc_id, CASE CAST(doc_id % 8 AS INT)
  WHEN 0 THEN '{{"Title": "About ' || source || ' [90]", "BODY": "' || esc || ' [75]", "other": "x", "lang": {{"description": "Speaks ' || lang || '", "confidence": 60}}}}'
  WHEN 1 THEN '```json' || chr(10) || '{{"title": "About ' || source || '", "body": "' || esc || '", "lang": "' || lang || ' [101]", "source": "s [7]"}}' || chr(10) || '```'
  WHEN 2 THEN 'Here you are: {{"title": "T [5]", "body": "' || esc || ' [55]"}} hope this helps'
  WHEN 3 THEN '{{"title": "T", "body": "' || esc || ' [40]", "lang": "' || lang || ' Confidence: 72",}}'
  WHEN 4 THEN '{{"title": "T [1]" "body": "' || esc || ' [2]" "source": "' || source || '"}}'
  WHEN 5 THEN '{{"title": "T [1]", "lang": "' || lang
  WHEN 6 THEN ''
  ELSE '{{"title": 5, "body": {{"d": "' || esc || '", "c": 33}}, "lang": null, "source": ["a"]}}' END AS response,
  text, esc, lang, source
FROM (SELECT doc_id, text, lang, source, {_ESC} AS esc FROM documents) d""",
    # texts with and without a confidence
    "remarks": """
SELECT conv_id, turn, CASE CAST((conv_id + turn) % 5 AS INT)
  WHEN 0 THEN text || ' [85]' WHEN 1 THEN text || chr(10) || 'Confidence: 72' || chr(10)
  WHEN 2 THEN 'Confidence: 250.' WHEN 3 THEN text || ' [999] ' ELSE text END AS remark
FROM conversations""",
}

VIEWS = {**SHOP_VIEWS, **OTHER_VIEWS, **ESTATE_VIEWS, **ANSWER_VIEWS}
NEEDS = {"estate_answered": ["estate_columns"]}


def with_clause(*names: str) -> str:
    """WITH text that defines the views (and what they need) for the comparison."""
    order = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)


# ------------------------------------------------------------------ keys
def pk(table, *columns):
    return {"table": table, "kind": "pk", "name": f"pk_{table}", "columns": list(columns)}


def fk(table, columns, ref_table, ref_columns, name=None):
    return {"table": table, "kind": "fk", "name": name or f"fk_{table}_{ref_table}",
            "columns": list(columns), "ref_table": ref_table, "ref_columns": list(ref_columns)}


def unique(table, *columns):
    return {"table": table, "kind": "unique", "name": f"uq_{table}_{columns[0]}", "columns": list(columns)}


STAR_KEYS = [
    pk("region", "r_regionkey"), pk("nation", "n_nationkey"), pk("customer", "c_custkey"),
    pk("supplier", "s_suppkey"), pk("part", "p_partkey"), pk("orders", "o_orderkey"), pk("events", "event_id"),
    pk("documents", "doc_id"), pk("pages", "page_id"), pk("embeddings", "vec_id"), pk("benchmark", "item_id"),
    pk("conversations", "conv_id", "turn"),
    fk("nation", ["n_regionkey"], "region", ["r_regionkey"]),
    fk("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    fk("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    fk("orders", ["o_custkey"], "customer", ["c_custkey"]),
    fk("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    fk("lineitem", ["l_partkey"], "part", ["p_partkey"]),
    fk("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
    fk("labels", ["doc_id"], "documents", ["doc_id"]),
]

TYPED_KEYS = [("as_double", "customer", "c_custkey"), ("as_decimal", "customer", "c_custkey"), ("as_decimal", "typed_parents", "quarter"),
              ("as_big", "typed_parents", "big"), ("as_day", "orders", "o_orderdate")]

SHOP = ["region", "nation", "supplier", "customers", "sales", "lines", "payments", "order_status", "no_rows"]
SHOP_KEYS = [
    pk("region", "r_regionkey"), pk("nation", "n_nationkey"), pk("supplier", "s_suppkey"),
    pk("customers", "customer_id"), pk("sales", "order_id"), pk("lines", "order_id", "l_linenumber"), pk("no_rows", "id"),
    unique("customers", "uuid"),
    fk("nation", ["n_regionkey"], "region", ["r_regionkey"]),
    fk("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    fk("sales", ["customer_id"], "customers", ["customer_id"]),
    fk("lines", ["order_id", "l_linenumber"], "sales", ["order_id", "customer_id"], "fk_lines_sales_pair"),
    fk("lines", ["order_id"], "sales", ["order_id"]),
    fk("lines", ["l_returnflag"], "return_flags", ["code"]),
    fk("no_rows", ["id"], "sales", ["order_id"]),
]
