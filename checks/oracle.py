"""Comparison SQL, one text per query, written against the raw tables for DuckDB.

The SQL restates each rule on plain rows (no frequency frames, no range partitions), so a
mistake in the Spark plans does not repeat itself here.
"""
from __future__ import annotations

from . import rules, views as V

# table -> [(column, branch, catalog type, nullable)]
_S, _N, _T = "string", "numeric", "datetime"
COLUMNS = {
    "region": [("r_regionkey", _N, "INT"), ("r_name", _S, "STRING")],
    "nation": [("n_nationkey", _N, "INT"), ("n_name", _S, "STRING"), ("n_regionkey", _N, "INT")],
    "customer": [("c_custkey", _N, "BIGINT"), ("c_name", _S, "STRING"), ("c_nationkey", _N, "INT"),
                 ("c_acctbal", _N, "DOUBLE"), ("c_mktsegment", _S, "STRING")],
    "supplier": [("s_suppkey", _N, "BIGINT"), ("s_name", _S, "STRING"), ("s_nationkey", _N, "INT"),
                 ("s_acctbal", _N, "DOUBLE")],
    "part": [("p_partkey", _N, "BIGINT"), ("p_name", _S, "STRING"), ("p_brand", _S, "STRING"), ("p_type", _S, "STRING"),
             ("p_size", _N, "INT"), ("p_retailprice", _N, "DOUBLE")],
    "orders": [("o_orderkey", _N, "BIGINT"), ("o_custkey", _N, "BIGINT"), ("o_orderstatus", _S, "STRING"),
               ("o_totalprice", _N, "DOUBLE"), ("o_orderdate", _T, "TIMESTAMP_NTZ"), ("o_orderpriority", _S, "STRING")],
    "lineitem": [("l_orderkey", _N, "BIGINT"), ("l_partkey", _N, "BIGINT"), ("l_suppkey", _N, "BIGINT"),
                 ("l_linenumber", _N, "INT"), ("l_quantity", _N, "DOUBLE"), ("l_extendedprice", _N, "DOUBLE"),
                 ("l_discount", _N, "DOUBLE"), ("l_tax", _N, "DOUBLE"), ("l_returnflag", _S, "STRING"),
                 ("l_linestatus", _S, "STRING"), ("l_shipdate", _T, "TIMESTAMP_NTZ")],
    "events": [("event_id", _N, "BIGINT"), ("ts", _T, "TIMESTAMP_NTZ"), ("user_id", _N, "BIGINT"),
               ("event_type", _S, "STRING"), ("value", _N, "DOUBLE"), ("props", _S, "STRING")],
    "documents": [("doc_id", _N, "BIGINT"), ("text", _S, "STRING"), ("lang", _S, "STRING"), ("source", _S, "STRING"),
                  ("n_chars", _N, "BIGINT")],
    "embeddings": [("vec_id", _N, "BIGINT"), ("embedding", _S, "ARRAY<FLOAT>"), ("label", _N, "INT")],
    "pages": [("page_id", _N, "BIGINT"), ("url", _S, "STRING"), ("html", _S, "STRING")],
    "benchmark": [("item_id", _N, "BIGINT"), ("text", _S, "STRING")],
    "labels": [("doc_id", _N, "BIGINT"), ("quality", _N, "INT"), ("toxic", _N, "INT")],
    "conversations": [("conv_id", _N, "BIGINT"), ("turn", _N, "BIGINT"), ("role", _S, "STRING"), ("text", _S, "STRING")],
    "customers": [("customer_id", _N, "BIGINT"), ("email", _S, "STRING"), ("phone", _S, "STRING"), ("ssn", _S, "STRING"),
                  ("ip_address", _S, "STRING"), ("uuid", _S, "STRING"), ("is_active", _S, "STRING", False),
                  ("region_code", _S, "STRING", False), ("credit_limit", _N, "DOUBLE"), ("attrs", _S, "STRING")],
    "sales": [("order_id", _N, "BIGINT"), ("customer_id", _N, "BIGINT"), ("order_date", _S, "STRING"),
              ("total_amount", _N, "DOUBLE")],
    "lines": [("order_id", _N, "BIGINT"), ("l_returnflag", _S, "STRING"), ("l_linestatus", _S, "STRING"),
              ("l_linenumber", _N, "INT"), ("quantity", _N, "DOUBLE"), ("price", _N, "DOUBLE"),
              ("constant_num", _N, "DOUBLE", False)],
    "payments": [("order_id", _N, "BIGINT"), ("sale_id", _N, "BIGINT"), ("customer_id", _N, "BIGINT"),
                 ("paid_at", _T, "TIMESTAMP_NTZ"), ("amount", _N, "DOUBLE")],
    "order_status": [("o_orderstatus", _S, "STRING"), ("o_orderpriority", _S, "STRING")],
    "no_rows": [("id", _N, "BIGINT"), ("note", _S, "STRING")],
}
COLUMNS = {t: [(*c, True) if len(c) == 3 else c for c in cs] for t, cs in COLUMNS.items()}


def lit(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def pct(n: str, total: str, digits: int = 2) -> str:
    ten = 10 ** digits
    return (f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST((CAST({200 * ten} AS HUGEINT) * ({n}) + ({total})) "
            f"// (2 * ({total})) AS DOUBLE) / {ten}.0 END")


def hund(x: str) -> str:
    return f"CAST(round(({x}) * 100) AS BIGINT)"


def pct_text(x: str, digits: int) -> str:
    if digits == 0:
        return f"CAST(({hund(x)} + 50) // 100 AS VARCHAR)"
    return f"CAST((({hund(x)} + 5) // 10) // 10 AS VARCHAR) || '.' || CAST((({hund(x)} + 5) // 10) % 10 AS VARCHAR)"


def stat(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN round({x}, 6) END"


def ts_text(x: str) -> str:
    return (f"CASE WHEN microsecond({x}) % 1000000 = 0 THEN strftime({x}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime({x}, '%Y-%m-%d %H:%M:%S.%f') END")


def matches(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {lit(pattern)})"


def slug(label: str) -> str:
    return label.lower().replace(" ", "_")


def with_views(*names: str, ctes: list[str] = ()) -> str:
    parts = [p for p in (V.with_clause(*[n for n in names if n in V.VIEWS]), *ctes) if p]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def _columns(tables, branch=None, only=None):
    for t in tables:
        for i, (c, kind, typ, nullable) in enumerate(COLUMNS[t], 1):
            if (branch is None or kind == branch) and (only is None or c in only):
                yield t, i, c, kind, typ, nullable


def _union(rows, empty: str) -> str:
    rows = list(rows)
    return "\nUNION ALL ".join(rows) if rows else f"SELECT {empty} WHERE false"


def float_text(x: str) -> str:
    """The shortest text of a float, below a thousandth with an exponent (``1.5E-4``)."""
    text = f"CAST(abs({x}) AS VARCHAR)"
    digits = f"ltrim(replace({text}, '0.', ''), '0')"
    power = f"length({text}) - 2 - length({digits}) + 1"
    long = f"substr({digits}, 1, 1) || '.' || coalesce(nullif(substr({digits}, 2), ''), '0') || 'E-' || CAST({power} AS VARCHAR)"
    short = (f"regexp_replace(regexp_replace({text}, '^([0-9])e', '\\1.0e'), 'e-0?', 'E-')")
    return (f"CASE WHEN {x} = 0 OR abs({x}) >= 0.001 THEN CAST({x} AS VARCHAR) ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || "
            f"CASE WHEN contains({text}, 'e') THEN {short} ELSE {long} END END")


def cells(tables, only=None) -> list[str]:
    """CTEs nc, sc, tc: one row per cell of the numeric, text and time columns."""
    num = lambda c, typ: f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE {c} END" if typ == "DOUBLE" else c
    nc = _union((f"SELECT {lit(t)} AS tbl, {i} AS ord, {lit(c)} AS col, CAST({num(c, typ)} AS DOUBLE) AS v, "
                 f"CAST({num(c, typ)} AS VARCHAR) AS txt FROM {t}" for t, i, c, _, typ, _ in _columns(tables, _N, only)),
                "'' AS tbl, 0 AS ord, '' AS col, 0.0::DOUBLE AS v, '' AS txt")
    js = lambda c, typ: f"'[' || array_to_string(list_transform({c}, lambda x: {float_text('x')}), ',') || ']'" if typ.startswith("ARRAY") else c
    sc = _union((f"SELECT {lit(t)} AS tbl, {i} AS ord, {lit(c)} AS col, {js(c, typ)} AS v FROM {t}"
                 for t, i, c, _, typ, _ in _columns(tables, _S, only)), "'' AS tbl, 0 AS ord, '' AS col, '' AS v")
    tc = _union((f"SELECT {lit(t)} AS tbl, {i} AS ord, {lit(c)} AS col, {c} AS v FROM {t}"
                 for t, i, c, _, _, _ in _columns(tables, _T, only)),
                "'' AS tbl, 0 AS ord, '' AS col, CAST(NULL AS TIMESTAMP) AS v")
    return [f"nc AS ({nc})", f"sc AS ({sc})", f"tc AS ({tc})"]


_BOOL = "(" + ", ".join(lit(w) for w in rules.BOOLEAN_WORDS) + ")"
_DATE = r"^\d{4}-\d{2}-\d{2}"


_SUM = "CAST(sum(CAST(({}) * 1152921504606846976.0 AS HUGEINT)) AS DOUBLE) / 1152921504606846976.0"


def stats(tables, only=None) -> list[str]:
    """CTEs ns, ss, ts on top of the cells: one row per column."""
    hits = ", ".join(f"count(*) FILTER ({matches('v', p)}) AS pattern_{slug(l)}" for l, p in rules.VALUE_PATTERNS)
    pii = ", ".join(f"count(*) FILTER ({matches('v', p)}) AS pii_{slug(l)}" for l, p in rules.PII_VALUE_PATTERNS)
    base = "tbl, ord, col, count(*) AS n_rows, count(v) AS n, count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count"
    pattern = "CASE WHEN n > 0 AND boolean_words = n THEN 'Boolean String' " + " ".join(
        f"WHEN n > 0 AND pattern_{slug(l)} * 100 >= n * {rules.PATTERN_SHARE_PCT} THEN {lit(l)}"
        for l, _ in rules.VALUE_PATTERNS) + " END AS detected_pattern"
    personal = "CASE " + " ".join(
        f"WHEN n > 0 AND pii_{slug(l)} * 100 >= n * {rules.PII_SHARE_PCT} THEN {lit(l)}"
        for l, _ in rules.PII_VALUE_PATTERNS) + " END AS pii_detected"
    return [
        *cells(tables, only),
        # sums of whole numbers, so that the order of rows does not matter
        f"""n0 AS (SELECT {base}, min(v) AS lo, max(v) AS hi, {_SUM.format('v')} / count(v) AS mean, quantile_cont(v, 0.5) AS med,
quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM nc GROUP BY tbl, ord, col)""",
        f"""nv AS (SELECT tbl, ord, sqrt({_SUM.format('(v - mean) * (v - mean)')} / (count(v) - 1)) AS sd
FROM nc JOIN n0 USING (tbl, ord) WHERE v IS NOT NULL AND n > 1 GROUP BY tbl, ord)""",
        "ns AS (SELECT n0.*, sd FROM n0 LEFT JOIN nv USING (tbl, ord))",
        """nout AS (SELECT tbl, ord, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_out
FROM nc JOIN ns USING (tbl, ord) WHERE q3 - q1 > 0 GROUP BY tbl, ord)""",
        f"""s0 AS (SELECT {base}, min(length(v)) AS min_length, max(length(v)) AS max_length, sum(length(v)) AS len_sum,
count(*) FILTER (lower(v) IN {_BOOL}) AS boolean_words, count(*) FILTER ({matches('v', _DATE)}) AS date_like,
count(*) FILTER ({matches('v', _DATE)} AND try_cast(v AS TIMESTAMP) IS NOT NULL) AS date_parsed, {hits}, {pii}
FROM sc GROUP BY tbl, ord, col)""",
        f"""ss AS (SELECT *, CASE WHEN n > 0 THEN CAST((len_sum * 20 + n) // (2 * n) AS DOUBLE) / 10.0 END AS avg_length,
{pattern}, {personal} FROM s0)""",
        f"ts AS (SELECT {base}, min(v) AS lo, max(v) AS hi FROM tc GROUP BY tbl, ord, col)",
    ]


def profile(tables) -> list[str]:
    """CTE prof: the whole column profile, one row per column."""
    none = lambda *names: ", ".join(f"NULL AS {n}" for n in names)
    nums = ["min_val", "max_val", "mean_val", "median_val", "std_val", "q25", "q75"]
    num_null = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in nums) + \
        ", CAST(NULL AS BIGINT) AS outlier_count, CAST(NULL AS DOUBLE) AS outlier_pct"
    text_null = ("CAST(NULL AS BIGINT) AS min_length, CAST(NULL AS BIGINT) AS max_length, CAST(NULL AS DOUBLE) AS avg_length, "
                 "CAST(NULL AS VARCHAR) AS detected_pattern, CAST(NULL AS VARCHAR) AS pii_detected")
    date_null = "CAST(NULL AS VARCHAR) AS min_date, CAST(NULL AS VARCHAR) AS max_date"
    head = "tbl, ord, col, n_rows, null_count, distinct_count"
    return [
        *stats(tables),
        f"""p0 AS (SELECT {head}, 'numeric' AS kind, {', '.join(f'{stat(x)} AS {n}' for x, n in zip(
            ('lo', 'hi', 'mean', 'med', 'sd', 'q1', 'q3'), nums))}, n_out AS outlier_count,
CASE WHEN n_out IS NOT NULL THEN {pct('n_out', 'n_rows')} END AS outlier_pct, {text_null}, {date_null}
FROM ns LEFT JOIN nout USING (tbl, ord)
UNION ALL SELECT {head}, 'string', {num_null}, min_length, max_length, avg_length, detected_pattern, pii_detected, {date_null} FROM ss
UNION ALL SELECT {head}, 'datetime', {num_null}, {text_null}, {ts_text('lo')}, {ts_text('hi')} FROM ts)""",
        f"""prof AS (SELECT *, {pct('null_count', 'n_rows')} AS null_pct, {pct('distinct_count', 'n_rows')} AS distinct_pct,
distinct_count = 1 AND null_count < n_rows AS is_constant, distinct_count = n_rows AND null_count = 0 AS is_unique FROM p0)""",
    ]


def top(tables, only=None) -> list[str]:
    """CTE topv: the ten most frequent values per column (needs the CTEs of :func:`stats`)."""
    return [f"""cand AS (SELECT tbl, ord, col, n_rows, v AS value, v AS tie_s, NULL::DOUBLE AS tie_n, count(*) AS n
  FROM sc JOIN ss USING (tbl, ord, col) WHERE v IS NOT NULL GROUP BY ALL
UNION ALL SELECT tbl, ord, col, n_rows, txt, NULL, v, count(*) FROM nc JOIN ns USING (tbl, ord, col)
  WHERE v IS NOT NULL GROUP BY tbl, ord, col, n_rows, txt, v
UNION ALL SELECT tbl, ord, col, n_rows, CAST(year(v) AS VARCHAR), NULL, CAST(year(v) AS DOUBLE), count(*)
  FROM tc JOIN ts USING (tbl, ord, col) WHERE v IS NOT NULL GROUP BY tbl, ord, col, n_rows, year(v))""",
            f"""topv AS (SELECT tbl, ord, col, rank, value, n, {pct('n', 'n_rows', 1)} AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY tbl, ord ORDER BY n DESC, tie_s, tie_n) AS rank FROM cand) WHERE rank <= {rules.TOP_N})"""]


def hist(only=None) -> list[str]:
    """CTE bars: ten bins per numeric column (needs nc and ns)."""
    edges = " + ".join(f"CAST(v >= {float(i)} * w + f AS BIGINT)" for i in range(1, 10))
    return ["""bnd AS (SELECT tbl, ord, col, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS f,
CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS g FROM ns WHERE n > 0)""",
            "wid AS (SELECT *, (g - f) / 10 AS w FROM bnd)",
            f"binned AS (SELECT tbl, ord, {edges} AS bin, count(*) AS n FROM nc JOIN wid USING (tbl, ord) WHERE v IS NOT NULL GROUP BY ALL)",
            """bars AS (SELECT wid.tbl, wid.ord, wid.col, CAST(b AS BIGINT) AS bin, b * w + f AS bin_lo,
CASE WHEN b = 9 THEN g ELSE (b + 1) * w + f END AS bin_hi, coalesce(binned.n, 0) AS n
FROM (SELECT *, unnest(range(10)) AS b FROM wid) LEFT JOIN binned ON binned.tbl = wid.tbl AND binned.ord = wid.ord AND binned.bin = b)
""".replace("FROM (SELECT *, unnest(range(10)) AS b FROM wid)", "FROM (SELECT *, unnest(range(10)) AS b FROM wid) AS wid")]


def duplicates(tables: dict[str, str]) -> str:
    """Text of (tbl, n_rows, duplicate_count) over named row sources."""
    return "\nUNION ALL ".join(
        f"SELECT {lit(t)} AS tbl, (SELECT count(*) FROM ({src})) AS n_rows, "
        f"(SELECT count(*) FROM ({src})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({src}))) AS duplicate_count"
        for t, src in tables.items())


def _clean(t: str) -> str:
    """All columns of a table with NaN as NULL."""
    return "SELECT " + ", ".join(
        f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" if typ == "DOUBLE" else c
        for c, _, typ, _ in COLUMNS[t]) + f" FROM {t}"


def score(dup_cte: str, prof_cte: str) -> str:
    width, nulls = "count(*)", f"sum({hund('null_pct')})"
    penalty = f"least({hund('any_value(duplicate_pct)')} * 3, 30000)"
    num = f"({width} * 100000 - {nulls} * 5 - {width} * {penalty})"
    return (f"SELECT p.tbl, CAST(greatest(least(({num} * 2 + {width} * 100) // ({width} * 200), 1000), 0) AS DOUBLE) / 10.0 "
            f"AS quality_score FROM {prof_cte} p JOIN {dup_cte} d ON d.tbl = p.tbl GROUP BY p.tbl")


_ISSUES = f"""SELECT tbl, 0 AS ord, 0 AS rule, 'High duplicate rate: ' || {pct_text('duplicate_pct', 1)} || '%' AS issue
  FROM dups WHERE duplicate_pct > 10
UNION ALL SELECT tbl, ord, 1, CASE WHEN null_pct > 80 THEN 'Column ''' || col || ''' is ' || {pct_text('null_pct', 0)} || '% null'
  ELSE 'Column ''' || col || ''' has majority nulls (' || {pct_text('null_pct', 0)} || '%)' END FROM prof WHERE null_pct > 50
UNION ALL SELECT tbl, ord, 2, 'Column ''' || col || ''' has only one distinct value' FROM prof WHERE is_constant
UNION ALL SELECT tbl, ord, 3, 'Column ''' || col || ''' may contain PII (' || pii_detected || ') — verify' FROM prof WHERE pii_detected IS NOT NULL"""


def table_rows(tables) -> list[str]:
    """CTEs dups, tabs, issues over the shop tables (on top of prof)."""
    counts = "\nUNION ALL ".join(f"SELECT {lit(t)} AS tbl, count(*) AS row_count FROM {t}" for t in tables)
    return [
        f"d0 AS ({duplicates({t: _clean(t) for t in tables})})",
        f"dups AS (SELECT *, {pct('duplicate_count', 'n_rows')} AS duplicate_pct FROM d0)",
        f"cnt AS ({counts})",
        f"sco AS ({score('dups', 'prof')})",
        f"""cellsum AS (SELECT tbl, count(*) AS column_count, sum(null_count) AS total_null_cells,
{pct('sum(null_count)', 'sum(n_rows)')} AS null_pct FROM prof GROUP BY tbl)""",
        """tabs AS (SELECT c.tbl, c.row_count, coalesce(column_count, 0) AS column_count,
coalesce(total_null_cells, 0) AS total_null_cells, coalesce(null_pct, 0.0) AS null_pct, duplicate_count, duplicate_pct,
coalesce(quality_score, 100.0) AS quality_score
FROM cnt c LEFT JOIN cellsum USING (tbl) LEFT JOIN dups USING (tbl) LEFT JOIN sco USING (tbl))""",
        f"issues AS ({_ISSUES})",
    ]


# ------------------------------------------------------------------ catalog rules in SQL
def pii_name(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches(f'lower({col})', p)} THEN {lit(l)}" for l, p in rules.PII_NAME_PATTERNS) + " END"


def tags(col: str) -> str:
    """All tags of matching rules joined by comma, each at its first place."""
    parts = ", ".join(f"CASE WHEN {matches(f'lower({col})', p)} THEN [{', '.join(lit(t) for t in ts)}] ELSE [] END"
                      for p, ts in rules.LINEAGE_RULES)
    flat = f"flatten([{parts}])"
    return (f"array_to_string(list_filter({flat}, lambda x, i: list_position({flat}, x) = i), ',')")


def style(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({col}, {lit(p)}) THEN {lit(s)}" for s, p in rules.NAMING_STYLES) + " END"


def table_class(name: str, n_columns: str, n_fks: str) -> str:
    has = lambda words: "(" + " OR ".join(f"contains(lower({name}), {lit(w)})" for w in words) + ")"
    starts = "(" + " OR ".join(f"starts_with(lower({name}), {lit(w.rstrip('_'))})" for w in rules.LOOKUP_HINTS) + ")"
    return f"""CASE WHEN {n_fks} >= 2 AND {n_columns} <= 5 THEN 'junction' WHEN {has(rules.JUNCTION_HINTS)} THEN 'junction'
WHEN {has(rules.AUDIT_HINTS)} THEN 'audit' WHEN {has(rules.LOOKUP_HINTS)} OR {starts} THEN 'lookup'
WHEN {has(rules.DIMENSION_HINTS)} THEN 'dimension' WHEN {has(rules.FACT_HINTS)} THEN 'fact'
WHEN {n_fks} >= 3 THEN 'fact' WHEN {n_columns} <= 4 AND {n_fks} = 0 THEN 'lookup' ELSE 'unknown' END"""


_ESTATE = ["estate_columns", "estate_keys"]
_PAIRS = """pairs AS (SELECT schema_name, table_name, position, ref_table, unnest(string_split(cols, ',')) AS column_name,
  unnest(string_split(ref_cols, ',')) AS ref_column, unnest(range(len(string_split(cols, ',')))) AS place FROM estate_keys WHERE kind = 'fk')"""
_ANNOTATED = [_PAIRS,
              """targets AS (SELECT schema_name, table_name, column_name, ref_table || '.' || ref_column AS fk_to FROM pairs
  QUALIFY row_number() OVER (PARTITION BY schema_name, table_name, column_name ORDER BY position DESC, place DESC) = 1)""",
              """ann AS (SELECT e.*, fk_to FROM estate_columns e LEFT JOIN targets t
  ON t.schema_name = e.schema_name AND t.table_name = e.table_name AND t.column_name = e.column_name)"""]
_CLASSES = f"""classes AS (SELECT schema_name, table_name, {table_class('table_name', 'count(*)', 'count(fk_to)')} AS table_type
  FROM ann GROUP BY schema_name, table_name)"""
_EDGES = """edges AS (SELECT schema_name, table_name || '_' || ref_table || '_' || replace(cols, ',', ', ') AS id, table_name AS source,
  ref_table AS target, replace(cols, ',', ', ') AS source_col, replace(ref_cols, ',', ', ') AS target_col,
  replace(cols, ',', ', ') || ' → ' || replace(ref_cols, ',', ', ') AS label,
  CASE WHEN EXISTS (SELECT 1 FROM estate_keys u WHERE u.kind IN ('pk', 'unique') AND u.schema_name = k.schema_name
    AND u.table_name = k.table_name AND list_contains(string_split(u.cols, ','), string_split(k.cols, ',')[1]))
    THEN '1:1' ELSE 'N:1' END AS cardinality, position FROM estate_keys k WHERE kind = 'fk')"""


# ------------------------------------------------------------------ shop catalog
def _shop_catalog() -> list[str]:
    """CTEs cat (analyzed columns) and fks (declared and inferred), restated for the shop tables."""
    names = {t.lower(): t for t in V.SHOP}
    rows = [(t, i, c, typ, nullable) for t, i, c, _, typ, nullable in _columns(V.SHOP)]
    keys = [(k["table"], c) for k in V.SHOP_KEYS if k["kind"] == "pk" for c in k["columns"]]
    fks = [(k["table"], at, k["name"], ",".join(k["columns"]), k["ref_table"], ",".join(k["ref_columns"]), False)
           for at, k in enumerate(V.SHOP_KEYS, 1) if k["kind"] == "fk"]
    # what the names imply: payments declares nothing and refers to sales and customers
    fks += [("payments", 2, "inferred__payments__sale_id", "sale_id", "sales", "order_id", True),
            ("payments", 3, "inferred__payments__customer_id", "customer_id", "customers", "customer_id", True)]
    assert "sales" in names and "customers" in names
    val = V._values
    return [
        f"c0 AS (SELECT * FROM (VALUES {val(rows)}) AS c(tbl, ord, col, typ, nullable))",
        f"pks AS (SELECT * FROM (VALUES {val(keys)}) AS k(tbl, col))",
        f"fks AS (SELECT * FROM (VALUES {val(fks)}) AS f(tbl, position, fk_name, cols, ref_table, ref_cols, inferred))",
        """fkc AS (SELECT tbl, col, arg_max(ref_table || '.' || rc, (inferred::INT, position)) AS fk_to FROM
  (SELECT tbl, position, inferred, ref_table, unnest(string_split(cols, ',')) AS col, unnest(string_split(ref_cols, ',')) AS rc FROM fks)
  GROUP BY tbl, col)""",
        f"""c1 AS (SELECT c0.*, pks.col IS NOT NULL AS is_pk, fk_to, {pii_name('c0.col')} AS pii_type, {tags('c0.col')} AS tags,
{style('c0.col')} AS style FROM c0 LEFT JOIN pks ON pks.tbl = c0.tbl AND pks.col = c0.col
LEFT JOIN fkc ON fkc.tbl = c0.tbl AND fkc.col = c0.col)""",
        """dom AS (SELECT tbl, style AS dominant FROM (SELECT tbl, style, count(*) AS n, min(ord) AS f FROM c1 WHERE style IS NOT NULL
  GROUP BY tbl, style) QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY n DESC, f) = 1)""",
        f"""cls AS (SELECT tbl, {table_class('tbl', 'count(*)', "count(fk_to) FILTER (tbl <> 'payments')")} AS table_type,
  count(*) AS n_columns FROM c1 GROUP BY tbl)""",
        """cat AS (SELECT c1.*, table_type, CASE WHEN dominant IS NULL THEN NULL
  WHEN style IS NULL THEN 'Non-standard naming (mixed/special chars)'
  WHEN style <> dominant THEN 'Expected ' || dominant || ', found ' || style END AS naming_issue
FROM c1 LEFT JOIN dom USING (tbl) JOIN cls USING (tbl))""",
    ]


def orphans(child, col, parent, ref) -> str:
    return f"SELECT count(*) FROM {child} WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {ref} FROM {parent})"


def _integrity(keys, known) -> str:
    rows = []
    for k in keys:
        head = ", ".join(f"{lit(v)} AS {n}" for v, n in (
            (k["table"], "tbl"), (k["name"], "fk_name"), (k["columns"][0], "local_col"),
            (k["ref_table"], "ref_table"), (k["ref_columns"][0], "ref_col")))
        if k["ref_table"] not in known:
            rows.append(f"SELECT {head}, -1 AS orphan_count, 'error' AS status, {lit('no such table: ' + k['ref_table'])} AS error")
            continue
        n = orphans(k["table"], k["columns"][0], k["ref_table"], k["ref_columns"][0])
        rows.append(f"SELECT {head}, n AS orphan_count, CASE WHEN n = 0 THEN 'ok' ELSE 'violation' END AS status, "
                    f"CAST(NULL AS VARCHAR) AS error FROM (SELECT ({n}) AS n)")
    return "\nUNION ALL ".join(rows)


def _shop_fks() -> list[dict]:
    return [k for k in V.SHOP_KEYS if k["kind"] == "fk"] + [
        V.fk("payments", ["sale_id"], "sales", ["order_id"], "inferred__payments__sale_id"),
        V.fk("payments", ["customer_id"], "customers", ["customer_id"], "inferred__payments__customer_id")]


def shop(select: str, with_profile=True, more: list[str] = ()) -> str:
    """A query over every CTE of the shop: prof, topv, bars, tabs, issues, cat, fks, integ."""
    ctes = [*(profile(V.SHOP) if with_profile else []), *(top(V.SHOP) + hist() + table_rows(V.SHOP) if with_profile else []),
            *_shop_catalog(), f"integ AS ({_integrity(_shop_fks(), V.SHOP)})", *more]
    return with_views(*V.SHOP, ctes=ctes) + select


def _hints() -> list[str]:
    q = lambda n: f"(SELECT string_agg('\"' || value || '\"', ', ' ORDER BY rank) FROM topv t WHERE t.tbl = p.tbl AND t.ord = p.ord AND t.rank <= {n})"
    two = lambda x: f"format('{{:.2f}}', {x})"
    whole = lambda x: f"CAST(CAST({x} AS HUGEINT) AS VARCHAR)"
    return [f"""hint AS (SELECT p.tbl, p.ord, p.col, list_filter([
CASE WHEN null_pct = 0 THEN 'always populated' WHEN null_pct >= 95 THEN {pct_text('null_pct', 0)} || '% null (almost never set)'
  WHEN null_pct >= 50 THEN {pct_text('null_pct', 0)} || '% null (often absent)' WHEN null_pct > 5 THEN {pct_text('null_pct', 0)} || '% null' END,
CASE WHEN is_constant AND {q(1)} IS NOT NULL THEN 'constant: always ' || {q(1)}
  WHEN is_unique THEN 'all values unique (identifier)' WHEN distinct_count <= 1 THEN NULL
  WHEN distinct_count <= 20 AND {q(rules.TOP_N)} IS NOT NULL THEN CAST(distinct_count AS VARCHAR) || ' distinct values: ' || {q(rules.TOP_N)}
  WHEN distinct_count <= 200 AND {q(rules.TOP_N)} IS NOT NULL THEN CAST(distinct_count AS VARCHAR) || ' distinct (top: ' || {q(rules.TOP_N)} || ')'
  ELSE format('{{:,}}', distinct_count) || ' distinct (' || {pct_text('distinct_pct', 0)} || '% unique)' END,
CASE WHEN min_val IS NOT NULL THEN CASE WHEN min_val = floor(min_val) AND max_val = floor(max_val)
  THEN 'range: ' || {whole('min_val')} || '–' || {whole('max_val')} ELSE 'range: ' || {two('min_val')} || '–' || {two('max_val')} END END,
'date range: ' || min_date || ' → ' || max_date,
CASE WHEN max_length > 0 THEN CASE WHEN min_length = max_length AND min_length IN (2, 3, 4) THEN 'fixed ' || min_length || '-char code'
  WHEN max_length <= 5 THEN 'short code (' || min_length || '–' || max_length || ' chars)' END END,
'pattern: ' || detected_pattern, 'contains: ' || pii_detected], lambda x: x IS NOT NULL) AS hints FROM prof p)"""]


_LINE = """line AS (SELECT c.tbl, c.ord, c.col, array_to_string(list_filter([
'- ' || c.col || ' [' || typ || ']',
'(' || nullif(array_to_string(list_filter([CASE WHEN is_pk THEN 'PK' END, 'FK→' || fk_to, CASE WHEN NOT nullable THEN 'required' END],
  lambda x: x IS NOT NULL), ', '), '') || ')',
'| ' || nullif(array_to_string(coalesce(hints, []), ' | '), ''), '| PII:' || pii_type, '| tags:' || nullif(tags, '')],
lambda x: x IS NOT NULL), ' ') AS line FROM cat c LEFT JOIN hint h ON h.tbl = c.tbl AND h.ord = c.ord)"""

_CONTEXT = f"""ctx AS (SELECT t.tbl, array_to_string(list_filter(['Row count: ' || format('{{:,}}', row_count),
CASE WHEN table_type <> 'unknown' THEN 'Classification: ' || table_type || ' table' END,
CASE WHEN null_pct > 0 THEN 'Overall null rate: ' || {pct_text('null_pct', 1)} || '%' END,
CASE WHEN duplicate_pct > 1 THEN 'Duplicate rows: ' || {pct_text('duplicate_pct', 1)} || '%' END,
'Data issues: ' || (SELECT string_agg(issue, '; ' ORDER BY ord, rule) FROM (SELECT * FROM issues i WHERE i.tbl = t.tbl)),
'Columns: ' || (SELECT string_agg(col || '(' || typ || ')' || CASE WHEN is_pk THEN ' PK' ELSE '' END, ', ' ORDER BY ord)
  FROM cat c WHERE c.tbl = t.tbl)], lambda x: x IS NOT NULL), chr(10)) AS context
FROM tabs t JOIN cls USING (tbl))"""

_AVG = "CAST((sum(CAST(round(quality_score * 10) AS BIGINT)) * 2 + count(*)) // (count(*) * 2) AS DOUBLE) / 10.0"
_WS = r"^\s+|\s+$"
_strip = lambda x: f"regexp_replace({x}, '{_WS}', '', 'g')"
_BRACKET = r"'(?s)^(.*?)\s*\[(\d{1,3})\]\s*$'"
_PHRASE = r"'(?i)\bconfidence[:\s]+(\d{1,3})\b'"
_conf = lambda x: (f"CASE WHEN regexp_matches({x}, {_BRACKET}) THEN least(CAST(regexp_extract({x}, {_BRACKET}, 2) AS BIGINT), 100) "
                   f"WHEN regexp_matches({x}, {_PHRASE}) THEN least(CAST(regexp_extract({x}, {_PHRASE}, 1) AS BIGINT), 100) END")
_desc = lambda x: (f"CASE WHEN regexp_matches({x}, {_BRACKET}) THEN {_strip(f'regexp_extract({x}, {_BRACKET}, 1)')} "
                   f"WHEN regexp_matches({x}, {_PHRASE}) THEN {_strip(f'''regexp_replace({x}, '(?i){chr(92)}n?{chr(92)}s*confidence[:{chr(92)}s]+{chr(92)}d+{chr(92)}s*{chr(92)}.?', '', 'g')''')} "
                   f"ELSE {x} END")


def _answer_rows() -> str:
    """What can be read of each form of answer, from how the forms are made."""
    rows = [
        (0, "title", "'About ' || source", "90"), (0, "body", "text", "75"), (0, "lang", "'Speaks ' || lang", "60"),
        (1, "title", "'About ' || source", "NULL"), (1, "body", "text", "NULL"), (1, "lang", "lang", "100"), (1, "source", "'s'", "7"),
        (2, "title", "'T'", "5"), (2, "body", "text", "55"),
        (3, "title", "'T'", "NULL"), (3, "body", "text", "40"), (3, "lang", "lang", "72"),
        (4, "title", "'T'", "1"), (4, "body", "esc", "2"), (4, "source", "source", "NULL"),
        (7, "body", "text", "33"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT CAST(doc_id AS VARCHAR) AS tbl, {lit(c)} AS col, {v} AS description, CAST({n} AS BIGINT) AS confidence "
        f"FROM answers WHERE doc_id % 8 = {form}" for form, c, v, n in rows)


def oracles() -> dict[str, str]:
    o = {}
    count_of = lambda tables: "\nUNION ALL ".join(f"SELECT {lit(t)} AS \"table\", count(*) AS row_count FROM {t}" for t in tables)
    o["catalog_tables"] = f"SELECT *, CAST(NULL AS VARCHAR) AS comment FROM ({count_of(V.BASE)})"
    o["table_row_counts"] = with_views(*V.SHOP) + count_of(V.SHOP)
    wanted = " OR ".join(f"regexp_full_match(lower(table_name), {lit(p)})" for p in ("part", "l.*", "ord.*", "play.*_track", "track"))
    o["catalog_filter"] = with_views("estate_columns") + (
        f"SELECT DISTINCT schema_name AS schema, table_name AS \"table\" FROM estate_columns WHERE {wanted}")
    listed = V._values((t, i, c, kind) for t, i, c, kind, _, _ in _columns(V.BASE))
    o["catalog_columns"] = (
        f"SELECT c.tbl AS \"table\", CAST(c.ord AS BIGINT) AS ordinal, c.col AS \"column\", c.kind, true AS nullable, n.row_count "
        f"FROM (VALUES {listed}) AS c(tbl, ord, col, kind) JOIN ({count_of(V.BASE)}) n ON n.\"table\" = c.tbl")
    o["column_kinds"] = "WITH " + ",\n".join(stats(V.BASE)) + """
SELECT tbl AS "table", kind, count(*) AS columns, sum(n) AS "values" FROM (SELECT tbl, n, 'numeric' AS kind FROM ns
UNION ALL SELECT tbl, n, 'string' FROM ss UNION ALL SELECT tbl, n, 'datetime' FROM ts) GROUP BY tbl, kind"""
    o["key_annotation"] = with_views(*_ESTATE, ctes=_ANNOTATED) + """SELECT schema_name AS schema, table_name AS "table",
column_name AS "column", is_key AS is_primary_key, fk_to IS NOT NULL AS is_foreign_key, fk_to AS foreign_key_to FROM ann"""
    o["fk_cardinality"] = with_views("estate_keys", ctes=[_EDGES]) + """SELECT schema_name AS schema, source AS "table",
position, replace(source_col, ', ', ',') AS columns, target AS ref_table, replace(target_col, ', ', ',') AS ref_columns, cardinality FROM edges"""
    o["sample_rows"] = f"""SELECT o_orderkey, o_orderstatus, o_totalprice, {ts_text('o_orderdate')} AS o_orderdate
FROM orders ORDER BY o_orderkey LIMIT {rules.SAMPLE_ROWS}"""
    o["sample_json"] = "\nUNION ALL ".join(
        f"""SELECT {lit(t)} AS "table", row_number() OVER (ORDER BY {k}) - 1 AS position, CAST(to_json({{{', '.join(
            f"'{c}': {c}" for c, *_ in COLUMNS[t])}}}) AS VARCHAR) AS row
FROM {t} QUALIFY row_number() OVER (ORDER BY {k}) <= {rules.SAMPLE_ROWS}""" for t, k in (("nation", "n_nationkey"), ("part", "p_partkey")))
    o["bounded_scan"] = """SELECT count(*) AS profiled_rows, max(l_extendedprice) AS max_price, sum(l_linenumber) AS line_numbers
FROM (SELECT * FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey LIMIT 10000)"""

    three = "UNION ALL".join(f" SELECT tbl, ord, col, n_rows, n, null_count, distinct_count FROM {x} " for x in ("ns", "ss", "ts"))
    counted = lambda tables: with_views(*tables, ctes=stats(tables) + [f"allc AS ({three})"])
    o["null_profile"] = counted(["customers", "lines"]) + f"""SELECT tbl AS "table", ord, col AS "column", n_rows AS rows,
null_count, {pct('null_count', 'n_rows')} AS null_pct FROM allc"""
    o["distinct_profile"] = counted(["customers", "lines"]) + f"""SELECT tbl AS "table", col AS "column", null_count,
distinct_count, {pct('distinct_count', 'n_rows')} AS distinct_pct FROM allc"""
    o["key_candidates"] = counted(["customers", "sales", "part"]) + """SELECT tbl AS "table", col AS "column",
distinct_count = 1 AND null_count < n_rows AS is_constant, distinct_count = n_rows AND null_count = 0 AS is_unique FROM allc"""
    o["numeric_summary"] = with_views("lines", ctes=stats(["lineitem", "lines"])) + f"""SELECT tbl AS "table", col AS "column",
{stat('lo')} AS min_val, {stat('hi')} AS max_val, {stat('mean')} AS mean_val, {stat('med')} AS median_val, {stat('sd')} AS std_val,
{stat('q1')} AS q25, {stat('q3')} AS q75 FROM ns"""
    o["histogram"] = with_views("lines", ctes=stats(["lines"]) + hist()) + \
        """SELECT col AS "column", bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, n AS count,
printf('%.2g', bin_lo) || '–' || printf('%.2g', bin_hi) AS label FROM bars"""
    o["iqr_outliers"] = with_views("lines", ctes=stats(["lines", "events"])) + f"""SELECT tbl AS "table", col AS "column",
n_out AS outlier_count, CASE WHEN n_out IS NOT NULL THEN {pct('n_out', 'n_rows')} END AS outlier_pct
FROM ns LEFT JOIN nout USING (tbl, ord)"""
    for name, branch in (("distinct_profile_approx", None), ("numeric_summary_approx", _N)):
        o[name] = "\nUNION ALL ".join(f"SELECT {lit(c)} AS \"column\", count(*) > 0 AS within_tolerance FROM lineitem"
                                      for _, _, c, _, _, _ in _columns(["lineitem"], branch))
    sketched = ["lineitem", "orders", "customers", "events"]
    o["sketched_profile"] = with_views("customers", ctes=profile(sketched)) + """SELECT tbl AS "table", col AS "column", kind, n_rows AS rows, null_count,
min_val, max_val, min_length, max_length, true AS within_tolerance FROM prof"""
    o["date_range"] = "\nUNION ALL ".join(
        f"SELECT {lit(t)} AS \"table\", {lit(c)} AS \"column\", {ts_text(f'min({c})')} AS min_date, {ts_text(f'max({c})')} AS max_date FROM {t}"
        for t, _, c, _, _, _ in _columns(["orders", "lineitem", "events"], _T))
    time_tables = ["orders", "lineitem", "events"]
    topped = """SELECT tbl AS "table", col AS "column", rank, value, n AS count, pct FROM topv"""
    o["top_years"] = "WITH " + ",\n".join(stats(time_tables) + top(time_tables)) + topped + " WHERE col IN (SELECT col FROM ts)"
    length_tables = ["documents", "customers", "pages", "conversations", "benchmark"]
    o["string_lengths"] = with_views("customers", ctes=stats(length_tables)) + """SELECT tbl AS "table", col AS "column",
min_length, max_length, avg_length FROM ss"""
    top_tables = ["orders", "events", "part", "lineitem", "documents", "pages", "conversations", "labels"]
    o["top_values"] = "WITH " + ",\n".join(stats(top_tables) + top(top_tables)) + topped
    text_tables = ["customers", "sales", "pages", "events", "documents"]
    texts = with_views("customers", "sales", ctes=stats(text_tables))
    o["value_patterns"] = texts + "SELECT tbl AS \"table\", col AS \"column\", boolean_words, " + ", ".join(
        f"pattern_{slug(l)}" for l, _ in rules.VALUE_PATTERNS) + ", detected_pattern FROM ss"
    o["value_pii"] = texts + "SELECT tbl AS \"table\", col AS \"column\", " + ", ".join(
        f"pii_{slug(l)}" for l, _ in rules.PII_VALUE_PATTERNS) + ", pii_detected FROM ss"
    o["value_patterns_first"] = with_views("sales") + f"""SELECT 'order_date' AS "column", count(*) AS n,
count(*) FILTER ({matches('v', _DATE)}) AS pattern_date_string,
CASE WHEN count(*) FILTER ({matches('v', _DATE)}) * 100 >= count(*) * {rules.PATTERN_SHARE_PCT} THEN 'Date String' END AS detected_pattern
FROM (SELECT order_date AS v FROM sales WHERE order_date IS NOT NULL ORDER BY order_id LIMIT {rules.PATTERN_SAMPLE})"""
    all_fields = """kind, null_count, null_pct, distinct_count, distinct_pct, min_val, max_val, mean_val, median_val, std_val, q25, q75,
outlier_count, outlier_pct, min_length, max_length, avg_length, detected_pattern, pii_detected, min_date, max_date, is_constant, is_unique"""
    o["column_profile"] = "WITH " + ",\n".join(profile(["lineitem"])) + f"""
SELECT tbl AS "table", ord, col AS "column", n_rows AS rows, {all_fields} FROM prof"""

    types = ", ".join(f"({lit(t)}, {i}, {lit(typ.lower())})" for t, i, _, _, typ, _ in _columns(V.BASE))
    o["column_profile_all"] = "WITH " + ",\n".join(profile(V.BASE)) + f"""
SELECT tbl AS "table", prof.ord, col AS "column", dtype, n_rows AS rows, {all_fields} FROM prof
JOIN (VALUES {types}) AS y(tbl, ord, dtype) USING (tbl, ord)"""

    # ------------------------------------------------------------ tables
    sources = {t: _clean(t) for t in ("order_status", "lineitem", "lines", "conversations", "embeddings", "no_rows", "part", "customers",
                                      "documents", "pages", "events")}
    sources |= {"part_names": "SELECT p_name, p_brand FROM part", "customer_phones": "SELECT phone, is_active FROM customers",
                "document_texts": "SELECT text FROM documents", "signed_zeros": "SELECT zero + 0.0 AS zero, bucket FROM signed_zeros"}
    o["duplicate_rows"] = with_views("order_status", "no_rows", "lines", "customers", "signed_zeros", ctes=[f"d0 AS ({duplicates(sources)})"]) + \
        f"""SELECT tbl AS "table", n_rows AS rows, duplicate_count, {pct('duplicate_count', 'n_rows')} AS duplicate_pct FROM d0"""
    null_tables = ["customers", "sales", "lines", "documents"]
    o["null_cells"] = counted(null_tables) + f"""SELECT tbl AS "table", sum(null_count) AS total_null_cells,
{pct('sum(null_count)', 'sum(n_rows)')} AS null_pct FROM allc GROUP BY tbl"""
    score_tables = ["customers", "sales", "lines", "order_status"]
    o["quality_score"] = with_views(*score_tables, ctes=[
        *profile(score_tables), f"d0 AS ({duplicates({t: _clean(t) for t in score_tables})})",
        f"dups AS (SELECT *, {pct('duplicate_count', 'n_rows')} AS duplicate_pct FROM d0)"]) + \
        f"SELECT tbl AS \"table\", quality_score FROM ({score('dups', 'prof')})"
    o["table_profile"] = shop("""SELECT tbl AS "table", row_count, column_count, total_null_cells, null_pct, duplicate_count,
duplicate_pct, quality_score FROM tabs""")
    o["quality_issues"] = shop("""SELECT tbl AS "table", ord, rule, issue FROM issues""")
    month = lambda t, c: f"SELECT {lit(t)} AS \"table\", {lit(c)} AS \"column\", strftime({c}, '%Y-%m') AS period, count(*) AS count FROM {t} GROUP BY 3"
    o["monthly_trend"] = "\nUNION ALL ".join((month("orders", "o_orderdate"), month("lineitem", "l_shipdate"), month("events", "ts")))
    o["monthly_trend_string"] = with_views("sales") + """SELECT 'sales' AS "table", 'order_date' AS "column",
strftime(try_cast(order_date AS TIMESTAMP), '%Y-%m') AS period, count(*) AS count FROM sales
WHERE try_cast(order_date AS TIMESTAMP) IS NOT NULL GROUP BY 3"""

    # ------------------------------------------------------------ analysis
    est = """schema_name AS schema, table_name AS "table" """
    estc = est + """, column_name AS "column" """
    o["classify_tables"] = with_views(*_ESTATE, ctes=[*_ANNOTATED, _CLASSES]) + f"SELECT {est}, table_type FROM classes"
    o["infer_fks"] = with_views(*_ESTATE, ctes=[
        *_ANNOTATED,
        """pre AS (SELECT *, CASE WHEN lower(column_name) LIKE '%\\_id' ESCAPE '\\' THEN substr(lower(column_name), 1, length(column_name) - 3)
  WHEN lower(column_name) LIKE '%id' AND length(column_name) > 2 THEN substr(lower(column_name), 1, length(column_name) - 2) END AS w
FROM ann a WHERE NOT is_key AND fk_to IS NULL AND NOT EXISTS (SELECT 1 FROM estate_keys k WHERE k.kind = 'fk'
  AND k.schema_name = a.schema_name AND k.table_name = a.table_name))""",
        """var AS (SELECT *, 1 AS choice, w AS name FROM pre WHERE w <> ''
UNION ALL SELECT *, 2, CASE WHEN w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y'
  WHEN w LIKE '%ses' OR w LIKE '%xes' OR w LIKE '%zes' THEN substr(w, 1, length(w) - 2)
  WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) END FROM pre WHERE w <> ''
UNION ALL SELECT *, 3, w || 's' FROM pre WHERE w <> ''
UNION ALL SELECT *, 4, substr(w, 1, length(w) - 1) || 'ies' FROM pre WHERE w LIKE '%y')""",
        "tn AS (SELECT schema_name, lower(table_name) AS low, max(table_name) AS ref FROM estate_columns GROUP BY ALL)"]) + f"""
SELECT v.schema_name AS schema, v.table_name AS "table", v.column_name AS "column",
'inferred__' || v.table_name || '__' || v.column_name AS name, tn.ref AS ref_table,
coalesce((SELECT string_split(cols, ',')[1] FROM estate_keys k WHERE k.kind = 'pk' AND k.schema_name = v.schema_name AND k.table_name = tn.ref), 'id') AS ref_column
FROM var v JOIN tn ON tn.schema_name = v.schema_name AND tn.low = v.name AND tn.ref <> v.table_name
QUALIFY row_number() OVER (PARTITION BY v.schema_name, v.table_name, v.column_name ORDER BY choice) = 1"""
    from_estate = with_views("estate_columns")
    o["pii_by_name"] = from_estate + f"SELECT {estc}, {pii_name('column_name')} AS pii_type FROM estate_columns"
    o["lineage_tags"] = from_estate + f"SELECT {estc}, {tags('column_name')} AS lineage_tags FROM estate_columns"
    o["naming_style"] = from_estate + f"SELECT {estc}, {style('column_name')} AS style FROM estate_columns"
    o["naming_issues"] = with_views("estate_columns", ctes=[
        f"sty AS (SELECT *, {style('column_name')} AS style FROM estate_columns)",
        """dom AS (SELECT schema_name, table_name, style AS dominant FROM (SELECT schema_name, table_name, style, count(*) AS n,
  min(ordinal) AS f FROM sty WHERE style IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY schema_name, table_name ORDER BY n DESC, f) = 1)"""]) + f"""
SELECT {estc}, CASE WHEN dominant IS NULL THEN NULL WHEN style IS NULL THEN 'Non-standard naming (mixed/special chars)'
WHEN style <> dominant THEN 'Expected ' || dominant || ', found ' || style END AS naming_issue
FROM sty LEFT JOIN dom USING (schema_name, table_name)"""

    # ------------------------------------------------------------ integrity
    o["fk_orphans"] = with_views("sales", "customers") + \
        f"SELECT ({orphans('sales', 'customer_id', 'customers', 'customer_id')}) AS orphan_count"
    o["fk_orphans_null_parent"] = with_views("sales", "parent_with_null") + f"""
SELECT ({orphans('sales', 'customer_id', 'parent_with_null', 'customer_id')}) AS orphan_count, true AS strict
UNION ALL SELECT (SELECT count(*) FROM sales s WHERE customer_id IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM parent_with_null p WHERE p.customer_id = s.customer_id)), false"""
    keys = [k for k in V.STAR_KEYS + [k for k in V.SHOP_KEYS if k["table"] in ("sales", "lines", "no_rows")] if k["kind"] == "fk"]
    integ_cols = """tbl AS "table", fk_name, local_col, ref_table, ref_col, CAST(orphan_count AS BIGINT) AS orphan_count, status, error"""
    o["fk_integrity_report"] = with_views("customers", "sales", "lines", "no_rows", ctes=[
        f"integ AS ({_integrity(keys, [*V.BASE, 'customers', 'sales', 'lines', 'no_rows'])})"]) + f"SELECT {integ_cols} FROM integ"
    o["fk_integrity_filtered"] = o["fk_integrity_report"]

    # both sides as the type that holds either exactly
    exact = {("as_double", "c_custkey"): "CAST(p.c_custkey AS DOUBLE)", ("as_decimal", "c_custkey"): "CAST(p.c_custkey AS DECIMAL(18,2))",
             ("as_decimal", "quarter"): "CAST(p.quarter AS DECIMAL(18,2))", ("as_big", "big"): "CAST(p.big AS BIGINT)",
             ("as_day", "o_orderdate"): "p.o_orderdate"}
    o["fk_mixed_types"] = with_views("typed_keys", "typed_parents", ctes=["found AS (" + "\nUNION ALL ".join(
        f"SELECT {lit(c)} AS local_col, {lit(t)} AS ref_table, {lit(p)} AS ref_col, count(*) AS orphan_count FROM typed_keys k "
        f"WHERE k.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {t} p WHERE {exact[c, p]} = k.{c})" for c, t, p in V.TYPED_KEYS) + ")"]) + \
        "SELECT *, CASE WHEN orphan_count = 0 THEN 'ok' ELSE 'violation' END AS status FROM found"

    # ------------------------------------------------------------ reports
    uniq = [(k["table"], k["name"]) for k in V.SHOP_KEYS if k["kind"] == "unique"]
    o["data_dictionary"] = shop(f"""SELECT t.tbl AS "table", row_count, table_type, n_columns,
(SELECT string_agg(col, ',' ORDER BY ord) FROM cat c WHERE c.tbl = t.tbl) AS columns,
coalesce((SELECT string_agg(p.col, ',' ORDER BY c.ord) FROM pks p JOIN c0 c ON c.tbl = p.tbl AND c.col = p.col WHERE p.tbl = t.tbl), '') AS primary_keys,
coalesce((SELECT string_agg(replace(cols, ',', ', ') || ' → ' || ref_table || '.' || replace(ref_cols, ',', ', '), '; ' ORDER BY inferred, position)
  FROM fks f WHERE f.tbl = t.tbl), '') AS foreign_keys,
coalesce((SELECT name FROM (VALUES {V._values(uniq)}) AS u(tbl, name) WHERE u.tbl = t.tbl), '') AS indexes,
CAST(coalesce((SELECT sum(orphan_count) FROM integ i WHERE i.tbl = t.tbl), 0) AS BIGINT) AS orphans
FROM tabs t JOIN cls USING (tbl)""")
    o["dictionary_totals"] = shop("""SELECT count(*) AS total_tables, sum(n_columns) AS total_columns, sum(row_count) AS total_rows
FROM tabs JOIN cls USING (tbl)""")
    o["profiling_totals"] = shop(f"""SELECT count(*) AS total_tables, sum(row_count) AS total_rows, sum(column_count) AS total_columns,
{_AVG} AS avg_quality_score FROM tabs""")
    o["profiling_dataset"] = shop("""SELECT t.tbl AS "table", column_count AS n_columns,
coalesce((SELECT sum(n) FROM bars b WHERE b.tbl = t.tbl), 0) AS binned,
coalesce((SELECT sum(n) FROM topv v WHERE v.tbl = t.tbl), 0) AS in_top,
coalesce((SELECT string_agg(issue, ' / ' ORDER BY ord, rule) FROM issues i WHERE i.tbl = t.tbl), '') AS issues,
CASE t.tbl WHEN 'sales' THEN 'order_date' WHEN 'payments' THEN 'paid_at' END AS trend_column,
CASE t.tbl WHEN 'sales' THEN (SELECT count(DISTINCT substr(order_date, 1, 7)) FROM sales WHERE order_date <> 'n/a')
  WHEN 'payments' THEN (SELECT count(DISTINCT strftime(paid_at, '%Y-%m')) FROM payments) END AS months FROM tabs t""")
    colors = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.CLASS_COLORS.items())
    labels = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.CLASS_LABELS.items())
    o["erd_nodes"] = shop(f"""SELECT t.tbl AS id, row_count, n_columns AS column_count, table_type, CASE table_type {colors} END AS type_color,
CASE table_type {labels} END AS type_label, (SELECT string_agg(col || CASE WHEN is_pk THEN ' PK' ELSE '' END || coalesce(' ' || fk_to, ''), ', ' ORDER BY ord)
FROM cat c WHERE c.tbl = t.tbl) AS columns FROM tabs t JOIN cls USING (tbl)""")
    o["erd_edges"] = with_views("estate_keys", ctes=[_EDGES]) + """SELECT schema_name AS schema, id, source, target, source_col,
target_col, label, cardinality, false AS inferred FROM edges QUALIFY row_number() OVER (PARTITION BY schema_name, id ORDER BY position) = 1"""
    o["erd_neighbours"] = with_views("estate_keys", ctes=[_EDGES]) + """SELECT schema_name AS schema, source AS "table", target AS neighbour
FROM edges WHERE source <> target UNION SELECT schema_name, target, source FROM edges WHERE source <> target"""
    o["database_overview"] = shop("""SELECT tbl AS "table", row_count, n_columns AS column_count, quality_score, table_type
FROM tabs JOIN cls USING (tbl)""")
    o["overview_totals"] = shop(f"""SELECT count(*) AS total_tables, sum(row_count) AS total_rows, sum(n_columns) AS total_columns,
{_AVG} AS avg_quality_score FROM tabs JOIN cls USING (tbl)""")
    o["summary_kpis"] = shop(f"""SELECT count(*) AS total_tables, sum(n_columns) AS total_columns, sum(row_count) AS total_rows,
{_AVG} AS avg_quality_score, (SELECT count(pii_type) FROM cat) AS pii_columns_count,
(SELECT count(*) FROM integ WHERE status = 'violation') AS fk_violations_count, (SELECT count(*) FROM issues) AS quality_issues_count
FROM tabs JOIN cls USING (tbl)""")
    o["summary_items"] = shop("""SELECT 'pii_columns' AS list, tbl AS "table", col AS "column", pii_type AS detail,
CAST(NULL AS BIGINT) AS orphan_count FROM cat WHERE pii_type IS NOT NULL
UNION ALL SELECT 'fk_violations', tbl, local_col, ref_table, orphan_count FROM integ WHERE status = 'violation'
UNION ALL SELECT 'quality_issues', tbl, NULL, issue, NULL FROM issues""")
    o["report_tables"] = shop("""SELECT t.tbl AS "table", '' AS schema, row_count, n_columns AS column_count, table_type, quality_score, null_pct,
duplicate_pct, (SELECT count(*) FROM integ i WHERE i.tbl = t.tbl AND status = 'violation') AS fk_violation_count,
(SELECT count(*) FROM issues i WHERE i.tbl = t.tbl) AS issue_count, '' AS description FROM tabs t JOIN cls USING (tbl)""")
    o["report_columns"] = shop("""SELECT tbl AS "table", table_type, col AS "column", typ AS type, nullable, is_pk, fk_to IS NOT NULL AS is_fk,
coalesce(fk_to, '') AS fk_to, '' AS default_value, coalesce(pii_type, '') AS pii_type, tags AS lineage_tags,
coalesce(naming_issue, '') AS naming_issue, '' AS description FROM cat""", with_profile=False)
    o["report_profiling"] = shop("""SELECT tbl AS "table", col AS "column", null_count, null_pct, distinct_count, distinct_pct, min_val, max_val,
mean_val, median_val, std_val, q25, q75, outlier_count, outlier_pct, coalesce(detected_pattern, '') AS detected_pattern,
coalesce(pii_detected, '') AS pii_detected, min_length, max_length, avg_length, min_date, max_date, is_constant, is_unique FROM prof""")
    o["report_top_values"] = shop(topped)
    o["report_relationships"] = shop("""SELECT f.tbl AS from_table, cols AS from_columns, f.ref_table AS to_table, ref_cols AS to_columns, f.fk_name,
CASE WHEN string_split(cols, ',')[1] IN (SELECT col FROM pks p WHERE p.tbl = f.tbl) THEN '1:1' ELSE 'N:1' END AS cardinality,
r.orphan_count, coalesce(r.status, '') AS integrity_status FROM fks f LEFT JOIN (
  SELECT f.fk_name AS key_name, f.tbl AS key_tbl, i.orphan_count, i.status, row_number() OVER (PARTITION BY f.tbl, f.fk_name ORDER BY o.inferred, o.position) AS nr
  FROM fks f JOIN integ i ON i.tbl = f.tbl AND list_contains(string_split(f.cols, ','), i.local_col)
  JOIN fks o ON o.tbl = i.tbl AND o.fk_name = i.fk_name) r ON r.key_name = f.fk_name AND r.key_tbl = f.tbl AND r.nr = 1""", with_profile=False)
    o["report_issues"] = shop("""SELECT tbl AS "table", issue, 'profiling' AS category FROM issues
UNION ALL SELECT tbl, 'FK violation: ' || local_col || ' → ' || ref_table || '.' || ref_col || ' (' || orphan_count || ' orphans)', 'referential_integrity'
FROM integ WHERE status = 'violation'""")
    o["pii_report"] = shop("""SELECT c.tbl AS "table", c.col AS "column", coalesce(pii_type, '') AS pii_from_name,
coalesce(pii_detected, '') AS pii_from_values, coalesce(pii_type, pii_detected) AS pii_type
FROM cat c LEFT JOIN prof p ON p.tbl = c.tbl AND p.ord = c.ord WHERE pii_type IS NOT NULL OR pii_detected IS NOT NULL""")
    o["quality_bands"] = shop("""SELECT CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good'
WHEN quality_score >= 50 THEN 'fair' ELSE 'poor' END AS band, count(*) AS count FROM tabs GROUP BY 1""")
    o["null_bands"] = shop("""SELECT CASE WHEN null_pct > 50 THEN 'high' WHEN null_pct > 20 THEN 'medium' ELSE 'low' END AS band,
count(*) AS count FROM prof GROUP BY 1""")
    rem = with_views("remarks", ctes=[f"r AS (SELECT *, {_strip('remark')} AS x FROM remarks)"])
    o["confidence_bands"] = rem + f"""SELECT CASE WHEN c IS NULL THEN 'none' WHEN c >= 80 THEN 'high' WHEN c >= 60 THEN 'good'
WHEN c >= 40 THEN 'fair' ELSE 'low' END AS band, count(*) AS count FROM (SELECT {_conf('x')} AS c FROM r) GROUP BY 1"""
    o["catalog_search"] = with_views(*_ESTATE, ctes=[*_ANNOTATED, _CLASSES]) + f"""SELECT {estc} FROM estate_columns
WHERE contains(lower(column_name), 'date') OR contains(lower(type), 'date')
UNION ALL SELECT {est}, CAST(NULL AS VARCHAR) FROM classes WHERE contains(lower(table_name), 'track') AND table_type = 'junction'"""

    # ------------------------------------------------------------ descriptions
    o["column_hints"] = shop("""SELECT tbl AS "table", col AS "column", array_to_string(hints, ' | ') AS hints FROM hint""", more=_hints())
    o["column_context"] = shop("""SELECT tbl AS "table", col AS "column", line FROM line""", more=[*_hints(), _LINE])
    o["table_context"] = shop("""SELECT tbl AS "table", context FROM ctx""", more=[_CONTEXT])
    from tabscope.operators.describe import COLUMN_REQUEST, TABLE_REQUEST
    o["prompt_batches"] = shop(f"""SELECT tbl AS "table", 'table' AS target, 0 AS columns, 400 AS max_tokens,
'Table: ' || tbl || chr(10) || context || chr(10) || chr(10) || {lit(TABLE_REQUEST)} AS prompt FROM ctx
UNION ALL SELECT tbl, 'columns', count(*), count(*) * 150 + 500, 'Table: ' || tbl || chr(10) || 'Columns:' || chr(10) ||
string_agg(line, chr(10) ORDER BY ord) || chr(10) || chr(10) || {lit(COLUMN_REQUEST)} || chr(10) || 'Names: ' || string_agg(col, ', ' ORDER BY ord)
FROM line GROUP BY tbl""", more=[*_hints(), _LINE, _CONTEXT])
    prints = lambda mode: (f"SELECT schema_name, table_name, substr(sha256({lit(mode)} || table_name || ':' || "
                           "string_agg(column_name, ',' ORDER BY column_name)), 1, 16) AS fingerprint FROM estate_columns GROUP BY schema_name, table_name")
    o["schema_fingerprint"] = from_estate + "\nUNION ALL ".join(
        f"SELECT schema_name AS schema, table_name AS \"table\", fingerprint, {e} AS enriched FROM ({prints(m)})"
        for m, e in (("basic:", "false"), ("enriched:", "true")))
    o["pending_columns"] = with_views("estate_answered", ctes=[f"fp AS ({prints('enriched:')})"]) + f"""
SELECT e.schema_name AS schema, e.table_name AS "table", e.column_name AS "column", fp.fingerprint
FROM estate_columns e JOIN fp USING (schema_name, table_name)
WHERE NOT EXISTS (SELECT 1 FROM estate_answered a JOIN fp f ON f.schema_name = a.schema_name AND f.table_name = a.table_name
  WHERE a.column_name = e.column_name AND a.ordinal % 5 <> 0 AND f.schema_name = e.schema_name AND f.fingerprint = fp.fingerprint)"""
    o["pending_tables"] = with_views("estate_columns", ctes=[f"fp AS ({prints('enriched:')})"]) + \
        f"SELECT {est}, fingerprint FROM fp WHERE length(table_name) % 2 <> 0"
    from tabscope.operators.describe import ONE_COLUMN_REQUEST
    o["single_prompts"] = shop(f"""SELECT c.tbl AS "table", c.col AS "column", 120 AS max_tokens,
'Table: ' || c.tbl || chr(10) || 'Column: ' || c.col || ' [' || typ || ']' || chr(10) ||
coalesce('Known: ' || nullif(array_to_string(hints, ' | '), '') || chr(10), '') || {lit(ONE_COLUMN_REQUEST)} AS prompt
FROM cat c LEFT JOIN hint h ON h.tbl = c.tbl AND h.ord = c.ord WHERE pii_type IS NULL AND tags = ''""", more=_hints())
    o["extend_cache"] = with_views("estate_answered", ctes=[f"fp AS ({prints('enriched:')})", """known AS (
SELECT schema_name, table_name, fingerprint, column_name, bool_or(ordinal = 1) AS anew FROM estate_answered JOIN fp USING (schema_name, table_name)
WHERE ordinal % 5 <> 0 GROUP BY ALL)"""]) + f"""SELECT e.schema_name AS schema, e.table_name AS "table", k.column_name AS "column",
CASE WHEN bool_or(k.anew) THEN 'anew' ELSE 'known' END AS description, CASE WHEN bool_or(k.anew) THEN 70 ELSE 80 END AS confidence
FROM (SELECT schema_name, table_name, fingerprint FROM fp) e JOIN known k ON k.schema_name = e.schema_name AND k.fingerprint = e.fingerprint
GROUP BY e.schema_name, e.table_name, k.column_name"""
    o["parse_responses"] = with_views("answers", ctes=[f"said AS ({_answer_rows()})"]) + \
        """SELECT tbl AS "table", col AS "column", description, confidence FROM said"""
    o["missing_descriptions"] = with_views("answers", ctes=[f"said AS ({_answer_rows()})"]) + """
SELECT CAST(doc_id AS VARCHAR) AS "table", c.col AS "column" FROM answers, (VALUES ('title'), ('body'), ('lang'), ('source')) AS c(col)
WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.tbl = CAST(doc_id AS VARCHAR) AND s.col = c.col)"""
    o["parse_confidence"] = rem + f"SELECT conv_id, turn, {_desc('x')} AS description, {_conf('x')} AS confidence FROM r"
    return o


ORACLES = oracles()
