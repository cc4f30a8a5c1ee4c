"""One hit and one miss per rule."""
import pytest
from pyspark.sql import functions as F

from tabscope.functions import exprs as E, rules


def ask(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", expr(F.col("v")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


UUID = "123e4567-e89b-12d3-a456-426614174000"
VALUE_VECTORS = {
    "UUID": (UUID, UUID[:-1]), "Email": ("a.b+c@x-y.org", "a@b"), "URL": ("http://x", "ftp://x"),
    "Date String": ("2024-01-31T10:00", "31-01-2024x"), "Phone": ("+1 (555) 123-45", "12345"),
    "IP Address": ("10.0.0.1", "10.0.0"), "JSON": ('{"a":\n1}', "{x"),
}


def test_value_patterns(spark):
    for label, pattern in rules.VALUE_PATTERNS:
        hit, miss = VALUE_VECTORS[label]
        assert ask(spark, [hit, miss], lambda v: v.rlike(pattern)) == [True, False], label
    # an address of digits is a phone number for the pattern rules, and an address for the personal data rules
    assert ask(spark, ["10.0.0.1"], lambda v: E.first_match(v, rules.VALUE_PATTERNS)) == ["Phone"]
    assert ask(spark, ["10.0.0.1", "123-45-6789", "2024-01-31"],
               lambda v: E.first_match(v, rules.PII_VALUE_PATTERNS)) == ["IP Address", "SSN", "Phone"]


PII_NAMES = {
    "user_email": "Email", "Mobile": "Phone", "ssn": "SSN", "passport_no": "Passport", "card_number": "Credit Card",
    "home address": "Address", "date_of_birth": "Date of Birth", "ip": "IP Address", "surname": "Person Name",
    "wage": "Financial", "nid": "National ID", "user_pwd": "Password", "vat": "Tax ID", "sex": "Demographic",
    "religion": "Demographic", "longitude": "Location", "quantity": None, "pants": None, "wages_paid": None,
    "billing_address": None,
}


def test_pii_names(spark):
    assert ask(spark, list(PII_NAMES), E.pii_from_name) == list(PII_NAMES.values())


TAGS = {
    "created_at": ["temporal", "audit", "created_at"], "LAST_UPDATED": ["temporal", "audit", "updated_at"],
    "deleted_at": ["temporal", "audit", "soft_delete"], "inserted_by": ["audit", "created_by"],
    "changed_by": ["audit", "updated_by"], "removed_by": ["audit", "deleted_by"],
    "is_deleted": ["soft_delete", "boolean_flag"], "is_active": ["status", "soft_delete", "boolean_flag"],
    "phase": ["status"], "etag": ["versioning"], "customer_id": ["surrogate_key"],
    "external_id": ["surrogate_key", "natural_key"], "unit_price": ["financial"], "geo_hash": ["geographic"],
    "ship_date": ["temporal"], "row_yn": ["boolean_flag"], "colour": [], "codex": [],
}


def test_lineage_tags(spark):
    assert ask(spark, list(TAGS), E.lineage_tags) == list(TAGS.values())


def test_naming_styles(spark):
    names = {"order_id": "snake_case", "orderId": "camelCase", "OrderId": "PascalCase", "ORDER_ID": "UPPER_SNAKE",
             "ID": "PascalCase", "A": "UPPER_SNAKE", "x-y": None, "_id": None, "Order_Id": None, "a_": None, "a\n": None}
    assert ask(spark, list(names), E.naming_style) == list(names.values())


def test_variants_and_prefix(spark):
    assert ask(spark, ["order", "boxes", "categories", "category", "class", "items"], E.name_variants) == [
        ["order", "orders"], ["boxes", "box", "boxess"], ["categories", "category", "categoriess"],
        ["category", "categorys", "categories"], ["class", "classs"], ["items", "item", "itemss"]]
    assert ask(spark, ["Order_ID", "categoryid", "paid", "id", "_id", "idx"], E.reference_prefix) == [
        "order", "category", "pa", None, None, None]


def test_confidence(spark):
    texts = ["Great description [85]", "Just text", "Confidence: 72\n", "a [999]", "b confidence 7. ", "[5] tail", "",
             None, "two\nlines\n\n[72]\n", "x [1234]", " y [3] "]
    assert ask(spark, texts, E.confidence_of) == [85, None, 72, 100, 7, None, None, None, 72, None, 3]
    assert ask(spark, texts, E.description_of) == [
        "Great description", "Just text", "", "a", "b", "[5] tail", "", "", "two\nlines", "x [1234]", "y"]


def test_table_filter(spark):
    names = ["part", "PARTS", "orders", "order_lines", "x"]
    keep = lambda f: [n for n, k in zip(names, ask(spark, names, lambda v: E.matches_filter(v, f))) if k]
    assert keep("part, ORDER.*") == ["part", "orders", "order_lines"]
    assert keep("a|x") == ["x"] and keep("") == names and keep(None) == names and keep(" , ") == []


@pytest.mark.parametrize("n,total,digits,want", [
    (1, 3, 2, 33.33), (2, 3, 2, 66.67), (1, 8, 1, 12.5), (1, 800, 2, 0.13), (0, 0, 2, 0.0), (5, 5, 2, 100.0),
    (10 ** 15 * 2 + 1, 3 * 10 ** 15, 2, 66.67)])
def test_percentages(spark, n, total, digits, want):
    row = spark.createDataFrame([(n, total)], "n bigint, t bigint").select(E.pct(F.col("n"), F.col("t"), digits).alias("p"))
    assert row.first()["p"] == want


def test_double_text(spark):
    values = [1.0, 0.05, 1e7, 123456789.25, 5e-4, 1e16, 0.0, -1.5e8]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(E.double_text(F.col("v")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["1.0", "0.05", "10000000.0", "123456789.25", "0.0005", "1.0E16", "0.0", "-150000000.0"]
