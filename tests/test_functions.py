"""Scalar functions on tables of cases."""

import pytest
from pyspark.sql import functions as F

from fleetdrift.functions import constraints as con
from fleetdrift.functions import indexes as idx
from fleetdrift.functions.datatypes import CANONICAL_TYPES, TYPE_ALIASES, normalize_type
from fleetdrift.functions.names import glob_to_regex, is_user_schema, quote_ident

# Spellings and the names they stand for, with the modifiers that fit them.
SPELLINGS = {
    "int8": ("bigint", [""]),
    "Float4": ("real", [""]),
    "decimal": ("numeric", ["", "(7)", "(12,5)"]),
    "VarChar": ("character varying", ["", "(31)"]),
    "bpchar": ("character", ["", "(2)"]),
    "bit varying": ("bit varying", ["", "(9)"]),
}
BLANKS = [("", ""), ("  ", ""), ("\t", " \n")]
DIMENSIONS = ["", "[]", "[4]", "[][2]"]


def type_cases():
    """Spelling x modifier x dimensions x blanks, each text with the parts it must come back as."""
    for spelling, (name, modifiers) in SPELLINGS.items():
        for modifier in modifiers:
            for dimensions in DIMENSIONS:
                for before, behind in BLANKS:
                    yield before + spelling + modifier + dimensions + behind, name + modifier + dimensions
        # an underscore in front is one more dimension behind
        if " " not in spelling:
            for dimensions in ("", "[4]"):
                yield f"_{spelling.lower()}{dimensions}", f"{name}{dimensions}[]"
            yield f"_{spelling.lower()}[]", f"{name}[]"
    # the precision of a zoned time stands before the zone, wherever it was written
    for spelling, name in (("timestamptz", "timestamp"), ("timetz", "time")):
        for precision in ("", "(0)", "(4)"):
            for dimensions in DIMENSIONS:
                yield spelling + precision + dimensions, f"{name}{precision} with time zone{dimensions}"
    yield "hour with time zone(2)", "hour(2) with time zone"
    # names outside the table stay as they are, also with blanks inside a modifier
    for name in ("Currency", "shop.Kind", "Box3D(Poly,7)", '"char"', "__twice", "varbit", ""):
        yield name, name
    yield '\n "char"', '"char"'
    yield "decimal ( 6 )", "numeric( 6 )"
    yield " _int8", "_int8"


def values(spark, texts, build):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize_type(spark):
    cases = list(type_cases()) + list(TYPE_ALIASES.items()) + [(c, c) for c in CANONICAL_TYPES]
    assert values(spark, [c[0] for c in cases], normalize_type) == [c[1] for c in cases]


def test_normalize_type_keeps_null(spark):
    assert values(spark, [None], normalize_type) == [None]


def test_number_of_known_types():
    assert len(TYPE_ALIASES) + len(CANONICAL_TYPES) == 54


@pytest.mark.parametrize(
    ("text", "strict", "kept"),
    [
        ("public", False, True),
        ("pg_toast", False, False),
        ("pgboss", False, False),
        ("pgboss", True, True),
        ("pg", False, True),
        ("information_schema", True, False),
        ("PG_x", False, True),
    ],
)
def test_user_schema(spark, text, strict, kept):
    assert values(spark, [text], lambda t: is_user_schema(t, strict=strict)) == [kept]


def test_columns_of_a_definition(spark):
    texts = ['PRIMARY KEY (a, "B c")', "UNIQUE (a)", "nothing", "PRIMARY KEY ()"]
    assert values(spark, texts, con.parse_columns) == [["a", "B c"], ["a"], None, None]
    assert values(spark, ["nothing"], con.key_columns) == [["?"]]


def test_check(spark):
    texts = ["CHECK ((weight < 9))", "CHECK ((x < 9)) NO INHERIT", "check\t((a\n< 9))"]
    assert values(spark, texts, con.check_expression) == ["(weight < 9)", "CHECK ((x < 9)) NO INHERIT", "(a\n< 9)"]
    assert values(spark, texts, con.check_no_inherit) == [False, True, False]


def test_foreign_key(spark):
    none = F.lit(None).cast("string")
    texts = [
        "FOREIGN KEY (depot) REFERENCES stock.depots (code)",
        'foreign key (x, "Y") references "s"."t"(k, l) ON UPDATE SET NULL ON DELETE CASCADE',
        "FOREIGN KEY (x) REFERENCES t (k) MATCH FULL",
        "unreadable",
    ]
    assert values(spark, texts, con.fk_columns) == [["depot"], ["x", "Y"], ["x"], ["?"]]
    assert values(spark, texts, con.fk_ref_columns) == [["code"], ["k", "l"], ["k"], ["?"]]
    targets = values(spark, texts, lambda t: con.fk_target(none, none, t))
    assert [tuple(t) for t in targets] == [("stock", "depots"), ("s", "t"), ("public", "t"), ("public", "?")]
    known = values(spark, texts[:1], lambda t: con.fk_target(F.lit("a"), F.lit("b"), t))
    assert tuple(known[0]) == ("a", "b")
    assert values(spark, texts, lambda t: con.fk_action(t, "DELETE")) == [
        "no_action", "cascade", "no_action", "no_action",
    ]
    assert values(spark, texts, lambda t: con.fk_action(t, "UPDATE"))[1] == "set_null"
    assert values(spark, texts, con.fk_match) == ["simple", "simple", "full", "simple"]


def test_exclusion(spark):
    texts = ["EXCLUDE USING spgist (dock WITH =, span WITH &&)", "EXCLUDE USING gist ((f(a, c)) WITH =) WHERE ((b < 9))", "odd"]
    assert values(spark, texts, con.exclusion_method) == ["spgist", "gist", "gist"]
    assert values(spark, texts, con.exclusion_predicate) == [None, "(b < 9)", None]
    elements = values(spark, texts, lambda t: con.exclusion_elements(con.exclusion_body(t)))
    # the comma printed behind an operator stays with it
    assert [[tuple(e)[:2] for e in es] for es in elements] == [[("dock", "=,"), ("span", "&&")], [("(f(a, c))", "=")], [("?", "=")]]


def test_index_keys(spark):
    cases = {
        "CREATE INDEX j ON u USING hash (dock)": [("dock", None, None, "asc", None)],
        "CREATE INDEX j ON u (dock, span)": [
            ("dock", None, None, "asc", None), ("span", None, None, "asc", None),
        ],
        "x (span DESC)": [("span", None, None, "desc", None)],
        "x (span DESC NULLS FIRST)": [("span", None, None, "desc", "first")],
        "x ((abs(weight)) desc nulls last)": [(None, "(abs(weight)) desc nulls last", None, "desc", "last")],
        # a call without outer parentheses is read as a column name
        "x (abs(weight))": [("abs(weight)", None, None, "asc", None)],
        'x ("A" text_ops) INCLUDE (z) WHERE (q)': [("A", None, "text_ops", "asc", None)],
        "no parentheses": [("?", None, None, "asc", None)],
        "x (a, b": [("?", None, None, "asc", None)],
        "x ()": [("?", None, None, "asc", None)],
        "x (desc)": [("?", None, None, "desc", None)],
    }
    found = values(spark, list(cases), idx.index_keys)
    assert [[tuple(k) for k in keys] for keys in found] == list(cases.values())


def test_paren_body_and_split(spark):
    texts = ["f(a, g(b, c)) (d)", "(a", "a)", ")((b)", "()"]
    assert values(spark, texts, idx.paren_body) == ["a, g(b, c)", None, None, "b", ""]
    parts = ["a, g(b, c), d", "", "a,", " ", ",a"]
    assert values(spark, parts, idx.split_top_level) == [["a", "g(b, c)", "d"], [], ["a"], [""], ["", "a"]]


def test_index_method(spark):
    assert values(spark, ["btree", "HASH", "custom_am"], idx.index_method) == ["btree", "hash", "btree"]


def test_glob_and_quoting(spark):
    names = ["temp_1", "tempx1", "a.b", "a1b", "x\\y"]

    def matches(glob):
        return values(spark, names, lambda t: F.regexp_like(t, glob_to_regex(F.lit(glob))))

    assert matches("temp_*") == [True, False, False, False, False]
    assert matches("a.b") == [False, False, True, False, False]
    assert matches("a?b") == [False, False, True, True, False]
    assert matches("x\\y") == [False, False, False, False, True]
    assert values(spark, ['a"b'], quote_ident) == ['"a""b"']


@pytest.mark.parametrize(
    ("data_type", "good", "bad"),
    [
        ("varchar(3)", ["abc", "abc  ", ""], ["abcd"]),
        ("char(2)", ["ab ", "a"], ["abc"]),
        ("numeric(4,1)", ["999.94", " 1 ", "-0.04", "1e2"], ["999.95", "1000", "x", "1,5", "NaN!"]),
        ("decimal(40,2)", ["1" * 38 + ".5"], ["1" * 39]),
        ("numeric", ["1e400", ".5"], ["", "."]),
        ("uuid", ["a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "{A0EEBC999C0B4EF8BB6D6BB9BD380A11}"], ["a0eebc99", "g0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"]),
        ("interval", ["1 day", "2 hours 3 mins ago", "-1:30", "P1DT2H", "1 year 2 days 03:04:05.6"], ["", "day", "1 dog", "PT"]),
        ("time without time zone", ["23:59", "00:00:00.5"], ["25:00", "12"]),
        ("bool", ["yes", "OFF", "1"], ["2", "maybe"]),
        ("int2", ["-32768", "+5"], ["32768", "1.0", "a"]),
        ("int4[]", ["{1,NULL, 2}", "{}", '{"3"}'], ["{1,x}", "1,2", "{1"]),
        ("varchar(2)[]", ['{ab,"a,"}'], ['{abc}']),
        ("jsonb", ['{"a": [1]}', "1"], ["{a}", ""]),
        ("timestamp with time zone", ["2024-02-29 10:00:00+02"], ["2023-02-29 10:00:00", "soon"]),
        ("text", ["", "x"], []),
    ],
)
def test_values_that_fit_a_type(spark, data_type, good, bad):
    from fleetdrift.operators import rowchecks

    rows = spark.createDataFrame([(v,) for v in [*good, *bad, None]], "v string")
    assert sorted(r.v for r in rowchecks.cast_violations(rows, "v", data_type).collect()) == sorted(bad)


def test_types_without_a_cast_test(spark):
    from fleetdrift.operators import rowchecks

    for text in ("geometry", "integer[][]", "numeric(3"):
        with pytest.raises(ValueError):
            rowchecks.cast_violations(spark.createDataFrame([("1",)], "v string"), "v", text)
