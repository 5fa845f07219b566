import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths, symbols

P = "scip-typescript npm test 1.0 src/`widget.ts`/"
CASES = [
    # symbol, leaf, short, kind, variable, type, runtime edge, alias base, value base, file
    (P + "Widget#run().", "run", "run", "method", False, False, True, None, "run", "src/widget.ts"),
    (P + "greet().", "greet", "greet", "function", False, False, True, None, "greet", "src/widget.ts"),
    (P + "Widget#", "Widget", "Widget", "class", False, True, False, None, "Widget", "src/widget.ts"),
    (P + "options#", "options", "options", "unknown", False, True, False, None, "options", "src/widget.ts"),
    (P + "Options#typeLiteral0:verbose.", "verbose", "verbose", "property", False, True, False, None, None, "src/widget.ts"),
    (P, "", "(module)", "unknown", False, False, False, None, None, "src/widget.ts"),
    (P + "greet().(name)", "greet().(name)", "greet().(name)", "unknown", False, False, True, None, None, "src/widget.ts"),
    (P + "limit.", "limit", "limit", "unknown", True, False, True, None, None, "src/widget.ts"),
    (P + "Foo#bar.", "bar", "bar", "unknown", True, True, False, None, None, "src/widget.ts"),
    (P + "greet0:", "", "greet0:", "unknown", False, False, True, "greet", None, "src/widget.ts"),
    (P + "Widget#`<get>size`().", "size", "size", "method", False, False, True, None, "size", "src/widget.ts"),
    ("scip-python python pkg 0.1 app/models.py/User#save().", "save", "save", "method", False, False, True, None, "save", "app/models.py"),
]


def test_symbol_shapes(spark):
    s = F.col("s")
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, s string")
    out = df.select("i", "s", symbols.leaf_name(s), symbols.short_name(s), symbols.kind(s), symbols.is_variable(s), symbols.is_type(s), symbols.is_runtime_edge(s), symbols.alias_base(s), symbols.value_base(s), symbols.file_path(s))
    for row in out.orderBy("i").collect():
        assert tuple(row)[1:] == CASES[row.i]


@pytest.mark.parametrize(
    ("name", "symbol", "match"),
    [
        ("Widget.run", P + "Widget#run().", True),
        ("Other.run", P + "Widget#run().", False),
        ("Options.verbose", P + "Options#typeLiteral0:verbose.", True),
        ("src.Widget.run", P + "Widget#run().", True),
        ("lib.Widget.run", P + "Widget#run().", False),
        ("models.User.save", "s p k 0.1 app/models.py/User#save().", True),
        ("a.b.c", "s p k 0 a.b/c().", True),
        ("run", P + "Widget#run().", True),
    ],
)
def test_qualifiers(spark, name, symbol, match):
    parts, leaf = symbols.parse_qualified(name)
    row = spark.createDataFrame([(symbol,)], "s string").select(symbols.matches_qualifier(F.col("s"), parts, leaf)).first()
    assert row[0] is match


def test_members_are_immediate(spark):
    parent = P + "Widget#"
    rows = [("run().", True), ("typeLiteral0:a.", True), ("Inner#", True), ("Inner#deep().", False), ("run().(x)", True), ("size.", True), ("", False)]
    df = spark.createDataFrame([(parent + tail, want) for tail, want in rows] + [("elsewhere", False)], "s string, want boolean")
    assert df.where(symbols.is_direct_member(F.lit(parent), F.col("s")) != F.col("want")).count() == 0


def test_paths(spark):
    rows = [
        ("tests/a.ts", True), ("test/a.ts", True), ("src/tests/a.ts", True), ("src/__tests__/a.ts", True), ("src/a.test.ts", True), ("src/a.spec.tsx", True), ("pkg/test_a.py", True), ("conftest.py", True),
        ("src/a.ts", False), ("src/contests/a.ts", False), ("src/test_a.ts", False), ("src/latest/a.ts", False), ("SRC\\Tests\\A.ts", True),
    ]
    df = spark.createDataFrame(rows, "p string, want boolean")
    assert df.where(paths.is_test(F.col("p")) != F.col("want")).count() == 0


def test_whole_words(spark):
    rows = [("a run(b)", "run", True), ("rerun()", "run", False), ("$run", "run", False), ("run", "run", True), ("naïverun", "run", False), ("x = a.b", "a.b", True), ("xxx", "", False), ("a+b", "a+b", True)]
    df = spark.createDataFrame(rows, "line string, word string, want boolean")
    assert df.where(symbols.has_word(F.col("line"), F.col("word")) != F.col("want")).count() == 0


def test_ranges_scopes_and_targets(spark, tmp_path):
    df = spark.createDataFrame([(0, 4, "1:5"), (3, None, "4:?"), (None, None, "??")], "a int, b int, want string")
    assert df.where(symbols.line_range(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    assert symbols.escape_like("a_b%c\\") == "a\\_b\\%c\\\\"
    assert symbols.looks_like_file("a/b") and symbols.looks_like_file("x.TSX") and not symbols.looks_like_file("Widget.run")
    assert paths.normalized_scope("src/../src/a", tmp_path) == "src/a" and paths.normalized_scope(".", tmp_path) == "." and paths.normalized_scope(None, tmp_path) is None
    with pytest.raises(ValueError):
        paths.normalized_scope("../other", tmp_path)
