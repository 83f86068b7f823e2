"""Structure: what imports what, and the parts that need no rows."""

import ast
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_nothing_imports_the_llm_subpackage():
    for path in (ROOT / "colonnade").rglob("*.py"):
        if "llm" not in path.parts:
            assert not [m for m in imports(path) if m.startswith("colonnade.llm")], path


def test_scalar_libraries_know_no_tables():
    for path in (ROOT / "colonnade/functions").glob("*.py"):
        assert not [m for m in imports(path) if m in ("colonnade.table", "colonnade.vector")], path


def test_names():
    from colonnade.naming import accessors, sanitize, unique_names

    assert sanitize("Group Key") == "group_key" and sanitize("2x") == "c2x" and sanitize("a__3") == "a__3_"
    assert sanitize("class") == "class_" and sanitize("!!") is None
    assert accessors(["a", "A", None]) == {"a": 0, "a__1": 1, "col2_": 2}
    assert unique_names(["x", "x", "y", "x"]) == ["x", "x2", "y", "x3"]


def test_every_query_has_a_function_and_most_have_sql():
    from colonnade.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.oracle_sql()) >= 0.9 * len(catalogue.queries())


def test_streams(spark, tmp_path):
    from colonnade.streaming import stream_table

    spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0)], "k int, v double").write.parquet(f"{tmp_path}/in")
    stream = stream_table(spark.readStream.schema("k int, v double").parquet(f"{tmp_path}/in"))
    out = stream[stream.v > 1]
    out = out["k",] >> {"double": out.v * 2}
    query = out.to_spark().writeStream.format("memory").queryName("streamed").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("streamed").collect())) == [(1, 4.0), (3, 10.0)]


def test_decimals(spark):
    from colonnade import Vector

    v = Vector([Decimal("1.50"), None, Decimal("-2.25")])
    assert v.schema() == (Decimal, True)
    assert (v + 1).to_list() == [Decimal("2.50"), None, Decimal("-1.25")]
    assert (v > 0).to_list() == [True, None, False]
    assert v.sum() == Decimal("-0.75")


@pytest.mark.parametrize("name", ["q_pricing_summary", "q_full_join", "q_window_composed", "q_quantiles_exclusive", "q_semi_mask"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    from colonnade.plans import catalogue

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = catalogue.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    result = con.execute(catalogue.oracle_sql()[name])
    places = [[c[0] for c in result.description].index(c) for c in columns]
    shown = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
    want = sorted(tuple(shown(r[p]) for p in places) for r in result.fetchall())
    assert sorted(tuple(map(shown, r)) for r in df.select(*columns).collect()) == want


def beside_sql(spark, name, folder):
    """Rows of a query and of its SQL over the tables of a folder, sorted."""
    import duckdb

    from colonnade.plans import catalogue

    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    result = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    rows = catalogue.queries()[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(repr, map(tuple, rows))), sorted(map(repr, result.fetchall()))


def test_float_edges_where_the_logarithm_is_inexact(spark, tmp_path):
    """Values whose third decimal turns on the digits that the SQL's logarithm loses."""
    import duckdb

    duckdb.execute(f"""copy (select i as event_id, i / 100.0::DOUBLE as value from range(166000, 168000) r(i)
      union all select i, i * 0.0137::DOUBLE from range(40000) r(i)) to '{tmp_path}/events.parquet'""")
    got, want = beside_sql(spark, "q_float_edges", tmp_path)
    assert len(got) == 42000 and got == want


def test_norms_of_a_product_that_underflows(spark, tmp_path):
    import duckdb

    from colonnade import Vector

    assert list(map(repr, (Vector(x).math.prod() for x in ([0.9] * 9999, [-0.9] * 9999, [0.5] * 1074, [0.5, 0.0])))) == ["0.0", "-0.0", "5e-324", "0.0"]
    duckdb.execute(f"""copy (select i as p_partkey, 'Brand#' || (i % 2) as p_brand, (i % 50)::INTEGER as p_size,
      CASE WHEN i % 2 = 0 THEN 900.0 ELSE 999.9 END::DOUBLE as p_retailprice from range(20000) r(i)) to '{tmp_path}/part.parquet'""")
    got, want = beside_sql(spark, "q_norms", tmp_path)
    # Of so few rows the SQL makes one product, which sticks above zero; of many it is 0 and its logarithm -inf.
    assert got[0].endswith(", -inf)") and got[0].split(",")[:3] == want[0].split(",")[:3] and got[1] == want[1]
