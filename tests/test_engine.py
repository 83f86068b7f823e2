"""Values, nulls, order and errors of vectors and tables, against plain Python."""

import datetime as dt
import math
import random
import statistics
import warnings

import pytest

from colonnade import (
    ColumnIndexError, ColumnKeyError, ColumnTypeError, ColumnValueError, EmptyReductionWarning, Table, Vector, read_csv, read_parquet,
)

pytestmark = pytest.mark.usefixtures("spark")


@pytest.fixture
def deals():
    return Table({"k": ["a", "b", "a", None], "v": [1, 2, None, 4], "f": [1.5, -2.0, 3.0, 0.5]})


def lanes(values, fn):
    return [None if v is None else fn(v) for v in values]


def test_inference_and_promotion():
    assert Vector([1, 2.5]).schema() == (float, False)
    assert Vector([None, 1]).schema() == (int, True)
    assert Vector([dt.date(2024, 1, 1), dt.datetime(2024, 1, 2)]).schema()[0] is dt.datetime
    assert Vector([1, "x"]).schema()[0] is object
    with pytest.raises(ColumnTypeError):
        Vector([1, None], dtype=int)


def test_arithmetic_follows_python():
    values = [-7, -6, 6, 7, None]
    v = Vector(values)
    for b in (-3, -2, 2, 3):
        assert (v % b).to_list() == lanes(values, lambda a: a % b)
        assert (v // b).to_list() == lanes(values, lambda a: a // b)
        assert (v / b).to_list() == lanes(values, lambda a: a / b)
    assert (v**3).to_list() == lanes(values, lambda a: a**3)
    assert (10 - v).to_list() == lanes(values, lambda a: 10 - a)
    assert abs(-v).to_list() == lanes(values, abs)
    assert (Vector(["a", "b"]) + "x").to_list() == ["ax", "bx"]
    assert (Vector([True, False]) + 1).to_list() == [2, 1]
    with pytest.raises(ColumnTypeError):
        v + "x"
    with pytest.raises(Exception, match="(?i)zero"):
        (v / 0).to_list()
    with pytest.raises(Exception, match="(?i)overflow"):
        (Vector([2**62]) * 4).to_list()


def test_large_powers_are_exact():
    assert (Vector([3]) ** 39).to_list() == [3**39]
    assert (Vector([2]) ** 62).to_list() == [2**62]


def test_comparison_null_and_nan():
    v = Vector([1.0, None, float("nan")])
    assert (v == v).to_list() == [True, None, False]
    assert (v != 1.0).to_list() == [False, None, True]
    assert (v < 5).to_list() == [True, None, False]
    with pytest.warns(UserWarning):
        assert (v == None).to_list() == [False, True, False]  # noqa: E711
    with pytest.raises(ColumnTypeError):
        bool(v)


def test_kleene():
    a, b = Vector([True, True, False, None]), Vector([None, False, None, None])
    assert (a & b).to_list() == [None, False, False, None]
    assert (a | b).to_list() == [True, True, None, None]
    assert (a ^ b).to_list() == [None, True, None, None]
    assert (~a).to_list() == [False, False, True, None]


def test_shifts():
    v = Vector([1, -8, None])
    assert v.bit_lshift(3).to_list() == [8, -64, None]
    assert v.bit_rshift(70).to_list() == [0, -1, None]
    with pytest.raises(Exception, match="overflow"):
        v.bit_lshift(63).to_list()
    with pytest.raises(Exception, match="negative"):
        v.bit_lshift(-1).to_list()


def test_membership(deals):
    assert deals.v.is_in([1, 9]).to_list() == [True, False, None, False]
    assert deals.v.is_in([1, None]).to_list() == [True, False, True, False]
    with pytest.raises(ColumnTypeError):
        deals.k.is_in("ab")
    with pytest.warns(UserWarning):
        deals.v.is_in(["x"])
    other = Table({"k": ["a", None]})
    assert deals[deals.k.is_in(other.k)].v.to_list() == [1, None]


def test_null_tools(deals):
    assert deals.v.fillna(0).to_list() == [1, 2, 0, 4]
    assert deals.v.fillna(0).schema() == (int, False)
    assert deals.v.fillna(0.5).schema()[0] is float
    with pytest.raises(ColumnValueError):
        deals.v.fillna("x")
    assert deals.v.coalesce(deals.f).to_list() == [1.0, 2.0, 3.0, 4.0]
    assert len(deals.dropna()) == 2
    assert deals.v.is_na().to_list() == [False, False, True, False]


def test_casts():
    assert Vector([True, None]).cast(str).to_list() == ["True", None]
    assert Vector(["1", " 2 "]).cast(int).to_list() == [1, 2]
    assert Vector([1e16, 0.1]).cast(str).to_list() == ["1e+16", "0.1"]
    assert Vector(["2024-02-29"]).cast(dt.date).to_list() == [dt.date(2024, 2, 29)]
    assert Vector(["", "x"]).cast(bool).to_list() == [False, True]
    assert Vector([1, 2]).cast(lambda x: x * 1.5).to_list() == [1.5, 3.0]
    with pytest.raises(Exception):
        Vector(["x"]).cast(int).to_list()


def test_selection(deals):
    assert deals[deals.v > 1].to_dict() == {"k": ["b", None], "v": [2, 4], "f": [-2.0, 0.5]}
    assert deals[1:3].v.to_list() == [2, None]
    assert deals[::-2].v.to_list() == [4, 2]
    assert deals[[3, 0, 0]].v.to_list() == [4, 1, 1]
    assert deals.v[-1] == 4 and deals[0].k == "a"
    assert deals[deals.v > 1, "f"].to_list() == [-2.0, 0.5]
    assert deals[0:2, ["k"]].to_dict() == {"k": ["a", "b"]}
    with pytest.raises(ColumnIndexError):
        deals.v[9]
    with pytest.raises(ColumnKeyError):
        deals["nope"]
    with pytest.raises(ColumnValueError):
        deals[[True, False]]


def test_columns(deals):
    assert (deals >> {"w": deals.v * 2}).w.to_list() == [2, 4, None, 8]
    with pytest.warns(UserWarning):
        twice = deals >> {"v": deals.f}
    assert twice.v__3.to_list() == deals.f.to_list()
    assert deals.drop("f").column_names() == ["k", "v"]
    assert deals.rename_columns({"k": "v", "v": "k"}).column_names() == ["v", "k", "f"]
    assert Table({"A b!": [1]}).a_b.to_list() == [1]
    with pytest.raises(ColumnKeyError):
        deals.drop("nope")
    with pytest.raises(ColumnValueError):
        deals >> {"w": [1, 2]}
    assert (deals >> {"w": [9, 8, 7, 6]}).w.to_list() == [9, 8, 7, 6]


def test_joins():
    left = Table({"id": [3, 1, None, 2], "a": [30, 10, 0, 20]})
    right = Table({"id": [1, 2, 4, None], "b": ["x", "y", "z", "n"]})
    assert left.inner_join(right, "id", "id").to_dict() == {"id": [1, 2], "a": [10, 20], "b": ["x", "y"]}
    assert left.left_join(right, "id", "id").b.to_list() == [None, "x", None, "y"]
    full = left.full_join(right, "id", "id")
    assert full.id.to_list() == [3, 1, None, 2, None, None] and full.b.to_list()[4:] == ["z", "n"]
    assert left.left_join(right, "id", "id").b.schema() == (str, True)
    twice = Table({"id": [1, 1], "b": ["p", "q"]})
    with pytest.raises(ColumnValueError, match="right"):
        left.inner_join(twice, "id", "id")
    assert left.inner_join(twice, "id", "id", expect_right_unique=False).b.to_list() == ["p", "q"]
    with pytest.raises(ColumnTypeError):
        left.inner_join(right, "id", "b")
    with pytest.raises(ColumnTypeError):
        Table({"x": [1.0]}).inner_join(Table({"x": [1.0]}), "x", "x")


def test_groups(deals):
    out = deals.aggregate("k", {"s": deals.v.sum, "n": len, "m": deals.f.mean, "h": lambda g: g.v.sum() / 2,
                                "u": lambda g: len(g.v.unique())})
    assert out.to_dict() == {"k": ["a", "b", None], "s": [1, 2, 4], "n": [2, 1, 1], "m": [2.25, -2.0, 0.5],
                             "h": [0.5, 1.0, 2.0], "u": [2, 1, 1]}
    assert deals.aggregate({"n": len, "c": deals.v.count}).to_dict() == {"n": [4], "c": [3]}
    assert deals[deals.v > 99].aggregate({"s": deals.v.sum} if False else {"n": len}).to_dict() == {"n": [0]}
    assert deals.window("k", {"s": deals.v.sum, "md": deals.f.stats.median}).to_dict() == {
        "k": ["a", "b", "a", None], "s": [1, 2, 1, 4], "md": [2.25, -2.0, 2.25, 0.5]
    }
    assert deals.aggregate("k", {"x_": deals["v", "f"].last}).to_dict() == {
        "k": ["a", "b", None], "x_v": [None, 2, 4], "x_f": [3.0, -2.0, 0.5]
    }
    with pytest.raises(ColumnTypeError):
        deals.aggregate("k", {"s": deals.v.sum()})
    with pytest.raises(ColumnTypeError):
        deals.window(None, {"s": deals.v.sum})


def test_empty_verdicts():
    t = Table({"k": ["a", "b"], "x": [None, True]})
    with pytest.warns(EmptyReductionWarning):
        assert t[t.k == "a"].x.to_object().cast(bool).all() is True
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert Vector([1, 0]).all() is False and Vector([1, 0]).any() is True


def test_reductions():
    xs = [5, 1, 4, 1, None]
    v, present = Vector(xs), [5, 1, 4, 1]
    assert (v.sum(), v.count(), v.min(), v.max()) == (11, 4, 1, 5)
    assert v.mean() == 2.75 and math.isclose(v.stdev(), statistics.stdev(present))
    assert v.first() == 5 and v.last() is None
    s = v.stats
    assert s.median() == 2.5 and s.median_low() == 1 and s.median_high() == 4
    assert s.mode() == 1 and s.multimode() == [1]
    for n in (2, 4, 7, 10):
        assert s.quantiles(n=n) == pytest.approx(statistics.quantiles(present, n=n))
        assert s.quantiles(n=n, method="inclusive") == pytest.approx(statistics.quantiles(present, n=n, method="inclusive"))
    assert s.geometric_mean() == pytest.approx(statistics.geometric_mean(present))
    assert s.harmonic_mean() == pytest.approx(statistics.harmonic_mean(present))
    assert s.pvariance() == pytest.approx(statistics.pvariance(present))
    assert v.math.prod() == 20 and v.math.gcd() == 1 and v.math.lcm() == 20
    assert v.math.hypot() == pytest.approx(math.hypot(*present))
    assert Vector([0.1] * 10).math.fsum() == math.fsum([0.1] * 10)
    empty = Vector([None, 1])[Vector([True, False])]
    assert empty.sum() == 0 and empty.max() is None and empty.math.prod() == 1
    assert Vector([4.0]).stdev(population=True) is None and Vector([4.0]).stats.pstdev() == 0.0
    a = Table({"x": [1, 2, 3, None], "y": [2, 4, 7, 1]})
    assert a.x.stats.correlation(a.y) == pytest.approx(statistics.correlation([1, 2, 3], [2, 4, 7]))
    assert a.x.stats.linear_regression(a.y) == pytest.approx(list(statistics.linear_regression([1, 2, 3], [2, 4, 7])))
    assert a.x.math.dist(a.y) == pytest.approx(math.dist([1, 2, 3], [2, 4, 7]))


def test_order_and_sets():
    t = Table({"a": [2, None, 1, 2], "b": ["x", "y", "z", "w"]})
    assert t.sort_by("a").b.to_list() == ["z", "x", "w", "y"]
    assert t.sort_by("a", reverse=True).b.to_list() == ["x", "w", "z", "y"]
    assert t.sort_by("a", na_last=False)[:2].b.to_list() == ["y", "z"]
    u = Table({"a": [1, 1, None, None], "b": ["p", "p", "q", "q"]})
    assert u.unique().to_dict() == {"a": [1, None], "b": ["p", "q"]}
    assert (u << u[:1]).a.to_list() == [1, 1, None, None, 1]
    assert (Vector([1, 2]) << 2.5).to_list() == [1.0, 2.0, 2.5]
    assert Vector([3, None, 3, 1]).unique().to_list() == [3, None, 1]
    srt = t.sort_by("b")
    assert srt.aggregate({"last": srt.a.last}).to_dict() == {"last": [1]}


def test_categories():
    c = Vector(["m", "s", None, "l"]).categorize(["s", "m", "l"])
    assert c.sort_by().to_list() == ["s", "m", "l", None]
    assert (c < "l").to_list() == [True, True, None, False]
    assert (c == "zzz").to_list() == [False, False, None, False]
    assert c.isin(["s"]).to_list() == [False, True, False, False]
    assert c.set_categories(["l", "m", "s"]).sort_by().to_list() == ["l", "m", "s", None]
    for bad in ({"s"}, ["s", "s"], ["s", 1], ["s"]):
        with pytest.raises((ColumnTypeError, ColumnValueError)):
            Vector(["m", "s"]).categorize(bad)
    with pytest.raises(ColumnValueError):
        c < "zzz"


STRINGS = ["", "abc", "Hello World", "  pad ", "a,b,,c", "straße", "ÀB", "x\ty\n", "123", "½", "aXbXc", None]


@pytest.mark.parametrize(
    ("name", "args"),
    [("upper", ()), ("lower", ()), ("strip", ()), ("lstrip", ()), ("rstrip", ()), ("strip", ("ab",)), ("find", ("b",)),
     ("rfind", ("X",)), ("replace", ("b", "--")), ("ljust", (6, "*")), ("rjust", (6, "*")), ("center", (6, "*")),
     ("center", (7, "*")), ("zfill", (5,)), ("startswith", ("a",)), ("endswith", (("c", "d"),)), ("isalpha", ()),
     ("isalnum", ()), ("isdigit", ()), ("isdecimal", ()), ("isnumeric", ()), ("isspace", ()), ("isupper", ()),
     ("islower", ()), ("istitle", ()), ("isascii", ()), ("isidentifier", ()), ("title", ()), ("swapcase", ()),
     ("capitalize", ()), ("casefold", ()), ("split", (",",)), ("split", ()), ("rsplit", (",", 1)), ("splitlines", ()),
     ("removeprefix", ("a",)), ("removesuffix", ("c",)), ("expandtabs", (4,)), ("encode", ()), ("count", ("b",)),
     ("join", (["p", "q"],)), ("isprintable", ())],
)
def test_string_methods(name, args):
    got = getattr(Vector(STRINGS), name)(*args).to_list()
    want = lanes(STRINGS, lambda s: getattr(s, name)(*args))
    assert [bytes(g) if isinstance(g, bytearray) else g for g in got] == want


def test_string_extras():
    v = Vector(["a.b.c", "abc", None])
    assert v.before(".").to_list() == ["a", "abc", None]
    assert v.after(".").to_list() == ["b.c", "", None]
    assert v.before_last(".").to_list() == ["a.b", "", None]
    assert v.after_last(".").to_list() == ["c", "abc", None]
    assert v.partition(".").to_list() == [["a", ".", "b.c"], ["abc", "", ""], None]
    assert v.rpartition(".").to_list() == [["a.b", ".", "c"], ["", "", "abc"], None]
    with pytest.raises(Exception, match="not found"):
        v.index("z").to_list()


def test_dates():
    days = [dt.date(2024, 2, 29), dt.date(2021, 1, 3), dt.date(1999, 12, 31), None]
    d = Vector(days)
    assert d.year.to_list() == lanes(days, lambda x: x.year)
    assert d.toordinal().to_list() == lanes(days, lambda x: x.toordinal())
    assert d.isocalendar().to_list() == lanes(days, lambda x: list(x.isocalendar()))
    assert d.ctime().to_list() == lanes(days, lambda x: x.ctime())
    assert d.strftime("%d.%m.%y %A").to_list() == lanes(days, lambda x: x.strftime("%d.%m.%y %A"))
    assert d.timetuple().to_list() == lanes(days, lambda x: list(x.timetuple()))
    assert (d + 1).to_list() == lanes(days, lambda x: x + dt.timedelta(1))
    assert (d - dt.date(2000, 1, 1)).to_list() == lanes(days, lambda x: (x - dt.date(2000, 1, 1)).days)
    assert (d - dt.timedelta(days=2)).to_list() == lanes(days, lambda x: x - dt.timedelta(2))
    assert d.eomonth().to_list()[0] == dt.date(2024, 2, 29)
    assert (d < "2021-06-01").to_list() == [False, True, True, None]
    with pytest.raises(ColumnValueError):
        d < "junk"
    t = Vector([dt.datetime(2024, 1, 2, 3), None])
    assert (t - dt.datetime(2024, 1, 1)).to_list() == [dt.timedelta(hours=27), None]


@pytest.mark.parametrize("name", ["ceil", "floor", "trunc", "fabs", "exp", "expm1", "sin", "cos", "tan", "atan", "sinh", "cosh",
                                  "tanh", "asinh", "degrees", "radians", "erf", "erfc", "isfinite", "ulp"])
def test_math_functions(name):
    xs = [-1.5, 0.25, 2.75, None]
    assert getattr(Vector(xs).math, name)().to_list() == pytest.approx(lanes(xs, getattr(math, name)))


def test_math_domains():
    for bad in (lambda: Vector([-1.0]).math.sqrt(), lambda: Vector([0.0]).math.log(), lambda: Vector([2.0]).math.acos(),
                lambda: Vector([1000.0]).math.exp(), lambda: Vector([21]).math.factorial()):
        with pytest.raises(Exception):
            bad().to_list()
    assert Vector([9, 15, 16]).math.isqrt().to_list() == [3, 3, 4]
    assert Vector([7.5]).math.remainder(2).to_list() == [math.remainder(7.5, 2)]
    assert Vector([5]).math.comb(2).to_list() == [10]
    assert Vector([-3.7]).math.modf().to_list()[0] == pytest.approx(list(math.modf(-3.7)))
    assert Vector([1.0, None]).math.isclose(1.0 + 1e-12).to_list() == [True, None]
    assert Vector([6]).bit_length().to_list() == [3] and Vector([-6]).bit_count().to_list() == [2]
    assert Vector([0.5]).hex().to_list() == [(0.5).hex()] and Vector([2.0]).is_integer().to_list() == [True]


def test_mutation(deals):
    v = deals.v.copy()
    v[0] = 9
    v[[1, 2]] = [8, 7]
    assert v.to_list() == [9, 8, 7, 4]
    v[v > 7] = 0.5
    assert v.to_list() == [0.5, 0.5, 7.0, 4.0]
    with pytest.raises(ColumnTypeError):
        v[0] = "x"
    with pytest.raises(ColumnTypeError):
        deals.v[0] = 1
    deals[deals.k == "a", "v"] = 0
    assert deals.v.to_list() == [0, 2, 0, 4]
    with deals.batch() as b:
        b[0, "v"] = 5
        b[-1, "f"] = None
    assert deals.v.to_list() == [5, 2, 0, 4] and deals.f.to_list()[-1] is None


def test_lifting():
    t = Table({"a": [1, 2], "b": [3, None]})
    assert (t * 2).to_dict() == {"a": [2, 4], "b": [6, None]}
    assert (10 - t).to_dict() == {"a": [9, 8], "b": [7, None]}
    assert (t + t).to_dict() == {"a": [2, 4], "b": [6, None]}
    assert (t > 1).to_dict() == {"a": [False, True], "b": [True, None]}
    assert t.sum().to_list() == [3, 3]
    assert (Vector([1, 2]) @ Vector([3, 4])) == 11
    assert (t @ [1, 10]).to_list() == [31, None]
    assert t.T.shape == (2, 2)


def test_csv(tmp_path, spark):
    path = tmp_path / "x.csv"
    path.write_text("zip,n,f,t,blank,flag\n01234, 5 ,1e3,2024-01-01,,True\n10000,,2,x,,False\n7\n")
    from colonnade import read_csv

    t = read_csv(str(path))
    assert t.zip.to_list() == ["01234", "10000", "7"]
    assert t.n.to_list() == [5, None, None] and t.f.to_list() == [1000.0, 2.0, None]
    assert t.t.to_list() == ["2024-01-01", "x", None] and t.flag.to_list() == ["True", "False", None]
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(ColumnValueError):
        read_csv(str(path))


def test_parquet(tmp_path, spark):
    from colonnade import read_parquet, write_parquet

    t = Table({"a": [3, 1, None], "s": ["x", None, "z"]})
    path = str(tmp_path / "t.parquet")
    write_parquet(t, path)
    back = read_parquet(path)
    assert back.to_dict() == t.to_dict()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,1)]" in back[back.a > 1]._frame.df._jdf.queryExecution().toString()
    with pytest.raises(ColumnTypeError):
        write_parquet(Table({"c": [1, "x"]}), path)


def test_zero_rows_keep_schemas():
    t = Table({"k": ["a"], "v": [1.5]})
    none = t[t.v > 9]
    assert none.aggregate("k", {"s": none.v.sum}).to_dict() == {"k": [], "s": []}
    assert none.v.schema()[0] is float and none.sort_by("v")[:3].to_dict() == {"k": [], "v": []}


def test_display():
    t = Table({"a": [1, None], "b c": ["x", "y"]})
    assert "a: int?" in t._ and "b_c: str" in t._
    assert "2 x 2 table <int?, str>" in repr(t)


# Values that earlier rules got wrong


def test_kinds_of_callables_come_from_all_values(spark):
    n = 200
    t = Table({"g": ["a"] * n + ["b"] * n, "x": [2] * n + [1] * (n - 1) + [101]})
    out = t.aggregate("g", {"m": lambda q: sum(q.x) / len(q) if max(q.x) > 50 else max(q.x)})
    assert out.to_dict() == {"g": ["a", "b"], "m": [2.0, 1.5]}
    v = Vector(list(range(60))).cast(lambda a: a if a < 50 else a / 2)
    assert v.to_list() == [float(a) if a < 50 else a / 2 for a in range(60)] and v.schema().kind is float
    assert Vector([1, None, 3]).cast(lambda a: f"<{a}>").to_list() == ["<1>", None, "<3>"]
    assert Vector([1, 2]).cast(lambda a: "x" if a == 1 else 5).to_list() == ["x", "5"]
    moments = [dt.datetime(2024, 1, 1, 5), None, dt.datetime(2024, 3, 1)]
    later = Vector(moments).cast(lambda m: m + dt.timedelta(hours=1))
    assert later.schema().kind is dt.datetime and later.to_list() == [m and m + dt.timedelta(hours=1) for m in moments]
    assert Vector(moments).cast(lambda m: m.date()).to_list() == [m and m.date() for m in moments]
    with pytest.raises(Exception, match="returns="):
        Vector([1, 2]).cast(lambda a: a / 2, returns=int).to_list()
    with pytest.raises(Exception, match="returns="):
        t.aggregate("g", {"m": lambda q: q.x.to_list()[0] + 0.5}, returns={"m": int}).to_dict()


def test_groups_as_local_tables(spark):
    nan = float("nan")
    t = Table({"g": [1, 1, 1, 2, 2], "x": [1.0, nan, None, 4.0, 6.0], "y": [10, 20, 30, 40, None], "s": ["b", "a", None, "c", "d"]})
    out = t.aggregate("g", {
        "nans": lambda q: sum(1 for v in q.x if v is not None and v != v),
        "traced": lambda q: q[q.y > 10].y.sum(),
        "one": lambda q: q.y[q.x >= 4].max(),
        "loops": lambda q: len(q[(q.y > 10) & ~(q.y > 30)]),
        "sorted": lambda q: q.sort_by("s", reverse=True).s.first(),
        "stat": lambda q: float(q.y.stats.median()) if len(q) > 1 else 0.0,
        "math": lambda q: sum((q.y.fillna(0) * 2).math.sqrt()),
        "text": lambda q: ",".join(q.s.dropna().upper()),
    })
    assert out.to_dict() == {
        "g": [1, 2], "nans": [1, 0], "traced": [50, 40], "one": [None, 40], "loops": [2, 0], "sorted": ["b", "d"], "stat": [20.0, 40.0],
        "math": pytest.approx([sum((2 * v) ** 0.5 for v in (10, 20, 30)), 80**0.5]), "text": ["B,A", "C,D"],
    }
    with pytest.raises(Exception, match="truth value"):
        t.aggregate("g", {"bad": lambda q: 1 if q.y.unique() else 0}).to_dict()


def test_gathered_reductions(spark):
    t = Table({"g": [1, 1, 1, 2, 3, 3], "x": [4, 6, None, None, 10, 15], "f": [1e16, 1.0, -1e16, None, 0.1, 0.2]})
    out = t.aggregate("g", {"p": t.x.math.prod, "d": t.x.math.gcd, "m": t.x.math.lcm, "s": t.f.math.fsum})
    assert out.to_dict() == {"g": [1, 2, 3], "p": [24, 1, 150], "d": [2, 0, 5], "m": [12, 1, 30], "s": [1.0, 0.0, math.fsum([0.1, 0.2])]}
    big = Vector([3_000_000_000] * 5 + [0])
    assert big.math.prod() == 0 and Vector([], int).math.prod() == 1
    with pytest.raises(Exception, match="64 bits"):
        Vector([3_000_000_000] * 5).math.prod()
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(3000)]
    assert Vector(values).math.fsum() == math.fsum(values)


def test_order_statistics_of_counts(spark):
    rng = random.Random(3)
    data = {g: [rng.randrange(20) / 2 for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 37), ("d", 500))}
    t = Table({"g": [g for g, xs in data.items() for _ in xs], "x": [x for xs in data.values() for x in xs]})
    out = t.aggregate("g", {
        "q": lambda u: u.x.stats.quantiles(n=7, method="inclusive"), "hi": t.x.stats.median_high, "lo": t.x.stats.median_low, "m": t.x.stats.multimode,
    }).to_dict()
    ex = t.aggregate("g", {"q": t.x.stats.quantiles}).to_dict()["q"]
    for k, xs in enumerate(data.values()):
        assert out["hi"][k] == statistics.median_high(xs) and out["lo"][k] == statistics.median_low(xs)
        assert out["m"][k] == statistics.multimode(xs)
        if len(xs) > 1:
            assert out["q"][k] == pytest.approx(statistics.quantiles(xs, n=7, method="inclusive")) and ex[k] == pytest.approx(statistics.quantiles(xs))
        else:
            assert out["q"][k] is None and ex[k] is None
    assert t.x.stats.quantiles(n=9) == pytest.approx(statistics.quantiles([x for xs in data.values() for x in xs], n=9))
    for wrong in (lambda: t.x.stats.quantiles(10), lambda: t.x.stats.fmean("junk"), lambda: t.x.math.fsum(1)):
        with pytest.raises(TypeError):
            wrong()


def test_values_like_pythons(spark):
    words_ = ["ßa", "ǆa", "ΑΣ", "ﬁx", "hELLO", "", None, "éCOLE"]
    assert Vector(words_).capitalize().to_list() == [None if w is None else w.capitalize() for w in words_]
    odd = ["²", "12", "½", "", "ab1", "é", "1a", "a\n", " "]
    for name in ("isdigit", "isnumeric", "isidentifier", "isprintable"):
        assert getattr(Vector(odd), name)().to_list() == [getattr(w, name)() for w in odd], name
    x = [1e300, -1e300, 2.5, -2.5, 1e16, -0.0, 4503599627370497.5, float("inf")]
    assert Vector(x).math.modf().to_list() == [list(math.modf(v)) for v in x]
    a, b = [1e16, -7.5, 7.5, 1e300, -0.0, 0.3, 6.0], [3.0, 2.0, -2.0, 7.0, 5.0, 0.1, -3.0]
    assert (Vector(a) // Vector(b)).to_list() == [p // q for p, q in zip(a, b)]
    assert [repr(v) for v in (Vector(a) % Vector(b)).to_list()] == [repr(p % q) for p, q in zip(a, b)]
    small = [1e-9, -1e-300, 0.5, -3.0, 1e10, 1e300, 0.0]
    assert Vector(small).math.asinh().to_list() == pytest.approx([math.asinh(v) for v in small], rel=1e-14)
    signs = [0.0, -0.0, 5.0, -5.0]
    assert [repr(v) for v in Vector([3.0, 3.0, -3.0, -3.0]).math.copysign(Vector(signs)).to_list()] == ["3.0", "-3.0", "3.0", "-3.0"]
    assert Vector(["1_000", " 7 ", None]).cast(int).to_list() == [1000, 7, None]


def test_csv_sources(spark, tmp_path):
    text = 'k,v\r\n1,"a\nb"\r\n2,plain\r\n'
    path = tmp_path / "lines.csv"
    path.write_bytes(text.encode())
    plain = tmp_path / "plain.csv"
    plain.write_text("k,v\n1,x\n2,\"y,z\"\n")
    assert read_csv(str(path)).to_dict() == {"k": [1, 2], "v": ["a\nb", "plain"]}
    assert read_csv(str(plain)).to_dict() == {"k": [1, 2], "v": ["x", "y,z"]}
    import io

    assert read_csv(io.StringIO(text)).to_dict() == read_csv(io.BytesIO(b"\xef\xbb\xbf" + text.encode())).to_dict() == {"k": [1, 2], "v": ["a\nb", "plain"]}
    assert read_csv(io.StringIO("")).shape == (0, 0)
    with pytest.raises(ValueError):
        read_csv(io.StringIO("a,b\n1,2,3\n")).to_dict()


def test_unsigned_columns_are_refused(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"u": pa.array([1, 2], pa.uint64())}), tmp_path / "u.parquet")
    pq.write_table(pa.table({"d": pa.array([1, 2], pa.decimal128(20, 0))}), tmp_path / "d.parquet")
    with pytest.raises(TypeError, match="unsigned"):
        read_parquet(str(tmp_path / "u.parquet"))
    assert read_parquet(str(tmp_path / "d.parquet")).shape == (2, 1)


def test_positions_without_one_task(spark, tmp_path, monkeypatch):
    """Rows numbered file by file give the positions of the window."""
    from colonnade import frame

    rng = random.Random(8)
    rows = [(i, rng.randrange(40), rng.choice("abc")) for i in range(500)]
    spark.createDataFrame(rows, "i long, k long, s string").repartition(4).write.parquet(f"{tmp_path}/t")
    t = read_parquet(f"{tmp_path}/t").sort_by(["k", "i"], reverse=[True, False])
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    monkeypatch.setattr(frame, "ONE_TASK", 0)
    assert t[5:400:7].i.to_list() == [r[0] for r in order[5:400:7]]
    assert t[-3:].i.to_list() == [r[0] for r in order[-3:]] and t[::-50].i.to_list() == [r[0] for r in order[::-50]]
    assert t[[3, 499, -2]].i.to_list() == [order[3][0], order[499][0], order[-2][0]]
    assert (t.i + Vector(range(500))).to_list() == [r[0] + k for k, r in enumerate(order)]
    u = t.copy()
    u[[0, 10], "s"] = "x"
    assert u.s.to_list() == ["x" if k in (0, 10) else r[2] for k, r in enumerate(order)]


def test_dense_orders_need_no_numbering(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/one")
    t = read_parquet(f"{tmp_path}/one")
    t._frame.numbered()
    assert "Window" not in t._frame.df._jdf.queryExecution().toString()
    assert t[t.id > 10][1:30:4].id.to_list() == list(range(11, 50))[1:30:4]
    assert (Vector([1, 2, 3]) + Vector([10, 20, 30])).to_list() == [11, 22, 33]


def test_lengths_in_callables_are_aggregates(spark, monkeypatch):
    from colonnade.operators import grouping

    nan = float("nan")
    t = Table({
        "g": ["a", "a", "a", "a", "b", "b"], "x": [1, None, 1, None, 2, 3], "f": [0.0, -0.0, nan, nan, None, 1.5],
        "s": ["p", "q", "p", None, "r", "r"], "y": [5, 6, None, 8, 1, 9],
    })

    ask = {
        "n": lambda q: len(q), "half": lambda q: len(q) / 2, "column": lambda q: len(q.x), "values": lambda q: len(q.x.unique()),
        "floats": lambda q: len(q.f.unique()), "texts": lambda q: len(q.s.unique()), "rows": lambda q: len(q[q.y > 5]),
        "masked": lambda q: len(q[q.y > 5].x.unique()), "cells": lambda q: len(q.s[q.y > 5]), "share": lambda q: len(q.s.unique()) / q.y.count(),
    }
    want = {
        "g": ["a", "b"], "n": [4, 2], "half": [2.0, 1.0], "column": [4, 2], "values": [2, 2], "floats": [3, 2], "texts": [3, 1], "rows": [2, 1],
        "masked": [1, 1], "cells": [2, 1], "share": [1.0, 0.5],
    }
    # The same functions over local tables, which the truth of a length asks for.
    local = {k: (lambda q, f=f: f(q) if bool(len(q)) else None) for k, f in ask.items()}
    assert t.aggregate("g", local).to_dict() == want

    def refused(*args, **kwargs):
        raise AssertionError("a local table")

    monkeypatch.setattr(grouping, "_udaf", refused)
    assert t.aggregate("g", ask).to_dict() == want
    assert t.aggregate("g", {"n": lambda q: len(q.s.unique())}, returns={"n": float}).to_dict() == {"g": ["a", "b"], "n": [3.0, 1.0]}
    assert t.window("g", {"n": lambda q: len(q.s.unique())}).n.to_list() == [3, 3, 3, 3, 1, 1]
    for untraced in (lambda q: len(q) if len(q) > 2 else 0, lambda q: len(q.x.unique().dropna()), lambda q: q.x.unique().sum(), lambda q: float(len(q))):
        with pytest.raises(AssertionError, match="local table"):
            t.aggregate("g", {"n": untraced})


def test_local_groups_are_sorted_and_shown_in_lots(spark, monkeypatch):
    import pyarrow as pa

    from colonnade.operators import local

    rng = random.Random(4)
    rows = [(i, "ab"[i % 2], rng.choice([None, *range(9)])) for i in range(400)]
    t = Table({"i": [r[0] for r in rows], "g": [r[1] for r in rows], "x": [r[2] for r in rows]}).sort_by("x", reverse=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = t.aggregate("g", {
            "all": lambda q: ",".join(map(str, q.i)), "some": lambda q: ",".join(map(str, q[q.x > 4].i.to_list()[:-1])),
            "ends": lambda q: f"{q.i.first()} {q.i.last()} {q.i[1]} {q[-2][0]} {q[[0, 3]].i.to_list()} {q.i[2:4].to_list()}",
        })
        found = out.sort_by("g").to_dict()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    for k, g in enumerate("ab"):
        own = [r[0] for r in order if r[1] == g]
        above = [r[0] for r in order if r[1] == g and r[2] is not None and r[2] > 4]
        assert found["all"][k] == ",".join(map(str, own)) and found["some"][k] == ",".join(map(str, above[:-1]))
        assert found["ends"][k] == f"{own[0]} {own[-1]} {own[1]} {own[-2]} {[own[0], own[3]]} {own[2:4]}"
    column = local.ColumnVector(pa.chunked_array([[3, None], [3, 4]]))
    other = local.ColumnVector(pa.chunked_array([["a", "b"], ["c", "d"]]))
    table = local.LocalTable(["n", "s"], [column, other])
    assert table.n.unique().to_list() == [3, None, 4] and table.n.sum() == 10 and table[table.n == 3].s.to_list() == ["a", "c"]
    assert len(table[table.n > 9]) == 0 and table[table.n > 9].n.first() is None and table.s.last() == "d"
    assert column._kept is None and other._kept is None
