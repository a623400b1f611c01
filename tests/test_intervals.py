import pytest
from hypothesis import assume, given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nervemap.operators.intervals import UNBOUNDED, Bound, Cube, Endpoint, Interval, closed_cover, open_cover, split

number = st.integers(-5, 5).map(float)
endpoint = st.one_of(number.map(Endpoint.open), number.map(Endpoint.at), st.just(UNBOUNDED))


@st.composite
def interval(draw):
    a, b = draw(endpoint), draw(endpoint)
    assume(Bound(a, True).intersects(Bound(b, False)))
    return Interval.of(a, b)


@given(endpoint, endpoint, endpoint)
def test_above_and_below_are_transitive(a, b, c):
    if a.bounded and b.bounded and c.bounded:
        assert not (a.is_above(b) and b.is_above(c)) or a.value >= c.value
        assert not (a.is_below(b) and b.is_below(c)) or a.value <= c.value


def test_endpoint_table():
    o, c = Endpoint.open(1), Endpoint.at(1)
    assert c.is_above(c) and c.is_above(o) and o.is_above(o) and not o.is_above(c)
    assert c.is_below(c) and c.is_below(o) and o.is_below(o) and not o.is_below(c)
    assert UNBOUNDED.is_above(c) and UNBOUNDED.is_below(o) and not c.is_above(UNBOUNDED)


@given(interval(), number, interval())
def test_interval_laws(a, x, b):
    assert a.intersects(b) == b.intersects(a)
    if a.contains_interval(b) and b.contains(x):
        assert a.contains(x)
    if a.contains(x) and b.contains(x):
        assert a.intersects(b)


@given(interval(), interval(), interval())
def test_inclusion_is_transitive(a, b, c):
    if a.contains_interval(b) and b.contains_interval(c):
        assert a.contains_interval(c)
    assert Cube(0, (a, b)).intersects(Cube(1, (b, c))) == Cube(1, (b, c)).intersects(Cube(0, (a, b)))


def test_construction_and_lengths():
    with pytest.raises(ValueError):
        Interval.open(1, 1)
    with pytest.raises(ValueError):
        Interval.closed(2, 1)
    assert Interval.closed(1, 1).contains(1) and Interval.open(0, 2).length == 2 and Interval.less_than(3).length is None
    assert str(Interval.closed_open(0, 2)) == "[0.0, 2.0)"
    assert Interval.open(0, 2).map(lambda x: x + 1) == Interval.open(1, 3)
    with pytest.raises(ValueError):
        Cube(0, (Interval.open(0, 1),)).contains([0.0, 1.0])
    assert sorted([Interval.open(0, 1), Interval.closed(0, 1)], key=Interval.key)[0] == Interval.closed(0, 1)


@given(st.lists(st.floats(-1e6, 1e6), min_size=3, max_size=3, unique=True), st.integers(1, 20), st.floats(0.01, 1))
def test_covers_cover(points, n, ratio):
    lo, x, hi = sorted(points)
    assume(hi - lo > 1e-6)
    for make in (open_cover, closed_cover):
        assert any(c.contains([x]) for c in make([lo], [hi], n, ratio))
    with pytest.raises(ValueError):
        split(lo, lo, n)


def test_columns_agree_with_values(spark):
    xs = [-2.0, -1.0, 0.0, 1.0, 2.0, float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for i in (Interval.open(-1, 1), Interval.closed(-1, 1), Interval.greater_than(0), Interval.less_equal(0), Interval.of(UNBOUNDED, UNBOUNDED)):
        assert [r[0] for r in df.select(i.column(F.col("x"))).collect()] == [i.contains(x) for x in xs]
