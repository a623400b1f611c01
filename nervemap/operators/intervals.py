"""Endpoints, bounds, intervals and cubes: values on the driver, predicates on columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Endpoint:
    """A value that belongs to its side (closed), or doesn't (open), or no limit at all (value None)."""

    value: float | None = None
    closed: bool = False

    @staticmethod
    def open(value: float) -> Endpoint:
        return Endpoint(float(value), False)

    @staticmethod
    def at(value: float) -> Endpoint:
        return Endpoint(float(value), True)

    @property
    def bounded(self) -> bool:
        return self.value is not None

    def is_above(self, other: Endpoint) -> bool:
        """As an upper limit: no point of ``other`` is left out. Only an open one against a closed one needs to be greater."""
        if not self.bounded:
            return True
        if not other.bounded:
            return False
        return self.value > other.value if other.closed and not self.closed else self.value >= other.value

    def is_below(self, other: Endpoint) -> bool:
        if not self.bounded:
            return True
        if not other.bounded:
            return False
        return self.value < other.value if other.closed and not self.closed else self.value <= other.value

    def map(self, f: Callable[[float], float]) -> Endpoint:
        return Endpoint(float(f(self.value)), self.closed) if self.bounded else self


UNBOUNDED = Endpoint()


@dataclass(frozen=True)
class Bound:
    """A half line: all points above its endpoint (``lower``) or below it. It contains any bound if it has no endpoint."""

    end: Endpoint
    lower: bool

    def contains(self, x: float) -> bool:
        if not self.end.bounded:
            return x == x
        v = self.end.value
        return (x >= v if self.end.closed else x > v) if self.lower else (x <= v if self.end.closed else x < v)

    def contains_bound(self, other: Bound) -> bool:
        if not self.end.bounded:
            return True
        if self.lower != other.lower:
            return False
        return self.end.is_below(other.end) if self.lower else self.end.is_above(other.end)

    def intersects(self, other: Bound) -> bool:
        if self.lower == other.lower or not self.end.bounded or not other.end.bounded:
            return True
        low, high = (self.end, other.end) if self.lower else (other.end, self.end)
        return low.value <= high.value if low.closed and high.closed else low.value < high.value

    def key(self) -> tuple:
        """Orders bounds of a kind; of two at one value the one that holds more comes first below, last above."""
        if not self.end.bounded:
            return (-1 if self.lower else 1, 0.0, 0)
        return (0, self.end.value, (0 if self.end.closed else 1) if self.lower else (1 if self.end.closed else 0))

    def column(self, x: Column) -> Column:
        """The same test on a column; NaN, which Spark orders above all numbers, is in no bound."""
        if not self.end.bounded:
            return ~F.isnan(x)
        v = F.lit(self.end.value)
        test = (x >= v if self.end.closed else x > v) if self.lower else (x <= v if self.end.closed else x < v)
        return test & ~F.isnan(x)

    def __str__(self) -> str:
        v = ("-inf" if self.lower else "inf") if not self.end.bounded else repr(self.end.value)
        return ("[" if self.end.closed else "(") + v if self.lower else v + ("]" if self.end.closed else ")")


@dataclass(frozen=True)
class Interval:
    lower: Bound
    upper: Bound

    def __post_init__(self):
        if not self.lower.lower or self.upper.lower:
            raise ValueError("an interval has a lower and an upper bound")
        if not self.lower.intersects(self.upper):
            raise ValueError("the bounds of an interval must meet")

    @staticmethod
    def of(lower: Endpoint, upper: Endpoint) -> Interval:
        return Interval(Bound(lower, True), Bound(upper, False))

    @staticmethod
    def open(a: float, b: float) -> Interval:
        return Interval.of(Endpoint.open(a), Endpoint.open(b))

    @staticmethod
    def closed(a: float, b: float) -> Interval:
        return Interval.of(Endpoint.at(a), Endpoint.at(b))

    @staticmethod
    def open_closed(a: float, b: float) -> Interval:
        return Interval.of(Endpoint.open(a), Endpoint.at(b))

    @staticmethod
    def closed_open(a: float, b: float) -> Interval:
        return Interval.of(Endpoint.at(a), Endpoint.open(b))

    @staticmethod
    def greater_than(a: float) -> Interval:
        return Interval.of(Endpoint.open(a), UNBOUNDED)

    @staticmethod
    def greater_equal(a: float) -> Interval:
        return Interval.of(Endpoint.at(a), UNBOUNDED)

    @staticmethod
    def less_than(b: float) -> Interval:
        return Interval.of(UNBOUNDED, Endpoint.open(b))

    @staticmethod
    def less_equal(b: float) -> Interval:
        return Interval.of(UNBOUNDED, Endpoint.at(b))

    def contains(self, x: float) -> bool:
        return self.lower.contains(x) and self.upper.contains(x)

    def contains_interval(self, other: Interval) -> bool:
        return self.lower.contains_bound(other.lower) and self.upper.contains_bound(other.upper)

    def intersects(self, other: Interval) -> bool:
        return self.lower.intersects(other.upper) and self.upper.intersects(other.lower)

    def key(self) -> tuple:
        return (self.lower.key(), self.upper.key())

    @property
    def length(self) -> float | None:
        if not self.lower.end.bounded or not self.upper.end.bounded:
            return None
        return self.upper.end.value - self.lower.end.value

    def map(self, f: Callable[[float], float], g: Callable[[float], float] | None = None) -> Interval:
        """f moves the lower end, g (or else f) the upper."""
        return Interval.of(self.lower.end.map(f), self.upper.end.map(g or f))

    def column(self, x: Column) -> Column:
        return self.lower.column(x) & self.upper.column(x)

    def __str__(self) -> str:
        return f"{self.lower}, {self.upper}"


@dataclass(frozen=True)
class Cube:
    """A product of intervals, with a number."""

    id: int
    sides: tuple[Interval, ...]

    @property
    def dimension(self) -> int:
        return len(self.sides)

    def _same(self, n: int) -> None:
        if n != self.dimension:
            raise ValueError(f"{n} dimensions met {self.dimension}")

    def contains(self, point: Sequence[float]) -> bool:
        self._same(len(point))
        return all(s.contains(x) for s, x in zip(self.sides, point, strict=True))

    def contains_cube(self, other: Cube) -> bool:
        self._same(other.dimension)
        return all(a.contains_interval(b) for a, b in zip(self.sides, other.sides, strict=True))

    def intersects(self, other: Cube) -> bool:
        self._same(other.dimension)
        return all(a.intersects(b) for a, b in zip(self.sides, other.sides, strict=True))

    def map(self, f: Callable[[Interval], Interval]) -> Cube:
        return Cube(self.id, tuple(map(f, self.sides)))

    def column(self, point: Sequence[Column]) -> Column:
        self._same(len(point))
        test = F.lit(True)
        for s, x in zip(self.sides, point, strict=True):
            test = test & s.column(x)
        return test

    def __str__(self) -> str:
        return f"{self.id}: " + " x ".join(map(str, self.sides))


def split(lower: float, upper: float, n: int) -> list[tuple[float, float]]:
    """n equal pieces; each ends where its start and the common width add up to."""
    if n <= 0:
        raise ValueError("the number of splits must be positive")
    if not upper > lower:
        raise ValueError(f"nothing to split between {lower} and {upper}")
    width = (upper - lower) / n
    starts = [lower + i * width for i in range(n)]
    return [(a, a + width) for a in starts]


def widened(lower: float, upper: float, n: int, ratio: float) -> list[tuple[float, float]]:
    """The pieces, each longer by ``ratio`` of its length, half of it on either side."""
    if ratio < 0:
        raise ValueError("the overlap ratio must not be negative")
    return [(a - (b - a) * ratio / 2, b + (b - a) * ratio / 2) for a, b in split(lower, upper, n)]


def _cubes(sides: Sequence[Sequence[Interval]]) -> Iterator[Cube]:
    for i, s in enumerate(product(*sides)):
        yield Cube(i, s)


def open_cover(lower: Sequence[float], upper: Sequence[float], n: int, ratio: float) -> list[Cube]:
    """Overlapping open cubes; the last dimension varies fastest."""
    return list(_cubes([[Interval.open(a, b) for a, b in widened(lo, hi, n, ratio)] for lo, hi in zip(lower, upper, strict=True)]))


def closed_cover(lower: Sequence[float], upper: Sequence[float], n: int, ratio: float) -> list[Cube]:
    return list(_cubes([[Interval.closed(a, b) for a, b in widened(lo, hi, n, ratio)] for lo, hi in zip(lower, upper, strict=True)]))
