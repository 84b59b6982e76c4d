"""Fluent builders of queries. ``build`` changes nothing, so it can be called again."""

from __future__ import annotations

from functools import reduce
from typing import Any

from tesserae.plans.criteria import Content, Criteria, InvalidQuery, Query, Spatial, Temporal


class _Part:
    def __init__(self, owner: QueryBuilder | None = None):
        self.owner, self.criteria = owner, None

    def _add(self, one: Criteria):
        self.criteria = one.validate() if self.criteria is None else self.criteria & one.validate()
        return self

    def and_(self, other: Criteria):
        return self._add(other)

    def or_(self, other: Criteria):
        self.criteria = other if self.criteria is None else self.criteria | other
        return self

    def not_(self):
        if self.criteria is None:
            raise InvalidQuery("nothing to negate")
        self.criteria = ~self.criteria
        return self

    def done(self) -> QueryBuilder:
        return self.owner

    def build(self) -> Query:
        if self.criteria is None:
            raise InvalidQuery("no criteria")
        return Query(self.criteria).validate()


class TemporalPart(_Part):
    def before(self, time: float):
        return self._add(Temporal(end_time=time))

    def after(self, time: float):
        return self._add(Temporal(start_time=time))

    def between(self, start: float, end: float):
        return self._add(Temporal(start, end))


class SpatialPart(_Part):
    def within_rectangle(self, min_x: float, min_y: float, max_x: float, max_y: float):
        return self._add(Spatial(min_x, min_y, max_x, max_y))

    def near(self, x: float, y: float, radius: float):
        return self._add(Spatial(center_x=x, center_y=y, radius=radius))


class ContentPart(_Part):
    def equals(self, name: str, value: Any):
        return self._add(Content(name, "=", value))

    def greater_than(self, name: str, value: Any):
        return self._add(Content(name, ">", value))

    def less_than(self, name: str, value: Any):
        return self._add(Content(name, "<", value))

    def like(self, name: str, pattern: str):
        return self._add(Content(name, "LIKE", pattern))

    def in_list(self, name: str, values: list):
        return self._add(Content(name, "IN", list(values)))

    def contains(self, name: str, value: Any):
        return self._add(Content(name, "CONTAINS", value))


class QueryBuilder:
    """The parts for time, space and content, joined by AND."""

    def __init__(self):
        self._parts = {"temporal": TemporalPart(self), "spatial": SpatialPart(self), "content": ContentPart(self)}
        self._limit = self._offset = None

    def temporal(self) -> TemporalPart:
        return self._parts["temporal"]

    def spatial(self) -> SpatialPart:
        return self._parts["spatial"]

    def content(self) -> ContentPart:
        return self._parts["content"]

    def limit(self, n: int) -> QueryBuilder:
        if n <= 0:
            raise InvalidQuery("limit is not positive")
        self._limit = n
        return self

    def offset(self, n: int) -> QueryBuilder:
        if n < 0:
            raise InvalidQuery("offset is negative")
        self._offset = n
        return self

    def build(self) -> Query:
        parts = [p.criteria for p in self._parts.values() if p.criteria is not None]
        if not parts:
            raise InvalidQuery("no criteria")
        return Query(reduce(lambda a, b: a & b, parts), self._limit, self._offset).validate()


def query() -> QueryBuilder:
    return QueryBuilder()


def temporal_query() -> TemporalPart:
    return TemporalPart()


def spatial_query() -> SpatialPart:
    return SpatialPart()


def content_query() -> ContentPart:
    return ContentPart()


def filter_by_property(properties: dict[str, Any]) -> Criteria:
    """Conjunction of equalities."""
    return reduce(lambda a, b: a & b, [Content(k, "=", v) for k, v in properties.items()])
