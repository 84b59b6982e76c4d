"""Criteria: frozen trees that validate themselves, round-trip through JSON and compile to one Column.

A missing field makes a predicate false, also under NOT.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import geometry

OPERATORS = ("=", ">", "<", ">=", "<=", "!=", "LIKE", "IN", "CONTAINS", "STARTS_WITH", "ENDS_WITH")
#: Names of operators in requests.
ALIASES = {"eq": "=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "IN", "contains": "CONTAINS", "starts_with": "STARTS_WITH", "ends_with": "ENDS_WITH", "like": "LIKE"}


class InvalidQuery(ValueError):
    """A query that cannot be run."""


@dataclass(frozen=True)
class Fields:
    """Where a table keeps time, place and content."""

    time: str = "t"
    x: str = "x"
    y: str = "y"
    content: str | None = None

    def of(self, name: str) -> Column:
        return F.col(self.content).getItem(name) if self.content else F.col(name)


def _numeric(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


class Criteria:
    def validate(self) -> Criteria:
        raise NotImplementedError

    def column(self, fields: Fields) -> Column:
        raise NotImplementedError

    def to_dict(self) -> dict:
        raise NotImplementedError

    def __and__(self, other: Criteria) -> Criteria:
        return _flat("AND", self, other)

    def __or__(self, other: Criteria) -> Criteria:
        return _flat("OR", self, other)

    def __invert__(self) -> Criteria:
        return Composite("NOT", (self,))


def _flat(operator: str, left: Criteria, right: Criteria) -> Criteria:
    parts = left.criteria if isinstance(left, Composite) and left.operator == operator else (left,)
    return Composite(operator, (*parts, right))


@dataclass(frozen=True)
class Temporal(Criteria):
    start_time: float | None = None
    end_time: float | None = None

    def validate(self) -> Temporal:
        if self.start_time is None and self.end_time is None:
            raise InvalidQuery("a temporal criterion needs a bound")
        if self.start_time is not None and self.end_time is not None and self.start_time > self.end_time:
            raise InvalidQuery("start is after end")
        return self

    def column(self, fields: Fields) -> Column:
        self.validate()
        t = F.col(fields.time)
        parts = ([t >= self.start_time] if self.start_time is not None else []) + ([t <= self.end_time] if self.end_time is not None else [])
        return reduce(lambda a, b: a & b, parts)

    def to_dict(self) -> dict:
        return {"type": "temporal", "start_time": self.start_time, "end_time": self.end_time}


@dataclass(frozen=True)
class Spatial(Criteria):
    min_x: float | None = None
    min_y: float | None = None
    max_x: float | None = None
    max_y: float | None = None
    center_x: float | None = None
    center_y: float | None = None
    radius: float | None = None

    def _box(self) -> tuple:
        return (self.min_x, self.min_y, self.max_x, self.max_y)

    def _circle(self) -> tuple:
        return (self.center_x, self.center_y, self.radius)

    def validate(self) -> Spatial:
        box, circle = all(v is not None for v in self._box()), all(v is not None for v in self._circle())
        if not box and not circle:
            raise InvalidQuery("a spatial criterion needs a whole box or a whole circle")
        if box and (self.min_x > self.max_x or self.min_y > self.max_y):
            raise InvalidQuery("the box is inside out")
        if circle and self.radius <= 0:
            raise InvalidQuery("the radius is not positive")
        return self

    def column(self, fields: Fields) -> Column:
        self.validate()
        parts = []
        if all(v is not None for v in self._box()):
            parts.append(F.col(fields.x).between(self.min_x, self.max_x) & F.col(fields.y).between(self.min_y, self.max_y))
        if all(v is not None for v in self._circle()):
            parts.append(geometry.in_circle(fields.x, fields.y, *self._circle()))
        return reduce(lambda a, b: a & b, parts)

    def to_dict(self) -> dict:
        return {"type": "spatial"} | {k: getattr(self, k) for k in ("min_x", "min_y", "max_x", "max_y", "center_x", "center_y", "radius")}


@dataclass(frozen=True)
class Content(Criteria):
    field_name: str
    operator: str
    value: Any

    def validate(self) -> Content:
        if not self.field_name:
            raise InvalidQuery("a content criterion needs a field")
        if ALIASES.get(self.operator, self.operator) not in OPERATORS:
            raise InvalidQuery(f"unknown operator {self.operator!r}")
        if ALIASES.get(self.operator, self.operator) == "IN" and not isinstance(self.value, list | tuple | set):
            raise InvalidQuery("IN needs a list")
        return self

    def column(self, fields: Fields) -> Column:
        self.validate()
        operator, column = ALIASES.get(self.operator, self.operator), fields.of(self.field_name)
        if fields.content and _numeric(self.value) and operator not in ("CONTAINS", "STARTS_WITH", "ENDS_WITH"):
            column = column.try_cast("double")
        match operator:
            case "=":
                return column == self.value
            case "!=":
                return column != self.value
            case ">":
                return column > self.value
            case "<":
                return column < self.value
            case ">=":
                return column >= self.value
            case "<=":
                return column <= self.value
            case "LIKE":
                return column.like(self.value)
            case "IN":
                return column.isin(list(self.value))
            case "STARTS_WITH":
                return column.startswith(self.value)
            case "ENDS_WITH":
                return column.endswith(self.value)
        return column.contains(self.value)

    def to_dict(self) -> dict:
        return {"type": "content", "field_name": self.field_name, "operator": self.operator, "value": self.value}


@dataclass(frozen=True)
class HasElement(Criteria):
    """CONTAINS on a list column."""

    field_name: str
    value: Any

    def validate(self) -> HasElement:
        return self

    def column(self, fields: Fields) -> Column:
        return F.array_contains(self.field_name, self.value)

    def to_dict(self) -> dict:
        return {"type": "element", "field_name": self.field_name, "value": self.value}


@dataclass(frozen=True)
class Composite(Criteria):
    operator: str
    criteria: tuple[Criteria, ...]

    def validate(self) -> Composite:
        if self.operator not in ("AND", "OR", "NOT"):
            raise InvalidQuery(f"unknown operator {self.operator!r}")
        if not self.criteria or (self.operator == "NOT" and len(self.criteria) != 1):
            raise InvalidQuery(f"{self.operator} with {len(self.criteria)} parts")
        for part in self.criteria:
            part.validate()
        return self

    def column(self, fields: Fields) -> Column:
        self.validate()
        parts = [c.column(fields) for c in self.criteria]
        if self.operator == "NOT":
            return ~F.coalesce(parts[0], F.lit(False))
        return reduce((lambda a, b: a & b) if self.operator == "AND" else (lambda a, b: a | b), parts)

    def to_dict(self) -> dict:
        return {"type": "composite", "operator": self.operator, "criteria": [c.to_dict() for c in self.criteria]}


def criteria_from_dict(data: Mapping) -> Criteria:
    kinds: dict[str, Callable[[Mapping], Criteria]] = {
        "temporal": lambda d: Temporal(**d),
        "spatial": lambda d: Spatial(**d),
        "content": lambda d: Content(**d),
        "element": lambda d: HasElement(**d),
        "composite": lambda d: Composite(d["operator"], tuple(criteria_from_dict(c) for c in d["criteria"])),
    }
    kind = str(data.get("type", "")).lower()
    if kind not in kinds:
        raise InvalidQuery(f"cannot read a criterion of type {kind!r}")
    return kinds[kind]({k: v for k, v in data.items() if k != "type"}).validate()


@dataclass(frozen=True)
class Query:
    criteria: Criteria
    limit: int | None = None
    offset: int | None = None
    query_id: str = field(default_factory=lambda: str(uuid.uuid4()))

    def validate(self) -> Query:
        if self.limit is not None and self.limit <= 0:
            raise InvalidQuery("limit is not positive")
        if self.offset is not None and self.offset < 0:
            raise InvalidQuery("offset is negative")
        self.criteria.validate()
        return self

    def run(self, df: DataFrame, fields: Fields | None = None, order_by: str = "node_id", row_cap: int | None = None) -> DataFrame:
        """All predicates first, then order, offset and limit; ``row_cap`` bounds what a query without a limit returns."""
        self.validate()
        out = df.where(self.criteria.column(fields or Fields()))
        if self.limit is None and not self.offset:
            return out if row_cap is None else out.limit(row_cap)
        out = out.orderBy(order_by).offset(self.offset or 0)
        return out if self.limit is None else out.limit(self.limit)

    def to_dict(self) -> dict:
        return {"query_id": self.query_id, "limit": self.limit, "offset": self.offset, "criteria": self.criteria.to_dict()}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @staticmethod
    def from_dict(data: Mapping) -> Query:
        return Query(criteria_from_dict(data["criteria"]), data.get("limit"), data.get("offset"), data.get("query_id") or str(uuid.uuid4())).validate()

    @staticmethod
    def from_json(text: str) -> Query:
        return Query.from_dict(json.loads(text))

    def key(self) -> str:
        """A hash of what the query asks, without its id."""
        asked = {k: v for k, v in self.to_dict().items() if k != "query_id"}
        return hashlib.md5(json.dumps(asked, sort_keys=True).encode()).hexdigest()
