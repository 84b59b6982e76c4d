"""Results: sorting, pages, and the request and response of the documented query endpoint."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.search import by_distance
from tesserae.plans.criteria import Fields, InvalidQuery, Query, Spatial, Temporal


@dataclass(frozen=True)
class Pages:
    total: int
    size: int
    page: int = 1

    @property
    def count(self) -> int:
        return math.ceil(self.total / self.size)

    @property
    def has_next(self) -> bool:
        return self.page < self.count

    @property
    def has_previous(self) -> bool:
        return self.page > 1

    def next(self) -> int | None:
        return self.page + 1 if self.has_next else None

    def previous(self) -> int | None:
        return self.page - 1 if self.has_previous else None


class Result:
    """A query result: transformations stay a plan; pages need a total order."""

    def __init__(self, df: DataFrame, order_by: list[str] | str = "node_id"):
        self.df, self.order_by = df, [order_by] if isinstance(order_by, str) else order_by

    def sort(self, key: Column | str, reverse: bool = False) -> Result:
        key = F.col(key) if isinstance(key, str) else key
        return Result(self.df.orderBy(key.desc() if reverse else key.asc(), *self.order_by), self.order_by)

    def filter(self, predicate: Column) -> Result:
        return Result(self.df.where(predicate), self.order_by)

    def map(self, *columns: Column | str) -> Result:
        return Result(self.df.select(*columns), self.order_by)

    def count(self) -> int:
        return self.df.count()

    def page(self, number: int, size: int) -> DataFrame:
        if size <= 0 or number < 1:
            raise InvalidQuery("pages and sizes start at 1")
        if number > 1 and number > Pages(self.count(), size).count:
            raise InvalidQuery(f"there is no page {number}")
        return self.df.orderBy(*self.order_by).offset((number - 1) * size).limit(size)

    def batch(self, offset: int, limit: int) -> DataFrame:
        return self.df.orderBy(*self.order_by).offset(offset).limit(limit)

    def rows(self) -> Iterator:
        """Rows one partition at a time; the driver never holds more."""
        return self.df.toLocalIterator(prefetchPartitions=True)


def sorted_by(df: DataFrame, key: Column, descending: bool = False, tie: str = "node_id") -> DataFrame:
    """By a key that counts as 0 where missing."""
    key = F.coalesce(key, F.lit(0))
    return df.orderBy(key.desc() if descending else key.asc(), tie)


def execute_query(request: dict, df: DataFrame, fields: Fields | None = None) -> dict:
    """The response of a request {spatial_criteria, temporal_criteria, limit, offset, sort_by, sort_order}.

    Filters come first, then order, then the page; ``rows`` is a DataFrame of the page.
    """
    fields = fields or Fields()
    limit, offset = request.get("limit", 100), request.get("offset", 0)
    if limit <= 0 or offset < 0:
        raise InvalidQuery("limit or offset out of range")
    space, time = request.get("spatial_criteria"), request.get("temporal_criteria")
    kind = "COMBINED" if space and time else "SPATIAL" if space else "TEMPORAL" if time else "BASIC"
    out = df
    if space:
        out = out.where(spatial(space).column(fields))
    if time:
        out = out.where(Temporal(time.get("start"), time.get("end")).column(fields))
    order = request.get("sort_by")
    if order == "distance":
        x, y = space.get("point") or (space["center_x"], space["center_y"])
        out_sorted = sorted_by(out, F.sqrt((F.col(fields.x) - x) ** 2 + (F.col(fields.y) - y) ** 2), request.get("sort_order") == "desc")
    else:
        key = F.col(fields.time) if order == "temporal" else F.col(order) if order else F.col("node_id")
        out_sorted = sorted_by(out, key, request.get("sort_order") == "desc")
    total = out.count()
    return {"type": kind, "rows": out_sorted.offset(offset).limit(limit), "total": total, "page": offset // limit + 1, "pages": math.ceil(total / limit)}


def spatial(space: dict) -> Spatial:
    """A point with a distance, a region, or the fields of the criterion itself."""
    if "point" in space:
        return Spatial(center_x=space["point"][0], center_y=space["point"][1], radius=space["distance"])
    if "region" in space:
        (x1, y1), (x2, y2) = space["region"]
        return Spatial(x1, y1, x2, y2)
    return Spatial(**space)


def spatial_query(df: DataFrame, point=None, distance=None, region=None, limit: int = 100) -> dict:
    space = {"point": point, "distance": distance} if point is not None else {"region": region}
    return execute_query({"spatial_criteria": space, "limit": limit}, df)


def temporal_query(df: DataFrame, start_time: float, end_time: float | None = None, limit: int = 100) -> dict:
    import time

    return execute_query({"temporal_criteria": {"start": start_time, "end": time.time() if end_time is None else end_time}, "limit": limit}, df)


def combined_query(df: DataFrame, spatial_criteria: dict, temporal_criteria: dict, limit: int = 100) -> dict:
    return execute_query({"spatial_criteria": spatial_criteria, "temporal_criteria": temporal_criteria, "limit": limit}, df)


def server_statistics(df: DataFrame) -> DataFrame:
    """One row for the endpoint of statistics: nodes, kinds, users, and the ends of time."""
    return df.agg(F.count("*").alias("nodes"), F.countDistinct("node_type").alias("kinds"), F.countDistinct("user_id").alias("users"), F.min("t").alias("first"), F.max("t").alias("last"))


def nearest(df: DataFrame, x: float, y: float, k: int) -> DataFrame:
    return by_distance(df, F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2), k)


def run_json(text: str, df: DataFrame) -> DataFrame:
    return Query.from_json(text).run(df)
