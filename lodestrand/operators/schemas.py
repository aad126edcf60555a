"""Schema evolution and validation, as functions from table to table."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def rename(old: str, new: str) -> Step:
    return lambda df: df.withColumnRenamed(old, new)


def change_type(name: str, kind: str) -> Step:
    """Values that can't be converted become null."""
    return lambda df: df.withColumn(name, F.col(name).try_cast(kind))


def add(name: str, value: object) -> Step:
    return lambda df: df.withColumn(name, F.lit(value))


def remove(name: str) -> Step:
    return lambda df: df.drop(name)


def merge(names: list[str], into: str, sep: str) -> Step:
    return lambda df: df.withColumn(into, F.concat_ws(sep, *names)).drop(*names)


def split(name: str, into: list[str], sep: str) -> Step:
    return lambda df: df.withColumns({n: F.get(F.split(name, sep), F.lit(k)) for k, n in enumerate(into)}).drop(name)


def extract(name: str, pattern: str, into: str, group: int = 1) -> Step:
    """A group of a pattern that must match from the value's beginning; empty if it doesn't."""
    return lambda df: df.withColumn(into, F.regexp_extract(name, f"^(?:{pattern})", group))


class Registry:
    """Schema versions with the steps between them."""

    def __init__(self):
        self.steps: dict[str, dict[str, list[Step]]] = {}

    def register(self, old: str, new: str, *steps: Step) -> None:
        self.steps.setdefault(old, {})[new] = list(steps)

    def path(self, old: str, new: str) -> list[str]:
        """The shortest way from one version to another."""
        before, queue = {old: None}, deque([old])
        while queue:
            at = queue.popleft()
            if at == new:
                way = [at]
                while before[way[-1]] is not None:
                    way.append(before[way[-1]])
                return way[::-1]
            for n in self.steps.get(at, {}):
                if n not in before:
                    before[n] = at
                    queue.append(n)
        raise ValueError(f"no way from schema {old} to {new}")

    def upgrade(self, df: DataFrame, old: str, new: str) -> DataFrame:
        way = self.path(old, new)
        for a, b in zip(way, way[1:], strict=False):
            for step in self.steps[a][b]:
                df = df.transform(step)
        return df


def errors(json: Column, required: dict[str, str]) -> Column:
    """What is wrong with a JSON object: missing fields and fields of another type (string, number, boolean, array, object)."""
    kinds = {"string": "^STRING", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^(OBJECT|STRUCT)"}
    value = F.try_parse_json(json)
    found = [F.when(value.isNull(), "not json")]
    for name, kind in required.items():
        field = F.try_variant_get(value, f"$.{name}", "variant")
        found.append(F.when(value.isNotNull() & field.isNull(), f"{name} is missing").when(field.isNotNull() & ~F.schema_of_variant(field).rlike(kinds[kind]), f"{name} is not {kind}"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())
