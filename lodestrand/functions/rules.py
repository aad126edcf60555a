"""Rules as data: conditions become column expressions, so no rule text is ever evaluated as code."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {
    "eq": lambda a, b: a == F.lit(b),
    "ne": lambda a, b: a != F.lit(b),
    "gt": lambda a, b: a > F.lit(b),
    "ge": lambda a, b: a >= F.lit(b),
    "lt": lambda a, b: a < F.lit(b),
    "le": lambda a, b: a <= F.lit(b),
    "contains": lambda a, b: F.contains(a, F.lit(b)),
    "not_contains": lambda a, b: ~F.contains(a, F.lit(b)),
    "starts_with": lambda a, b: F.startswith(a, F.lit(b)),
    "ends_with": lambda a, b: F.endswith(a, F.lit(b)),
    "matches": lambda a, b: a.rlike(f"^(?:{b})"),
}


@dataclass(frozen=True)
class Condition:
    """A metric compared with a value; a missing metric never meets it."""

    metric: str
    operator: str
    value: object

    def column(self) -> Column:
        return F.coalesce(OPERATORS[self.operator](F.col(self.metric), self.value), F.lit(False))


@dataclass(frozen=True)
class Every:
    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Any:
    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Neither:
    """None of the parts: what a NOT over several conditions means."""

    parts: tuple

    def column(self) -> Column:
        return ~Any(self.parts).column()


@dataclass(frozen=True)
class Rule:
    rule_id: str
    condition: object
    action: str
    priority: int
    active: bool = field(default=True)


# The default governance rules with their thresholds, actions and priorities.
GOVERNANCE = (
    Rule("size_limit", Condition("size_bytes", "gt", 1073741824), "split", 10),
    Rule("fragmentation", Condition("fragmentation", "gt", 0.5), "reorganize", 8),
    Rule("low_access", Every((Condition("access_frequency", "lt", 0.1), Condition("age_days", "gt", 30))), "archive", 5),
    Rule("high_access", Condition("access_frequency", "gt", 10.0), "optimize_hot", 9),
    Rule("semantic_drift", Condition("semantic_coherence", "lt", 0.5), "semantic_reorganize", 7),
)


def triggered(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each rule that each row of rows sets off, with rule_id, action, priority and the rule's place
    among those set off: by priority from the highest, then in the order given."""
    active = [r for r in rules if r.active]
    ranked = sorted(active, key=lambda r: -r.priority)
    made = [F.when(r.condition.column(), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.action).alias("action"), F.lit(r.priority).cast("bigint").alias("priority"))) for r in ranked]
    hit = F.posexplode(F.filter(F.array(*made), lambda x: x.isNotNull()))
    return rows.select("*", hit.alias("place", "rule")).withColumn("place", F.col("place").cast("bigint")).select("*", "rule.*").drop("rule")
