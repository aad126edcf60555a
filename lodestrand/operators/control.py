"""What is called by name around tables: handlers of rules' actions, hooks, health checks, metered and limited functions, cached pages."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.storage import cut
from lodestrand.operators import sequence

#: How bad each status is.
STATUSES = ("healthy", "degraded", "unhealthy")


def perform(triggered: DataFrame, key: str, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(key, rule_id, action, outcome, handled): what each action's handler makes of the rows that set it off.

    A handler is given its action's rows and returns them with a string ``outcome``. Actions without a handler are not handled.
    """
    rows = cut(triggered)
    out = [f(rows.where(F.col("action") == a)).select(key, "rule_id", "action", F.col("outcome").cast("string").alias("outcome"), F.lit(True).alias("handled")) for a, f in handlers.items()]
    rest = rows.where(~F.coalesce(F.col("action").isin(list(handlers)), F.lit(False)))
    return reduce(DataFrame.unionByName, out, rest.select(key, "rule_id", "action", F.lit(None).cast("string").alias("outcome"), F.lit(False).alias("handled")))


@dataclass
class Hooks:
    """Functions registered under the names of points in a process, called in the order in which they were registered."""

    at: dict[str, list[Callable]] = field(default_factory=dict)

    def register(self, name: str, f: Callable) -> None:
        self.at.setdefault(name, []).append(f)

    def call(self, name: str, *args, **kwargs) -> list:
        """What each function gives for the same arguments; nothing for a name without any."""
        return [f(*args, **kwargs) for f in self.at.get(name, [])]

    def through(self, name: str, df: DataFrame) -> DataFrame:
        """df passed through the functions one after another, as one plan."""
        return reduce(DataFrame.transform, self.at.get(name, []), df)


def health(spark: SparkSession, checks: dict[str, Callable[[], tuple[str, str]]]) -> DataFrame:
    """(name, status, message) of each check, and ``overall``: the worst of them. A check that raises is unhealthy."""
    out = []
    for name, check in checks.items():
        try:
            out.append((name, *check()))
        except Exception as e:  # whatever a check raises is its finding
            out.append((name, "unhealthy", f"{type(e).__name__}: {e}"))
    worst = max((s for _, s, _ in out), key=STATUSES.index, default="healthy")
    return spark.createDataFrame([*out, ("overall", worst, f"{len(out)} checks")], "name string, status string, message string")


@dataclass
class Ledger:
    """What metered functions have cost, at a price a unit for each (service, operation)."""

    prices: dict[tuple[str, str], float]
    entries: list[tuple[str, str, float, float]] = field(default_factory=list)

    def metered(self, service: str, operation: str, units: Callable[..., float] | None = None):
        """Book each call before it is made: units(*args) of them, or one."""

        def wrap(f):
            @wraps(f)
            def run(*args, **kwargs):
                n = float(units(*args, **kwargs)) if units else 1.0
                self.entries.append((service, operation, n, n * self.prices.get((service, operation), 0.0)))
                return f(*args, **kwargs)

            return run

        return wrap

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries, "service string, operation string, units double, cost double")


class TooMany(RuntimeError):
    """A call beyond its function's rate."""


def limited(rate: float, burst: int, clock: Callable[[], float] = time.monotonic):
    """Let ``burst`` calls through at once and ``rate`` a second after that; others raise TooMany."""

    def wrap(f):
        held = [float(burst), clock()]

        @wraps(f)
        def run(*args, **kwargs):
            now = clock()
            held[:] = [min(float(burst), held[0] + (now - held[1]) * rate), now]
            if held[0] < 1:
                raise TooMany(f.__name__)
            held[0] -= 1
            return f(*args, **kwargs)

        return run

    return wrap


def page_reads(reads: DataFrame, by: list[str], order: list[str], page: str, capacity: int) -> DataFrame:
    """(by, order, hit): whether each read finds its page (a number) in a cache of the ``capacity`` pages used last.

    A cache's reads pass through one task in order, which holds the cached numbers only.
    """

    def step(cache, number):
        cache = OrderedDict() if cache is None else cache
        hit = number in cache
        cache[number] = None
        cache.move_to_end(number)
        if len(cache) > capacity:
            cache.popitem(last=False)
        return cache, int(hit)

    return sequence.in_order(reads, by, order, page, step, "hit").withColumn("hit", F.col("hit") == 1)
