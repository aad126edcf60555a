"""Access rules, clearances and stream decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_matches(resource: Column, pattern: Column) -> Column:
    """A pattern is '*', a resource, or the beginning of one followed by '*'."""
    return (pattern == "*") | (pattern == resource) | (F.endswith(pattern, F.lit("*")) & F.startswith(resource, F.left(pattern, F.length(pattern) - 1)))


def allowed(requests: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """requests (subject, resource, permission, ...) with ``allowed``: whether an unexpired rule (rule_subject,
    rule_resource, permissions, expiry) grants it; what no rule grants is denied.

    A rule set is small beside the requests and is broadcast by the planner where its measured size allows;
    a request is kept once, however many rules match.
    """
    named = (F.col("rule_subject") == "*") | (F.col("rule_subject") == F.col("subject"))
    match = named & rule_matches(F.col("resource"), F.col("rule_resource")) & (F.col("expiry").isNull() | (F.col("expiry") > as_of))
    grants = match & (F.array_contains("permissions", F.col("permission")) | F.array_contains("permissions", "*"))
    yes = requests.join(rules, grants, "left_semi").withColumn("allowed", F.lit(True))
    no = requests.join(rules, grants, "left_anti").withColumn("allowed", F.lit(False))
    return yes.unionByName(no)


def may_read(level: Column, compartments: Column, doc_level: Column, doc_compartments: Column) -> Column:
    """No reading up: the level must reach the document's, and every compartment of it must be held."""
    return (level >= doc_level) & (F.size(F.array_except(doc_compartments, compartments)) == 0)


def may_write(level: Column, doc_level: Column) -> Column:
    """No writing down."""
    return doc_level >= level


def decision(denied: Column, needs_mfa: Column) -> Column:
    """A denial wins over a demand for a second factor, which wins over consent."""
    return F.when(denied, "DENY").when(needs_mfa, "REQUIRE_MFA").otherwise("ALLOW")


def behaviour_score(rare_operation: Column, rare_hour: Column, rare_type: Column, history: Column) -> Column:
    """What is odd about an operation, given at least ten rows of history."""
    score = F.when(rare_operation, 0.3).otherwise(0.0) + F.when(rare_hour, 0.4).otherwise(0.0) + F.when(rare_type, 0.3).otherwise(0.0)
    return F.when(history >= 10, score).otherwise(0.0)
