"""Rule policies compiled to columns.

A condition is a nested dict: {"all": [...]}, {"any": [...]}, {"not": ...} or
{"left": operand, "operator": OP, "right": operand}; an operand names a feature, a parameter or a
literal. A comparison with a value that is not usable is unknown (null); all/any/not follow the
three-valued logic of SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tideglass.functions.scalars import VALUED_STATES

COMPARE = {
    "EQ": lambda a, b: a == b, "NE": lambda a, b: a != b, "GT": lambda a, b: a > b, "GTE": lambda a, b: a >= b,
    "LT": lambda a, b: a < b, "LTE": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    priority: int
    condition: dict
    code: str
    severity: str
    dimensions: tuple[str, ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class Policy:
    policy_id: str
    key: str
    mode: str
    parameters: dict[str, float]
    rules: tuple[Rule, ...]
    missing: str = "INSUFFICIENT_EVIDENCE"
    version: int = 1
    extra: dict = field(default_factory=dict)

    def ordered(self) -> list[Rule]:
        return sorted((r for r in self.rules if r.enabled), key=lambda r: r.priority)


def _at_least(feature: str, parameter: str) -> dict:
    return {"left": {"feature": feature}, "operator": "GTE", "right": {"parameter": parameter}}


# The three reference policies with their default thresholds.
REPEATED_PAYMENT_RETURN = Policy(
    "POL-CORP-REPEATED-PAYMENT-RETURN-001", "REPEATED_PAYMENT_RETURN", "ALL_MATCHES",
    {"PAYMENT_RETURN_COUNT_THRESHOLD": 3},
    (Rule("R-PPR-001", 100, _at_least("returned_payment_count_30d", "PAYMENT_RETURN_COUNT_THRESHOLD"),
          "REPEATED_PAYMENT_RETURN", "HIGH", ("REPAYMENT_CONDUCT", "LIQUIDITY")),),
)
DPD_DETERIORATION = Policy(
    "POL-CORP-DPD-DETERIORATION-001", "DPD_DERIORATION", "PRIORITY",
    {"DPD_WARNING_THRESHOLD": 15, "DPD_HIGH_THRESHOLD": 30},
    (
        Rule("R-DPD-001", 100, _at_least("current_dpd", "DPD_HIGH_THRESHOLD"), "DPD_DERIORATION", "HIGH",
             ("REPAYMENT_CONDUCT", "CASH_FLOW_DEBT_SERVICE")),
        Rule("R-DPD-002", 200, _at_least("current_dpd", "DPD_WARNING_THRESHOLD"), "DPD_DERIORATION", "MEDIUM",
             ("REPAYMENT_CONDUCT", "CASH_FLOW_DEBT_SERVICE")),
    ),
)
HIGH_UTILIZATION = Policy(
    "POL-CORP-HIGH-UTILIZATION-001", "UTILIZATION_HIGH", "PRIORITY",
    {"UTILIZATION_HIGH_THRESHOLD": 0.85, "CRITICAL_UTILIZATION_THRESHOLD": 0.95},
    (
        Rule("R-UTL-001", 100, _at_least("utilization_ratio", "CRITICAL_UTILIZATION_THRESHOLD"), "UTILIZATION_HIGH",
             "HIGH", ("LIQUIDITY", "REFINANCING_FUNDING")),
        Rule("R-UTL-002", 200, _at_least("utilization_ratio", "UTILIZATION_HIGH_THRESHOLD"), "UTILIZATION_HIGH",
             "MEDIUM", ("LIQUIDITY", "REFINANCING_FUNDING")),
    ),
)


def features_of(condition: dict) -> list[str]:
    for key in ("all", "any"):
        if key in condition:
            return [f for c in condition[key] for f in features_of(c)]
    if "not" in condition:
        return features_of(condition["not"])
    return [o["feature"] for o in (condition.get("left"), condition.get("right")) if isinstance(o, dict) and "feature" in o]


class Compiler:
    """Turns conditions into columns for rows that carry ``<feature>`` and ``<feature>_state``."""

    def __init__(self, parameters: dict[str, float], overrides: dict[str, Column] | None = None):
        self.parameters = parameters
        self.overrides = overrides or {}

    def operand(self, o: dict):
        if "feature" in o:
            name = o["feature"]
            return F.when(F.col(f"{name}_state").isin(VALUED_STATES), F.col(name))
        if "parameter" in o:
            default = F.lit(self.parameters[o["parameter"]])
            given = self.overrides.get(o["parameter"])
            return default if given is None else F.coalesce(given, default)
        value = o["literal"]
        return [F.lit(v) for v in value] if isinstance(value, list) else F.lit(value)

    def condition(self, c: dict) -> Column:
        if "all" in c:
            return reduce(lambda a, b: a & b, [self.condition(x) for x in c["all"]])
        if "any" in c:
            return reduce(lambda a, b: a | b, [self.condition(x) for x in c["any"]])
        if "not" in c:
            return ~self.condition(c["not"])
        left, op = self.operand(c["left"]), c["operator"]
        if op == "IS_NULL":
            return left.isNull()
        if op == "IS_NOT_NULL":
            return left.isNotNull()
        right = self.operand(c["right"])
        if op == "IN":
            return left.isin(*right)
        if op == "NOT_IN":
            return ~left.isin(*right)
        if op == "BETWEEN":
            return left.between(right[0], right[1])
        return COMPARE[op](left, right)

    def rule(self, rule: Rule) -> Column:
        """true, false or null (unknown); a feature that does not apply makes the rule false."""
        names = features_of(rule.condition)
        skip = reduce(lambda a, b: a | b, [F.col(f"{n}_state") == "NOT_APPLICABLE" for n in names]) if names else F.lit(False)
        return F.when(skip, F.lit(False)).otherwise(self.condition(rule.condition))


def evaluate(rows: DataFrame, policy: Policy, overrides: dict[str, Column] | None = None, into: str = "result") -> DataFrame:
    """Add a struct (status, rule_id, outcome_code, severity) for PRIORITY and FIRST_MATCH policies."""
    compiler = Compiler(policy.parameters, overrides)
    undecided = {"RULE_NOT_MATCHED": "NOT_MATCHED", "FAIL_EVALUATION": "FAILED"}.get(policy.missing, "INSUFFICIENT_EVIDENCE")

    def outcome(status, rule=None):
        return F.struct(
            F.lit(status).alias("status"), F.lit(rule.rule_id if rule else None).cast("string").alias("rule_id"),
            F.lit(rule.code if rule else None).cast("string").alias("outcome_code"),
            F.lit(rule.severity if rule else None).cast("string").alias("severity"),
        )

    chain = None
    for rule in policy.ordered():
        hit = compiler.rule(rule)
        if undecided == "NOT_MATCHED":
            hit = F.coalesce(hit, F.lit(False))
        else:
            chain = F.when(hit.isNull(), outcome(undecided)) if chain is None else chain.when(hit.isNull(), outcome(undecided))
        chain = F.when(hit, outcome("MATCHED", rule)) if chain is None else chain.when(hit, outcome("MATCHED", rule))
    return rows.withColumn(into, chain.otherwise(outcome("NOT_MATCHED")))


def trace(rows: DataFrame, policy: Policy, overrides: dict[str, Column] | None = None) -> DataFrame:
    """One struct per enabled rule with its operands, verdict and reason, in priority order."""
    compiler = Compiler(policy.parameters, overrides)
    entries = []
    for rule in policy.ordered():
        hit = compiler.rule(rule)
        names = features_of(rule.condition)
        not_applicable = reduce(lambda a, b: a | b, [F.col(f"{n}_state") == "NOT_APPLICABLE" for n in names])
        entries.append(
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.priority).alias("priority"),
                F.lit(rule.code).alias("outcome_code"), F.lit(rule.severity).alias("severity"),
                F.array(*[F.col(n).cast("double") for n in names]).alias("operands"),
                F.when(hit.isNull(), "UNKNOWN").when(hit, "MATCHED").otherwise("NOT_MATCHED").alias("verdict"),
                F.when(not_applicable, "FEATURE_NOT_APPLICABLE").when(hit.isNull(), "FEATURE_NOT_USABLE")
                .when(hit, "CONDITION_TRUE").otherwise("CONDITION_FALSE").alias("reason"),
            )
        )
    return rows.withColumn("trace", F.array(*entries))


def evaluate_all(rows: DataFrame, policy: Policy, overrides: dict[str, Column] | None = None) -> DataFrame:
    """One row per matching rule for ALL_MATCHES policies."""
    traced = trace(rows, policy, overrides)
    return traced.withColumn("match", F.explode(F.filter("trace", lambda r: r["verdict"] == "MATCHED"))).drop("trace")


def simulate(rows: DataFrame, baseline: Policy, candidate: Policy) -> DataFrame:
    """Both policies on the same population in one pass; no join of two runs is needed."""
    return evaluate(evaluate(rows, baseline, into="baseline"), candidate, into="candidate")


def simulation_summary(simulated: DataFrame, entity: str) -> DataFrame:
    count = lambda run, status: F.sum((F.col(f"{run}.status") == status).cast("int"))
    return simulated.agg(
        F.count(F.lit(1)).alias("evaluations"),
        count("candidate", "MATCHED").alias("matched"), count("candidate", "NOT_MATCHED").alias("not_matched"),
        count("candidate", "INSUFFICIENT_EVIDENCE").alias("insufficient"), count("candidate", "FAILED").alias("failed"),
        F.count_distinct(F.when(F.col("candidate.status") == "MATCHED", F.col(entity))).alias("unique_entities"),
        (count("candidate", "MATCHED") - count("baseline", "MATCHED")).alias("delta_matched"),
    )


def impact(simulated: DataFrame, by: Column, name: str) -> DataFrame:
    hit = lambda run: F.sum((F.col(f"{run}.status") == "MATCHED").cast("int"))
    return simulated.groupBy(by.alias(name)).agg(
        hit("candidate").alias("candidate"), hit("baseline").alias("baseline"), (hit("candidate") - hit("baseline")).alias("delta")
    )


def rule_impact(simulated: DataFrame) -> DataFrame:
    """Matches per rule in both runs; each row is counted under the rule that decided it."""
    sides = F.array(
        F.struct(F.col("candidate.rule_id").alias("rule_id"), F.lit(1).alias("c"), F.lit(0).alias("b")),
        F.struct(F.col("baseline.rule_id").alias("rule_id"), F.lit(0).alias("c"), F.lit(1).alias("b")),
    )
    rows = simulated.select(F.explode(sides).alias("s")).filter("s.rule_id IS NOT NULL")
    return rows.groupBy(F.col("s.rule_id").alias("rule_id")).agg(
        F.sum("s.c").alias("candidate"), F.sum("s.b").alias("baseline"), (F.sum("s.c") - F.sum("s.b")).alias("delta")
    )
