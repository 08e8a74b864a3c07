"""The rule dimension: phrases, classes and thresholds of the four safety rules.

Fixed values, which must be these for right results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERSON = "worker"
PHRASES = {
    "rule_1": ("hard hat", "high-visibility vest"),
    "rule_2": ("safety harness", "fall-protection lanyard"),
    "rule_3": ("guardrail", "edge protection barrier"),
}
PROXIMITY_PAIR = ("worker", "excavator")
OBJECT_LABEL = {"rule_1": "hard hat", "rule_2": "harness", "rule_3": "guardrail", "rule_4": "excavator"}
CLASS_OF = {"rule_1": "ppe_violation", "rule_2": "fall_hazard", "rule_3": "fall_hazard", "rule_4": "struck_by_risk"}
CLASSES = ("ppe_violation", "fall_hazard", "struck_by_risk", "compliant")
THRESHOLD = {"rule_1": 0.08, "rule_2": 0.08, "rule_3": 0.20, "rule_4": 0.05}
RULES = tuple(CLASS_OF)


def dimension(spark: SparkSession) -> DataFrame:
    """rule_id, phrase_0, phrase_1, class, object_label, threshold_frac, kind: four rows, safe to broadcast."""
    rows = [(r, *(PHRASES.get(r) or PROXIMITY_PAIR), CLASS_OF[r], OBJECT_LABEL[r], THRESHOLD[r], "presence" if r in PHRASES else "proximity") for r in RULES]
    return spark.createDataFrame(rows, "rule_id string, phrase_0 string, phrase_1 string, class string, object_label string, threshold_frac double, kind string")


def lookup(rule: Column, table: dict[str, object]) -> Column:
    """The rule's value in a table of the dimension; null for other rules."""
    out = F.lit(None)
    for key, value in table.items():
        out = F.when(rule == key, F.lit(value)).otherwise(out)
    return out


def known(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """value, or an error that names what it should have been. Nulls pass."""
    return F.when(value.isNull() | value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)))


def grounding_query(rule: Column, phrasing: int = 0) -> Column:
    """The phrase to look for; a proximity rule has no single phrase and raises."""
    return lookup(known(rule, tuple(PHRASES), "presence rule"), {r: p[phrasing] for r, p in PHRASES.items()})
