"""Classes, rules, labels and verdicts, and the text forms in which tables hold lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def violated(flags: dict[str, Column]) -> Column:
    """The rules whose field is set (true), in order."""
    return F.filter(F.array(*(F.when(flags[r], F.lit(r)) for r in rules.RULES)), lambda r: r.isNotNull())


def primary_class(found: Column) -> Column:
    """The first class, by priority, that a violated rule has; `compliant` without any."""
    out = F.lit(rules.CLASSES[-1])
    classes = F.transform(found, lambda r: rules.lookup(r, rules.CLASS_OF))
    for name in reversed(rules.CLASSES[:-1]):
        out = F.when(F.array_contains(classes, name), F.lit(name)).otherwise(out)
    return out


def assigned_rule(cls: Column, found: Column, index: Column) -> Column:
    """The first violated rule of the class; compliant samples go round the four rules by index (from 0)."""
    own = F.get(F.filter(found, lambda r: rules.lookup(r, rules.CLASS_OF) == cls), F.lit(0))
    turn = F.get(F.array(*map(F.lit, rules.RULES)), F.pmod(index, F.lit(len(rules.RULES))).cast("int"))
    return F.when(cls == rules.CLASSES[-1], turn).otherwise(own)


def verdict(source: Column, changed_1: Column, changed_2: Column) -> Column:
    """A grid explains nothing; otherwise an answer that changed under a mask supports the explanation."""
    return F.when(source == "grid", "no_usable_explanation").when(changed_1 | changed_2, "explanation_supported").otherwise("explanation_weak")


def phrase_of(rule: Column, label: Column) -> Column:
    """The phrase that a top region was found by."""
    first = {r: p[0] for r, p in rules.PHRASES.items()} | {"rule_4": rules.PROXIMITY_PAIR[1]}
    return F.when(label == rules.PERSON, rules.PERSON).otherwise(rules.lookup(rule, first))


def box_labels(rule: Column, workers: Column, objects: Column) -> Column:
    """A label for each of the workers' and then the objects' boxes (given as counts)."""
    return F.concat(F.array_repeat(F.lit(rules.PERSON), workers), F.array_repeat(rules.lookup(rule, rules.OBJECT_LABEL), objects))


def short_rule(field: Column) -> Column:
    return F.regexp_replace(field, "_violation$", "")


def slug(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def piped(items: Column) -> Column:
    return F.array_join(items, "|")


def unpiped(text: Column) -> Column:
    """The list of a piped cell; empty for null and empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\|"))


def is_multi(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("|")), F.lit(False))


def boxes_json(text: Column) -> Column:
    return F.from_json(text, "array<array<double>>")


def task_prompt(token: Column, text: Column | None = None) -> Column:
    """A model prompt: the task's token and the text, if any."""
    return token if text is None else F.concat(token, F.coalesce(text, F.lit("")))
