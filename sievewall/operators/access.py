"""Access decisions: a tree of conditions on context columns, compiled to one CASE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dialect
from ..functions.errors import ConfigurationError
from ..functions.rules import ACCESS_TREE

MISSING = "__undefined__"
# Severity, confidence and wording by action.
ACTIONS = {"allow": ("info", 0.0, "ACL decision: "), "warn": ("low", 0.3, "ACL warning: "), "deny": ("high", 0.85, "ACL denied: "), "block": ("critical", 0.95, "ACL blocked: ")}


def paths(tree: dict, seen: tuple[tuple[str, str], ...] = ()) -> list[tuple[tuple[tuple[str, str], ...], str, str, tuple[str, ...]]]:
    """(conditions as (column, value; "default": any other), action, reason, path) of each leaf; defaults after their siblings."""
    if "action" in tree:
        if tree["action"] not in ACTIONS:
            raise ConfigurationError(f"unknown action {tree['action']!r}")
        return [(seen, tree["action"], tree.get("reason", ""), tuple(f"{c}={v}" for c, v in seen))]
    column, out = tree["condition"], []
    for value in sorted(tree["branches"], key=lambda v: v == "default"):
        out += paths(tree["branches"][value], (*seen, (column, value)))
    if "default" not in tree["branches"]:
        out.append(((*seen, (column, "default")), "deny", f"No matching branch for {column}", tuple(f"{c}={v}" for c, v in (*seen, (column, "default")))))
    return out


def _when(tree: dict, value: Callable[[str, str, tuple[str, ...]], Column], context: dict[str, Column]) -> Column:
    out = None
    for conditions, action, reason, path in paths(tree):
        holds = F.lit(True)
        for column, wanted in conditions:
            if wanted != "default":
                holds = holds & (F.coalesce(context[column], F.lit(MISSING)) == wanted)
        out = F.when(holds, value(action, reason, path)) if out is None else out.when(holds, value(action, reason, path))
    return out


def decide(context: dict[str, Column], tree: dict = ACCESS_TREE) -> Column:
    """Struct (action, reason, path). Leaves come in order, a branch's default after its siblings, so the first that holds decides."""
    return F.struct(
        _when(tree, lambda a, r, p: F.lit(a), context).alias("action"),
        _when(tree, lambda a, r, p: F.lit(r), context).alias("reason"),
        _when(tree, lambda a, r, p: F.array(*map(F.lit, p)), context).alias("path"),
    )


def result(text: Column, context: dict[str, Column] | None, tree: dict = ACCESS_TREE) -> Column:
    """The detector's result struct; without context, or with no context value at all, everything is allowed."""
    empty = F.coalesce(text, F.lit("")).rlike(dialect.BLANK)
    if context is None:
        decision, some = F.struct(F.lit("allow").alias("action"), F.lit("").alias("reason"), F.array().cast("array<string>").alias("path")), F.lit(False)
    else:
        decision, some = decide(context, tree), F.coalesce(*context.values()).isNotNull()
    action = decision["action"]
    threat = ~empty & some & (action != "allow")

    def of(i: int) -> Column:
        out = F.lit(ACTIONS["allow"][i])
        for name, values in ACTIONS.items():
            out = F.when(action == name, F.lit(values[i])).otherwise(out)
        return out

    match = F.array(F.struct(F.concat(F.lit("acl_"), action).alias("name"), F.concat(F.lit("path: "), F.array_join(decision["path"], " -> ")).alias("match"), F.lit("direct_injection").alias("category")))
    return F.struct(
        F.lit("acl_decision_tree").alias("detector"),
        threat.alias("is_threat"),
        F.when(threat, of(0)).otherwise("info").alias("severity"),
        F.lit("direct_injection").alias("category"),
        F.when(threat, of(1)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(empty, "Empty input").when(~some, "No ACL context provided, allowing by default").otherwise(F.concat(of(2), decision["reason"])).alias("reason"),
        F.when(threat, match).otherwise(F.array().cast("array<struct<name:string,match:string,category:string>>")).alias("matches"),
        F.lit(None).cast("string").alias("sanitized_input"),
    )
