"""Protection of texts: sanitising, validation of outputs, canary markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dialect

# What is removed, by stage: label, pattern, flags. Paired elements are written out by name.
_PAIRED = "|".join(rf"<{t}[^>]*>[\s\S]*?</{t}>" for t in ("script", "style", "iframe", "object", "embed", "link", "meta"))
STAGES: list[tuple[str, str, str]] = [
    ("HTML", rf"{_PAIRED}|<script[^>]*>[\s\S]*?</script[\s\S]*?>|<!--[\s\S]*?-->", "i"),
    ("ZWC", r"[​‌‍﻿]{3,}", ""),
    ("dataURI", r"data\s*:\s*(?:text|image|application)/[^;]+;base64,[A-Za-z0-9+/]+=*", ""),
    ("token", r"<\|endofprompt\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|</system>|</prompt>", "i"),
]
# What outputs are checked for: type, category, pattern, flags.
CHECKS: list[tuple[str, str, str, str]] = [
    ("email", "pii", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ""),
    ("cc", "pii", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", ""),
    ("cred", "pii", r"\b(?:password|pwd|apiKey|api_key|token|secret_key)\s*[:=]\s*\S{8,}", ""),
    ("xss", "inj", r"<script|javascript:|<iframe|on\w+\s*=", "i"),
    ("sqli", "inj", r"\bUNION\s+SELECT\b", "i"),
]
CUT = 80


def _anything(pattern: str) -> str:
    r"""[\s\S] in a form that both engines take."""
    return pattern.replace(r"[\s\S]", r"[\x{0}-\x{10FFFF}]")


def stage_pattern(pattern: str, engine: str, flags: str) -> str:
    return dialect.render(_anything(pattern), engine, flags)


#: Of the paired elements, those that are void in HTML: nearly every page opens some, hardly any closes one.
_VOID = ("embed", "link", "meta")


def _removed(label: str, pattern: str, flags: str, now: str) -> Column:
    """``now`` without what the stage removes.

    Without a closing tag of a void element, none of these elements can match; their alternatives,
    which would look for one from each opening tag to the end of the page, are left out.
    """
    text = F.col(now)
    whole = F.regexp_replace(text, stage_pattern(pattern, "spark", flags), "")
    if label != "HTML":
        return whole
    kept = "|".join(x for x in pattern.split("|") if not any(x.startswith(f"<{t}[") for t in _VOID))
    lower = F.lower(text)
    closed = F.lit(False)
    for t in _VOID:
        closed = closed | lower.contains(f"</{t}>")
    return F.when(closed, whole).otherwise(F.regexp_replace(text, stage_pattern(kept, "spark", flags), ""))


def sanitize(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with clean, modified, removals. A null text is empty. White space is tidied, but doesn't count as a change.

    Each stage is a projection of its own, which the next ones use more than once, so none runs twice.
    """
    out = df.withColumn("_s0", F.coalesce(text, F.lit("")))
    for i, (label, pattern, flags) in enumerate(STAGES):
        out = out.withColumn(f"_s{i + 1}", _removed(label, pattern, flags, f"_s{i}"))
    n = len(STAGES)
    removals = F.array_compact(F.array(*[F.when(F.col(f"_s{i + 1}") != F.col(f"_s{i}"), F.lit(STAGES[i][0])) for i in range(n)]))
    tidy = F.regexp_replace(F.regexp_replace(F.col(f"_s{n}"), " {2,}", " "), r"\t+", " ")
    space = dialect.render(r"\s", "spark", "")
    out = out.withColumn("removals", removals).withColumn("clean", F.regexp_replace(tidy, rf"^{space}+|{space}+\z", ""))
    return out.withColumn("modified", F.size("removals") > 0).drop(*[f"_s{i}" for i in range(n + 1)])


#: What a text must hold for a check to be worth its pattern: every match implies it.
_WORTH = {
    "email": lambda t, low: t.contains("@"),
    "cc": lambda t, low: t.rlike(r"[0-9]{4}[^0-9]?[0-9]{4}"),
    "cred": lambda t, low: (t.contains(":") | t.contains("=")) & t.rlike("password|pwd|apiKey|api_key|token|secret_key"),
    "xss": lambda t, low: low.contains("<script") | low.contains("javascript:") | low.contains("<iframe") | (t.contains("=") & low.contains("on")),
    "sqli": lambda t, low: low.contains("union") & low.contains("select"),
}


def validate(text: Column) -> Column:
    """Array of (type, category, match) of the checks that fail, each its first match, cut; empty if the text is safe."""
    own = F.coalesce(text, F.lit(""))
    found = []
    for t, c, p, f in CHECKS:
        match = F.when(_WORTH[t](own, F.lower(own)), F.regexp_extract(own, dialect.render(p, "spark", f), 0)).otherwise("")
        found.append(F.struct(F.lit(t).alias("type"), F.lit(c).alias("category"), F.substring(match, 1, CUT).alias("match")))
    return F.filter(F.array(*found), lambda x: x["match"] != "")


def secret(key: Column, salt: str) -> Column:
    """32 hex digits, by key and salt: the same each time the plan runs."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), key.cast("string")), 256), 1, 32)


def insert_canary(text: Column, mark: Column) -> Column:
    """The text with a marker: at the beginning of up to 50 characters, else after a third."""
    own = F.coalesce(text, F.lit(""))
    at = F.when(F.length(own) > 50, F.floor(F.length(own) / 3)).otherwise(0).cast("int")
    return F.concat(F.substring(own, F.lit(1), at), F.lit(" CANARY["), mark, F.lit("] "), F.substring(own, at + 1, F.length(own)))


MARK = r"CANARY\[([0-9a-f]+)\]"


def check_canaries(outputs: DataFrame, canaries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, secret, every column of ``canaries``) of each known marker in each output, once; markers join by equality, not by search."""
    marks = outputs.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(1)))).alias("_mark"))
    return marks.join(canaries, marks["_mark"] == canaries["secret"]).drop("_mark").withColumnRenamed("_key", f"found_{key}")


def canary_report(outputs: DataFrame, canaries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, has_leak, total_leaked, leaked_secrets, total_inserted) for each row of ``outputs``, leaks or none.

    total_inserted counts all canaries; total_leaked those found in this output, each once.
    """
    found = check_canaries(outputs, canaries.select("secret").distinct(), key, text)
    leaks = found.groupBy(F.col(f"found_{key}").alias("_key")).agg(F.count("*").alias("total_leaked"), F.array_sort(F.collect_list("secret")).alias("leaked_secrets"))
    rows = outputs.join(leaks, F.col(key) == F.col("_key"), "left")
    n = F.coalesce("total_leaked", F.lit(0).cast("long"))
    return rows.select(key, (n > 0).alias("has_leak"), n.alias("total_leaked"), F.coalesce("leaked_secrets", F.array().cast("array<string>")).alias("leaked_secrets"), F.lit(canaries.select("secret").distinct().count()).alias("total_inserted"))


def mark_leaked(canaries: DataFrame, outputs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``canaries`` with ``leaked``: whether any output so far held the marker; what is marked already stays so."""
    found = check_canaries(outputs, canaries.select("secret").distinct(), key, text).select(F.col("secret").alias("_found")).distinct()
    before = F.coalesce("leaked", F.lit(False)) if "leaked" in canaries.columns else F.lit(False)
    return canaries.join(found, canaries["secret"] == found["_found"], "left").withColumn("leaked", before | F.col("_found").isNotNull()).drop("_found")
