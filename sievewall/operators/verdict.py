"""Screening: an ordered list of detectors, their results, and one verdict for each row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import DetectionError, PipelineError
from ..functions.schema import BLOCKED, RESULT, SEVERITIES
from . import access, detectors, similarity

#: The built-in detectors, in the order that decides which reason blocks.
ORDER = ("direct_injection", "bypass_detection", "memory_poisoning", "goal_hijack", "exfiltration", "inter_agent_injection", "vector_similarity", "acl_decision_tree", "content_framing", "indirect_injection", "document_injection")


def rank(severity: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, F.lit(i)).otherwise(out)
    return out


def max_severity(results: Column) -> Column:
    """The gravest severity among threats, else info."""
    top = F.array_max(F.transform(results, lambda r: F.when(r["is_threat"], rank(r["severity"])).otherwise(0)))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(top, F.lit(0)) + 1)


def blocking(results: Column, block: Iterable[str] = BLOCKED, least: float = 0.0) -> Column:
    """The results that block: threats of a blocked category, or critical, with a confidence of at least ``least``."""
    block = tuple(block)
    return F.filter(results, lambda r: r["is_threat"] & (r["confidence"] >= least) & ((r["category"].isin(*block) if block else F.lit(False)) | (r["severity"] == "critical")))


class Screening:
    """Detectors in order; ``run`` adds their results and the verdict to a DataFrame.

    A detector of one's own is a function from the text column to a column of type ``RESULT``.
    If it can't be built, its row says so and is safe, as screening fails open.

    rules: detectors by name, as ``rulebook`` makes them; one that is missing there is switched off.
    max_input_length: code points of a text that are screened (None: all). min_confidence: what a
    threat must reach to block.
    """

    def __init__(self, block: Iterable[str] = BLOCKED, threshold: float = similarity.THRESHOLD, rules: dict[str, detectors.Detector] | None = None, max_input_length: int | None = None, min_confidence: float = 0.0) -> None:
        self.block, self.threshold = tuple(block), threshold
        self.rules = detectors.DETECTORS if rules is None else rules
        self.max_input_length, self.min_confidence = max_input_length, min_confidence
        self._detectors: list[tuple[str, Callable[[Column], Column] | None]] = []

    @classmethod
    def full(cls, **settings) -> Screening:
        """With all built-in detectors."""
        out = cls(**settings)
        for name in ORDER:
            out.add(name)
        return out

    def add(self, name: str, build: Callable[[Column], Column] | None = None) -> Screening:
        if build is None and name not in ORDER and name not in self.rules:
            raise PipelineError(f"no detector is called {name!r}")
        self._detectors.append((name, build))
        return self

    def remove(self, name: str) -> bool:
        kept = [d for d in self._detectors if d[0] != name]
        found = len(kept) < len(self._detectors)
        self._detectors = kept
        return found

    @property
    def detectors(self) -> list[str]:
        return [name for name, _ in self._detectors]

    def run(self, df: DataFrame, text: str = "text", context: dict[str, str] | None = None) -> DataFrame:
        """``df`` with results, blocked, block_reason, severity, sanitized_text, allowed.

        context: the columns of user_role, request_type and data_classification.
        """
        found, results = {}, []
        own = [self.rules[name] for name, build in self._detectors if build is None and name in self.rules]
        before = df.columns
        if self.max_input_length is None:
            column = F.col(text)
        else:
            df = df.withColumn("_cut", F.substring(text, 1, self.max_input_length))
            column = F.col("_cut")
        df = detectors.scan(df, text if self.max_input_length is None else "_cut", own) if own else df
        for name, build in self._detectors:
            if build is not None:
                try:
                    results.append(build(column))
                except Exception as e:
                    results.append(_failed(name, DetectionError(f"Detector error: {e}", name, e)))
            elif name in self.rules:
                results.append(F.expr(detectors.result_sql(self.rules[name])))
            elif name in detectors.DETECTORS:
                continue  # switched off
            elif name == "vector_similarity":
                found["_similar"] = similarity.scores(column)
                results.append(similarity.result(column, F.col("_similar"), self.threshold))
            else:
                results.append(access.result(column, None if context is None else {k: F.col(v) for k, v in context.items()}))
        every = F.array(*results) if results else F.array().cast(f"array<{RESULT.simpleString()}>")
        out = df.withColumns(found) if found else df
        # The partition's number isn't deterministic to Spark, which so keeps filters on the verdict above this
        # projection: pushed below it, they would hold the whole of it again for each column they name.
        every = F.when(F.spark_partition_id() >= 0, every)
        out = out.withColumn("results", every).select(*before, "results").withColumn("_blocking", blocking(F.col("results"), self.block, self.min_confidence))
        sanitized = F.get(F.filter("results", lambda r: F.coalesce(r["sanitized_input"], F.lit("")) != ""), F.lit(0))["sanitized_input"]
        return out.withColumns({
            "blocked": F.size("_blocking") > 0,
            "block_reason": F.coalesce(F.get("_blocking", F.lit(0))["reason"], F.lit("")),
            "block_detector": F.coalesce(F.get("_blocking", F.lit(0))["detector"], F.lit("")),
            "severity": max_severity(F.col("results")),
            "sanitized_text": F.coalesce(sanitized, F.col(text)),
            "allowed": F.size("_blocking") == 0,
        }).drop("_blocking")


def _failed(name: str, error: DetectionError) -> Column:
    return F.struct(
        F.lit(name).alias("detector"), F.lit(False).alias("is_threat"), F.lit("info").alias("severity"), F.lit("direct_injection").alias("category"), F.lit(0.0).alias("confidence"),
        F.lit(str(error)).alias("reason"), F.array().cast("array<struct<name:string,match:string,category:string>>").alias("matches"), F.lit(None).cast("string").alias("sanitized_input"),
    )
