"""Severities, categories and result types."""

from __future__ import annotations

from pyspark.sql import types as T

# Severities from least to most, and their weights for escalation.
SEVERITIES = ("info", "low", "medium", "high", "critical")
WEIGHTS = {"info": 0, "low": 1, "medium": 3, "high": 7, "critical": 10}

# Threat categories, and those that block by default.
CATEGORIES = ("direct_injection", "indirect_injection", "multimodal_injection", "document_injection", "environment_manipulation", "memory_poisoning", "goal_hijack", "exfiltration", "inter_agent_injection", "bypass_detection")
BLOCKED = ("direct_injection", "bypass_detection", "exfiltration", "memory_poisoning", "inter_agent_injection")

MATCH = T.StructType([T.StructField("name", T.StringType()), T.StructField("match", T.StringType()), T.StructField("category", T.StringType())])
RESULT = T.StructType([
    T.StructField("detector", T.StringType()), T.StructField("is_threat", T.BooleanType()), T.StructField("severity", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("matches", T.ArrayType(MATCH)), T.StructField("sanitized_input", T.StringType()),
])
