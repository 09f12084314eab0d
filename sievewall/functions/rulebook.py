"""Rules of one's own: from a JSON file or a table, looked up by section, and made into detectors.

A file is an object of sections; a section is an object of buckets, each a list of
(name, pattern), and may say ``enabled``. A section named as a built-in detector
replaces its rules and keeps its ladder; any other becomes a detector with the buckets
high, medium and low.
"""

from __future__ import annotations

import json
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.detectors import DETECTORS, Detector, plain_detector
from . import dialect
from .errors import ConfigurationError

#: Rules that a table may hold; they become part of the plan.
MOST = 5000

Book = dict[str, dict]


def load(spark: SparkSession, path: str) -> Book:
    """The sections of a JSON file, wherever Spark can read it; a file that isn't JSON has none."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).take(1))
    try:
        book = json.loads(text)
    except ValueError:
        return {}
    return book if isinstance(book, dict) else {}


def from_table(rules: DataFrame) -> Book:
    """The sections of a table (detector, bucket, name, pattern, enabled if there is one)."""
    rows = rules.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ConfigurationError(f"more than {MOST} rules")
    book: Book = {}
    for r in rows:
        section_ = book.setdefault(r["detector"], {"enabled": True})
        section_["enabled"] &= "enabled" not in rules.columns or r["enabled"] is not False
        section_.setdefault(r["bucket"], []).append({"name": r["name"], "pattern": r["pattern"]})
    return book


def section(book: Book, name: str) -> dict | None:
    found = book.get(name)
    return found if isinstance(found, dict) else None


def value(book: Book, name: str, key: str) -> object:
    """One value of a section; None if there is no such section or key."""
    return (section(book, name) or {}).get(key)


def rules_of(book: Book, name: str, strict: bool = False) -> list[tuple[str, str, str]]:
    """(bucket, name, pattern) of a section. A pattern that is none is passed over, or with ``strict`` an error."""
    out = []
    for bucket, entries in (section(book, name) or {}).items():
        for e in entries if isinstance(entries, list) else ():
            try:
                if not all(isinstance(e.get(k), str) and re.fullmatch(r"[^'\\\\]*", e["name"]) for k in ("name", "pattern")):
                    raise ConfigurationError(f"{name}: a rule needs a name and a pattern")
                out.append((bucket, e["name"], dialect.check(e["pattern"])))
            except (ConfigurationError, AttributeError) as error:
                if strict:
                    raise ConfigurationError(str(error)) from error
    return out


def detectors(book: Book, strict: bool = False) -> dict[str, Detector]:
    """All detectors with the book's rules: built-in ones that it doesn't name stay, sections that aren't enabled are left out."""
    out = {n: d for n, d in DETECTORS.items() if n not in book}
    for name in book:
        if section(book, name) is None or value(book, name, "enabled") is False:
            continue
        base = DETECTORS.get(name) or plain_detector(name)
        known = {b for buckets in base.counts.values() for b in buckets}
        out[name] = replace(base, own=tuple(r for r in rules_of(book, name, strict) if r[0] in known))
    return out
