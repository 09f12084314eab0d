"""The nine pattern detectors: hits, counts by bucket, and ladders of severity.

A ladder is data: rungs of (condition on counts, severity, cap, base, step, count).
The same rungs become Spark columns and DuckDB SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dialect
from ..functions.errors import ConfigurationError
from ..functions.rules import RULES

Rung = tuple[str, str, float, float, float, str]


@dataclass(frozen=True)
class Detector:
    """counts: letter -> buckets; rungs use the letters, and A for all hits."""

    name: str
    category: str
    counts: dict[str, tuple[str, ...]]
    rungs: tuple[Rung, ...]
    none: str
    says: str
    #: (bucket, name, pattern) of one's own; None: the built-in ones.
    own: tuple[tuple[str, str, str], ...] | None = None

    @property
    def rules(self) -> list[tuple[str, str, str]]:
        if self.own is not None:
            return list(self.own)
        return [(bucket, name, pattern) for bucket, rules in RULES[self.name].items() for name, pattern in rules]

    @property
    def decodes(self) -> bool:
        """Whether what a base64 rule finds is looked at decoded."""
        return self.name == "bypass_detection" and any(name == "base64_payload" for _, name, _ in self.rules)


def _levels(first: float, medium_high: tuple[float, float] | None, medium: float, caps: tuple[float, float], bases: tuple[float, float]) -> tuple[Rung, ...]:
    rungs: list[Rung] = [("H >= 2", "critical", caps[0], bases[0], 0.1, "H"), ("H >= 1", "high", caps[1], bases[1], 0.1, "M")]
    if medium_high:
        rungs.append(("M >= 2", "high", *medium_high, 0.1, "M"))
    return (*rungs, ("M >= 1", "medium", 1.0, medium, 0.1, "M"), ("A >= 1", "low", 1.0, first, 0.05, "A"))


_HML = {"H": ("high",), "M": ("medium",), "L": ("low",)}
_MEMORY = _levels(0.2, (0.7, 0.45), 0.4, (0.95, 0.8), (0.7, 0.5))

# Conditions, severities, caps, bases and steps of the ladders; categories.
DETECTORS: dict[str, Detector] = {
    d.name: d
    for d in (
        Detector("direct_injection", "direct_injection", _HML, _levels(0.2, (0.75, 0.5), 0.4, (0.95, 0.8), (0.7, 0.5)), "No patterns detected", "Direct injection"),
        Detector("bypass_detection", "bypass_detection", {"J": ("jailbreak",), "S": ("stealth",)}, (
            ("J >= 2", "critical", 0.95, 0.7, 0.1, "J"), ("J >= 1", "high", 0.85, 0.5, 0.1, "S"), ("S >= 2", "high", 0.75, 0.5, 0.1, "S"), ("A >= 1", "medium", 1.0, 0.35, 0.1, "S"),
        ), "No bypass patterns detected", "Bypass"),
        Detector("memory_poisoning", "memory_poisoning", {"H": ("memory_manipulation",), "M": ("fake_facts",)}, _MEMORY, "No memory poisoning patterns detected", "Memory poisoning"),
        Detector("goal_hijack", "goal_hijack", {"H": ("drift_keywords",), "M": ("scope_expansion", "escalation")}, _MEMORY, "No goal hijack patterns detected", "Goal hijack"),
        Detector("exfiltration", "exfiltration", {"H": ("endpoint_injection", "webhook_abuse"), "M": ("data_collection", "encoding_exfil")}, (
            ("H >= 2 OR (H >= 1 AND M >= 1)", "critical", 0.98, 0.75, 0.1, "(H + M)"), ("H >= 1", "high", 0.85, 0.55, 0.1, "M"), ("M >= 2", "high", 0.75, 0.5, 0.1, "M"), ("M >= 1", "medium", 1.0, 0.4, 0.1, "M"),
        ), "No exfiltration patterns detected", "Exfiltration"),
        Detector("inter_agent_injection", "inter_agent_injection", {"H": ("masquerade", "trust_exploit"), "M": ("role_override", "chain_attacks")}, _MEMORY, "No inter-agent patterns detected", "Inter-agent injection"),
        Detector("content_framing", "bypass_detection", {"Y": ("syntactic_masking",), "N": ("sentiment_saturation",), "O": ("oversight_evasion",), "P": ("persona_hyperstition",)}, (
            ("O >= 2 OR (O >= 1 AND Y >= 1)", "critical", 0.95, 0.7, 0.1, "(O + Y)"), ("Y >= 2 OR O >= 1", "high", 0.8, 0.5, 0.1, "(Y + O)"), ("P >= 1", "medium", 1.0, 0.4, 0.1, "P"), ("A >= 1", "low", 1.0, 0.2, 0.05, "A"),
        ), "No content framing patterns detected", "Content framing"),
        Detector("indirect_injection", "indirect_injection", _HML, _levels(0.2, None, 0.35, (0.9, 0.75), (0.6, 0.5)), "No indirect injection patterns detected", "Indirect injection"),
        Detector("document_injection", "document_injection", _HML, _levels(0.2, (0.65, 0.4), 0.35, (0.9, 0.75), (0.6, 0.5)), "No document injection patterns detected", "Document injection"),
    )
}



def plain_detector(name: str) -> Detector:
    """A detector of one's own, with the buckets high, medium and low and the commonest ladder."""
    if not re.fullmatch(r"\w+", name):
        raise ConfigurationError(f"a section's name has letters, digits and underscores only: {name!r}")
    return Detector(name, "direct_injection", _HML, _levels(0.2, (0.7, 0.45), 0.4, (0.95, 0.8), (0.7, 0.5)), "No patterns detected", name)


# Words sought in the first decoded base64 run, and that check's name.
DECODED_WORDS = ("ignore", "bypass", "admin", "system", "override", "disable")
DECODED_RULE = "base64_decoded_instruction"


def _base64(d: Detector) -> str:
    return next(p for _, name, p in d.rules if name == "base64_payload")


def literal(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literals(ds: Iterable[Detector]) -> list[str]:
    return sorted({w for d in ds for _, _, p in d.rules for w in dialect.gate(p)})


def _extract(pattern: str) -> str:
    return f"regexp_extract(_text, {literal(dialect.render(dialect.check(pattern), 'spark'))}, 0)"


#: The first base64 run of the text, and what it says, decoded, in small letters.
_RUN, _SAID = "_run", "_said"


def _decoded() -> str:
    """The first base64 run if, decoded, it speaks of an override; else an empty string."""
    return f"CASE WHEN {' OR '.join(f'contains({_SAID}, {literal(w)})' for w in DECODED_WORDS)} THEN {_RUN} ELSE '' END"


def _hits(d: Detector, at: dict[str, int]) -> str:
    """Array of (bucket, name, match) of the rules that match, in the rules' order; each rule once, its first match."""
    out = []
    for bucket, name, pattern in d.rules:
        match = _RUN if d.decodes and name == "base64_payload" else _extract(pattern)
        if sets := dialect.gates(pattern):
            first = " OR ".join(f"_has[{at[w]}]" for w in sorted(sets[0]))
            more = [" OR ".join(f"contains(_low, {literal(w)})" for w in sorted(x)) for x in sets[1:]]
            match = f"CASE WHEN {' AND '.join(f'({x})' for x in (first, *more))} THEN {match} ELSE '' END"
        out.append((bucket, name, match))
    if d.decodes:
        out.append(("stealth", DECODED_RULE, _decoded()))
    every = ", ".join(f"named_struct('bucket', '{b}', 'name', '{n}', 'match', {m})" for b, n, m in out)
    return f"filter(array({every}), x -> x.match <> '')"


def _counts(d: Detector) -> str:
    parts = [f"'{k}', size(filter({hits_of(d)}, x -> x.bucket IN ({', '.join(map(literal, b))})))" for k, b in d.counts.items()]
    return f"named_struct({', '.join(parts)}, 'A', size({hits_of(d)}))"


def hits_of(d: Detector) -> str:
    """The column that ``scan`` adds for a detector's hits."""
    return f"_hits_{d.name}"


def scan(df: DataFrame, text: str, ds: Iterable[Detector]) -> DataFrame:
    """``df`` with ``_text`` and each detector's hits and counts (``_n_`` and its name).

    Rules share literals; each is looked for once, in small letters made once (``_has``). Most texts
    hold few, and a rule's pattern is searched only where one of its literals is, and one of each
    further set that any match must hold. Every step is a
    projection of its own, whose columns the next uses more than once, so that Spark doesn't merge
    them and evaluate them again for every use.
    """
    ds = list(ds)
    at = {w: i for i, w in enumerate(_literals(ds), 1)}
    lower = df.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_low", F.lower("_text"))
    held = lower.withColumn("_has", F.expr(f"array({', '.join(['false', *(f'contains(_low, {literal(w)})' for w in at)])})"))
    runs = [d for d in ds if d.decodes]
    if runs:
        worth = "true" if runs[0].own else "_text RLIKE '[A-Za-z0-9+/]{20}'"  # what the built-in rule's matches hold
        held = held.withColumn(_RUN, F.expr(f"CASE WHEN {worth} THEN {_extract(_base64(runs[0]))} ELSE '' END")).withColumn(_SAID, F.expr(f"lower(make_valid_utf8(cast(try_to_binary(nullif({_RUN}, ''), 'base64') AS string)))"))
    found = held.withColumns({hits_of(d): F.expr(_hits(d, at)) for d in ds}).drop("_has", "_low", _RUN, _SAID)
    return found.withColumns({f"_n_{d.name}": F.expr(_counts(d)) for d in ds})


def counts_sql(d: Detector) -> dict[str, str]:
    """DuckDB expressions over ``text``, by letter."""

    def one(name: str, pattern: str) -> str:
        return f"(CASE WHEN regexp_matches(text, {quoted(dialect.render(pattern, 'duckdb', ''))}, 'i') THEN 1 ELSE 0 END)"

    out = {}
    for letter, buckets in d.counts.items():
        parts = [one(n, p) for b, n, p in d.rules if b in buckets]
        if d.decodes and "stealth" in buckets:
            said = f"lower(from_base64(nullif(regexp_extract(text, {quoted(dialect.render(_base64(d), 'duckdb', ''))}, 0, 'i'), ''))::VARCHAR)"
            parts.append("(CASE WHEN " + " OR ".join(f"contains({said}, '{w}')" for w in DECODED_WORDS) + " THEN 1 ELSE 0 END)")
        out[letter] = " + ".join(parts)
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _confidence(rung: Rung) -> str:
    _, _, cap, base, step, count = rung
    return f"least(CAST({cap} AS DOUBLE), CAST({base} AS DOUBLE) + CAST({step} AS DOUBLE) * {count})"


def ladder_sql(d: Detector) -> tuple[str, str]:
    """SQL of severity and confidence over columns named by the letters, in both engines."""
    severity = "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[1]}'" for r in d.rungs) + " ELSE 'info' END"
    confidence = "CASE " + " ".join(f"WHEN {r[0]} THEN {_confidence(r)}" for r in d.rungs) + " ELSE CAST(0 AS DOUBLE) END"
    return severity, confidence


EMPTY = f"_text RLIKE {literal(dialect.BLANK)}"
NO_MATCHES = "cast(array() AS array<struct<name:string,match:string,category:string>>)"


def result_sql(d: Detector) -> str:
    """The detector's result struct, over what ``scan`` added."""
    n = f"_n_{d.name}"
    severity, confidence = (re.sub(r"\b([A-Z])\b", rf"{n}.\1", x) for x in ladder_sql(d))
    threat = f"(NOT ({EMPTY}) AND {n}.A > 0)"
    told = ", ', ', ".join(f"cast({n}.{k} AS string), {literal(' ' + ' + '.join(b))}" for k, b in d.counts.items())
    matches = f"transform({hits_of(d)}, x -> named_struct('name', x.name, 'match', x.match, 'category', '{d.category}'))"
    return f"""named_struct(
        'detector', '{d.name}', 'is_threat', {threat}, 'severity', CASE WHEN {threat} THEN {severity} ELSE 'info' END,
        'category', CASE WHEN {threat} THEN '{d.category}' ELSE 'direct_injection' END, 'confidence', CASE WHEN {threat} THEN {confidence} ELSE cast(0 AS double) END,
        'reason', CASE WHEN {EMPTY} THEN 'Empty input' WHEN {threat} THEN concat({literal(d.says + ' detected: ')}, {told}) ELSE {literal(d.none)} END,
        'matches', CASE WHEN {threat} THEN {matches} ELSE {NO_MATCHES} END, 'sanitized_input', cast(null AS string))"""
