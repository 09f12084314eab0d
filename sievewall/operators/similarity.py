"""TF-IDF cosine similarity to phrasings of known attacks, row by row.

The vocabulary is the attacks' own: other words weigh nothing, so a text's vector
has at most some hundred entries. Weights are literals of the plan; there is
no join and no shuffle. A text's length cancels out of the cosine.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rules import ATTACKS
from ..functions import dialect

WORD = "[a-z0-9]{2,}"
THRESHOLD, TOP = 0.85, 5


def weights(attacks: list[tuple[str, str]] = ATTACKS) -> tuple[dict[str, float], list[dict[str, float]]]:
    """(inverse document frequency by word, each attack's vector of length one)."""
    words = [re.findall(WORD, s.lower()) for _, s in attacks]
    seen = Counter(w for x in words for w in set(x))
    idf = {w: math.log(len(words) / n) for w, n in seen.items()}
    vectors = []
    for x in words:
        v = {w: n / len(x) * idf[w] for w, n in Counter(x).items()}
        norm = math.sqrt(sum(a * a for a in v.values())) or 1.0
        vectors.append({w: a / norm for w, a in v.items()})
    return idf, vectors


def scores(text: Column, attacks: list[tuple[str, str]] = ATTACKS) -> Column:
    """Array of (seq, label, score) for every attack, in order."""
    idf, vectors = weights(attacks)
    rows = ", ".join(f"'{w}', array({', '.join(f'{x!r}D' for x in (idf[w], *(v.get(w, 0.0) for v in vectors)))})" for w in idf)
    table = F.expr(f"map({rows})")
    known = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: w.isin(list(idf)))
    own = F.transform(F.array_distinct(known), lambda w: F.struct(table[w].alias("w"), (F.size(F.filter(known, lambda y: y == w)) * F.get(table[w], F.lit(0))).alias("x")))
    zero = F.struct(F.lit(0.0).alias("n"), *[F.lit(0.0).alias(f"d{i}") for i in range(len(attacks))])
    sums = F.aggregate(own, zero, lambda a, e: F.struct((a["n"] + e["x"] * e["x"]).alias("n"), *[(a[f"d{i}"] + e["x"] * F.get(e["w"], F.lit(i + 1))).alias(f"d{i}") for i in range(len(attacks))]))
    return F.transform(F.array(sums), lambda s: F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(label).alias("label"), F.when(s["n"] > 0, s[f"d{i}"] / F.sqrt(s["n"])).otherwise(0.0).alias("score")) for i, (label, _) in enumerate(attacks)]))[0]


def above(found: Column, threshold: float = THRESHOLD) -> Column:
    """Scores of at least ``threshold``, best first; of equal ones the earlier attack."""
    kept = F.filter(found, lambda x: x["score"] >= threshold)
    order = F.array_sort(F.transform(kept, lambda x: F.struct((-x["score"]).alias("k"), x["seq"].alias("seq"), x["label"].alias("label"), x["score"].alias("score"))))
    return F.transform(order, lambda x: F.struct(x["seq"].alias("seq"), x["label"].alias("label"), x["score"].alias("score")))


def result(text: Column, found: Column, threshold: float = THRESHOLD) -> Column:
    """The detector's result struct from ``scores``."""
    best = above(found, threshold)
    top = F.get(best, F.lit(0))["score"]
    empty = F.coalesce(text, F.lit("")).rlike(dialect.BLANK)
    threat = ~empty & (F.size(best) > 0)
    matches = F.transform(F.slice(best, 1, TOP), lambda x: F.struct(x["label"].alias("name"), F.format_string("similarity: %.3f", x["score"]).alias("match"), F.lit("direct_injection").alias("category")))
    words = F.lower(F.coalesce(text, F.lit(""))).rlike(WORD)
    return F.struct(
        F.lit("vector_similarity").alias("detector"),
        threat.alias("is_threat"),
        F.when(~threat, "info").when(top >= 0.95, "critical").when(top >= 0.90, "high").when(top >= 0.85, "medium").otherwise("low").alias("severity"),
        F.lit("direct_injection").alias("category"),
        F.when(threat, top).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(empty, "Empty input").when(threat, F.format_string("Similar to %d known attacks, best %.3f (%s)", F.size(best), top, F.get(best, F.lit(0))["label"])).when(~words, "No meaningful tokens").otherwise("No similar attack patterns found").alias("reason"),
        F.when(threat, matches).otherwise(F.array().cast("array<struct<name:string,match:string,category:string>>")).alias("matches"),
        F.lit(None).cast("string").alias("sanitized_input"),
    )
