"""Gates in front of a model: web requests and chats, passed on or blocked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt
from .verdict import Screening

METHODS, EXCLUDED = ("POST", "PUT", "PATCH"), ("/health", "/docs")


def chats(turns: DataFrame, session: str, order: str, text: str = "text") -> DataFrame:
    """(session, text): all of a chat's messages in order, joined by line feeds; a null message is empty."""
    said = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return turns.groupBy(session).agg(said.alias("_said")).select(session, F.array_join(F.transform("_said", lambda x: x["t"]), "\n").alias("text"))


def chat_gate(turns: DataFrame, session: str, order: str, screening: Screening, text: str = "text") -> DataFrame:
    """A verdict for each chat as a whole."""
    return screening.run(dealt(chats(turns, session, order, text)))


def json_text(body: Column) -> Column:
    """A body as JSON writes it: an object or a list anew, compact and unescaped where it can be; any other text as a string with its quotes.

    Keys of an object come in alphabetical order.
    """
    whole = F.to_json(F.struct(body.alias("b")))
    return F.when(body.rlike(r"^\s*[\[{]"), F.coalesce(F.to_json(F.try_parse_json(body)), F.substring(whole, F.lit(6), F.length(whole) - 6))).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def refusal(reason: Column) -> Column:
    """What a blocked request gets back: (status, body)."""
    return F.struct(F.lit(400).alias("status"), F.to_json(F.struct(F.lit("blocked").alias("error"), reason.alias("reason"))).alias("body"))


def request_gate(requests: DataFrame, screening: Screening, prefix: bool = False, methods: tuple[str, ...] = METHODS, excluded: tuple[str, ...] = EXCLUDED, on_block: Callable[[Column], Column] = refusal) -> DataFrame:
    """``requests`` (method, path, body) with ``scanned``, ``passed`` and ``response``, which ``on_block`` makes of a block's reason.

    Requests of other methods pass unscanned. Exclusion is by equal paths, and bodies are scanned as JSON, but
    for an empty object; with ``prefix`` it is by the path's beginning, and bodies are scanned raw, but for empty ones.
    """
    path = F.coalesce("path", F.lit(""))
    skip = ~F.coalesce("method", F.lit("")).isin(*methods)
    for x in excluded:
        skip = skip | (path.startswith(x) if prefix else path == x)
    body = F.coalesce("body", F.lit(""))
    out = requests.withColumn("_body", body if prefix else json_text(body))
    scanned = ~skip & (F.col("_body") != ("" if prefix else "{}"))
    out = out.withColumn("scanned", scanned).withColumn("_body", F.when(F.col("scanned"), F.col("_body")).otherwise(""))
    return screening.run(out, "_body").withColumns({"passed": ~F.col("blocked"), "response": F.when(F.col("blocked"), on_block(F.col("block_reason")))}).drop("_body")


def split(screened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, quarantined) rows."""
    return screened.where("not blocked"), screened.where("blocked")
