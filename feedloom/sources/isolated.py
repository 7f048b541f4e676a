"""Parsing with failures kept to the payload that has them: one scan gives each payload's entries and its error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.plans.persist import materialize

#: Characters of an error that are kept.
SAID = 500


def entries_or_error(parse: Callable[[str], list[dict]], entries: str) -> Callable[[Column], Column]:
    """A function in Python that takes one payload apart as a Column function: struct<entries, error>. What it raises is the
    error of that payload alone; a null payload is ''. entries: the SQL type of what parse returns."""

    @F.pandas_udf(StructType.fromDDL(f"entries {entries}, error string"))
    def run(payloads: pd.Series) -> pd.DataFrame:
        out = []
        for text in payloads:
            try:
                out.append((parse(text or ""), None))
            except Exception as e:  # noqa: BLE001  a parser may fail in any way
                out.append((None, f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}"[:SAID]))
        return pd.DataFrame(out, columns=["entries", "error"])

    return run


@dataclass(frozen=True)
class PayloadParser:
    """taken: payload -> struct<entries array<struct>, error string>; finish: rows with the entries' fields -> items."""

    taken: Callable[[Column], Column]
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows

    @staticmethod
    def of_columns(entries: Callable[[Column], Column], error: Callable[[Column, Column], Column], finish: Callable[[DataFrame], DataFrame]) -> PayloadParser:
        """From Column functions for the entries and, given payload and entries, the error."""

        def taken(payload: Column) -> Column:
            # the entries as a lambda's variable, so that the payload is parsed once
            return F.get(F.transform(F.array(entries(payload)), lambda e: F.struct(e.alias("entries"), error(payload, e).alias("error"))), F.lit(0))

        return PayloadParser(taken, finish)

    @staticmethod
    def of_python(parse: Callable[[str], list[dict]], entries: str, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> PayloadParser:
        """From a function in Python, which may raise."""
        return PayloadParser(entries_or_error(parse, entries), finish)


@dataclass
class Parsed:
    """items: what all parsers gave; dead_letters: source_id, fetcher_type, error and the payload, one row for each payload that
    failed; outcomes: source_id, ok, n_payloads, n_failed, n_items, error."""

    items: DataFrame
    dead_letters: DataFrame
    outcomes: DataFrame


ITEM = ["source_id", "url", "title", "content", "author", "published_at"]


def parse_isolated(payloads: DataFrame, sources: DataFrame, parsers: dict[str, PayloadParser], kept: tuple[str, ...] = ()) -> Parsed:
    """Payloads (source_id, payload, and the kept columns) of enabled sources through the parser of their type.

    A payload that breaks its parser, or whose source has an unknown type, is a dead letter and leaves all others as they are, those of its
    own source included. A source is ok unless every payload failed and nothing came of it; its error is that of one of its
    failed payloads. Payloads of sources that are not enabled or not known are left out. All types are read in one scan, and the
    registry, which is small, is sent to the tasks, so that a source of many payloads is dealt over them.
    """
    types = sources.filter("enabled").select(F.col("id").alias("source_id"), "fetcher_type")
    typed = payloads.select("source_id", "payload", *kept).join(F.broadcast(types), "source_id")
    dead = ["source_id", "fetcher_type", "error", "payload"]
    unknown = typed.filter(~F.coalesce(F.col("fetcher_type").isin(list(parsers)), F.lit(False)))
    letters = unknown.withColumn("error", F.concat(F.lit("unknown fetcher type: "), F.coalesce("fetcher_type", F.lit("null")))).select(*dead)
    counts = letters.select("source_id", "error", F.lit(0).alias("n"))
    own = {kind: F.col("fetcher_type") == kind for kind in parsers}
    taken = {kind: f"_taken{i}" for i, kind in enumerate(parsers)}
    read = typed.filter(F.col("fetcher_type").isin(list(parsers)))
    read = read.withColumns({taken[kind]: F.when(own[kind], parser.taken(F.when(own[kind], F.col("payload")))) for kind, parser in parsers.items()})
    field = lambda kind, name: F.col(f"{taken[kind]}.{name}")
    error = F.coalesce(*[field(kind, "error") for kind in parsers], F.lit(None).cast("string"))
    n = F.coalesce(*[F.when(F.size(field(kind, "entries")) > 0, F.size(field(kind, "entries"))) for kind in parsers], F.lit(0))
    # a payload is kept only where it failed
    read = read.select("source_id", *kept, "fetcher_type", *[field(kind, "entries").alias(taken[kind]) for kind in parsers], n.alias("n"), error.alias("error"), "payload")
    read = materialize(read.withColumns({"payload": F.when(F.col("error").isNotNull(), F.col("payload")), "n": F.when(F.col("error").isNull(), F.col("n")).otherwise(0)}), "taken")
    letters = letters.union(read.filter("error is not null").select(*dead))
    counts = counts.union(read.select("source_id", "error", "n"))
    items = None
    for kind, parser in parsers.items():
        rows = read.filter(own[kind] & F.col("error").isNull()).select("source_id", *kept, F.posexplode(taken[kind]).alias("pos", "entry")).select("source_id", *kept, "pos", "entry.*")
        found = parser.finish(rows).select(*ITEM)
        items = found if items is None else items.unionByName(found)
    outcomes = counts.groupBy("source_id").agg(
        F.count("*").alias("n_payloads"), F.count("error").alias("n_failed"), F.sum("n").alias("n_items"), F.min("error").alias("error")
    )
    ok = (F.col("n_failed") < F.col("n_payloads")) | (F.col("n_items") > 0)
    return Parsed(items, letters, outcomes.select("source_id", ok.alias("ok"), "n_payloads", "n_failed", "n_items", "error"))
