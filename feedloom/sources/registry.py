"""The source registry, routing of landed payloads to parsers, and outcomes per source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.plans.persist import materialize


def load_sources(config: DataFrame) -> DataFrame:
    """Registry rows of config (id, display_name, fetcher_type, config struct, enabled): enabled unless said otherwise,
    config kept as JSON, health untouched."""
    made = F.to_json("config") if config.schema["config"].dataType.typeName() in ("struct", "map", "array") else F.col("config").cast("string")
    return config.select(
        "id",
        F.coalesce("display_name", "id").alias("display_name"),
        "fetcher_type",
        made.alias("config_json"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.lit(1.0).alias("health_score"),
        F.lit(None).cast("timestamp").alias("last_success_at"),
        F.lit(None).cast("string").alias("last_error"),
    )


def route_payloads(payloads: DataFrame, sources: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """(items, failures): each enabled source's payloads through the parser of its type; an unknown type only fails that
    source, and a parser that throws only the sources of its type. payloads: source_id, payload, ..."""
    types = sources.filter("enabled").select(F.col("id").alias("source_id"), "fetcher_type")
    typed = payloads.drop("fetcher_type").join(types, "source_id")
    items, thrown = None, []
    for kind, parser in parsers.items():
        own = typed.filter(F.col("fetcher_type") == kind)
        try:
            one = materialize(parser(own), "parsed")
        except Exception as e:  # noqa: BLE001  a parser may fail in any way; its sources are reported
            said = (str(e).splitlines() or [""])[0][:500]
            thrown.append(own.select("source_id", F.lit(f"{type(e).__name__}: {said}").alias("error")).distinct())
            continue
        items = one if items is None else items.unionByName(one, allowMissingColumns=True)
    unknown = typed.filter(~F.col("fetcher_type").isin(list(parsers)) | F.col("fetcher_type").isNull())
    failures = unknown.select("source_id", F.concat(F.lit("unknown fetcher type: "), F.coalesce("fetcher_type", F.lit("null"))).alias("error")).distinct()
    for one in thrown:
        failures = failures.union(one)
    return items, failures


def partial_failures(keywords: DataFrame) -> DataFrame:
    """source_id, ok, n_items of keyword outcomes (source_id, failed, n_items): a source fails only if every keyword did
    and nothing came."""
    n = keywords.groupBy("source_id").agg(F.count_if("failed").alias("n_failed"), F.count("*").alias("n"), F.sum("n_items").alias("n_items"))
    return n.select("source_id", ((F.col("n_failed") < F.col("n")) | (F.col("n_items") > 0)).alias("ok"), "n_failed", "n_items")


def first_in_run(items: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order; a grouped aggregate."""
    rest = [c for c in items.columns if c != key]
    best = items.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, "r.*").select(*items.columns)
