"""Labels and topics from a model: prompts out, raw text in. The model is any function over pandas batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import CONTENT, SNIPPET, clean_iso, clean_str, strip_code_fence, titled
from feedloom.operators.state import merge_keyed, set_classification

FIELDS = ["event_date", "registration_deadline", "location", "registration_url", "registration_contact"]
TEMPLATE = "Today is {today}. Label the item as event, news, tool or other; answer in JSON.\nTitle: {title}\nText: {content}"
TOPIC_TEMPLATE = "Group these {n} items into {least} to {most} topics; answer with a JSON list of name, summary, item_ids.\n{items}"


def build_label_prompt(items: DataFrame, today: Column, template: str = TEMPLATE) -> DataFrame:
    """id, prompt; the text is cut to CONTENT code points before it leaves the JVM."""
    out = F.replace(F.lit(template), F.lit("{today}"), today.cast("string"))
    out = F.replace(out, F.lit("{title}"), titled(F.col("title")))
    out = F.replace(out, F.lit("{content}"), F.substring(F.coalesce("content", F.lit("")), 1, CONTENT))
    return items.select("id", out.alias("prompt"))


def score(prompts: DataFrame, model_fn: Callable[[str], str], concurrency: int = 8) -> DataFrame:
    """id, raw: the model's answer to each prompt; a call that fails gives null and never fails the batch. Each task has
    `concurrency` calls open at a time; the number of tasks follows the prompts' partitions."""

    def ask(prompt: str) -> str | None:
        try:
            return model_fn(prompt)
        except Exception:  # noqa: BLE001  a model may fail in any way
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as calls:
            for pdf in batches:
                yield pd.DataFrame({"id": pdf["id"], "raw": list(calls.map(ask, pdf["prompt"]))})

    kind = prompts.schema["id"].dataType.simpleString()
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, raw string")


def _typed(v: Column, path: str, kind: str) -> Column:
    """The value at path if its JSON type is kind, else null (try_variant_get alone would cast)."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == kind, F.try_variant_get(v, path, kind.lower()))


def parse_label(raw: Column) -> Column:
    """struct<ok, kind, metadata>: ok false for what is no JSON; unknown kinds are other; metadata only of events that
    carry an object."""

    def read(v: Column) -> Column:
        named = F.lower(_typed(v, "$.kind", "STRING"))
        kind = F.when(named.isin("event", "news", "tool", "other"), named).otherwise(F.lit("other"))
        has = F.schema_of_variant(F.try_variant_get(v, "$.event_metadata", "variant")).startswith("OBJECT")
        fields = [(clean_iso if f in FIELDS[:2] else clean_str)(_typed(v, f"$.event_metadata.{f}", "STRING")).alias(f) for f in FIELDS]
        metadata = F.when((kind == "event") & has, F.struct(*fields))
        ok = v.isNotNull()
        return F.struct(ok.alias("ok"), F.when(ok, kind).alias("kind"), F.when(ok, metadata).alias("metadata"))

    # a lambda's variable, so that the text is parsed once for all fields
    return F.get(F.transform(F.array(F.try_parse_json(strip_code_fence(raw))), read), F.lit(0))


def apply_labels(items: DataFrame, metadata: DataFrame, parsed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, metadata) after labels parsed (id, label); rows without a label stay as they are and are tried again."""
    good = parsed.filter(F.col("label.ok"))
    labels = good.select("id", F.col("label.kind").alias("kind"), now.alias("classified_at"))
    facts = good.filter(F.col("label.metadata").isNotNull()).select(F.col("id").alias("item_id"), *[F.col(f"label.metadata.{f}").alias(f) for f in FIELDS], now.alias("extracted_at"))
    return set_classification(items, labels), merge_keyed(metadata, facts, ["item_id"], "replace")


def build_topic_prompt(items: DataFrame, least: int = 3, most: int = 5, template: str = TOPIC_TEMPLATE) -> DataFrame:
    """digest_date, prompt: a line for each item (id/title/snippet) in the order of pos; days without items have none."""
    line = F.concat_ws("/", F.col("id").cast("string"), titled(F.col("title")), F.substring(F.coalesce("content", F.lit("")), 1, SNIPPET))
    listed = items.groupBy("digest_date").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    out = F.replace(F.lit(template), F.lit("{n}"), F.size("rows").cast("string"))
    out = F.replace(F.replace(out, F.lit("{least}"), F.lit(str(least))), F.lit("{most}"), F.lit(str(most)))
    return listed.select("digest_date", F.replace(out, F.lit("{items}"), F.array_join("rows.line", "\n")).alias("prompt"))


def parse_topics(answers: DataFrame, sent: DataFrame) -> DataFrame:
    """digest_date, pos, name, summary, item_ids: topics of a JSON list, in order.

    answers: digest_date, raw; sent: digest_date, item_id. Entries that are no objects or have no name or list are
    skipped, ids that were not sent dropped, topics left without ids too.
    """
    v = F.try_parse_json(strip_code_fence(F.col("raw")))
    topics = answers.select("digest_date", F.posexplode(F.try_variant_get(v, "$", "array<variant>")).alias("pos", "t"))
    named = topics.select(
        "digest_date",
        "pos",
        clean_str(_typed(F.col("t"), "$.name", "STRING")).alias("name"),
        F.coalesce(F.trim(_typed(F.col("t"), "$.summary", "STRING")), F.lit("")).alias("summary"),
        F.posexplode(F.try_variant_get("t", "$.item_ids", "array<variant>")).alias("at", "i"),
    ).filter(F.col("name").isNotNull())
    ids = named.withColumn("item_id", F.when(F.schema_of_variant("i") == "STRING", F.try_variant_get("i", "$", "string"))).drop("i")
    known = ids.join(sent.select("digest_date", "item_id").distinct(), ["digest_date", "item_id"], "left_semi")
    grouped = known.groupBy("digest_date", "pos", "name", "summary").agg(F.array_sort(F.collect_list(F.struct("at", "item_id"))).alias("l"))
    return grouped.select("digest_date", "pos", "name", "summary", F.col("l.item_id").alias("item_ids"))


def record_topics(topics: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, assignments, labels) of parsed topics. Every assigned id counts, shown or not; an item's label is the
    last topic that has it. Topic ids are made of date, position and name."""
    keyed = topics.withColumn("id", F.sha2(F.concat_ws("|", F.col("digest_date").cast("string"), F.col("pos").cast("string"), "name"), 256))
    used = keyed.select("digest_date", "pos", "name", "id", F.explode("item_ids").alias("item_id"))
    assignments = used.select("item_id", F.col("id").alias("topic_id"), "digest_date").distinct()
    labels = used.groupBy("digest_date", "item_id").agg(F.max_by("name", "pos").alias("topic"))
    return keyed.select("id", "name", "summary", "digest_date", now.alias("created_at")), assignments, labels


def diff_metadata(old: list[Column], new: list[Column], names: list[str] | None = None) -> Column:
    """Names of the fields that are null before and not after."""
    names = names or FIELDS
    gained = [F.when(o.isNull() & n.isNotNull(), F.lit(name)) for o, n, name in zip(old, new, names, strict=True)]
    return F.filter(F.array(*gained), lambda x: x.isNotNull())


def merge_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with each field of new that is not blank, for items where some null field was gained; others stay."""
    n = new.select("item_id", *[F.col(f).alias(f"new_{f}") for f in FIELDS])
    rows = old.join(n, "item_id", "left")
    gained = F.size(diff_metadata([F.col(f) for f in FIELDS], [F.col(f"new_{f}") for f in FIELDS])) > 0

    def field(f: str) -> Column:
        fresh = F.col(f"new_{f}") if f in FIELDS[:2] else F.nullif(F.col(f"new_{f}"), F.lit(""))
        return F.when(gained, F.coalesce(fresh, F.col(f))).otherwise(F.col(f)).alias(f)

    return rows.select("item_id", *[field(f) for f in FIELDS], *[c for c in old.columns if c not in FIELDS and c != "item_id"]).select(*old.columns)


def refill_counts(old: DataFrame, parsed: DataFrame) -> DataFrame:
    """improved, unchanged, downgraded, failed: what asking again gave; parsed: id, label."""
    rows = old.join(parsed.withColumnRenamed("id", "item_id"), "item_id")
    gained = F.size(diff_metadata([F.col(f) for f in FIELDS], [F.col(f"label.metadata.{f}") for f in FIELDS])) > 0
    ok, event = F.coalesce("label.ok", F.lit(False)), F.col("label.kind") == "event"
    return rows.agg(
        F.count_if(ok & event & gained).alias("improved"),
        F.count_if(ok & event & ~gained).alias("unchanged"),
        F.count_if(ok & ~event).alias("downgraded"),
        F.count_if(~ok).alias("failed"),
    )
