"""Keyed state: every upsert, ledger and counter is a new snapshot merged from the old one and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.prefix import numbered, ranged
from feedloom.schemas import KINDS


def _first(df: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    """One row of each key: the least by order; a grouped aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    by = F.struct(*order) if order else F.xxhash64(*[F.col(c).cast("string") for c in rest])
    return df.groupBy(*keys).agg(F.min_by(row, by).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def merge_keyed(target: DataFrame, updates: DataFrame, keys: list[str], mode: str, set_cols: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The snapshot after updates.

    first_wins: keys already there stay as they are; replace: the update's row; set_cols: only those columns of existing
    keys change, new keys are inserted. Of updates of one key the least by order counts. Null keys never match and are
    left out of updates.
    """
    new = _first(updates.na.drop(subset=keys), keys, order)
    if mode == "first_wins":
        return target.unionByName(new.join(target.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
    if mode == "replace":
        return target.join(new.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new, allowMissingColumns=True)
    if mode != "set_cols" or set_cols is None:
        raise ValueError("mode is first_wins, replace or set_cols with columns")
    old = target.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in set_cols:
            out.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return old.select(*out)


def insert_items_if_new(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of batch to append: not blank, neither id nor (source_id, url) in target, and each id and each
    (source_id, url) only once: the row fetched first, then the least id."""
    new = batch.filter("url <> ''").join(target.select("id"), "id", "left_anti")
    return first_of_batch(new.join(target.select("source_id", "url"), ["source_id", "url"], "left_anti").select(*batch.columns))


def first_of_batch(new: DataFrame) -> DataFrame:
    """Each id and each (source_id, url) only once: the row fetched first, then the least id."""
    new = _first(new, ["id"], [F.col("fetched_at"), F.xxhash64("source_id", "url", "title", "content")])
    return _first(new, ["source_id", "url"], [F.col("fetched_at"), F.col("id")])


def upsert_sources(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Descriptive columns are replaced, health columns kept."""
    return merge_keyed(target, updates, ["id"], "set_cols", ["display_name", "fetcher_type", "config_json", "enabled"])


def health_scores(outcomes: DataFrame, alpha: float = 0.3, start: float = 1.0) -> DataFrame:
    """source_id, health_score after folding ok in the order (ts, id): alpha * ok + (1 - alpha) * before.

    The fold is affine, so an outcome's share of the score depends only on how many outcomes follow it. Outcomes are numbered from the last one on
    in two levels, whatever their source or minute, and their shares are added up: nothing holds a source's history or a part of it.
    """
    order = [F.col("source_id"), F.col("ts").desc(), F.col("id").desc()]
    rows = numbered(ranged(outcomes.select("source_id", "ts", "id", F.col("ok").cast("int").cast("double").alias("ok")), order, "outcomes"), order, "after", ["source_id"])
    kept = F.pow(F.lit(1 - alpha), F.col("after"))
    return rows.groupBy("source_id").agg((F.sum(alpha * F.col("ok") * kept) + start * F.pow(F.lit(1 - alpha), F.count("*"))).alias("health_score"))


def update_health(sources: DataFrame, outcomes: DataFrame, alpha: float = 0.3) -> DataFrame:
    """sources with scores, last success and last error after outcomes (source_id, ts, id, ok, error); unknown sources are
    ignored. The score continues from the stored one."""
    n = outcomes.groupBy("source_id").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("success"),
        F.max_by(F.struct("ok", "error"), F.struct("ts", "id")).alias("last"),
    )
    folded = health_scores(outcomes, alpha, 0.0).join(n, "source_id").withColumnRenamed("source_id", "id").withColumnRenamed("health_score", "add")
    return sources.join(folded, "id", "left").select(
        *[c for c in sources.columns if c not in ("health_score", "last_success_at", "last_error")],
        F.when(F.col("n").isNull(), F.col("health_score")).otherwise(F.col("health_score") * F.pow(F.lit(1 - alpha), F.col("n")) + F.col("add")).alias("health_score"),
        F.coalesce("success", "last_success_at").alias("last_success_at"),
        F.when(F.col("n").isNull(), F.col("last_error")).when(~F.col("last.ok"), F.col("last.error")).alias("last_error"),
    ).select(*sources.columns)


def set_classification(items: DataFrame, labels: DataFrame) -> DataFrame:
    """items with kind and classified_at of labels (id, kind, classified_at); unknown kinds are left out (see bad_kinds)."""
    good = labels.filter(F.col("kind").isin(KINDS)).select("id", "kind", "classified_at")
    known = good.join(items.select("id"), "id", "left_semi")
    return merge_keyed(items, known, ["id"], "set_cols", ["kind", "classified_at"])


def bad_kinds(labels: DataFrame) -> DataFrame:
    """Labels outside the domain."""
    return labels.filter(F.col("kind").isNull() | ~F.col("kind").isin(KINDS))


def upsert_digests(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Key (digest_date, kind): content is refreshed, an id that is there stays."""
    return merge_keyed(target, updates, ["digest_date", "kind"], "set_cols", ["content_md"])


def mark_pushed(digests: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """pushed_at set and push_attempts one more for the digests in ids (id)."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return digests.join(hit, "id", "left").select(
        *[
            F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c) if c == "pushed_at"
            else (F.coalesce(c, F.lit(0)) + F.coalesce(F.col("_hit").cast("int"), F.lit(0))).cast("int").alias(c) if c == "push_attempts"
            else F.col(c)
            for c in digests.columns
        ]
    )


def push_attempts(keys: DataFrame, digests: DataFrame) -> DataFrame:
    """keys (digest_date, kind) with push_attempts, 0 where absent."""
    return keys.join(digests.select("digest_date", "kind", "push_attempts"), ["digest_date", "kind"], "left").withColumn("push_attempts", F.coalesce("push_attempts", F.lit(0)))


def mark_archived(items: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return items.join(hit, "id", "left").withColumn("notion_archived_at", F.when(F.col("_hit"), now).otherwise(F.col("notion_archived_at"))).select(*items.columns)


def is_synced(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """The items whose id is in the calendar ledger."""
    return items.join(ledger.select(F.col("item_id").alias("id")), "id", "left_semi")


def evolve_schema(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the missing columns, all rows at the default; running it again changes nothing."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows of children whose key no parent has; null keys are no violation."""
    return children.filter(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
