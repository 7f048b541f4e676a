"""Mixing sources to target weights over blocks of tokens.

The words of a source, in a pseudorandom order of its documents, are one stream that is packed into blocks of fixed length. Output slots, dealt into
shards of fixed size, draw their source at random, so the counts of a shard are multinomial; the nth slot of a source reads the block that
a pseudorandom permutation of the source's block numbers gives for n (one permutation for each pass over the source), and slots and documents meet by a join on
(source, block). Slots that a source drew beyond what its target needs go to the sources that drew too few, so targets are met to the word.

Everything is Columns and joins. Streams and slots are numbered by two-level running totals, so no source, shard or order is in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.prefix import PART, numbered, ranged, running_totals
from feedloom.plans.persist import materialize

#: Between words stand spaces and the characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SHARD, SEED, ROUNDS = 512, 256, 11, 4
#: Slots and intervals meet in cells of so many slots; an interval has at least one slot, so a cell holds so many at most.
CELL = 64


@dataclass
class Mix:
    """documents: one row per input row; sources: one per source; draws: one per output slot."""

    documents: DataFrame
    sources: DataFrame
    draws: DataFrame
    block: int


def number_of(text: Column, first: int, digits: int) -> Column:
    """Hexadecimal digits of the MD5 of text as a number (at most 15 digits)."""
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("long")


def permuted(rows: DataFrame, name: str, x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> DataFrame:
    """rows with a column `name`: the place of x under a pseudorandom permutation of 0..n-1 chosen by key (n under 2^34).

    Each round mixes the numbers below the largest power of two m <= n by bijections of m numbers (an odd factor, a
    shifted exclusive or) and then moves all numbers round by an offset, so every number is in the mixed part for some rounds.
    """
    rows = rows.withColumns({"_x": x, "_n": n, "_key": key}).withColumn("_bits", F.length(F.bin("_n")) - 1).withColumn("_m", F.expr("shiftleft(1L, _bits)"))
    for r in range(rounds):
        text = F.concat("_key", F.lit(f":{r}"))
        rows = rows.withColumns({"_odd": number_of(text, 1, 7).bitwiseOR(F.lit(1)), "_turn": F.pmod(number_of(text, 8, 12), F.col("_n"))})
        rows = rows.withColumn("_y", (F.col("_x") * F.col("_odd")).bitwiseAND(F.col("_m") - 1))
        mixed = F.col("_y").bitwiseXOR(F.expr("shiftright(_y, _bits div 2 + 1)"))
        rows = rows.withColumn("_y", F.when(F.col("_x") < F.col("_m"), mixed).otherwise(F.col("_x")))
        rows = rows.withColumn("_x", (F.col("_y") + F.col("_turn")) % F.col("_n"))
    return rows.withColumn(name, F.col("_x")).drop("_x", "_y", "_n", "_m", "_key", "_bits", "_odd", "_turn")


def in_intervals(points: DataFrame, at: str, intervals: DataFrame) -> DataFrame:
    """points joined with the interval [low, high) that holds their `at`; both sides meet by cell, so a wide interval
    is spread over the cells that it covers."""
    cells = F.sequence(F.floor(F.col("low") / CELL), F.floor((F.col("high") - 1) / CELL))
    wide = intervals.filter("high > low").withColumn("_cell", F.explode(cells))
    return points.withColumn("_cell", F.floor(F.col(at) / CELL)).join(wide, "_cell").filter((F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))).drop("_cell", "low", "high")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, repeats: int, block: int) -> DataFrame:
    """k, source, source_size, target, and the words and slots that meet it, for each source of sized (source, size).

    Sources in the order of their code points, null last, have the weights in turn. Targets are min(repeats * size, level * weight) with
    the one level at which they sum to share of all sizes: in the order of size / weight, a source is full if the level at which it fills up
    costs no more than the budget.
    """
    order = [F.col("source").asc_nulls_last()]
    sources = numbered(ranged(sized.groupBy("source").agg(F.sum("size").alias("source_size")), order, "sources"), order, "k")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    sources = sources.drop(PART).withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    filling = [F.col("most") / F.col("weight"), F.col("k")]
    rows = ranged(sources, filling, "filling")
    total, weights_sum = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    budget = share * total
    rows = running_totals(rows, filling, {"full": F.col("most"), "used": F.col("weight")})
    rows = rows.withColumn("is_full", F.col("full") + F.col("most") / F.col("weight") * (F.lit(weights_sum) - F.col("used")) <= budget)
    spent, gone = rows.filter("is_full").agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    target = F.when(F.col("is_full"), F.col("most").cast("double")).otherwise(F.lit(budget - spent) * F.col("weight") / (F.lit(weights_sum) - gone))
    rows = rows.withColumn("target", target)
    words = F.least(F.floor(F.col("target") + 0.5), F.col("most"))
    size, one = F.col("source_size"), F.lit(block)
    rows = rows.withColumn("words", words).withColumn("blocks", F.ceil(size / one)).withColumn("whole", F.floor(size / one))
    rows = rows.withColumn("passes", F.when(size > 0, F.expr("words div source_size")).otherwise(F.lit(0))).withColumn("rest", F.col("words") - F.col("passes") * size)
    rows = rows.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / one))
    keep = ["k", "source", "source_size", "target", "words", "blocks", "whole", "passes", "rest", "slots"]
    order = [F.col("k")]
    return materialize(running_totals(ranged(rows.select(*keep), order, "quotas"), order, {"low": F.col("slots")}).drop(PART), "targets")


def drawn_slots(spark: SparkSession, sources: DataFrame, seed: int, block: int, shard: int) -> DataFrame:
    """One row per output slot: shard, slot (within the shard), k, pass, block (of the source), take (its first words)."""
    n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    slots = spark.range(n).select("id", F.expr(f"id div {shard}").alias("shard"))
    point = F.pmod(number_of(F.concat(F.lit(f"{seed}:slot:"), F.col("id").cast("string")), 1, 15), F.lit(max(n, 1)))
    owners = sources.select("k", "low", (F.col("low") + F.col("slots")).alias("high"))
    drawn = in_intervals(slots.withColumn("_point", point), "_point", owners).select("id", "shard", "k")
    order = [F.col("k"), F.col("id")]
    placed = materialize(numbered(ranged(drawn, order, "drawn"), order, "nth", ["k"]), "placed")
    # what a source drew beyond its quota goes to those that drew too few
    got = placed.groupBy("k").agg(F.count("*").alias("got"))
    quotas = sources.select("k", "slots").join(got, "k", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    by_k = [F.col("k")]
    needs = {"over_at": F.greatest(F.col("got") - F.col("slots"), F.lit(0)), "low": F.greatest(F.col("slots") - F.col("got"), F.lit(0))}
    quotas = materialize(running_totals(ranged(quotas, by_k, "balance"), by_k, needs).drop(PART), "balanced")
    placed = placed.join(quotas.select("k", "slots", "over_at"), "k").drop(PART)
    kept = placed.filter("nth < slots").select("id", "shard", "k", "nth")
    over = placed.filter("nth >= slots").select("id", "shard", (F.col("over_at") + F.col("nth") - F.col("slots")).alias("_point"))
    short = quotas.filter("got < slots").select("k", "got", F.col("low").alias("from"), "low", (F.col("low") + F.col("slots") - F.col("got")).alias("high"))
    moved = in_intervals(over, "_point", short).select("id", "shard", "k", (F.col("got") + F.col("_point") - F.col("from")).alias("nth"))
    rows = kept.unionByName(moved).join(sources.drop("low", "slots", "source", "target", "words"), "k")
    rows = rows.withColumn("pass", F.expr("nth div blocks")).withColumn("j", F.col("nth") % F.col("blocks"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("k").cast("string"), F.col("pass").cast("string"))
    rows = permuted(rows, "place", F.least("j", "whole"), F.col("whole") + 1 - (F.col("j") < F.col("whole")).cast("int"), key)
    rows = rows.withColumn("block", F.when(F.col("j") < F.col("whole"), F.col("place")).otherwise(F.col("j")))
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    take = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("j") * block))
    return rows.select("shard", (F.col("id") % shard).alias("slot"), "k", "pass", "block", take.alias("take"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, block: int = BLOCK, shard: int = SHARD, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", texts: bool = False,
) -> Mix:
    """The plan of a mixture. documents: doc_id, source, size, source_size, target, and k and start, its place in the
    source's stream (with texts=True also text).

    A text's size is its words (null: 0). Null is a source of its own, the last. A document of no words is in no block. Repeated rows
    and ids are rows of their own; rows equal in id, size and text are alike. An empty table, or one without words, gives no slots. Other columns are not looked at.
    """
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    kept = [text.alias("text")] if texts else []
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), mark.alias("mark"), F.xxhash64(text).alias("same"), *kept)
    order = [F.col("source").asc_nulls_last(), F.col("mark"), F.col("size"), F.col("same")]
    rows = ranged(materialize(sized, "sized"), order, "streams")  # ranges are found in a read of their own
    sources = source_targets(rows, weights, share, repeats, block)
    # starts of sources in each range of the order, so that documents meet their source by range and a hot source stays split
    parts = rows.groupBy(PART, "source").agg(F.sum("size").alias("n")).join(sources.select(F.col("source").alias("_source"), "k", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    parts = parts.select(F.col(PART).alias("_at"), "_source", "k", "source_size", "target")
    starts = numbered_starts(rows, order)
    documents = starts.join(parts, (F.col(PART) == F.col("_at")) & F.col("source").eqNullSafe(F.col("_source")))
    documents = documents.select("doc_id", "source", "size", "source_size", "target", "k", "start", *(["text"] if texts else []))
    return Mix(documents, sources, materialize(drawn_slots(docs.sparkSession, sources, seed, block, shard), "draws"), block)


def numbered_starts(rows: DataFrame, order: list[Column]) -> DataFrame:
    return running_totals(rows, order, {"start": F.col("size")}, ["source"])


def pieces(made: Mix) -> DataFrame:
    """Documents cut at the ends of blocks: their columns, block, and in it at (first word) and n (words). A document of
    no words has one row without a block."""
    block = made.block
    last = F.expr(f"(start + size - 1) div {block}")
    cut = made.documents.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), last))))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.withColumn("at", low - F.col("block") * block).withColumn("n", high - low)


def taken_words(made: Mix) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words of the document that the mixture holds, repeats counted."""
    draws = made.draws.select(F.col("k").alias("_k"), F.col("block").alias("_block"), "take")
    met = pieces(made).join(draws, (F.col("k") == F.col("_k")) & (F.col("block") == F.col("_block")), "left")
    got = F.greatest(F.least(F.col("n"), F.coalesce("take", F.lit(0)) - F.col("at")), F.lit(0))
    row = ["doc_id", "size", "source_size", "target", "k", "start"]
    some = met.filter("size > 0").groupBy(*row).agg(F.coalesce(F.sum(got), F.lit(0)).alias("taken"))
    none = made.documents.filter("size = 0").select(*row, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).drop("k", "start")


def mixed_texts(made: Mix) -> DataFrame:
    """The mixture: shard, slot, source, k, block, and text: the block's first `take` words, one space between two. Needs
    mix(texts=True). A slot gathers at most a block's words."""
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    cut = pieces(made).filter("size > 0").withColumn("words", F.slice(words, (F.col("block") * made.block + F.col("at") - F.col("start") + 1).cast("int"), F.col("n").cast("int")))
    draws = made.draws.withColumnRenamed("k", "_k").withColumnRenamed("block", "_block")
    met = cut.join(draws, (F.col("k") == F.col("_k")) & (F.col("block") == F.col("_block"))).filter("at < take")
    part = F.slice("words", 1, F.least(F.col("n"), F.col("take") - F.col("at")).cast("int"))
    whole = met.groupBy("shard", "slot", "source", "k", "block").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("words")))).alias("parts"))
    return whole.withColumn("text", F.array_join(F.flatten(F.col("parts.words")), " ")).drop("parts")


def _rounds(names: str) -> str:
    """The rounds of permuted() as chained table expressions of the oracle."""
    steps = []
    for r in range(ROUNDS):
        odd, turn = f"('0x' || substr(md5(key || ':{r}'), 1, 7))::bigint | 1", f"('0x' || substr(md5(key || ':{r}'), 8, 12))::bigint % n"
        steps.append(f"y{r} as (select {names}, n, m, bits, key, x, (x * ({odd})) & (m - 1) as y, {turn} as turn from x{r})")
        steps.append(f"x{r + 1} as (select {names}, n, m, bits, key, (case when x < m then xor(y, y >> (bits // 2 + 1)::int) else x end + turn) % n as x from y{r})")
    return ",\n".join(steps)


OP11_SQL = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
  md5('{SEED}:' || coalesce(doc_id::varchar, 'null')) as mark from documents),
a as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
b as (select *, [3, 1, 2][k % 3 + 1] as w, 2 * source_size as most from a),
budget as (select 1.5::double * sum(source_size) as t from b),
c as (select b.*, (select sum(least(o.most, b.most::double / b.w * o.w)) from b o) <= t as is_full, t from b, budget),
spent as (select coalesce(sum(most) filter (is_full), 0) as most, sum(w) filter (not is_full) as w from c),
e as (select k, source, source_size, case when is_full then c.most::double else (t - spent.most) * c.w / spent.w end as target, c.most from c, spent),
f as (select *, least(floor(target + 0.5), most)::bigint as words, (source_size + {BLOCK - 1}) // {BLOCK} as blocks, source_size // {BLOCK} as whole from e),
g as (select *, case when source_size > 0 then words // source_size else 0 end as passes, case when source_size > 0 then words % source_size else 0 end as rest from f),
h as (select *, passes * blocks + (rest + {BLOCK - 1}) // {BLOCK} as slots from g),
s as (select *, coalesce(sum(slots) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as low from h),
ids as (select unnest(range((select coalesce(sum(slots), 0)::bigint from s))) as id),
p as (select id, ('0x' || substr(md5('{SEED}:slot:' || id), 1, 15))::bigint % (select sum(slots)::bigint from s) as point from ids),
drawn as (select id, k, row_number() over (partition by k order by id) - 1 as nth from p join s on point >= low and point < low + slots),
q as (select s.k, slots, count(id) as got from s left join drawn using (k) group by s.k, slots),
over_list as (select id, row_number() over (order by k, nth) - 1 as r from drawn join q using (k) where nth >= slots),
short_list as (select k, got + i as nth, row_number() over (order by k, i) - 1 as r from (select k, got, unnest(range(greatest(slots - got, 0))) as i from q)),
placed as (select id, k, nth from drawn join q using (k) where nth < slots union all select id, k, nth from over_list join short_list using (r)),
j as (select id, placed.k, nth // blocks as pass, nth % blocks as j, whole, passes, rest, source_size from placed join s using (k)),
x0 as (select id, k, pass, j, passes, rest, source_size, whole as n, (1::bigint << (length(bin(whole)) - 1)::int) as m, length(bin(whole)) - 1 as bits, '{SEED}:' || k || ':' || pass as key, j as x from j where j < whole),
{_rounds("id, k, pass, j, passes, rest, source_size")},
blocks as (select k, pass, j, passes, rest, source_size, x as block from x{ROUNDS} union all select k, pass, j, passes, rest, source_size, j from j where j >= whole),
len as (select *, least({BLOCK}, source_size - block * {BLOCK}) as length from blocks),
draws as (select k, block, case when pass < passes then length else least(length, rest - j * {BLOCK}) end as take from len),
docs as (select d.doc_id, d.size, s.source_size, s.target, s.k, row_number() over () as n, coalesce(sum(d.size) over (partition by d.source order by mark, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join s on d.source is not distinct from s.source),
cut as (select *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) as block from docs where size > 0),
got as (select n, sum(greatest(0, least(start + size, block * {BLOCK} + take) - greatest(start, block * {BLOCK}))) as taken from cut join draws using (k, block) group by n)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from docs left join got using (n)
"""
