"""N-gram Jaccard join by MinHash banding.

Texts with the same set of word n-grams form one class member (their sets are not compared with each other). Each distinct
set gets a MinHash signature; the numbers of bands and rows are chosen for a target recall at the threshold. Sets that
share a band's hash meet in a bucket. Verification is on the full n-gram sets.

A bucket may hold a large share of all sets, so its pairs are never listed outright: for LEADERS rounds every member is
verified against one leader, the set that collides with most others. What is left are members of different components,
and the triangle inequality of the Jaccard distance rules out many of them (distances to a leader that differ by more
than 1 - threshold). The sets of the rest are joined exactly, with prefix and positional filters, so no pair of a bucket
that could join two components is lost.

Links are counted afterwards. Similar sets are in one component, so a component is dealt into blocks of bounded size and
each two of its blocks meet in a group of their own, where all pairs are compared on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.textbytes import mix, steps, take_apart
from feedloom.operators.components import connected_components
from feedloom.plans.persist import materialize

WORDS, THRESHOLD, RECALL, MOST_HASHES, LEADERS = 5, 0.8, 0.9995, 128, 1
#: Rows of an Arrow batch whose texts are Python objects at a time.
ROWS = 256
#: Sets and bytes of text of a component's block, and n-grams that two blocks are compared on at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 16 << 20, 4096


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of up to `most` hashes that finds a pair at the threshold with that
    probability."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def ngram_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; one for all the words of a shorter text; none without words."""
    for a, b in steps(texts):
        w = take_apart(texts[a:b])
        at = 0
        for count in w.counts:
            words = w.hashes[at : at + count]
            at += count
            k = min(n, count)
            if not k:
                yield np.zeros(0, np.uint64)
                continue
            grams = np.zeros(count - k + 1, np.uint64)
            for j in range(k):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : count - k + 1 + j]
            yield np.unique(mix(grams + np.uint64(k)))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One hash for each set and band (no set is empty)."""
    rng = np.random.default_rng(11)
    at = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for _ in range(rows):
            salt, factor = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat((flat ^ salt) * (factor | np.uint64(1)), at)
            key = mix(key * np.uint64(0x100000001B3) + least)
        out[:, band] = key
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of a shares with each of b."""
    left, right = np.concatenate(a), np.concatenate(b)
    known = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.int64)

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, place in known) of each n-gram of both sides, ordered by place."""
        at = np.searchsorted(known, flat)
        kept = known[np.minimum(at, len(known) - 1)] == flat
        at, of = at[kept], np.repeat(np.arange(len(sets)), list(map(len, sets)))[kept]
        order = np.argsort(at, kind="stable")
        return of[order], at[order]

    if len(known):
        listed = [(len(a), *places(a, left)), (len(b), *places(b, right))]
        for k in range(0, len(known), COLUMNS):
            sides = []
            for rows, of, at in listed:
                i, j = np.searchsorted(at, (k, k + COLUMNS))
                side = np.zeros((rows, min(COLUMNS, len(known) - k)), np.float32)
                side[of[i:j], at[i:j] - k] = 1
                sides.append(side)
            out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of a and of b are similar, as jaccard() has it."""
    both = shared_counts(a, b)
    sizes = np.fromiter(map(len, a), np.int64, len(a))[:, None] + np.fromiter(map(len, b), np.int64, len(b))
    return both / (sizes - both) >= threshold


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _signed(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, digest of the n-gram set (null without words) and band hashes of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            texts = batch.column("text").to_pylist()
            digests, keys = [None] * len(texts), [None] * len(texts)
            for a, b in steps(texts):
                sets = list(ngram_sets(texts[a:b], n))
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                signed = signatures([sets[i] for i in full], bands, rows).view(np.int64)
                for i, row in zip(full, signed, strict=True):
                    digests[a + i], keys[a + i] = blake2b(sets[i].tobytes(), digest_size=16).digest(), row
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "digest", "bands"],
            )

    return given.mapInArrow(run, "doc_id long, text_key long, digest binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, similarity) of distinct pairs of digests, from the full n-gram sets of their texts."""
    left = texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in _few(batches):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = []
            for key, x, y in zip(a, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if key != known[0]:
                    known = (key, next(ngram_sets([x], n)))
                found.append(jaccard(known[1], next(ngram_sets([y], n))))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _rest(open_: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b) of every pair that could be similar and would join two components met in one open bucket: an exact
    set-similarity join of the open buckets' sets.

    N-grams are ranked by rarity among these sets. A pair at the threshold shares one of the rarest n - ceil(t*n) + 1
    of each (prefix filter), and enough must be left from there on in both (positional filter). One side are the sets
    outside their bucket's largest component, so a large component is not compared with itself.
    """
    shares = open_.groupBy("band", "hash", "component").agg(F.count("*").alias("n"))
    major = shares.groupBy("band", "hash").agg(F.max_by("component", F.struct("n", "component")).alias("major"))
    sides = open_.join(major, ["band", "hash"]).groupBy("digest").agg(F.any_value("component").alias("component"), F.max(F.col("component") != F.col("major")).alias("minor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            grams = [g.view(np.int64) for g in ngram_sets(batch.column("text").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(grams, pa.list_(pa.int64()))], names=["digest", "grams"])

    sets = materialize(texts.join(sides.select("digest"), "digest", "left_semi").select("digest", "text").mapInArrow(run, "digest binary, grams array<long>"), "open-sets")
    each = sets.select("digest", F.explode("grams").alias("gram"))
    rarity = each.groupBy("gram").agg(F.count("*").alias("n"))
    # a set's own n-grams, as many as its text has
    ranked = each.join(rarity, "gram").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("ranked"))
    size = F.size("ranked")
    prefix = ranked.select("digest", size.alias("size"), F.posexplode(F.expr(f"slice(ranked.gram, 1, size(ranked) - cast(ceil({threshold}D * size(ranked) - 1e-9D) as int) + 1)")).alias("pos", "gram"))
    prefix = materialize(prefix.join(sides, "digest"), "prefix")
    x, y = prefix.filter("minor").alias("x"), prefix.alias("y")
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("x.size") + F.col("y.size")) - 1e-9)
    left = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & (left >= least))
    return met.select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"))


def _link_counts(component: DataFrame, texts: DataFrame, weights: DataFrame, n: int, threshold: float) -> DataFrame:
    """(digest, n_links) of every set of a component (node, component): the sum of the weights (digest, weight) of the
    others that are similar to it.

    A set goes to the groups (i, j) of its own block with each block of its component; group (i, i) compares a block
    with itself.
    """
    members = component.withColumnRenamed("node", "digest").join(texts, "digest").join(weights, "digest")
    sizes = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    own = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = own.select("component", "own", "digest", "weight", "text", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    group = ["component", "i", "j"]
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "weight", "text")

    def counted(group: list[tuple[int, bytes, int, np.ndarray]], i: int, j: int) -> list[tuple[bytes, int]]:
        left, right = [x for x in group if x[0] == i], [x for x in group if x[0] == j]
        if not left or not right:
            return []
        near = similar([x[3] for x in left], [x[3] for x in right], threshold)
        if i == j:
            np.fill_diagonal(near, False)
        out = zip((x[1] for x in left), (near @ np.array([x[2] for x in right])).tolist(), strict=True)
        if i == j:
            return list(out)
        return [*out, *zip((x[1] for x in right), (np.array([x[2] for x in left]) @ near).tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "own", "digest", "weight", "text")]
            for c, i, j, own, digest, weight, grams in zip(*columns[:-1], ngram_sets(columns[-1], n), strict=True):
                if key != (c, i, j):
                    if members:
                        found += counted(members, *key[1:])
                    key, members = (c, i, j), []
                members.append((own, digest, weight, grams))
            yield as_batch(found)
        if members:
            yield as_batch(counted(members, *key[1:]))

    def as_batch(found: list[tuple[bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64())], names=["digest", "n_links"])

    parts = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "digest binary, n_links long")
    return parts.groupBy("digest").agg(F.sum("n_links").alias("n_links"))


def ngram_links(
    docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, texts): rows has doc_id, text_key, digest of every input row; links has verified pairs of digests
    (a, b, similarity >= threshold) that connect every component of similar sets; texts has a text of every linked
    digest."""
    bands, rows = bands_for(threshold, recall)
    signed = materialize(_signed(docs, n, bands, rows, id_col, text_col), "signed")
    sets = signed.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.any_value("bands").alias("bands"))
    listed = sets.select("digest", F.posexplode("bands").alias("band", "hash"))
    shared = listed.groupBy("band", "hash").agg(F.count("*").alias("size")).filter("size > 1")
    sized = materialize(listed.join(shared, ["band", "hash"]).select("band", "hash", "digest", "size"), "sized")
    # what the most sets collide with is likely their common origin: it leads, so most of a bucket joins in one round
    weight = sized.groupBy("digest").agg(F.sum("size").alias("weight"))
    members = materialize(sized.drop("size").join(weight, "digest").select("band", "hash", "digest", "weight"), "members")

    met = members.select("digest").distinct()
    chosen = sets.join(met, "digest").select("digest", F.col("one.doc_id").alias("id"), F.col("one.text_key").alias("key"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    texts = chosen.join(every.withColumnsRenamed({"id": "id_", "key": "key_"}), F.col("key").eqNullSafe(F.col("key_")) & F.col("id").eqNullSafe(F.col("id_")))
    texts = materialize(texts.select("digest", "text").dropDuplicates(["digest"]), "texts")

    # distance: to the bucket's last leader; open: buckets that may still join components
    open_, seen, component = members, None, None
    for _ in range(LEADERS):
        leaders = open_.groupBy("band", "hash").agg(F.max_by("digest", F.struct("weight", "digest")).alias("leader"))
        led = open_.select("band", "hash", "digest", "weight").join(leaders, ["band", "hash"])
        todo = _pairs(led.select(F.col("digest").alias("a"), F.col("leader").alias("b")))
        if seen is not None:
            todo = todo.join(seen, ["a", "b"], "left_anti")
        new = materialize(_verified(todo, texts, n), "verified")
        seen = new if seen is None else materialize(seen.unionByName(new), "seen")
        component = materialize(connected_components(seen.filter(F.col("similarity") >= threshold)), "components")
        led = led.withColumns({"a": F.least("digest", "leader"), "b": F.greatest("digest", "leader")})
        led = led.join(seen, ["a", "b"], "left").join(component.withColumnRenamed("node", "digest"), "digest", "left")
        led = led.select("band", "hash", "digest", "weight", "leader", (1 - F.coalesce("similarity", F.lit(1.0))).alias("distance"), F.coalesce("component", "digest").alias("component"))
        # a bucket whose members are in one component is done; so is a leader, and a member that no other could join
        spread = led.groupBy("band", "hash").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
        led = led.filter("digest <> leader").join(spread, ["band", "hash"])
        reach = 1 - threshold + 1e-9
        apart = led.groupBy("band", "hash").agg(
            F.min(F.when(F.col("component") == F.col("c0"), F.col("distance"))).alias("low0"),
            F.max(F.when(F.col("component") == F.col("c0"), F.col("distance"))).alias("high0"),
            F.min(F.when(F.col("component") != F.col("c0"), F.col("distance"))).alias("low1"),
            F.max(F.when(F.col("component") != F.col("c0"), F.col("distance"))).alias("high1"),
        )
        led = led.join(apart, ["band", "hash"]).filter(
            F.when(F.col("component") != F.col("c0"), F.lit(True)).otherwise(F.col("distance").between(F.col("low1") - reach, F.col("high1") + reach))
        )
        open_ = materialize(led.select("band", "hash", "digest", "weight", "distance", "component"), "open")
    todo = _pairs(_rest(open_, texts, n, threshold)).join(seen, ["a", "b"], "left_anti")
    links = seen.unionByName(materialize(_verified(todo, texts, n), "verified")).filter(F.col("similarity") >= threshold)
    return signed.select("doc_id", "text_key", "digest"), materialize(links, "links"), texts


def ngram_classes(
    docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, text_key, class_id (least doc_id of its class), class_size, n_links, kept.

    A class is what verified links and equal n-gram sets connect. n_links counts the other distinct texts whose n-gram
    sets are similar or equal to the row's; rows with the very same text are one text. kept is true for one row of each
    class: a least doc_id, of equal ones any single row. Texts without words, null ones too, are alone in their classes,
    whose id is their own. Null ids sort last. Other columns are not looked at; an empty table gives an empty result.
    """
    rows, links, texts = ngram_links(docs, n, threshold, recall, id_col, text_col)
    component = materialize(connected_components(links), "components")
    weights = rows.filter("digest is not null").groupBy("digest").agg(F.countDistinct("text_key").alias("weight"))
    counts = _link_counts(component, texts, weights, n, threshold)
    linked = weights.join(counts, "digest", "left").select("digest", (F.col("weight") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    classes = _classes(rows, component).join(materialize(linked.filter("n_links > 0"), "link-counts"), "digest", "left")
    return classes.select("doc_id", "text_key", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "kept")


def _classes(rows: DataFrame, component: DataFrame) -> DataFrame:
    """doc_id, text_key, digest, class_id, class_size, kept of every row, from components (node, component) of digests."""
    sets = rows.filter("digest is not null").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")).alias("first"), F.count("*").alias("size")
    )
    sets = sets.join(component.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    whole = sets.groupBy("component").agg(F.min("first").alias("head"), F.sum("size").alias("class_size"))
    known = materialize(sets.join(whole, "component").select("digest", "head", "class_size"), "classes")
    joined = rows.join(known, "digest", "left")
    alone = F.col("digest").isNull()
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    return joined.select(
        "doc_id",
        "text_key",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | same).alias("kept"),
    )


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, all columns as they were."""
    def key(text_key: Column, row_id: Column) -> Column:
        return F.concat_ws("|", text_key.cast("string"), F.coalesce(row_id.cast("string"), F.lit("none")))

    rows, links, _ = ngram_links(docs, id_col=id_col, text_col=text_col)
    classes = _classes(rows, connected_components(links))
    kept = classes.filter("kept").select(key(F.col("text_key"), F.col("doc_id")).alias("_key"))
    keyed = docs.withColumn("_key", key(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.col(id_col).cast("long")))
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
