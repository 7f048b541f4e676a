"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The index is a stored table of postings (row, term, position) of the documents' words that stand in the benchmark, and
one end mark for each row, at the place after its last word. Texts are read once, for this table; all else reads
postings. Benchmark items are cut into windows of consecutive words. The two rarest places of a window (by the index's
counts) are its anchors: the lists of both, less the anchors' offsets, are intersected. Where they meet, the lists of
the window's other terms are intersected too, which gives exact phrases; where they are apart by at most `slop` words,
the place is a match by proximity.

Every intersection is a join on row, window and place, so no term, row or window is a key by itself. Tables made from the
benchmark, and the ids of rows with places, are broadcast only where their counted rows are at most BROADCAST_ROWS;
beyond it the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.words import word_list
from feedloom.plans.persist import materialize

#: About 100 bytes each: some 20 MB broadcast at most.
BROADCAST_ROWS = 200_000
#: The end mark of a document, which no word is.
END, END_ID = "", -1
#: How far from its place, in words, the second anchor of a match by proximity may stand.
SLOP = 2


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted size allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, window): each run of `size` consecutive words; all words of a shorter item, none of an empty one."""
    listed = items.select(F.col(id_col).alias("item_id"), word_list(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1))))
    return listed.select("item_id", "w", starts.alias("i")).select("item_id", F.expr(f"slice(w, i, {size})").alias("window")).distinct()


def numbered(windows: DataFrame) -> DataFrame:
    """wid, window: the distinct windows, stored, so that their numbers stay."""
    return materialize(windows.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def vocabulary(windows: DataFrame) -> DataFrame:
    """term, term_id: the words of the windows and END, stored, so that their numbers stay."""
    mark = windows.sparkSession.range(1).select(F.lit(END).alias("term"))
    terms = windows.select(F.explode("window").alias("term")).union(mark).distinct()
    return materialize(terms.withColumn("term_id", F.when(F.col("term") == END, END_ID).otherwise(F.monotonically_increasing_id())), "terms")


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number for each row of docs), term_id, pos (from 0) of each word that terms has, and one END for each row, which
    alone has the row's doc_id and text_key; stored once, so that the numbers stay."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        text_key(F.col(text_col)).alias("text_key"),
        F.concat(word_list(F.col(text_col)), F.array(F.lit(END))).alias("words"),
    )
    postings = rows.select("row", "doc_id", "text_key", F.posexplode("words").alias("pos", "term")).join(bounded(terms, terms.count()), "term")
    last = F.col("term_id") == END_ID
    return materialize(postings.select("row", "term_id", "pos", F.when(last, F.col("doc_id")).alias("doc_id"), F.when(last, F.col("text_key")).alias("text_key")), "postings")


def marks(index: DataFrame) -> DataFrame:
    """row, doc_id, text_key, n_words of every row of the documents."""
    return index.filter(F.col("term_id") == END_ID).select("row", "doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))


def anchors(windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """wid, length, the term_id and offset of the two rarest places whose terms the index has, and whole: it has them all.

    A window with one such place has it twice; it can be met only if it is whole.
    """
    counts = index.filter(F.col("term_id") != END_ID).groupBy("term_id").agg(F.count("*").alias("n")).join(terms, "term_id")
    places = windows.select("wid", F.size("window").alias("length"), F.posexplode("window").alias("at", "term")).join(counts, "term")
    order = Window.partitionBy("wid").orderBy("n", "term", "at")
    ranked = places.withColumn("rank", F.row_number().over(order))

    def nth(rank: int, col: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(col)))

    chosen = ranked.groupBy("wid", "length").agg(
        nth(1, "term_id").alias("term_id"),
        nth(1, "at").alias("at"),
        F.coalesce(nth(2, "term_id"), nth(1, "term_id")).alias("term_id2"),
        F.coalesce(nth(2, "at"), nth(1, "at")).alias("at2"),
        (F.count("*") == F.col("length")).alias("whole"),
    )
    return chosen.filter(F.col("whole") | (F.col("at") != F.col("at2")))


def anchor_list(index: DataFrame, side: DataFrame, start: str, pos: str) -> DataFrame:
    """The postings of one anchor of each window (side: wid, term_id, at): row, wid, pos, and start, the pos less the offset."""
    return index.join(side, "term_id").select("row", "wid", F.col("pos").alias(pos), (F.col("pos") - F.col("at")).alias(start))


def index_matches(index: DataFrame, terms: DataFrame, windows: DataFrame, slop: int | None = None) -> DataFrame:
    """Places of numbered windows in an index: row, wid, start, length, exact; see window_matches."""
    width = max(slop or 0, 1)
    chosen = anchors(windows, terms, index)
    chosen = materialize(chosen.filter("whole") if slop is None else chosen, "anchors")
    n = chosen.count()
    first = anchor_list(index, bounded(chosen.select("wid", "term_id", "at"), n), "start", "pos")
    second = anchor_list(index, bounded(chosen.select("wid", F.col("term_id2").alias("term_id"), F.col("at2").alias("at")), n), "start2", "pos2")
    cell, cell2 = F.floor(F.col("start") / width), F.floor(F.col("start2") / width)
    first = first.withColumn("cell", F.explode(F.sequence(cell - 1, cell + 1)) if slop else cell)
    pairs = first.join(second.withColumn("cell", cell2), ["row", "wid", "cell"]).filter(F.abs(F.col("start") - F.col("start2")) <= (slop or 0))
    met = pairs.groupBy("row", "wid", "start").agg(F.max(F.col("start") == F.col("start2")).alias("meets"), F.max(F.col("pos") != F.col("pos2")).alias("near"))
    found = materialize(met, "places").join(bounded(chosen.select("wid", "length", "whole"), n), "wid")
    phrases = found.filter(F.col("meets") & F.col("whole") & (F.col("start") >= 0))
    # the lists of all the window's terms, of the rows that have places
    placed = materialize(phrases.select("row").distinct(), "placed")
    n_placed = placed.count()
    lists = index.select("row", "term_id", "pos")
    lists = lists.join(F.broadcast(placed), "row", "left_semi") if n_placed <= BROADCAST_ROWS else lists
    listed = windows.select("wid", F.posexplode("window").alias("offset", "term")).join(terms, "term").select("wid", "offset", "term_id")
    wanted = phrases.join(listed, "wid").select("row", "wid", "start", "length", "term_id", (F.col("start") + F.col("offset")).alias("pos"))
    whole = wanted.join(lists, ["row", "term_id", "pos"], "left_semi").groupBy("row", "wid", "start", "length").agg(F.count("*").alias("n")).filter("n = length")
    whole = whole.select("row", "wid", "start", "length", F.lit(True).alias("exact"))
    if slop is None:
        return whole
    marked = found.join(whole.drop("length"), ["row", "wid", "start"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    return marked.filter("exact or near").select("row", "wid", "start", "length", "exact")


def window_matches(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", slop: int | None = None) -> DataFrame:
    """Places of windows in documents: doc_id, text_key, window, start (from 0), length, exact; each place of a row once.

    With slop None only exact phrases; else also places where the window's two rarest terms that the corpus has, less
    their offsets, are at most slop words apart (exact false; start is the first term's and may lie before the text).
    """
    known = numbered(windows)
    terms = vocabulary(known)
    index = positional_index(docs, terms, id_col, text_col)
    found = index_matches(index, terms, known, slop).join(known, "wid").join(marks(index), "row")
    return found.select("doc_id", "text_key", "window", "start", "length", "exact")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    slop: int = SLOP,
) -> DataFrame:
    """One row per input row: doc_id, text_key, n_words, n_hit (words inside an exact occurrence of a window), items (ids with
    occurring windows, sorted as strings), contaminated (n_hit > 0), n_near (places of windows that match by proximity
    only) and near_items (ids of those windows, sorted as strings).

    Null and empty texts have no words; an item without words has no window; an item with a null id hits words but is
    not listed. Rows with a null id or a repeated id are kept apart by their texts; repeated rows each give their row.
    Empty tables give no hits or no rows. Other columns are not looked at.
    """
    windows = materialize(item_windows(items, size, item_id, item_text), "item-windows")
    known = numbered(windows)
    terms = vocabulary(known)
    index = positional_index(docs, terms, id_col, text_col)
    found = materialize(index_matches(index, terms, known, slop), "matches")
    hit = found.filter("exact").select("row", F.explode(F.expr("sequence(start, start + length - 1)")).alias("pos")).distinct()
    hit = hit.groupBy("row").agg(F.count("*").alias("n_hit"))
    near = found.filter("not exact").groupBy("row").agg(F.count("*").alias("n_near"))
    owners = windows.join(known, "window").select("wid", F.col("item_id").cast("string").alias("item"))
    named = found.select("row", "wid", "exact").distinct().join(owners, "wid").groupBy("row").agg(
        *[F.array_sort(F.collect_set(F.when(kind, F.col("item")))).alias(c) for c, kind in (("items", F.col("exact")), ("near_items", ~F.col("exact")))]
    )
    # one side of all three, as a row with matches has a row in `named` at least
    matched = named.join(hit, "row", "left").join(near, "row", "left")
    rows = marks(index).join(matched, "row", "left")
    none, nobody = F.lit(0), F.array().cast("array<string>")
    return rows.select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", none).cast("long").alias("n_hit"),
        F.coalesce("items", nobody).alias("items"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
        F.coalesce("n_near", none).cast("long").alias("n_near"),
        F.coalesce("near_items", nobody).alias("near_items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a window of an item, all columns as they were."""
    found = window_matches(docs, item_windows(items, size), id_col, text_col)
    bad = found.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    keyed = docs.withColumn("_key", text_key(F.col(text_col)))
    left = keyed.join(bad, (F.col("_key") == F.col("_bad_key")) & F.col(id_col).eqNullSafe(F.col("_bad_id")), "left_anti")
    return left.select(*docs.columns)


#: Oracle of op8_decontaminate.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (
  SELECT g.doc_id, g.k, g.i, g.n, win.item_id FROM grams g JOIN win ON g.k = win.k AND g.n = win.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), vocab AS (
  SELECT DISTINCT unnest(w) AS t FROM b
), tok AS (
  SELECT doc_id, t, p FROM (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d) WHERE t IN (SELECT t FROM vocab)
), freq AS (
  SELECT t, count(*) AS c FROM tok GROUP BY t
), ranked AS (
  SELECT k, n, t, p, row_number() OVER (PARTITION BY k ORDER BY c, t, p) AS r
  FROM (SELECT k, n, unnest(string_split(k, ' ')) AS t, unnest(range(0, n)) AS p FROM (SELECT DISTINCT k, n FROM win)) JOIN freq USING (t)
), two AS (
  SELECT x.k, x.t AS t1, x.p AS p1, y.t AS t2, y.p AS p2 FROM ranked x JOIN ranked y ON x.k = y.k WHERE x.r = 1 AND y.r = 2
), probe AS (
  SELECT doc_id, k, tok.p - p1 AS s, t2, tok.p AS q1, unnest(range(tok.p - p1 + p2 - 2, tok.p - p1 + p2 + 3)) AS q2 FROM tok JOIN two ON tok.t = two.t1
), near AS (
  SELECT doc_id, count(*) AS n_near FROM (
    SELECT DISTINCT probe.doc_id, k, s FROM probe JOIN tok ON tok.doc_id = probe.doc_id AND tok.t = probe.t2 AND tok.p = q2 WHERE q1 <> q2
    EXCEPT SELECT doc_id, k, i - 1 FROM found
  ) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
