"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Each benchmark window (a run of consecutive item words) is looked up by its rarest terms. The index
stores (document, position) postings of the benchmark's terms over the whole corpus; one pass over the texts writes it,
and frequencies, word counts and look-ups all read it. A window's candidates are the postings of its rarest term, moved
back by the term's offset in the window, that are also in the moved-back list of its second rarest; the words of the
documents that have candidates then confirm the phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table, written

WINDOW = 10
#: What stands between words; a word is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side is broadcast only if its counted rows stay below this; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text in order; NULL has none."""
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(t) == F.length(t)  # of A-Z, lower() changes nothing else in such a text, and is quicker
    return F.filter(F.split(F.when(plain, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)), BETWEEN), lambda x: x != "")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, words, item_ids): distinct windows of the items (item_id, text).

    An item of fewer words than a window, but not none, is one window; an item without words has none.
    """
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(F.xxhash64("words").alias("window"), "words", "item_ids")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, w): documents as words; (doc_id, h) names a row up to exact repetition."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))


def postings(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, pos, term): the stored index, positions of the windows' terms in all documents.

    Every row of docs has a row with pos 0, or NULL if it has no words; its term is NULL if no window has it. The texts
    are read and cut into words once, here.
    """
    vocab = cut(wins.select(F.explode("words").alias("term")).distinct())
    known = _sized(vocab.withColumn("known", F.lit(True)), vocab.count())
    # the outer explode has no filter on its words, which would cut the texts into words a second time
    each = keyed(docs).withColumn("n_words", F.size("w")).select("doc_id", "h", "n_words", F.posexplode_outer("w").alias("pos", "term"))
    spots = each.join(known, "term", "left").filter("known OR coalesce(pos, 0) = 0")
    return written(spots.select("doc_id", "h", "n_words", "pos", F.when(F.col("known"), F.col("term")).alias("term")))


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df): occurrences of the windows' terms over the whole corpus, summed up in a stage of its own."""
    return cut(index.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")))


def anchors(wins: DataFrame, index: DataFrame, count: int = 2) -> DataFrame:
    """(window, rank, offset, term, need): the `count` rarest distinct terms of each window by corpus frequency."""
    spots = wins.select("window", F.posexplode("words").alias("offset", "term"))
    w = Window.partitionBy("window")
    first = spots.groupBy("window", "term").agg(F.min("offset").alias("offset"))
    # a window with a term that the corpus lacks cannot occur
    ranked = first.join(frequencies(index), "term", "left").withColumn("none", F.count_if(F.col("df").isNull()).over(w)).filter("none = 0")
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy("df", "term"))).filter(F.col("rank") <= count)
    return ranked.select("window", "rank", "offset", "term", F.count("*").over(w).alias("need"))


def _hits(index: DataFrame, a: DataFrame, rows: int) -> DataFrame:
    """The postings of the anchors' terms, each with the windows that it anchors."""
    return index.filter("term IS NOT NULL").select("doc_id", "h", "pos", "term").join(_sized(a, rows), "term")


def _candidates(index: DataFrame, a: DataFrame, rows: int) -> DataFrame:
    """(doc_id, h, window, start): offset-adjusted postings of the rarest terms, intersected."""
    hit = _hits(index, a, rows)
    moved = hit.select("doc_id", "h", "window", "need", "rank", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")
    lists = moved.groupBy("doc_id", "h", "window", "start").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("ranks"), F.max("need").alias("need"))
    return lists.filter("bit_count(ranks) = need").select("doc_id", "h", "window", "start")


def _beside_texts(docs: DataFrame, found: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, h, w, c): the words of each document with candidates, and c, its candidates (start, window, words).

    Only documents with candidates move: their keys are sent to the texts if their counted rows are few, else the
    texts are dealt out by key.
    """
    named = wins.join(found.select("window").distinct(), "window", "left_semi").select("window", "words")
    wanted = found.join(_sized(named, named.count()), "window").withColumnsRenamed({"doc_id": "d2", "h": "h2"})
    starts = wanted.groupBy("d2", "h2").agg(F.collect_set(F.struct("start", "window", "words")).alias("c"))  # at most a document's own positions
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    ids = found.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).distinct()
    few = ids.count()
    if few <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), same, "left_semi")
    return texts.join(starts, same).select("doc_id", "h", words(F.col("text")).alias("w"), "c")


def phrase_matches(docs: DataFrame, wins: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, h, window, start, len): every exact occurrence of a window in a document, positions from 0."""
    index = postings(docs, wins) if index is None else index
    a = cut(anchors(wins, index))
    found = cut(_candidates(index, a, a.count()))
    joined = _beside_texts(docs, found, wins)
    good = F.filter("c", lambda x: F.slice("w", x["start"] + 1, F.size(x["words"])) == x["words"])
    # the outer explode keeps Spark from working the condition twice; a document without a match leaves a row without a window
    true = joined.select("doc_id", "h", F.explode_outer(good).alias("x")).select("doc_id", "h", "x.window", "x.start", F.size("x.words").alias("len"))
    return true.filter("window IS NOT NULL").distinct()  # a repeated row finds the same places again


def near_anchors(wins: DataFrame, index: DataFrame, count: int, edits: Column) -> DataFrame:
    """(window, rank, offset, term, need): the `count` rarest terms of each window among those that the corpus has.

    A window may lack `edits` of its words. Each word that the corpus lacks is one of them; `need` is how many of the
    anchors are left if each further one costs an anchor. Windows that lack more words than that cannot occur.
    """
    spots = wins.select("window", edits.alias("edits"), F.posexplode("words").alias("offset", "term"))
    all_of = Window.partitionBy("window")
    first = spots.groupBy("window", "edits", "term").agg(F.min("offset").alias("offset"), F.count("*").alias("times"))
    left = first.join(frequencies(index), "term", "left").withColumn("spare", F.col("edits") - F.coalesce(F.sum(F.when(F.col("df").isNull(), F.col("times"))).over(all_of), F.lit(0)))
    ranked = left.filter("spare >= 0 AND df IS NOT NULL").withColumn("rank", F.row_number().over(all_of.orderBy("df", "term"))).filter(F.col("rank") <= count)
    return ranked.select("window", "rank", "offset", "term", F.greatest(F.count("*").over(all_of) - F.col("spare"), F.lit(1)).alias("need"))


def proximity_matches(docs: DataFrame, wins: DataFrame, slop: int = 2, terms: int = 3) -> DataFrame:
    """(doc_id, h, window, start, words_near): every place where a window occurs with small changes.

    There all words of the window but one in WINDOW lie within `slop` words of their exact places, so one of ten words
    may be changed, dropped or set between others. Candidates are starts near which the rarest terms agree; the
    document's words then decide. Of starts within `slop` of each other, those with most words in place are kept.
    A start is negative if a document begins inside the window.
    """
    wide = 2 * slop + 1  # anchors of one start lie in one of two neighbouring cells of so many words
    if terms * 2 * wide > 62:
        raise ValueError("the cells of all anchors must fit into one number")
    edits = F.floor(F.size("words") / WINDOW)
    index = postings(docs, wins)
    a = cut(near_anchors(wins, index, terms, edits))
    hit = _hits(index, a, a.count())
    moved = hit.select("doc_id", "h", "window", "need", "rank", (F.col("pos") - F.col("offset")).alias("at"))
    cells = moved.select("doc_id", "h", "window", "need", "rank", "at", F.explode(F.array(F.expr(f"floor(at / {wide})"), F.expr(f"floor(at / {wide}) + 1"))).alias("cell"))
    bit = F.expr(f"shiftleft(1L, cast((rank - 1) * {2 * wide} + at - (cell - 1) * {wide} as int))")
    g = cells.groupBy("doc_id", "h", "window", "cell").agg(F.bit_or(bit).alias("m"), F.max("need").alias("need"))
    ranks = [f"shiftright(m, {r * 2 * wide}) & {(1 << 2 * wide) - 1}" for r in range(terms)]
    agree = " + ".join(f"int((shiftright(shiftleft({m}, {2 * slop}), j + {slop}) & {(1 << wide) - 1}) <> 0)" for m in ranks)
    some = g.filter(F.expr(f"{' + '.join(f'int(({m}) <> 0)' for m in ranks)} >= need"))
    at = F.expr(f"transform(filter(sequence({-slop}, {2 * wide - 1 + slop}), j -> {agree} >= need), j -> cast((cell - 1) * {wide} + j as int))")
    found = cut(some.select("doc_id", "h", "window", F.explode(at).alias("start")).distinct())
    joined = _beside_texts(docs, found, wins)
    each = joined.select("doc_id", "h", F.explode_outer(F.transform("c", lambda x: _placed(x, slop))).alias("x")).select("doc_id", "h", "x.*").distinct()
    good = each.filter("words_near >= len - edits")
    by = Window.partitionBy("doc_id", "h", "window").orderBy("start").rangeBetween(-slop, slop)
    return good.withColumn("most", F.max(F.struct("words_near", "exact")).over(by)).filter("most = struct(words_near, exact)").select("doc_id", "h", "window", "start", "words_near")


def _placed(x: Column, slop: int) -> Column:
    """How many words of a candidate's window stand within slop words of their places in w, and how many exactly there."""
    at = F.sequence(F.lit(0), F.size(x["words"]) - 1)

    def near(i: Column) -> Column:
        low = F.greatest(x["start"] + i - slop, F.lit(0))
        n = F.greatest(x["start"] + i + slop + 1 - low, F.lit(0))
        return F.array_contains(F.slice("w", low + 1, n), F.get(x["words"], i))

    same = F.filter(at, lambda i: (x["start"] + i >= 0) & (F.get(F.col("w"), x["start"] + i) == F.get(x["words"], i)))
    return F.struct(
        x["window"].alias("window"),
        x["start"].alias("start"),
        F.size(x["words"]).alias("len"),
        F.floor(F.size(x["words"]) / WINDOW).alias("edits"),
        F.size(F.filter(at, near)).alias("words_near"),
        F.size(same).alias("exact"),
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text).

    A word is hit if it lies in any occurrence of a window. Documents without words, and all documents if
    there are no items, have zeros and the hash of the empty string. Repeated rows keep one row each.
    """
    wins = cut(windows(items, size))
    index = postings(docs, wins)
    m = cut(phrase_matches(docs, wins, index))
    w = Window.partitionBy("doc_id", "h").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    spans = m.groupBy("doc_id", "h", "start").agg(F.max("len").alias("len"))
    new = spans.withColumn("done", F.coalesce(F.max(end).over(w), F.lit(0)))
    hits = new.groupBy("doc_id", "h").agg(F.sum(F.greatest(end - F.greatest("start", "done"), F.lit(0))).alias("n_hit"))
    names = m.select("doc_id", "h", "window").distinct().join(wins.select("window", F.explode("item_ids").alias("item_id")), "window")
    ids = names.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = hits.join(ids, hits.doc_id.eqNullSafe(ids.doc_id) & (hits.h == ids.h)).select(hits.doc_id.alias("d2"), hits.h.alias("h2"), "n_hit", "ids")
    counted = index.filter("coalesce(pos, 0) = 0").select("doc_id", "h", F.col("n_words").cast("bigint").alias("n_words"))
    out = counted.join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    ids_text = F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ",")
    n = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        "doc_id",
        "h",
        "n_words",
        n.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(ids_text, 256).alias("items_sha256"),
        (n > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the rows that hold an occurrence of a benchmark window. Further columns may have any name."""
    m = phrase_matches(docs.select("doc_id", "text"), cut(windows(items, size))).select("doc_id", "h").distinct()
    d, h = fresh(docs, "d"), fresh(docs, "h")
    m = m.withColumnsRenamed({"doc_id": d, "h": h})
    return docs.join(m, F.col("doc_id").cast("bigint").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("h")


def op2_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, start, words_near): where documents hold a window of an item with small changes or none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wins = cut(windows(table(spark, sf_dir, "benchmark").select("item_id", "text")))
    m = proximity_matches(docs, wins).join(wins.select("window", F.explode("item_ids").alias("item_id")), "window")
    return m.groupBy("doc_id", "h", "item_id", "start").agg(F.max("words_near").alias("words_near")).drop("h")


ORACLE = rf"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) AS n, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS win, least(n, 10) AS len FROM bs),
lens AS (SELECT DISTINCT len FROM win),
ds AS (SELECT rid, len, w, unnest(range(1, len(w) - len + 2)) AS i FROM dw, lens WHERE len(w) >= len),
hit AS (SELECT rid, i, win.len, item_id FROM ds JOIN win ON win.len = ds.len AND win.win = array_to_string(ds.w[ds.i:ds.i+ds.len-1], ' ')),
pos AS (SELECT DISTINCT rid, unnest(range(i, i + len)) AS p FROM hit),
nh AS (SELECT rid, count(*) AS n_hit FROM pos GROUP BY 1),
ni AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid)
"""
