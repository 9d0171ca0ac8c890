"""Page-locality analytics over access traces: gathers, coalescing, tier hits, FIFO residency.

A trace has seq (a total order, a number or a struct), index, and as needed block, warp and thread.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

PAGE = 1024
T2_ENTRIES = 32
COUNTS = ["block", "entry", "hits", "misses", "conflicts", "released", "pinned"]


def page_of(index: str = "index", page: int = PAGE) -> Column:
    return F.floor(F.col(index) / page)


def page_histogram(trace: DataFrame) -> DataFrame:
    return trace.groupBy(page_of().alias("page")).agg(F.count("*").alias("accesses"), F.countDistinct(F.col("index") % PAGE).alias("offsets"))


def gather(trace: DataFrame, backing: DataFrame) -> DataFrame:
    """(seq, index, value) by position."""
    return trace.select("seq", "index").join(backing, "index").select("seq", "index", "value")


def coalesced_gather(trace: DataFrame, backing: DataFrame) -> DataFrame:
    """The same rows, fetched a page at a time: each wanted page is read once and its elements are picked from it."""
    want = trace.select("seq", "index", page_of().alias("page"))
    pages = (
        backing.withColumn("page", page_of())
        .join(want.select("page").distinct(), "page", "left_semi")
        .groupBy("page")
        .agg(F.map_from_entries(F.collect_list(F.struct((F.col("index") % PAGE).alias("o"), "value"))).alias("data"))  # one page: 1024 elements
    )
    return want.join(pages, "page").select("seq", "index", F.element_at("data", F.col("index") % PAGE).alias("value")).filter("value IS NOT NULL")


def coalesced_probes(trace: DataFrame, step: str | None = None) -> DataFrame:
    """One row accesses, probes: one probe for each page that a warp wants in a step."""
    keys = ["warp", page_of().alias("page")] + ([F.col(step).alias("step")] if step else [])
    g = trace.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accesses"), F.count("*").alias("probes"))


def with_steps(trace: DataFrame) -> DataFrame:
    """trace with step: the how-manieth access of its thread each row is, from 0; the lanes of a warp take a step together."""
    return trace.withColumn("step", F.row_number().over(Window.partitionBy("thread").orderBy("seq")) - 1)


def _flags(trace: DataFrame, tiers: int, launch: str | None) -> DataFrame:
    """trace with page, and h1 and h2: whether T1 or T2 holds the page."""
    if tiers not in (2, 3):
        raise ValueError("tiers must be 2 or 3")
    extra = [launch] if launch else []
    t = trace.withColumn("page", page_of())
    w1 = Window.partitionBy(*extra, "block", "thread").orderBy("seq")
    t = t.withColumn("h1", F.coalesce(F.lag("page").over(w1) == F.col("page"), F.lit(False)))
    if tiers == 2:
        return t.withColumn("h2", F.lit(False))
    w2 = Window.partitionBy(*extra, "block", "h1", F.col("page") % T2_ENTRIES).orderBy("seq")
    return t.withColumn("h2", ~F.col("h1") & F.coalesce(F.lag("page").over(w2) == F.col("page"), F.lit(False)))


def tier_hits(trace: DataFrame, tiers: int = 3, launch: str | None = None) -> DataFrame:
    """One row accesses, t1_hits, t2_hits, t3_hits, misses of an unbounded last tier.

    T1 is the thread's last page, T2 the block's direct-mapped entry page % 32, T3 first touch.
    T1 and T2 start anew with each launch.
    """
    t = _flags(trace, tiers, launch)
    g = t.groupBy("page").agg(F.count("*").alias("n"), F.count_if("h1").alias("a"), F.count_if("h2").alias("b"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return g.agg(
        s("n").alias("accesses"), s("a").alias("t1_hits"), s("b").alias("t2_hits"), (s("n") - s("a") - s("b") - F.count("*")).alias("t3_hits"), F.count("*").alias("misses")
    )


def bounded_tier_hits(trace: DataFrame, slots: int, tiers: int = 3, launch: str | None = None) -> DataFrame:
    """One row accesses, t1_hits, t2_hits, t3_hits, misses; the last tier is one first-in first-out cache of `slots` pages.

    T1 and T2 start anew with each launch, T3 does not. Only what T1 and T2 do not hold is put in order for T3.
    """
    t = _flags(trace, tiers, launch)
    none = F.lit(0).cast("bigint")
    upper = t.agg(F.count("*").alias("accesses"), F.count_if("h1").alias("t1_hits"), F.count_if("h2").alias("t2_hits"), none.alias("t3_hits"), none.alias("misses"))
    asked = t.filter("NOT h1 AND NOT h2").select(none.alias("cache"), "seq", "index")
    last = fifo_simulate(asked, slots, "cache").select(none.alias("accesses"), none.alias("t1_hits"), none.alias("t2_hits"), F.col("hits").alias("t3_hits"), "misses")
    s = lambda c: F.coalesce(F.sum(c), none).alias(c)
    return upper.unionByName(last).agg(*(s(c) for c in upper.columns))


def coalesced_tier_hits(trace: DataFrame) -> DataFrame:
    """One row accesses, t1_hits, probes, t2_hits, t3_hits, misses of an unbounded last tier, counted as acquisitions.

    trace has warp and step. What T1 does not hold is asked for once for each page that a warp wants in a step; T2 and
    T3 count those probes and not their lanes.
    """
    t = _flags(trace, 2, None)
    lead = t.filter("NOT h1").groupBy("block", "warp", "step", "page").agg(F.min("seq").alias("seq"))
    w2 = Window.partitionBy("block", F.col("page") % T2_ENTRIES).orderBy("seq")
    lead = lead.withColumn("h2", F.coalesce(F.lag("page").over(w2) == F.col("page"), F.lit(False)))
    g = lead.groupBy("page").agg(F.count("*").alias("n"), F.count_if("h2").alias("b"))
    none = F.lit(0).cast("bigint")
    s = lambda c: F.coalesce(F.sum(c), none)
    lower = g.agg(s("n").alias("probes"), s("b").alias("t2_hits"), (s("n") - s("b") - F.count("*")).alias("t3_hits"), F.count("*").alias("misses"))
    upper = t.agg(F.count("*").alias("accesses"), F.count_if("h1").alias("t1_hits"))
    return upper.crossJoin(F.broadcast(lower))  # a row each


def observed(trace: DataFrame, tiers: int = 3) -> tuple[DataFrame, Observation]:
    """The trace's pages with h1 and h2, and counters that any action on them fills: accesses, t1_hits, t2_hits."""
    seen = Observation()
    return _flags(trace, tiers, None).observe(seen, F.count("*").alias("accesses"), F.count_if("h1").alias("t1_hits"), F.count_if("h2").alias("t2_hits")), seen


def pinned_entries(events: DataFrame) -> DataFrame:
    """(block, entry, hits, misses, conflicts, released, pinned) of T2 entries whose readers pin them.

    events: block, seq, page, count; a positive count acquires for so many readers, a negative one releases them.
    An entry is page % 32. Acquiring its own page is a hit; an empty entry, or one without readers, takes the page
    (a miss, and a page released if one was there); another reader's page is a conflict, and the acquire is refused.
    A release counts down its own page only, to 0 at least; pinned are the readers left when the trace ends.
    """
    e = events.select("block", F.pmod("page", F.lit(T2_ENTRIES)).cast("bigint").alias("entry"), "seq", "page", F.col("count").cast("bigint").alias("count"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s = None, None
        out: list[tuple] = []
        for b in batches:
            for block, entry, page, count in zip(b["block"].tolist(), b["entry"].tolist(), b["page"].tolist(), b["count"].tolist(), strict=True):
                if key != (block, entry):
                    if key is not None:
                        out.append((*key, *s[1:5], s[5]))
                    key, s = (block, entry), [None, 0, 0, 0, 0, 0]  # page, hits, misses, conflicts, released, readers
                if count < 0:
                    if page == s[0]:
                        s[5] = max(0, s[5] + count)
                elif page == s[0]:
                    s[1] += 1
                    s[5] += count
                elif s[0] is None or s[5] == 0:
                    s[2] += 1
                    s[4] += s[0] is not None
                    s[0], s[5] = page, count
                else:
                    s[3] += 1
            if out:
                yield pd.DataFrame(out, columns=COUNTS)
                out = []
        if key is not None:
            yield pd.DataFrame([(*key, *s[1:5], s[5])], columns=COUNTS)

    return e.repartition("block", "entry").sortWithinPartitions("block", "entry", "seq").drop("seq").mapInPandas(run, ", ".join(f"{c} bigint" for c in COUNTS))


def fifo_step(pages: list[int], slots: int, queue: deque, resident: set) -> tuple[int, int]:
    """Hits and misses of one stretch of a trace; queue and resident carry on."""
    hits = misses = 0
    for p in pages:
        if p in resident:
            hits += 1
            continue
        misses += 1
        if len(queue) == slots:
            resident.discard(queue.popleft())
        queue.append(p)
        resident.add(p)
    return hits, misses


def fifo_simulate(trace: DataFrame, slots: int | list[int], cache: str = "block") -> DataFrame:
    """(cache, slots, hits, misses) of first-in first-out caches, one for each value of the cache column.

    A cache is sequential by nature; caches and sizes run side by side. Rows arrive sorted and are
    streamed, so a task holds the resident pages and not the trace.
    """
    sizes = [slots] if isinstance(slots, int) else list(slots)
    if not sizes or min(sizes) < 1:
        raise ValueError("a cache needs at least one slot")
    t = trace.select(F.col(cache).cast("bigint").alias("cache"), "seq", page_of().alias("page"))
    t = t.withColumn("slots", F.explode(F.array(*(F.lit(s) for s in sizes))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple | None = None
        for b in batches:
            out = []
            for (c, s), g in b.groupby(["cache", "slots"], sort=False):
                if state is None or state[:2] != (c, s):
                    if state is not None:
                        out.append((state[0], state[1], state[4], state[5]))
                    state = (c, s, deque(), set(), 0, 0)
                h, m = fifo_step(g["page"].tolist(), int(s), state[2], state[3])
                state = (*state[:4], state[4] + h, state[5] + m)
            if out:
                yield pd.DataFrame(out, columns=["cache", "slots", "hits", "misses"])
        if state is not None:
            yield pd.DataFrame([(state[0], state[1], state[4], state[5])], columns=["cache", "slots", "hits", "misses"])

    return t.repartition("cache", "slots").sortWithinPartitions("cache", "slots", "seq").drop("seq").mapInPandas(run, "cache bigint, slots int, hits bigint, misses bigint")


def derived_metrics(counts: DataFrame) -> DataFrame:
    """counts (accesses, hits, misses, ms, target_ms) with hit_pct, t1_hits, gb_per_s, speedup and pcie_mb."""
    total = F.col("hits") + F.col("misses")
    return counts.select(
        "*",
        F.when(total > 0, F.col("hits") * 100.0 / total).otherwise(0.0).alias("hit_pct"),
        F.greatest(F.col("accesses") - total, F.lit(0)).alias("t1_hits"),
        F.when(F.col("ms") > 0, F.col("accesses") * 4 / 1e9 / (F.col("ms") / 1e3)).alias("gb_per_s"),
        F.when(F.col("ms") > 0, F.col("target_ms") / F.col("ms")).alias("speedup"),
        (F.col("misses") * 4096 / 1048576.0).alias("pcie_mb"),
    )


def sizing(elements: int, share: float) -> tuple[int, int]:
    """(pages, cache pages) for a share of the array; a share outside (0, 1] is an error."""
    if not 0 < share <= 1:
        raise ValueError("the cache share must be in (0, 1]")
    pages = -(-elements // PAGE)
    return pages, int(pages * share)


def sizing_rows(sizes: DataFrame) -> DataFrame:
    """sizes (elements, share) with pages and cache_pages; the product of pages and share is one of 32-bit floats, cut to an integer."""
    pages = F.ceil(F.col("elements") / PAGE)
    return sizes.select("elements", "share", pages.alias("pages"), F.floor((pages.cast("float") * F.col("share").cast("float")).cast("float")).alias("cache_pages"))


def first_mismatches(a: DataFrame, b: DataFrame, key: str, value: str, count: int = 5) -> DataFrame:
    """(key, expected, got) of the first differing rows in the order of the key; NULL where a side has no row."""
    j = a.select(key, F.col(value).alias("expected")).join(b.select(key, F.col(value).alias("got")), key, "full")
    return j.filter(~F.col("expected").eqNullSafe(F.col("got"))).orderBy(key).limit(count)


def mismatches(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row rows, mismatched: keys whose values differ or that one side lacks."""
    x = a.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x"))
    y = b.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    j = x.join(y, key, "full")
    bad = F.col("_x").isNull() | F.col("_y").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return j.agg(F.count("*").alias("rows"), F.count_if(bad).alias("mismatched"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
