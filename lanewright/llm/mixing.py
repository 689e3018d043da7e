"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  Each
pattern offers its words up to ``max_repeats`` times, the k-th copy at cost k (convex), to the
quotas of its sources; a min-cost maximum flow says how many words each pattern gives.  Within a
pattern all documents get the whole copies and a seeded selection gets one more, found by
histograms of a hash, so that no task ever sorts a whole source.

Cases: null or empty text has size 0 and is taken 0 times; no documents give no rows; a null
source is a source of its own, ordered last; rows that repeat a doc_id share one decision; a null
doc_id gets its place in the seeded order from its text;
extra columns are ignored by ``mix_documents`` (it returns its own columns only).
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, IdSpace, fresh, materialize, own_columns, require_columns

BUCKETS = 4096


def capped_targets(sizes: list[float], weights: list[float], cap: float) -> list[float]:
    """Share sum(sizes) by weight; no target above cap * size, the excess is shared again by weight."""
    targets, active, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in active:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return targets


def min_cost_flow(supply: list[int], members: list[tuple[int, ...]], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources.

    Shortest augmenting paths, all of one cost at a time, on source -> pattern (``repeats`` parallel arcs of cost 0, 1, ...)
    -> member sources -> sink; the graph has one node for each pattern and source.
    """
    n, m = len(supply), len(quotas)
    s, t = n + m, n + m + 1
    to, cap, cost, out = [], [], [], [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y), cap.append(cc), cost.append(ww)
        return len(to) - 2

    share: dict[tuple[int, int], int] = {}
    for p in range(n):
        for k in range(repeats):
            arc(s, p, supply[p], k)
        for q in members[p]:
            share[p, q] = arc(p, n + q, supply[p] * repeats, 0)
    for q in range(m):
        arc(n + q, t, quotas[q], 0)
    while True:
        # Distances by cost, then a blocking flow over the arcs of shortest paths.
        dist, queue, queued = {s: 0}, deque([s]), {s}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in out[x]:
                if cap[e] and dist[x] + cost[e] < dist.get(to[e], 1 << 60):
                    dist[to[e]] = dist[x] + cost[e]
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if t not in dist:
            break
        at, path, inside = [0] * len(out), [], {s}
        x = s
        while True:
            if x == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                x, path, inside = s, [], {s}
                continue
            while at[x] < len(out[x]):
                e = out[x][at[x]]
                if cap[e] and to[e] not in inside and dist.get(to[e], 1 << 60) == dist[x] + cost[e]:
                    break
                at[x] += 1
            if at[x] < len(out[x]):
                path.append(e)
                x = to[e]
                inside.add(x)
            elif path:
                inside.discard(x)
                x = to[path.pop() ^ 1]
                at[x] += 1
            else:
                break
    flows: list[dict[int, int]] = [{} for _ in range(n)]
    for (p, q), e in share.items():
        flows[p][q] = cap[e ^ 1]
    return flows


def _pick(sized: DataFrame, quota: DataFrame) -> DataFrame:
    """sized (pattern, doc_id, size, h) with extra copies: sized and a boolean ``extra``.

    quota (pattern, rest): words to take once more.  The seeded order is that of h.  Two
    histograms of 4096 buckets narrow the place where the running sum passes ``rest``; only the
    rows of the last bucket are put in order.  Of the documents behind, the one nearest to the
    words still missing is added if that comes nearer.
    """
    live = quota.where("rest > 0")
    at, left = sized.join(F.broadcast(live), "pattern"), F.col("rest")
    cuts = live.select("pattern", "rest", F.lit(0).cast("long").alias("low"))
    for level in (1, 2):
        width = 1 << (62 - 12 * level)
        inside = at.drop("rest").join(F.broadcast(cuts), "pattern").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width * BUCKETS))
        buckets = inside.groupBy("pattern", "low", "rest", ((F.col("h") - F.col("low")) / width).cast("long").alias("b")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("pattern").orderBy("b")
        before = F.coalesce(F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        buckets = buckets.withColumn("before", before).where((F.col("before") <= left) & (F.col("before") + F.col("size") > left))
        cuts = buckets.groupBy("pattern").agg(F.min_by(F.struct((F.col("rest") - F.col("before")).alias("rest"), (F.col("low") + F.col("b") * width).alias("low")), "b").alias("c")).select("pattern", "c.rest", "c.low")
        cuts = materialize(cuts, f"cuts{level}")  # a row for each pattern
    last = 1 << 38
    inside = at.drop("rest").join(F.broadcast(cuts), "pattern").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + last))
    run = Window.partitionBy("pattern").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("sum", F.sum("size").over(run)).where(F.col("sum") <= left)
    fits = fits.groupBy("pattern").agg(F.max("h").alias("upto"), F.max("sum").alias("got"))
    ends = cuts.join(fits, "pattern", "left").select("pattern", F.coalesce("upto", F.col("low") - 1).alias("upto"), (F.col("rest") - F.coalesce("got", F.lit(0))).alias("gap"))
    ends = materialize(ends, "ends")  # a row for each pattern
    near = F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("h"))
    one = at.drop("rest").join(F.broadcast(ends), "pattern").where((F.col("h") > F.col("upto")) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    one = one.groupBy("pattern").agg(F.min(near).alias("n")).select("pattern", F.col("n.h").alias("one"))
    plan = live.select("pattern").join(ends, "pattern", "left").join(one, "pattern", "left").withColumn("all", F.col("upto").isNull())
    done = sized.join(F.broadcast(plan), "pattern", "left")
    extra = F.coalesce(F.col("all") | (F.col("h") <= F.col("upto")) | (F.col("h") == F.col("one")), F.lit(False))
    return done.select(*sized.columns, extra.alias("extra"))


def mix(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 8, max_patterns: int = 4096) -> DataFrame:
    """sized (doc_id, sources array<string>, size long) -> doc_id, sources, size, taken, and each source's size and target.

    Sources weigh ``weights``, repeating, in code-point order, a null last; their sizes and targets
    come from all memberships.  The driver sees one number for each source and for each of the
    ``max_patterns`` patterns with the most words.  Each other pattern gives only to the one of its
    sources whose target is the largest multiple of its size, together with all that give to that
    one alone; it keeps its memberships, so sources, sizes and targets stay what they are.
    """
    spark = sized.sparkSession
    each = F.array_distinct("sources")
    key = F.transform(each, lambda s: F.when(s.isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), s)))
    key = F.concat_ws("\x00", F.transform(F.array_sort(key), lambda s: F.base64(s.cast("binary"))))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 2)
    rows = sized.select("doc_id", "sources", "size", key.alias("pattern"), h.alias("h"))
    patterns = materialize(rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.min(each).alias("sources")), "patterns")
    found = {r.s: r.size for r in patterns.select("size", F.explode("sources").alias("s")).groupBy("s").agg(F.sum("size").alias("size")).collect()}
    names = sorted(found, key=lambda s: (s is None, (s or "").encode()))
    place, sizes = {s: i for i, s in enumerate(names)}, [found[s] for s in names]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], max_repeats)
    totals = [(r.pattern, r.size, tuple(sorted({place[s] for s in r.sources}))) for r in patterns.orderBy(F.desc("size"), "pattern").limit(max_patterns).collect()]
    info = spark.createDataFrame([(s, x, t, t / x if x else 0.0) for s, x, t in zip(names, sizes, targets, strict=True)], "name string, source_size long, target double, need double")
    large = spark.createDataFrame([(p,) for p, _, _ in totals], "pattern string")
    small = patterns.join(F.broadcast(large), "pattern", "left_anti").select("pattern", "size", F.explode("sources").alias("name"))
    small = small.join(F.broadcast(info.select(F.col("name").alias("name_"), "need")), F.col("name").eqNullSafe(F.col("name_")))
    small = small.groupBy("pattern").agg(F.max("size").alias("size"), F.max_by("name", F.struct("need", "name")).alias("only"))
    small = materialize(small.select("pattern", "size", F.when(F.col("only").isNull(), "n").otherwise(F.concat(F.lit("="), "only")).alias("only")), "small")
    # A merged group's name starts with a sign that no base64 text has.
    merged = F.concat(F.lit("*"), F.col("only"))
    if not small.isEmpty():
        rows = rows.join(small.select("pattern", merged.alias("merged")), "pattern", "left").withColumn("pattern", F.coalesce("merged", "pattern")).drop("merged")
        totals += [(f"*{r.only}", r.size, (place[None if r.only == "n" else r.only[1:]],)) for r in small.groupBy("only").agg(F.sum("size").alias("size")).orderBy("only").collect()]
    flows = min_cost_flow([x for _, x, _ in totals], [m for _, _, m in totals], [round(x) for x in targets], max_repeats)
    quota = [(p, sum(f.values()) // x if x else 0, sum(f.values()) % x if x else 0) for (p, x, _), f in zip(totals, flows, strict=True)]
    quota = spark.createDataFrame(quota, "pattern string, copies long, rest long")
    picked = _pick(rows, quota.drop("copies")).join(F.broadcast(quota.drop("rest")), "pattern", "left")
    taken = F.col("size") * (F.col("copies") + F.col("extra").cast("long"))
    out = picked.select("doc_id", "sources", "size", taken.alias("taken"))
    return out.withColumn("source", F.element_at("sources", 1)).join(F.broadcast(info), F.col("source").eqNullSafe(F.col("name")), "left").drop("name", "need")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """documents -> doc_id, source, size, source_size, target, taken."""
    require_columns(docs, ["doc_id", "text", "source"])
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    ids = IdSpace(docs)
    sized = materialize(docs.select(ids.known().alias("doc_id"), F.array("source").alias("sources"), size.alias("size")), "sized")
    out = mix(sized, **options)
    return out.select(ids.given("doc_id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    Each text of a repeated doc_id goes by its own source and size; a null doc_id gets its place from its text.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    ids = IdSpace(docs)
    sized = materialize(docs.select(ids.known().alias("doc_id"), F.array("source").alias("sources"), size.alias("size")), "sized")
    mixed = mix(sized, **options).where("taken > 0")
    id_, source_, size_, copies_, copy_ = (fresh(docs, x) for x in ("mixed_id", "mixed_source", "mixed_size", "copies", "copy"))
    mixed = mixed.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source_), F.col("size").alias(size_)).agg(F.max(F.expr("taken div size")).alias(copies_))
    out = docs.join(mixed, (ids.known() == F.col(id_)) & (size == F.col(size_)) & F.col("source").eqNullSafe(F.col(source_)))
    return out.withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(copies_).cast("int")))).select(*own_columns(docs))
