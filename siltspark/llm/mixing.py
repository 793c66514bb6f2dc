"""Mixing sources to target weights.

Texts are grouped by the set of sources they occur in (their pattern). A minimum-cost flow sends tokens from patterns to
source quotas: each pattern has one layer of tokens for every time its texts may be used, dearer with each repetition,
and may serve any of its sources. Texts of a pattern then lie on a line in seeded order, as long as their tokens; each
source takes the stretch of the line, wrapped around, that the flow gives it."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltspark.llm.bpe import encode_column
from siltspark.session import default_parallelism, materialize

#: Sources for which overlaps are followed, as bits of a long.
MOST_SOURCES = 60
#: Patterns (sets of sources that some text occurs in) beyond which the flow is not attempted on the driver.
MOST_PATTERNS = 1 << 16


@dataclass(frozen=True)
class Source:
    name: str
    weight: float
    repeats: int


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials; costs are not negative. The graph has a node for
    each pattern and source only."""

    def __init__(self, nodes: int):
        self.edges: list[list[list]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> list:
        forth, back = [b, capacity, cost, None], [a, 0, -cost, None]
        forth[3], back[3] = back, forth
        self.edges[a].append(forth)
        self.edges[b].append(back)
        return back  # its capacity is what flows along the edge

    def run(self, start: int, end: int) -> int:
        n, total = len(self.edges), 0
        potential = [0] * n
        while True:
            distance: list = [None] * n
            distance[start], via = 0, [None] * n
            heap = [(0, start)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > distance[a]:
                    continue
                for e in self.edges[a]:
                    if e[1] > 0:
                        away = d + e[2] + potential[a] - potential[e[0]]
                        if distance[e[0]] is None or away < distance[e[0]]:
                            distance[e[0]], via[e[0]] = away, e
                            heapq.heappush(heap, (away, e[0]))
            if distance[end] is None:
                return total
            potential = [p + (distance[i] if distance[i] is not None else 0) for i, p in enumerate(potential)]
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = via[at][3][0]
            amount = min(e[1] for e in path)
            for e in path:
                e[1] -= amount
                e[3][1] += amount
            total += amount


def route(patterns: dict[int, int], sources: list[Source], quotas: list[int]) -> dict[tuple[int, int], int]:
    """Tokens by (pattern, source). patterns: tokens by bit mask of sources. Quotas are met as far as they can be, by as
    few repetitions as possible; the n-th use of a token costs n - 1. A pattern serves a source at most its repeats
    times over, and all its sources together at most as often as the most generous of them allows."""
    masks = sorted(patterns)
    first_source, end = 1 + len(masks), 1 + len(masks) + len(sources)
    flow = Flow(end + 1)
    flows = {}
    for i, mask in enumerate(masks):
        members = [s for s in range(len(sources)) if mask >> s & 1]
        for use in range(max((sources[s].repeats for s in members), default=0)):
            flow.add(0, 1 + i, patterns[mask], use)
        for s in members:
            flows[mask, s] = flow.add(1 + i, first_source + s, patterns[mask] * sources[s].repeats, 0)
    for s, quota in enumerate(quotas):
        flow.add(first_source + s, end, quota, 0)
    flow.run(0, end)
    return {k: e[1] for k, e in flows.items() if e[1] > 0}


def plan(patterns: dict[int, int], sources: list[Source], total: int | None = None) -> tuple[dict[tuple[int, int], int], list[int]]:
    """Flows and quotas. Without a total, it is the largest at which every source that has texts gets its share; weights
    of sources without texts (or uses) are spread over the others in proportion."""
    there = [any(mask >> s & 1 and n > 0 for mask, n in patterns.items()) and x.repeats > 0 and x.weight > 0 for s, x in enumerate(sources)]
    weight = sum(x.weight for x, t in zip(sources, there) if t)
    quotas_at = lambda n: [int(n * x.weight / weight) if t else 0 for x, t in zip(sources, there)]
    if not weight:
        return {}, [0] * len(sources)
    if total is None:
        low, high = 0, sum(n * max(sources[s].repeats for s in range(len(sources)) if mask >> s & 1) for mask, n in patterns.items()) + 1
        while high - low > 1:
            middle = (low + high) // 2
            quotas = quotas_at(middle)
            low, high = (middle, high) if sum(route(patterns, sources, quotas).values()) == sum(quotas) else (low, middle)
        total = low
    quotas = quotas_at(total)
    return route(patterns, sources, quotas), quotas


def source_label(c: Column | str) -> Column:
    """Labels that differ in letter case and outer blanks only are the same source."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def mix_sources(documents: DataFrame, targets: DataFrame, tokenizer, total: int | None = None, seed: int = 0, slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). selection: doc_id, source, uses, tokens of each document taken; shares: source,
    target_share (of all weights), quota_share (of the weights of sources with texts), documents, uses, tokens, actual_share,
    of every source in targets.

    documents: doc_id, text, source. Copies of one text are one item; where it serves a source it stands for the
    smallest doc_id of that source, so that no document is used more than its source's max_repeats times. Null, empty
    and token-less texts and documents whose source is null or has no target are not used. targets: source,
    target_share, max_repeats, a list the driver reads (at most MOST_SOURCES sources); rows with a null or no positive
    share or repeats have no quota; of rows of one label the one with the largest share, then repeats, counts. The same
    seed gives the same selection.

    A source's actual tokens differ from its flow by less than one text for each pattern that serves it. On the driver
    are only token sums by pattern: no more than occur, and with more than MOST_PATTERNS the mix is refused."""
    spark = documents.sparkSession
    listed: dict[str, Source] = {}
    labelled = targets.select(source_label("source").alias("source"), F.struct("target_share", "max_repeats").alias("t")).filter(F.col("source").isNotNull())
    for r in labelled.groupBy("source").agg(F.max("t").alias("t")).limit(MOST_SOURCES + 1).collect():
        listed[r["source"]] = Source(r["source"], max(0.0, r["t"]["target_share"] or 0.0), max(0, r["t"]["max_repeats"] or 0))
    sources = sorted(listed.values(), key=lambda s: s.name)
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    slots = slots or max(1024, 16 * default_parallelism(spark))

    index = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s.name), F.lit(i))])[source_label("source")] if sources else F.lit(None).cast("int")
    used = documents.select("doc_id", "text", index.alias("s")).filter(F.col("s").isNotNull() & (F.length("text") > 0))
    keyed = used.select(F.struct("doc_id", "s", F.unhex(F.sha2("text", 256)).alias("item")).alias("row"), "text")
    counted = encode_column(keyed, "row", "text", tokenizer, counts_only=True).filter("tokens > 0").select("row.*", "tokens")
    # One combinable aggregate: a text that a third of all documents hold is reduced before the shuffle.
    firsts = [F.min(F.when(F.col("s") == i, F.col("doc_id"))).alias(f"doc_{i}") for i in range(len(sources))]
    items = counted.groupBy("item").agg(F.max("tokens").alias("tokens"), F.expr("bit_or(shiftleft(1L, s))").alias("mask"), *firsts)
    order = F.xxhash64(F.lit(seed), F.col("item"))
    items = materialize(items.withColumn("at", order).withColumn("slot", F.pmod(F.shiftright(F.col("at"), 32), F.lit(slots)).cast("int")), "items")

    by_slot = materialize(items.groupBy("mask", "slot").agg(F.sum("tokens").alias("tokens")), "slots")
    sums = by_slot.groupBy("mask").agg(F.sum("tokens").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"texts occur in more than {MOST_PATTERNS} different sets of sources")
    patterns = {r["mask"]: r["n"] for r in sums}
    flows, quotas = plan(patterns, sources, total)

    # Stretches of each pattern's line, one source after the other.
    stretches, at = [], {}
    for (mask, s), amount in sorted(flows.items()):
        lo = at.get(mask, 0)
        stretches.append((mask, s, lo, lo + amount, patterns[mask]))
        at[mask] = lo + amount
    lines = spark.createDataFrame(stretches, "mask long, s int, lo long, hi long, length long")

    slot_start = Window.partitionBy("mask").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slot.select("mask", "slot", F.coalesce(F.sum("tokens").over(slot_start), F.lit(0)).alias("before"))
    within = Window.partitionBy("mask", "slot").orderBy("at", "item").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.withColumn("start", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, ["mask", "slot"]).withColumn("start", F.col("start") + F.col("before"))
    # At most MOST_PATTERNS x MOST_SOURCES rows, mostly of one source a pattern.
    taken = placed.join(F.broadcast(lines), "mask")
    laps = lambda upto: F.ceil((F.col(upto) - F.col("start")) / F.col("length"))
    uses = (F.greatest(laps("hi"), F.lit(0)) - F.greatest(laps("lo"), F.lit(0))).cast("int")
    doc = F.coalesce(*[F.when(F.col("s") == i, F.col(f"doc_{i}")) for i in range(len(sources))], F.lit(None).cast("long")) if sources else F.lit(None).cast("long")
    name = F.element_at(F.array(*[F.lit(s.name) for s in sources]), F.col("s") + 1) if sources else F.lit(None).cast("string")
    selection = taken.select(doc.alias("doc_id"), name.alias("source"), uses.alias("uses"), "tokens").filter("uses > 0")

    weight = sum(s.weight for s in sources)
    goal = sum(quotas)
    wanted = spark.createDataFrame([(s.name, s.weight / weight if weight else 0.0, q / goal if goal else 0.0) for s, q in zip(sources, quotas)], "source string, target_share double, quota_share double")
    sums = selection.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
    shares = wanted.join(sums, "source", "left").na.fill(0, ["documents", "uses", "tokens"])
    everything = Window.partitionBy(F.lit(0))  # one row a source
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(everything)), F.lit(0.0)))
    return selection, shares
