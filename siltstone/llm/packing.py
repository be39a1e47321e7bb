"""Filling containers of fixed capacity with whole documents."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 2048
#: Context sizes; an item belongs to the smallest that holds it. The largest is the capacity.
TIERS = (256, 512, 1024, 2048)
#: Containers that one training step takes.
STEP_CONTAINERS = 8
#: Items of one length are ranked in parts: so many, or one for so many items if that is more.
RANK_PARTS, ITEMS_A_PART = 1024, 100_000


@dataclass
class Group:
    """``n`` containers of context size ``tier`` with the same content: ``pattern`` lists (length, items)."""

    n: int
    gap: int
    tier: int
    pattern: list[tuple[int, int]] = field(default_factory=list)

    def with_items(self, n: int, length: int, items: int) -> Group:
        return Group(n, self.gap - length * items, self.tier, [*self.pattern, (length, items)])


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    """The smallest context size that holds an item."""
    return min(t for t in tiers if t >= length)


def pack_tier(lengths: dict[int, int], tier: int, capacity: int) -> list[Group]:
    """Containers of one tier's own items: longest first, each in the tightest gap of these containers or in a new one."""
    by_gap: dict[int, list[Group]] = {}
    gaps: list[int] = []

    def put(g: Group) -> None:
        if g.gap not in by_gap:
            by_gap[g.gap] = []
            insort(gaps, g.gap)
        by_gap[g.gap].append(g)

    for length in sorted(lengths, reverse=True):
        left, filled = lengths[length], []
        while left and (i := bisect_left(gaps, length)) < len(gaps):
            gap = gaps[i]
            group = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(i)
            each = min(gap // length, left)
            take = min(group.n, left // each)
            if take < group.n:
                put(Group(group.n - take, gap, tier, group.pattern))
            filled.append(group.with_items(take, length, each))
            left -= take * each
        each = capacity // length
        if left >= each:
            filled.append(Group(left // each, capacity, tier).with_items(left // each, length, each))
        if left % each:
            filled.append(Group(1, capacity, tier).with_items(1, length, left % each))
        for g in filled:
            put(g)
    return [g for gap in gaps for g in by_gap[gap]]


def fill_gaps(groups: list[Group], shorter: dict[int, int]) -> list[Group]:
    """Fill the gaps of packed containers with ``shorter`` items, which are taken out of it.

    The tightest gaps come first; each takes the longest item that fits, again
    and again, so the shortest items are left for the remainders.
    """
    lengths = sorted(shorter)
    out: list[Group] = []
    todo = sorted(groups, key=lambda g: (-g.gap, g.pattern))
    while todo:
        g = todo.pop()
        i = bisect_right(lengths, g.gap) - 1
        if i < 0:
            out.append(g)
            continue
        length = lengths[i]
        each = max(1, min(g.gap // length, shorter[length] // g.n))
        take = min(g.n, shorter[length] // each)
        if take < g.n:
            todo.append(Group(g.n - take, g.gap, g.tier, g.pattern))
        todo.append(g.with_items(take, length, each))
        shorter[length] -= take * each
        if not shorter[length]:
            del shorter[length]
            lengths.pop(i)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[Group]:
    """How many containers of which content hold items of the given lengths.

    Every item belongs to the tier of the smallest context size that holds it.
    Tier by tier, the longest first: the tier is packed by itself, only its own
    items in its containers; then the gaps that are left are filled from the
    shorter tiers, and what those keep is packed in its turn. Containers of equal
    content are one group, so the work and the plan depend on the number of
    different lengths (at most ``capacity``), not of items. Lengths outside
    1..capacity are an error, as are tiers whose largest is not the capacity.
    """
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("an item is empty or longer than a container")
    if not tiers or max(tiers) != capacity:
        raise ValueError("the largest tier has to be the capacity")
    left = {k: v for k, v in histogram.items() if v}
    out: list[Group] = []
    for tier in sorted(tiers, reverse=True):
        own = {x: left.pop(x) for x in list(left) if tier_of(x, tiers) == tier}
        out += fill_gaps(pack_tier(own, tier, capacity), left)
    return out


def placements(groups: list[Group]) -> list[tuple]:
    """Rows that send the r-th item of a length to its place: ``length, r0, r1, each, first, at, context``.

    Containers are numbered tier by tier and, within one, by falling cost (sum of
    squared item lengths, the attention work); dealing them out to the steps back
    and forth in that order gives each step its share of every tier and balances
    the work.
    """
    groups = sorted(groups, key=lambda g: (-g.tier, -sum(x * x * k for x, k in g.pattern), g.gap, g.pattern))
    rank: dict[int, int] = {}
    out, first = [], 0
    for g in groups:
        at = 0
        for length, each in g.pattern:
            r = rank.get(length, 0)
            out.append((length, r, r + g.n * each, each, first, at, g.tier))
            rank[length] = r + g.n * each
            at += length * each
        first += g.n
    return out


def pieces(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, n_tokens``: a document, or the pieces of one beyond the capacity.

    All pieces but the last are full. A document without tokens is one piece of
    0. Repeated rows are separate documents.
    """
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0))
    cut = sized.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n_tokens"))


def pack(items: DataFrame, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """``doc_id, piece, n_tokens, tier, context, container, start, step_group`` of each item.

    ``tier`` is the item's own, ``context`` that of the container it lies in.

    ``items``: columns of :func:`pieces`, read twice, so best a written table.
    Only the histogram of lengths (at most ``capacity`` rows) goes to the driver
    and only the placement rows (bounded by ``capacity`` as well) come back by
    broadcast. Items of one length are ranked in hash parts whose counts are then
    summed up, so a length that a third of the items share is no single task.
    Items without tokens need no space: all but the first three columns are null.
    """
    spark = items.sparkSession
    parts = max(RANK_PARTS, items.count() // ITEMS_A_PART)
    base = items.select("doc_id", "piece", "n_tokens", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int").alias("part"))
    counts = base.filter("n_tokens > 0").groupBy("n_tokens", "part").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most `capacity` rows
    rows = placements(plan(histogram, capacity, tiers))
    n_containers = sum((stop - start) // each for _, start, stop, each, _, at, _ in rows if at == 0)
    n_steps = max(1, -(-n_containers // step_containers))
    table = spark.createDataFrame(rows, "n_tokens long, r0 long, r1 long, each long, first long, at long, context int")
    before = W.partitionBy("n_tokens").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = W.partitionBy("n_tokens", "part").orderBy("doc_id", "piece")
    ranked = (
        base.filter("n_tokens > 0")
        .withColumn("i", F.row_number().over(inside) - 1)
        .join(offsets, ["n_tokens", "part"])
        .withColumn("r", F.col("offset") + F.col("i"))
    )
    k = F.col("r") - F.col("r0")
    tier = F.coalesce(*[F.when(F.col("n_tokens") <= t, t) for t in sorted(tiers)])
    turn, place = F.floor(F.col("container") / n_steps), F.col("container") % n_steps
    placed = (
        ranked.join(F.broadcast(table), "n_tokens")
        .filter("r >= r0 and r < r1")
        .withColumn("container", F.col("first") + F.floor(k / F.col("each")))
        .withColumn("start", F.col("at") + (k % F.col("each")) * F.col("n_tokens"))
        .withColumn("step_group", F.when(turn % 2 == 0, place).otherwise(n_steps - 1 - place))
        .withColumn("tier", tier)
    )
    out = ["doc_id", "piece", "n_tokens", "tier", "context", "container", "start", "step_group"]
    none = F.lit(None).cast("long")
    empty = base.filter("n_tokens <= 0").select("doc_id", "piece", "n_tokens", none.cast("int").alias("tier"), none.cast("int").alias("context"), none.alias("container"), none.alias("start"), none.alias("step_group"))
    return placed.select(*out).unionByName(empty)


def violations(sized: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rule, n_checked, n_broken`` of a packing, from the placed items alone.

    'capacity': containers filled beyond it; 'contiguity': items that do not begin
    where the one before ends, and containers that do not begin at 0; 'coverage':
    documents whose pieces do not add up to their tokens; 'whole': documents in
    several pieces that would fit in one container; 'numbering': containers
    missing between the first and the last.
    """
    held = packed.filter("container is not null")
    by_place = W.partitionBy("container").orderBy("start", "n_tokens")
    steps = held.withColumn("end_before", F.coalesce(F.lag(F.col("start") + F.col("n_tokens")).over(by_place), F.lit(0)))
    per = held.groupBy("container").agg(F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("used"))
    want = sized.groupBy("doc_id").agg(F.sum(F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0))).alias("want"), F.count("*").alias("copies"))
    got = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("n_pieces"))
    docs = want.join(got, "doc_id", "full")
    broken = lambda df, rule, bad: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n_checked"), F.count(F.when(bad, 1)).alias("n_broken"))
    return (
        broken(per, "capacity", (F.col("end") > capacity) | (F.col("used") > capacity))
        .unionByName(broken(steps, "contiguity", F.col("start") != F.col("end_before")))
        .unionByName(broken(docs, "coverage", ~F.col("want").eqNullSafe(F.col("got"))))
        .unionByName(broken(docs.filter(F.col("want") <= capacity), "whole", F.col("n_pieces") > F.col("copies")))
        .unionByName(per.agg(F.lit("numbering").alias("rule"), F.count("*").alias("n_checked"), F.coalesce(F.max("container") + 1 - F.count("*"), F.lit(0)).alias("n_broken")))
    )


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, containers, unused share, and the least and most work and long containers of a step."""
    per = packed.filter("container is not null").groupBy("container", "context", "step_group").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("used"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"))
    step = per.groupBy("step_group").agg(F.sum("n").alias("n"), F.count("*").alias("c"), F.sum("used").alias("used"), F.sum("cost").alias("cost"), F.count(F.when(F.col("context") == capacity, 1)).alias("long"))
    return step.agg(
        F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"), F.sum("c").alias("n_containers"),
        (1 - F.sum("used") / (F.sum("c") * capacity)).alias("unused_share"), F.min("cost").alias("least_step_cost"), F.max("cost").alias("most_step_cost"),
        F.min("long").alias("least_long_containers"), F.max("long").alias("most_long_containers"),
    )
