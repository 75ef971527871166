"""Problem 8: filling containers of fixed capacity with texts.

Large-item matching on a histogram.  Sizes are whole numbers up to the capacity,
so the packing is decided on the histogram of sizes, whose length the capacity
bounds, not on the documents:

1. Texts are sized in tokens; a text larger than the capacity is cut into full
   containers and a rest, the only split there is.
2. Pieces above one third of the capacity are large: at most two of them share a
   container.  From the largest down, each is matched with the largest other one
   that still fits.
3. The smaller pieces, from the largest down, go to the containers with the
   smallest sufficient gap (best fit), then to new containers.

Equal steps are taken for whole runs of equal pieces and containers at once.  The
plan is a table of runs: the pieces of one size with ranks from a to b go to the
containers from c on, m to each.  Ranks within a size are numbered in parallel:
row numbers within salted parts of a size, plus the counts of the parts before.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from .tables import slices, small_rows, table
from .tokens import token_sizes

SALTS, SALT_ROWS = 64, 2_000_000  # parts in which the pieces of one size are numbered, at least; pieces a part from which there are more
LARGEST_CAPACITY = 1_000_000  # bounds the histogram and the plan


@dataclass
class Plan:
    """Runs of the packing of one capacity: per size, ascending first ranks with
    the first container and the pieces a container."""

    containers: int = 0
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    taken: dict[int, int] = field(default_factory=dict)

    def place(self, size: int, pieces: int, first: int, each: int) -> None:
        rank = self.taken.get(size, 0)
        self.runs.setdefault(size, []).append((rank, first, each))
        self.taken[size] = rank + pieces


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """Packing of `histogram` (size -> pieces, sizes from 1 to `capacity`)."""
    plan = Plan()
    left = {s: n for s, n in histogram.items() if n > 0}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of containers (first, count)

    def open_run(count: int, gap: int) -> int:
        first = plan.containers
        plan.containers += count
        if gap:
            gaps.setdefault(gap, []).append((first, count))
        return first

    # large pieces, at most two a container
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        n = left[size]
        at = bisect.bisect_right(large, capacity - size) - 1
        if at < 0:
            plan.place(size, n, open_run(n, capacity - size), 1)
            left[size] = 0
        else:
            partner = large[at]
            pairs = n // 2 if partner == size else min(n, left[partner])
            if partner == size and not pairs:
                # a single piece left: match it with the next size below, or leave it alone
                partner = large[at - 1] if at else None
                pairs = min(n, left[partner]) if partner else 0
            if pairs and partner:
                first = open_run(pairs, capacity - size - partner)
                plan.place(size, pairs, first, 1)
                plan.place(partner, pairs, first, 1)
                left[size] -= pairs
                left[partner] -= pairs
                if not left[partner] and partner != size:
                    large.remove(partner)
            else:
                plan.place(size, n, open_run(n, capacity - size), 1)
                left[size] = 0
        if not left[size]:
            large.remove(size)
    # smaller pieces, best fit
    order = sorted(gaps)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        at = bisect.bisect_left(order, size)
        while n and at < len(order):
            gap = order[at]
            each = gap // size
            runs = gaps[gap]
            while n and runs:
                first, count = runs.pop()
                full = min(count, n // each)
                if full:
                    plan.place(size, full * each, first, each)
                    n -= full * each
                    _give(gaps, order, gap - each * size, first, full)
                rest = count - full
                if rest and n:
                    # fewer pieces than fill one more container
                    plan.place(size, n, first + full, n)
                    _give(gaps, order, gap - n * size, first + full, 1)
                    n, full, rest = 0, full + 1, rest - 1
                if rest:
                    runs.append((first + full, rest))
                at = bisect.bisect_left(order, gap)
            if not runs:
                del gaps[gap]
                order.remove(gap)
            at = bisect.bisect_left(order, size)
        if n:
            each = capacity // size
            full, rest = divmod(n, each)
            if full:
                first = plan.containers
                plan.containers += full
                plan.place(size, full * each, first, each)
                _give(gaps, order, capacity - each * size, first, full)
            if rest:
                first = plan.containers
                plan.containers += 1
                plan.place(size, rest, first, rest)
                _give(gaps, order, capacity - rest * size, first, 1)
    return plan


def _give(gaps: dict, order: list, gap: int, first: int, count: int) -> None:
    if gap:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((first, count))


def pieces(sizes: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, doc_id, part, start_token, size): each text for each capacity,
    cut only where it is larger.  Texts of no tokens give one piece of size 0."""
    each = sizes.where("doc_id is not null").withColumn("capacity", F.explode(F.array(*[F.lit(c).cast("long") for c in capacities])))
    parts = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)).cast("long")
    return (
        each.select("capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"))
        .select("capacity", "doc_id", "part", (F.col("part") * F.col("capacity")).alias("start_token"), F.least("capacity", F.col("n_tokens") - F.col("part") * F.col("capacity")).alias("size"))
    )


PACKED = "capacity long, container long, doc_id long, part long, start_token long, size long"


def pack(sizes: DataFrame, capacities: list[int]) -> DataFrame:
    """Containers for `sizes` (doc_id, n_tokens), for each capacity:
    (capacity, container, doc_id, part, start_token, size).

    Every piece is in exactly one container, no container holds more than its
    capacity, and only texts above the capacity have several parts.  Texts of no
    tokens are spread over the containers.  Rows with a null id are left out;
    repeated rows are packed as often as they occur.
    """
    if any(not 1 <= c <= LARGEST_CAPACITY for c in capacities):
        raise ValueError(f"capacities must lie between 1 and {LARGEST_CAPACITY}")
    capacities = sorted(set(capacities))
    sizes = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    if not capacities:
        return sizes.sparkSession.createDataFrame([], PACKED)
    cut = staged(pieces(sizes, capacities), "pieces")
    salts = max(SALTS, cut.count() // SALT_ROWS)
    items = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    counts = staged(items.groupBy("capacity", "size", "salt").agg(F.count("*").alias("n")), "piece-counts")
    histogram: dict[int, dict[int, int]] = {c: {} for c in capacities}
    for r in counts.groupBy("capacity", "size").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        histogram[r.capacity][r.size] = r.n
    plans = {c: plan_packing({s: n for s, n in h.items() if s}, c) for c, h in histogram.items()}
    before = F.sum("n").over(Window.partitionBy("capacity", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("capacity", "size", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("capacity", "size", "salt").orderBy("doc_id", "part")) - 1
    ranked = items.withColumn("number", number).join(offsets, ["capacity", "size", "salt"]).select("capacity", "doc_id", "part", "start_token", "size", (F.col("offset") + F.col("number")).alias("rank"))
    shared = items.sparkSession.sparkContext.broadcast({c: (p.containers, {s: tuple(np.array(x, dtype=np.int64) for x in zip(*runs)) for s, runs in p.runs.items()}) for c, p in plans.items()})
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PACKED.split(", ")])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            capacity, doc_id, part, start, size, rank = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            container = np.zeros(len(rank), dtype=np.int64)
            by = np.lexsort((size, capacity))
            edges = np.flatnonzero(np.diff(capacity[by]) | np.diff(size[by])) + 1
            for rows in np.split(by, edges):
                if not len(rows):
                    continue
                containers, runs = shared.value[int(capacity[rows[0]])]
                s = int(size[rows[0]])
                if s == 0:
                    container[rows] = rank[rows] % max(1, containers)
                    continue
                begins, firsts, eaches = runs[s]
                run = np.searchsorted(begins, rank[rows], side="right") - 1
                container[rows] = firsts[run] + (rank[rows] - begins[run]) // eaches[run]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (capacity, container, doc_id, part, start, size)], schema=schema)

    return ranked.mapInArrow(assign, PACKED)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacities = [int(r.capacity_tokens) for r in small_rows(table(spark, sf_dir, "container_sizes").select("capacity_tokens")) if r.capacity_tokens]
    return pack(token_sizes(table(spark, sf_dir, "documents")), capacities)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and fill of each capacity, and the least number of
    containers any packing needs by volume."""
    each = _packed(spark, sf_dir).groupBy("capacity", "container").agg(F.sum("size").alias("tokens"), F.count("*").alias("texts"))
    return each.groupBy("capacity").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        (F.sum("tokens") / (F.count("*") * F.col("capacity"))).alias("fill"), F.ceil(F.sum("tokens") / F.col("capacity")).alias("least_containers"),
    )


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
