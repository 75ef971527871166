"""Problem 9: mixing sources to target weights.

Hierarchical budgeting over the tree domain - language - source.  The domain is
the last label of the source's host, a leaf is one source in one language of one
domain.

1. One aggregate gives documents and tokens of each leaf.
2. Weights are propagated through the tree: a source's target share is divided
   among its leaves by their tokens; a node weighs as much as its leaves.  The
   budget goes down in proportion to weights.  A leaf can take its tokens times
   the source's largest number of repeats; what it cannot take is shared out
   among its siblings, then, if they are full, among the siblings of the parent,
   and so on (`budgets`).  The tree has as many leaves as listed sources have
   languages, so this is done on the driver.
3. Each leaf takes as many whole epochs as fit its budget, and of one more epoch
   the token prefix of a seeded order.  The prefix is found in parallel: tokens
   are summed per leaf and hash bucket, buckets before the border are taken
   whole, and only the documents of the border's bucket are sorted.  The prefix
   ends where it comes nearest to the budget; what a leaf takes too much or too
   little is made good by the next leaf of its source.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from .tables import small_rows, table
from .tokens import token_sizes

BUCKETS = 4096  # hash buckets of a leaf's order
TOLERANCE = 0.01  # by how much a source's share may fall short for the sake of a larger mixture
ALL_TEXTS = "all texts"  # size of a mixture: that of all texts of the listed sources, each once
SEED = 20_24


def budgets(leaves: dict[tuple, tuple[float, float]], total: float) -> dict[tuple, float]:
    """Tokens each leaf gets.  `leaves` maps a path (domain, language, source) to
    its weight and its most tokens; `total` is the size of the mixture.

    A shortage is shared out in proportion to weights among siblings with room,
    level by level from the leaves to the root; what nobody can take stays
    unused.
    """
    given = dict.fromkeys(leaves, 0.0)
    weights = sum(w for w, _ in leaves.values())
    if not weights:
        return given

    def fill(paths: list[tuple], amount: float) -> float:
        """Water-filling of `amount` among leaves by weight; returns what is left."""
        open_ = [p for p in paths if leaves[p][0] > 0 and given[p] < leaves[p][1]]
        while amount > 1e-9 and open_:
            share = amount / sum(leaves[p][0] for p in open_)
            amount, still = 0.0, []
            for p in open_:
                wanted = share * leaves[p][0]
                room = leaves[p][1] - given[p]
                given[p] += min(wanted, room)
                amount += max(0.0, wanted - room)
                if wanted < room:
                    still.append(p)
            open_ = still
        return amount

    short: dict[tuple, float] = defaultdict(float)
    for p, (w, most) in leaves.items():
        target = total * w / weights
        given[p] = min(target, most)
        short[p[:-1]] += target - given[p]
    depth = max(len(p) for p in leaves)
    for level in range(depth - 1, -1, -1):
        upper: dict[tuple, float] = defaultdict(float)
        for node, amount in sorted(short.items()):
            left = fill([p for p in sorted(leaves) if p[:level] == node], amount)
            if level:
                upper[node[:-1]] += left
        short = upper
    return given


def leaf_of(source: F.Column) -> F.Column:
    return F.regexp_extract(source, r"([^.]*)$", 1)


def mixture(documents: DataFrame, weights: DataFrame, total_tokens: int | str | None = None, seed: int = SEED) -> DataFrame:
    """(source, doc_id, n_tokens, repeats): the documents of the mixture and how
    often each is used.

    `documents` has (doc_id, source, lang, text), `weights` (source,
    target_share, max_repeats).  Documents of sources that are null or not
    listed take no part; a null language is a language of its own; texts of no
    tokens are used in whole epochs only.  `total_tokens` is the size of the
    mixture, by default the largest at which every listed source that has tokens
    can come within `TOLERANCE` of its share within its repeats; with `ALL_TEXTS`
    that of all texts of the listed sources.  The share of a
    source without documents, and what a scarce source falls short, is a shortage
    of its domain.  The result depends on the seed and the ids alone, not on
    partitions.
    """
    listed = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in small_rows(weights.select("source", "target_share", "max_repeats")) if r.source}
    ours = documents.where(F.col("source").isin(list(listed)))
    sized = staged(
        token_sizes(ours, keep=("source", "lang")).where("doc_id is not null")
        .select("doc_id", "source", F.coalesce("lang", F.lit("und")).alias("lang"), leaf_of(F.col("source")).alias("domain"), "n_tokens",
                F.xxhash64(F.lit(seed), F.col("doc_id")).alias("place"))
        .withColumn("bucket", F.pmod(F.shiftright("place", 40), F.lit(BUCKETS)).cast("int")), "sized"
    )
    leaf = ["domain", "lang", "source"]
    per_bucket = staged(sized.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "buckets")
    totals = {(r.domain, r.lang, r.source): int(r.tokens) for r in small_rows(per_bucket.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")))}
    of_source: dict[str, int] = defaultdict(int)
    for (_, _, source), tokens in totals.items():
        of_source[source] += tokens
    everything = sum(share for share, _ in listed.values())
    if total_tokens == ALL_TEXTS:
        total_tokens = sum(of_source.values())
    elif total_tokens is None:
        reach = [
            of_source[name] * most / (share / everything - TOLERANCE)
            for name, (share, most) in listed.items() if of_source[name] and most > 0 and share / everything > TOLERANCE
        ]
        total_tokens = min([*reach, sum(of_source[name] * most for name, (_, most) in listed.items())])
    # a leaf whose texts are all longer than its part of the budget leaves it to the other languages of its source
    part = {p: total_tokens * listed[p[2]][0] / everything * t / of_source[p[2]] for p, t in totals.items() if t}
    parts = F.broadcast(sized.sparkSession.createDataFrame([(*p, b) for p, b in part.items()], "domain string, lang string, source string, part double"))
    fits = {(r.domain, r.lang, r.source): float(r.tokens or 0) for r in small_rows(sized.join(parts, leaf).groupBy(*leaf).agg(F.sum(F.when(F.col("n_tokens") <= F.col("part"), F.col("n_tokens"))).alias("tokens")))}
    leaves: dict[tuple, tuple[float, float]] = {}
    for name, (share, most) in listed.items():
        own = {p: (float(totals[p]), totals[p] * most if part[p] >= totals[p] else fits[p]) for p in part if p[2] == name}
        aimed = budgets(own, sum(part[p] for p in own)) if own else {}
        placed_part = sum(aimed.values())
        for p in own:
            weight = share * (aimed[p] / placed_part if placed_part else totals[p] / of_source[name])
            leaves[p] = (weight, float(totals[p] * most))
        if not own and share > 0:
            leaves[name.rpartition(".")[2], "und", name] = (share, 0.0)
    given = {p: b for p, b in budgets(leaves, float(total_tokens)).items() if p in totals}
    plan = [(*p, int(b // totals[p]) if b else 0, float(b - (b // totals[p]) * totals[p])) for p, b in given.items()]
    spark = documents.sparkSession
    planned = F.broadcast(spark.createDataFrame(plan, "domain string, lang string, source string, epochs long, rest double"))  # one row a leaf
    ordered = Window.partitionBy(*leaf).orderBy("bucket")
    whole_leaf = Window.partitionBy(*leaf)
    borders = per_bucket.join(planned, leaf).withColumn("before", F.sum("tokens").over(ordered) - F.col("tokens"))
    # the bucket in which the prefix ends: the last one that begins before its end
    borders = borders.withColumn("start", F.max(F.when(F.col("before") < F.col("rest"), F.col("before"))).over(whole_leaf)).withColumn(
        "state", F.when(F.col("start").isNull() | (F.col("before") > F.col("start")), "out").when(F.col("before") < F.col("start"), "in").when(F.col("before") < F.col("rest"), "border").otherwise("out")
    )
    placed = sized.join(borders.select(*leaf, "bucket", "epochs", "rest", "start", "state"), [*leaf, "bucket"])
    columns = ["source", "doc_id", "n_tokens", "repeats"]
    whole = placed.where("state != 'border'").withColumn("repeats", F.col("epochs") + F.when(F.col("state") == "in", 1).otherwise(0)).select(*columns)
    border = placed.where("state = 'border'").select(*leaf, "doc_id", "n_tokens", "place", "epochs", (F.col("rest") - F.col("start")).alias("rest"))
    # one bucket of each leaf of a source: a few documents
    chosen = border.groupBy("source").applyInArrow(_prefix, "source string, doc_id long, n_tokens long, repeats long")
    return whole.unionByName(chosen).where("repeats > 0")


def _prefix(border: pa.Table) -> pa.Table:
    """Prefixes of the documents at the borders of a source's leaves, in seeded
    order, each ending where its tokens come nearest to what is left of the
    budget and of the leaves before."""
    border = border.sort_by([("domain", "ascending"), ("lang", "ascending"), ("place", "ascending"), ("doc_id", "ascending")])
    sizes = border.column("n_tokens").to_numpy()
    rooms = border.column("rest").to_numpy()
    leaves = list(zip(border.column("domain").to_pylist(), border.column("lang").to_pylist()))
    more = np.zeros(len(sizes), dtype=np.int64)
    carried = 0.0
    start = 0
    while start < len(leaves):
        end = start
        while end < len(leaves) and leaves[end] == leaves[start]:
            end += 1
        wanted = rooms[start] + carried
        sums = np.concatenate([[0], np.cumsum(sizes[start:end])])
        taken = int(np.argmin(np.abs(sums - wanted)))
        more[start : start + taken] = sizes[start : start + taken] > 0
        carried = wanted - sums[taken]
        start = end
    repeats = border.column("epochs").to_numpy() + more
    return pa.table({"source": border.column("source"), "doc_id": border.column("doc_id"), "n_tokens": border.column("n_tokens"), "repeats": pa.array(repeats, pa.int64())})


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Target and actual share of each listed source, with its documents, tokens
    and most repeats; sources without documents have an actual share of 0."""
    by_source = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    joined = weights.select("source", "target_share", "max_repeats").join(by_source, "source", "left").withColumn("all_tokens", by_source.agg(F.sum("tokens")).scalar())
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
    )


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "source_weights")
    return shares(staged(p9_mixture(spark, sf_dir), "mixture"), weights)


def p9_full_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as all texts of the listed sources together: scarce
    sources are repeated up to their cap, and what they then fall short goes to
    their siblings, then to the rest of the tree."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"), ALL_TEXTS)


def p9_full_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(staged(p9_full_mixture(spark, sf_dir), "mixture"), table(spark, sf_dir, "source_weights"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_full_mixture": p9_full_mixture, "p9_full_shares": p9_full_shares}
SQL: dict[str, str] = {}
