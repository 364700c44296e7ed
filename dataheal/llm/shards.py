"""Resharding by minimum-cost flow.

From the bytes in the old shards and equal capacities of the new ones, a minimum-cost flow decides
how many bytes go from each old shard to each new one so that the fewest bytes move. Old shards are
cut into blocks by a hash of the id, blocks into runs of documents; each document goes where the
flow sends its middle byte. Only shards whose content changes are rewritten.

The law is ``bytes``. Large documents, of which there can only be few, are placed first: longest
first, each where the flow has most room left for its old shard. The flow of the small ones then
fills all new shards to one level, so sizes differ by a small document at each of a shard's cuts.
Running sums are taken within blocks of about ``BLOCK_ROWS`` rows and then over the small table of
block sums, so neither an old shard with a third of all rows nor a new one is one task's work.

Defined results: a null text has size 8; null ids, equal ids and repeated rows are each placed once;
an empty table gives no rows; ``reshard`` keeps other columns, and its own are chosen so that they clash
with none.
"""

from __future__ import annotations

import heapq
from collections import Counter, deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataheal.llm import common
from dataheal.session import local_frame, materialise

BLOCK_ROWS = 20_000
#: Bytes that a document takes besides its text.
OVERHEAD = 8
#: A document is large if it takes more than this share of a new shard; so few can be.
LARGE = 0.001


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Units from each old to each new shard, all placed, at least cost: staying (i to i) is free, a move costs 1 a unit.

    Successive shortest augmenting paths over the bipartite graph; the graph is as small as the
    lists of shards.
    """
    n_old, n_new = len(supply), len(capacity)
    source, sink = n_old + n_new, n_old + n_new + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, left, cost = [], [], []

    def edge(a: int, b: int, units: int, price: int) -> None:
        for u, v, c, p in ((a, b, units, price), (b, a, 0, -price)):
            graph[u].append(len(to))
            to.append(v)
            left.append(c)
            cost.append(p)

    moves = {}
    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(n_new):
            moves[len(to)] = (i, j)
            edge(i, n_old + j, s, int(i != j))
    for j, c in enumerate(capacity):
        edge(n_old + j, sink, c, 0)
    while True:
        far, came = [None] * (sink + 1), [-1] * (sink + 1)
        far[source], queue, waits = 0, deque([source]), [False] * (sink + 1)
        while queue:  # Bellman-Ford with a queue: residual edges have negative costs
            u = queue.popleft()
            waits[u] = False
            for e in graph[u]:
                v = to[e]
                if left[e] > 0 and (far[v] is None or far[u] + cost[e] < far[v]):
                    far[v], came[v] = far[u] + cost[e], e
                    if not waits[v]:
                        waits[v] = True
                        queue.append(v)
        if far[sink] is None:
            break
        units, v = None, sink
        while v != source:
            units = left[came[v]] if units is None else min(units, left[came[v]])
            v = to[came[v] ^ 1]
        v = sink
        while v != source:
            left[came[v]] -= units
            left[came[v] ^ 1] += units
            v = to[came[v] ^ 1]
    return {ij: left[e ^ 1] for e, ij in moves.items() if left[e ^ 1] > 0}


def capacities(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def place_large(sizes: list[tuple[int, int, int]], flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (old, size, shard, first, last) of the equally long large documents (old, size, number) of each old shard."""
    room: dict[int, list[tuple[int, int]]] = {}
    for (i, j), units in flow.items():
        heapq.heappush(room.setdefault(i, []), (-units, j))
    runs = []
    for i, size, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        to = Counter()
        for _ in range(n):
            left, j = room[i][0]
            heapq.heapreplace(room[i], (left + size, j))
            to[j] += 1
        at = 0
        for j in sorted(to, key=lambda j: (j != i, j)):
            runs.append((i, size, j, at, at + to[j]))
            at += to[j]
    return runs


def levelled(held: list[int], more: int) -> list[int]:
    """How much of ``more`` each shard takes so that all reach one level, as far as what they hold allows."""
    order = sorted(range(len(held)), key=lambda j: held[j])
    for n in range(len(held), 0, -1):
        level, rest = divmod(more + sum(held[j] for j in order[:n]), n)
        if level >= held[order[n - 1]]:
            out = [0] * len(held)
            for k, j in enumerate(order[:n]):
                out[j] = level + (k < rest) - held[j]
            return out
    return [0] * len(held)


def assign(rows: DataFrame, n_new: int) -> DataFrame:
    """``rows`` (id, size, digest, old) with ``shard`` and ``slot``; old shards are 0 to their number - 1."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") > LARGE * total / n_new
    # at most n_new / LARGE different sizes are large, and as many old shards as there are
    by_size = rows.groupBy("old", F.when(large, F.col("size")).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    n_old = max((r["old"] for r in by_size), default=-1) + 1
    supply, small, counts = [0] * n_old, [0] * n_old, [0] * n_old
    for r in by_size:
        supply[r["old"]] += r["bytes"]
        if r["size"] is None:
            small[r["old"]], counts[r["old"]] = r["bytes"], r["n"]
    runs = place_large([(r["old"], r["size"], r["n"]) for r in by_size if r["size"] is not None], min_cost_flow(supply, capacities(total, n_new)))
    held = [0] * n_new
    for _, size, j, first, last in runs:
        held[j] += size * (last - first)
    flow = min_cost_flow(small, levelled(held, sum(small)))
    # the small documents of an old shard: the bytes that stay, then those for each new shard in turn
    cuts = []
    for i in range(n_old):
        at = 0
        for j in sorted((j for (k, j) in flow if k == i), key=lambda j: (j != i, j)):
            cuts.append((i, j, at, at + flow[i, j]))
            at += flow[i, j]
    mixed = rows.withColumn("mixed", F.xxhash64("id", "digest", "size"))
    key = ("mixed", "id", "digest", "size")

    of_runs = local_frame(spark, runs, "old int, size long, shard int, first long, last long")
    k = F.row_number().over(W.partitionBy("old", "size").orderBy(*key)) - 1
    big = mixed.where(large).withColumn("k", k).join(F.broadcast(of_runs), ["old", "size"]).where(
        (F.col("k") >= F.col("first")) & (F.col("k") < F.col("last"))).withColumn("block", F.lit(-1))

    plan = local_frame(spark, cuts, "old int, shard int, first long, last long")
    blocks = local_frame(spark, [(i, max(1, -(-n // BLOCK_ROWS))) for i, n in enumerate(counts)], "old int, blocks int")
    dealt = mixed.where(~large).join(F.broadcast(blocks), "old").withColumn("block", F.pmod("mixed", "blocks").cast("int"))
    order = W.partitionBy("old", "block").orderBy(*key)
    inner = dealt.withColumn("inner", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    sums = rows_before(dealt.groupBy("old", "block").agg(F.sum("size").alias("amount")), ["old"], ["block"], "before")
    middle = F.col("before") + F.col("inner") + F.expr("size div 2")
    cut = inner.join(sums, ["old", "block"]).withColumn("middle", middle).join(F.broadcast(plan), "old").where(
        (F.col("middle") >= F.col("first")) & (F.col("middle") < F.col("last")))

    cols = ("id", "size", "digest", "old", "shard", "block", "mixed")
    # written once: slots number the rows of the very same assignment
    placed = materialise(big.select(*cols).union(cut.select(*cols)))
    before = rows_before(placed.groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("amount")), ["shard"], ["old", "block"], "earlier")
    rank = F.row_number().over(W.partitionBy("shard", "old", "block").orderBy(*key)) - 1
    return placed.withColumn("rank", rank).join(before, ["shard", "old", "block"]).withColumn("slot", F.col("earlier") + F.col("rank"))


def rows_before(sums: DataFrame, of: list[str], order: list[str], name: str) -> DataFrame:
    """Sum of ``amount`` over the blocks before each one; a row per ``BLOCK_ROWS`` rows of data."""
    along = W.partitionBy(*of).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return sums.withColumn(name, (F.sum("amount").over(along) - F.col("amount")).cast("long")).drop("amount")


def old_shard(place: Column, n: int) -> Column:
    """The shard that a name had: its hash; null is a name as well."""
    return F.pmod(F.crc32(F.coalesce(place.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def shard(docs: DataFrame, n_new: int = 24, n_old: int = 16, doc_id: str = "doc_id", text: str = "text", place: str = "source") -> DataFrame:
    """Placement of every document when ``n_old`` shards by hash of ``place`` become ``n_new`` of equal bytes."""
    rows = docs.select(
        F.col(doc_id).alias("id"), size_of(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"), old_shard(F.col(place), n_old).alias("old"))
    return assign(rows, n_new).select(
        F.col("id").alias("doc_id"), "size", F.col("digest").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def changed(placement: DataFrame) -> list[int]:
    """New shards whose files must be rewritten: those that gain or lose a document (as many as there are shards)."""
    moved = placement.where("shard <> old_shard")
    return sorted(r[0] for r in moved.select(F.explode(F.array("shard", "old_shard"))).distinct().collect())


def reshard(docs: DataFrame, placement: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """Write the documents of every changed shard to ``path``/shard=N in slot order; returns those shards.

    Repeated rows are matched to their placements one by one, by their number among their equals.
    """
    affected = changed(placement)
    digest = F.crc32(F.coalesce(docs[text], F.lit("")).cast("binary"))
    equals = W.partitionBy("_id", "_digest", "_size")
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[doc_id].alias("_id"), digest.alias("_digest"), size_of(docs[text]).alias("_size"))
    right = placement.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_digest"), F.col("size").alias("_size"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    left = left.withColumn("_k", F.row_number().over(equals.orderBy(F.xxhash64("_row"))))
    right = right.withColumn("_k", F.row_number().over(equals.orderBy("_shard", "_slot")))
    same = left["_id"].eqNullSafe(right["_id"])
    for c in ("_digest", "_size", "_k"):
        same = same & (left[c] == right[c])
    rows = left.join(right.where(F.col("_shard").isin(affected)), same).select(F.col("_shard").alias("shard"), "_slot", "_row")
    n = max(1, len(affected))
    rows.repartitionByRange(4 * n, "shard", "_slot").sortWithinPartitions("shard", "_slot").select("shard", F.col("_slot").alias("slot"), F.col("_row").alias("row")).write.mode(
        "overwrite").partitionBy("shard").parquet(path)
    return affected


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
