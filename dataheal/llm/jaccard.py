"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with equal sets of n-grams form one class; the join runs over classes. The product is
taken over the prefix of every class only: of ``n`` n-grams in one global order, two sets that are
similar enough share one of the first ``n - ceil(t n) + 1``. The place of an n-gram in that order also
bounds the size of the partners it can matter for: sets of n and m must share ``ceil(t (n + m) / (1 + t))``,
so of their first ``n`` less that, and ``m`` less that, one more is the same n-gram, and each
n-gram carries the largest such ``m``. The order puts n-grams that many
documents share last, by a table of counts of all n-grams of all documents (``SLOTS`` fixed slots,
so a bounded broadcast), which only decides the order and never the result.

Each column block of the incidence matrix is one task's work: it sums overlap counts of pairs of
classes whose sizes allow a link. Counts are added up over the blocks, pairs that cannot reach the
threshold from their sizes and count are discarded, and the rest is verified on the whole sets.

An n-gram that several classes have in their prefixes (near copies by the thousand) is not multiplied
out: it gives one row a class, and pairs only where these rows say so. Classes that no partner's size there allows are left out: most near copies that lie just beyond the threshold
have enough n-grams of their own for that. The other classes are linked to the most typical one first, then what is left to the most typical of that.
What stays in different components is compared by leaders: Jaccard distance is a metric, so members
of two stars can only be linked if the distance of their leaders allows it, and only then members
are compared. No link between different texts is lost, and a group of copies costs as many rows as
it has members. Before whole sets are fetched, a bitmap of each set (one bit by n-gram) bounds the
overlap of a pair from above: differing bits are n-grams that only one of them has.

Defined results: null and empty texts have no n-gram and are linked with nothing, so are their own
component; a text with fewer words than the width has its whole sequence as one n-gram; repeated
rows are in one component; a null id is returned, and never is the smallest; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.llm import common, native
from dataheal.session import materialise

WIDTH, PERCENT = 5, 75
SLOTS, SLICE = 1 << 21, 1 << 13
#: Documents of an n-gram up to which it is as good as a rare one in the order; classes of one beyond which it
#: is not multiplied out; prefix n-grams by block of the product. They choose plans, never results.
USUAL, COMMON, BLOCK = 64, 3, 400_000
#: 64-bit words of the bitmap of a set, at least; long sets have more, always a power of two.
BITMAP = 16
#: Slices of the count table that one task adds up at most.
FAN_IN = 256


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(common.window_hashes(common.word_hashes(words), width))


def class_of(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()))))if len(grams) else 0


def bitmap(grams: np.ndarray) -> np.ndarray:
    """One bit for each n-gram, in 1.5 to 3 bits an n-gram; half the words is the other half or-ed onto it."""
    words = max(BITMAP, 1 << int(np.ceil(np.log2(max(1, 1.5 * len(grams) / 64)))))
    bits = np.zeros(64 * words, np.uint8)
    bits[((grams >> np.uint64(20)) % np.uint64(64 * words)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def folded(bits, words):
    """A bitmap in ``words`` words, which are as many or fewer."""
    up = lambda i: F.aggregate(F.sequence(i, F.size(bits) - 1, words), F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(bits[k]))
    return F.when(F.size(bits) == words, bits).otherwise(F.transform(F.sequence(F.lit(0), words - 1), up))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """n-grams that a set of n must share with any set linked to it."""
    return -(-percent * n // 100)


def needed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def measure(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, key, cls, n) by document, and the level of every slot: 0, or higher the more common its n-grams are."""
    schema = T.StructType.fromDDL("doc_id long, key long, cls long, n long, bits array<long>, part int, slice int, counts binary")
    arrow = common.to_arrow_schema(schema)

    def batch(rows: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(rows, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(SLOTS, np.uint32)
        for b in common.chunks(batches, "text"):
            sets = [shingles(t, width) for t in common.utf8(b.column("text"))]
            slots, times = np.unique((np.concatenate(sets) >> np.uint64(40)).astype(np.int64) % SLOTS, return_counts=True)
            counts[slots] += times.astype(np.uint32)
            yield batch(b.num_rows, doc_id=b.column("doc_id"), key=b.column("key"), cls=[class_of(x) for x in sets], n=[len(x) for x in sets], bits=[bitmap(x) for x in sets])
        task = TaskContext.get().partitionId()
        filled = [(i, packed(counts[i * SLICE : (i + 1) * SLICE])) for i in range(SLOTS // SLICE) if counts[i * SLICE : (i + 1) * SLICE].any()]
        yield batch(len(filled), part=[task] * len(filled), slice=[i for i, _ in filled], counts=[c for _, c in filled])

    both = materialise(needed(docs).mapInArrow(run, schema))
    tasks = both.rdd.getNumPartitions()

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpacked(c).astype(np.uint64) for c in table.column("counts").to_pylist())
        row = {"part": [0], "slice": [table.column("slice")[0].as_py()], "counts": [packed(np.minimum(total, 2**32 - 1).astype(np.uint32))]}
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(row.items(), (pa.int32(), pa.int32(), pa.binary()))})

    slices = both.where("counts is not null").select(F.expr(f"part % {-(-tasks // FAN_IN)}").alias("part"), "slice", "counts")
    for keys in (["slice", "part"], ["slice"]):
        slices = slices.groupBy(*keys).applyInArrow(add, "part int, slice int, counts binary")
    counts = np.zeros(SLOTS, np.uint32)
    for r in slices.collect():
        counts[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = unpacked(r["counts"])
    usual = USUAL + 2 * counts.mean()
    levels = np.where(counts > usual, np.log2(np.maximum(1, counts / usual)) + 1, 0).astype(np.uint8)
    return both.where("counts is null").select("doc_id", "key", "cls", "n", "bits"), levels


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), np.uint32)


def prefix(grams: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first n-grams in the global order (level, hash), as many as a linked set must share one of; their levels; the most n-grams of a partner."""
    level = levels[(grams >> np.uint64(40)).astype(np.int64) % SLOTS]
    n = len(grams)
    order = np.argsort(level, kind="stable")[: n - int(least_overlap(n, percent)) + 1]
    return grams[order], level[order], (100 + percent) * (n - np.arange(len(order))) // percent - n


def share_of_range(most: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The largest size of a partner in one byte: where it lies between the least and the greatest that a set of n links with, rounded up."""
    low, high = percent / 100, 100 / percent
    return np.ceil((most / n - low) / max(high - low, 1e-9) * 255 - 1e-9).clip(0, 255).astype(np.uint8)


def most_of(byte: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """What :func:`share_of_range` put into a byte, never less."""
    low, high = percent / 100, 100 / percent
    return np.floor(n * (low + (high - low) * byte / 255) + 1e-6).astype(np.int64)


def incidence(docs: DataFrame, levels: np.ndarray, n_blocks: int, width: int, percent: int) -> DataFrame:
    """Prefix n-grams by column block: packed runs of one class each (``cls``, ``n``, ``size`` of the run) and their ``grams``.

    A block holds all classes of its n-grams, which 40 bits tell apart within it; a sixth byte has the largest
    partner. Common n-grams come as rows of ``common`` (gram, cls, n, share of common n-grams in millionths,
    largest partner), dealt out evenly.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    schema = T.StructType.fromDDL("block int, cls binary, n binary, size binary, grams binary, common binary")
    arrow = common.to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a class is written once by each task
        for b in common.chunks(batches, "text"):
            held, often = [np.empty((0, 4), np.int64)], [np.empty((0, 5), np.int64)]
            for text in common.utf8(b.column("text")):
                grams = shingles(text, width)
                cls = class_of(grams)
                if not len(grams) or cls in seen:
                    continue
                seen.add(cls)
                first, level, most = prefix(grams, sent.value, percent)
                rows = np.empty((len(first), 5), np.int64)
                rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4] = first.view(np.int64), cls, len(grams), share_of_range(most, len(grams), percent), most
                held.append(rows[level == 0, :4])
                if level.any():
                    rows[:, 3] = 1_000_000 * np.count_nonzero(sent.value[(grams >> np.uint64(40)).astype(np.int64) % SLOTS]) // len(grams)
                    often.append(rows[level > 0])
            rows, rest = np.concatenate(held), np.concatenate(often)
            block = (rows[:, 0].view(np.uint64) % np.uint64(n_blocks)).astype(np.int64)
            order = np.lexsort((rows[:, 1], block))
            rows, block = rows[order], block[order]
            at = ((rest[:, 0] ^ rest[:, 1]).view(np.uint64) % np.uint64(n_blocks)).astype(np.int64)
            out = {f.name: [] for f in arrow}
            for k in np.unique(np.concatenate([block, at])).tolist():
                a, z = np.searchsorted(block, [k, k + 1])
                part = rows[a:z]
                runs = np.flatnonzero(np.concatenate([[True], part[1:, 1] != part[:-1, 1]])) if len(part) else np.empty(0, np.int64)
                six = np.ascontiguousarray((part[:, 0].view(np.uint64) >> np.uint64(24)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
                six[:, 5] = part[:, 3]
                for name, value in (
                    ("cls", part[runs, 1]), ("n", part[runs, 2].astype(np.int32)), ("size", np.diff(np.concatenate([runs, [len(part)]])).astype(np.int32)),
                    ("grams", np.ascontiguousarray(six)), ("common", rest[at == k])):
                    out[name].append(value.tobytes())
                out["block"].append(k)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return needed(docs).mapInArrow(run, schema)


PRODUCT = "a long, b long, na long, nb long, overlap long, met long, gram long, share long, most long"


def product(percent: int):
    """Pairs of classes in one column block with their overlap there, and how many of its n-grams matter for sets of their sizes; common n-grams as (a, na, gram, share, most) with b null."""
    arrow = common.to_arrow_schema(T.StructType.fromDDL(PRODUCT))

    def table(rows: np.ndarray, names: str) -> pa.Table:
        cols = dict(zip(names.split(), rows.T))
        return pa.table([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(rows), f.type) for f in arrow], schema=arrow)

    def run(block: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in block.column(name).to_pylist()])
        sizes = read("size", np.int32)
        grams = np.zeros((int(sizes.sum()), 8), np.uint8)
        six = read("grams", np.uint8).reshape(-1, 6)
        grams[:, :5] = six[:, :5]
        n = np.repeat(read("n", np.int32).astype(np.int64), sizes)
        rows = np.stack([grams.view("<i8")[:, 0], np.repeat(read("cls", np.int64), sizes), n, most_of(six[:, 5], n, percent)], 1)
        hot = [read("common", np.int64).reshape(-1, 5)[:, [1, 2, 0, 3, 4]]]
        pairs = [np.empty((0, 6), np.int64)]
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
        if len(rows):
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])]
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            number = block.column("block")[0].as_py()
            for size in np.unique(sizes[sizes > 1]).tolist():
                at = starts[sizes == size]
                if size > COMMON:
                    many = rows[(at[:, None] + np.arange(size)).ravel()]
                    name = (many[:, 0] << 24) ^ number
                    hot.append(np.stack([many[:, 1], many[:, 2], name, np.zeros(len(many), np.int64), many[:, 3]], 1))
                    continue
                i, j = np.triu_indices(size, 1)
                for part in np.array_split(at, -(-len(at) * len(i) // 250_000)):
                    a, b = rows[(part[:, None] + i).ravel()], rows[(part[:, None] + j).ravel()]
                    ok = 100 * a[:, 2] >= percent * b[:, 2]
                    a, b = a[ok], b[ok]
                    met = (a[:, 2] <= b[:, 3]) & (b[:, 2] <= a[:, 3])
                    pairs.append(summed(np.stack([a[:, 1], b[:, 1], a[:, 2], b[:, 2], np.ones(len(a), np.int64), met], 1)))
        return pa.concat_tables([table(summed(np.concatenate(pairs)), "a b na nb overlap met"), table(np.concatenate(hot), "a na gram share most")])

    return run


def summed(pairs: np.ndarray) -> np.ndarray:
    """Equal pairs (a, b) as one, their last two columns added up."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(1)]))
    out = pairs[first].copy()
    out[:, 4:] = np.add.reduceat(pairs[:, 4:], first)
    return out


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """``pairs`` (a, b) with ``both``, ``na`` and ``nb``: sizes of the intersection and of the whole sets."""
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    keys = classes.join(ends, "cls", "left_semi").select("key")
    chosen = common.among(needed(docs), common.settled(keys), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text are left out before the shuffle
        for b in common.chunks(batches, "text"):
            sets = {class_of(x): x.tobytes() for x in (shingles(t, width) for t in common.utf8(b.column("text")))}
            new = [c for c in sets if c not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([sets[c] for c in new], pa.binary())], schema=common.to_arrow_schema(of_class))

    of_class = T.StructType.fromDDL("cls long, grams binary")
    sets = chosen.mapInArrow(run, of_class).dropDuplicates(["cls"])
    left, right = sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))
    schema = T.StructType.fromDDL("a long, b long, na long, nb long, both long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ga, gb = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("ga", "gb"))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(ga, gb)]
            cols = [b.column("a"), b.column("b"), *(pa.array(v, pa.int64()) for v in ([len(x) for x in ga], [len(x) for x in gb], both))]
            yield pa.RecordBatch.from_arrays(cols, schema=common.to_arrow_schema(schema))

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(count, schema)


def similar(percent: int):
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def may_link(a: str, b: str, percent: int, apart=0.0):
    """Whether classes a and b (structs with n and bits) can have a distance of 1 - percent / 100 + ``apart`` at most.

    From their sizes, and from the bits that differ: each is an n-gram that only one of them has.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = percent / 100 - apart
    x, y = F.col(f"{a}.bits"), F.col(f"{b}.bits")
    words = F.least(F.size(x), F.size(y))
    differ = F.aggregate(F.zip_with(folded(x, words), folded(y, words), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    return (F.least(n, m) >= least * F.greatest(n, m) - 1e-6) & ((1 + least) * (n + m - differ) >= 2 * least * (n + m) - 1e-6)


def screened(pairs: DataFrame, classes: DataFrame, percent: int, apart=0.0) -> DataFrame:
    """The ``pairs`` (a, b, ...) that may be linked, by their whole bitmaps."""
    x = classes.select(F.col("cls").alias("a"), F.struct("n", "bits").alias("x"))
    y = classes.select(F.col("cls").alias("b"), F.struct("n", "bits").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(may_link("x", "y", percent, apart)).drop("x", "y")


def far():
    """Jaccard distance of a verified pair."""
    return 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))


def placed_in(rows: DataFrame, home: DataFrame) -> DataFrame:
    """``rows`` of classes ``cls`` with their ``component``; ``home`` is (node, component)."""
    return rows.join(home, rows["cls"] == home["node"], "left").withColumn("component", F.coalesce("component", "cls")).drop("node")


def apart(placed: DataFrame) -> DataFrame:
    """The rows of n-grams whose classes are in several components."""
    several = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gram")
    return placed.join(several, "gram", "left_semi")


def leaders(rows: DataFrame) -> DataFrame:
    """The most typical class of each n-gram: that with the largest share of common n-grams, then of the largest number."""
    led = rows.groupBy("gram").agg(F.max(F.struct("share", "cls", "n", "most", "component")).alias("l"))
    return led.select("gram", F.col("l.cls").alias("leader"), F.col("l.n").alias("leader_n"), F.col("l.most").alias("leader_most"), F.col("l.component").alias("of"), F.col("l.share").alias("typical"))


def stars(docs: DataFrame, classes: DataFrame, hot: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b, typical, far) of classes ``a`` to leaders ``b`` of their common n-grams, in two rounds."""
    found = None
    for round_ in range(2):
        home = common.components(found.select("a", "b")) if round_ else hot.select(F.col("cls").alias("node"), F.col("cls").alias("component")).limit(0)
        rows = apart(placed_in(hot, home))
        for _ in range(round_):  # what the first leaders have not won
            rows = rows.join(leaders(rows), "gram").where("component <> of").select("gram", "share", "most", "n", "cls", "component")
        rows = common.settled(rows)
        near = rows.join(leaders(rows), "gram").where((F.col("component") != F.col("of")) & (F.col("n") <= F.col("leader_most")) & (F.col("leader_n") <= F.col("most")))
        pairs = near.groupBy(F.col("cls").alias("a"), F.col("leader").alias("b")).agg(F.max("typical").alias("typical"))
        pairs = common.settled(screened(pairs, classes, percent))
        won = common.settled(verified(docs, classes, pairs, width).where(similar(percent)).join(pairs, ["a", "b"]).select("a", "b", "typical", far().alias("far")))
        found = won if found is None else found.union(won)
    return found


def between_stars(docs: DataFrame, classes: DataFrame, hot: DataFrame, spokes: DataFrame, home: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the components of ``home`` over common n-grams; ``spokes`` are the links of :func:`stars`."""
    centre = spokes.groupBy(F.col("a").alias("member")).agg(F.max(F.struct("typical", F.col("b").alias("cls"), "far")).alias("s"))
    placed = apart(placed_in(hot, home))
    placed = common.settled(placed.join(centre, placed["cls"] == centre["member"], "left").select(
        "gram", "most", "n", "cls", "component", F.coalesce("s.cls", "cls").alias("centre"), F.coalesce("s.far", F.lit(0.0)).alias("far")))
    reach = placed.groupBy("centre").agg(F.max("far").alias("reach"))
    by_gram = placed.groupBy("gram", "centre", "component").agg(F.min("n").alias("n"), F.max("most").alias("most")).join(reach, "centre")
    left, right = (by_gram.select("gram", F.struct("centre", "component", "reach", "n", "most").alias(s)) for s in ("x", "y"))
    sizes = (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most")) & (F.col("x.component") != F.col("y.component"))
    both = F.col("x.reach") + F.col("y.reach")
    centres = left.join(right, "gram").where((F.col("x.centre") < F.col("y.centre")) & sizes)
    centres = centres.groupBy(F.col("x.centre").alias("a"), F.col("y.centre").alias("b")).agg(F.max(both).alias("reach"))
    centres = common.settled(screened(centres, classes, percent, F.col("reach")))
    measured = verified(docs, classes, centres, width).select("a", "b", "na", "nb", "both", far().alias("apart"))
    close = common.settled(centres.join(measured, ["a", "b"]).where(F.col("apart") <= 1 - percent / 100 + F.col("reach") + 1e-9))
    # of two centres the one with fewer rows comes first, so a large star's rows are met by n-gram only, not once by each pair
    size = placed.groupBy("centre").agg(F.count(F.lit(1)).alias("rows"))
    a, b = (size.select(F.col("centre").alias(c), F.col("rows").alias(f"rows_{c}")) for c in "ab")
    first = F.col("rows_a") <= F.col("rows_b")
    ordered = close.where("reach > 0").join(a, "a").join(b, "b").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("many"), "apart")
    x, y = (placed.select("gram", F.col("centre").alias(c), F.struct("cls", "component", "far", "n", "most").alias(s)) for c, s in (("few", "x"), ("many", "y")))
    members = ordered.join(x, "few").join(y, ["gram", "many"]).where(
        sizes & (F.col("apart") <= 1 - percent / 100 + F.col("x.far") + F.col("y.far") + 1e-9))
    pairs = members.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    pairs = common.settled(screened(pairs, classes, percent))
    more = verified(docs, classes, pairs, width).where(similar(percent)).select("a", "b")
    return close.where(similar(percent)).select("a", "b").union(more)


def allowed(hot: DataFrame) -> DataFrame:
    """The rows (gram, cls, n, most, ...) of common n-grams that some other class's size there allows a link."""
    least = hot.groupBy("gram").agg(F.min("n").alias("least"), F.max("most").alias("largest"))
    left = hot.join(least, "gram").where((F.col("least") <= F.col("most")) & (F.col("n") <= F.col("largest"))).drop("least", "largest")
    return left.join(left.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "gram", "left_semi")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n, least_id, group): ``key`` hashes the text, ``group`` is a class of the component (null without n-grams), ``least_id`` its smallest id."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    by_doc, levels = measure(docs, width)
    classes = common.settled(by_doc.where("n > 0").groupBy("cls", "n").agg(F.min("key").alias("key"), F.min("doc_id").alias("least_id"), F.first("bits").alias("bits")))
    total = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    matrix = incidence(docs, levels, max(1, -(-int(total) // BLOCK)), width, percent)
    multiplied = materialise(matrix.groupBy("block").applyInArrow(product(percent), PRODUCT))
    common_rows = common.settled(multiplied.where("b is null").groupBy("gram", F.col("a").alias("cls"), F.col("na").alias("n")).agg(
        F.max("share").alias("share"), F.max("most").alias("most")))
    hot = common.settled(allowed(common_rows))
    spokes = stars(docs, classes, hot, width, percent)
    home = common.components(spokes.select("a", "b"))
    # pairs of the product, unless stars join them already; what their common n-grams can add to an overlap at most
    warm = common_rows.groupBy("cls").agg(F.count(F.lit(1)).alias("more")).join(home, F.col("cls") == home["node"], "full").select(
        F.coalesce("cls", "node").alias("cls"), F.coalesce("more", F.lit(0)).alias("more"), "component")
    pairs = multiplied.where("b is not null").groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"), F.sum("met").alias("met")).where("met > 0")
    x, y = (warm.select(F.col("cls").alias(c), F.struct("more", "component").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    ends = pairs.join(x, "a", "left").join(y, "b", "left")
    rest = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    most = F.col("overlap") + F.least(F.coalesce("x.more", F.lit(0)), F.coalesce("y.more", F.lit(0))) + F.greatest(rest("na"), rest("nb"))
    enough = (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))
    parted = F.coalesce("x.component", "a") != F.coalesce("y.component", "b")
    kept = common.settled(screened(ends.where(enough & parted).select("a", "b"), classes, percent))
    links = verified(docs, classes, kept, width).where(similar(percent)).select("a", "b")
    links = common.settled(spokes.select("a", "b").union(links))
    links = links.union(between_stars(docs, classes, hot, spokes, common.components(links), width, percent))
    home = common.settled(common.components(links).join(classes.select(F.col("cls").alias("node"), "least_id"), "node"))
    least = home.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = classes.select("cls", "least_id").join(
        home.select(F.col("node").alias("cls"), "component").join(least, "component"), "cls", "left").select(
        "cls", F.coalesce("component", "cls").alias("group"), F.coalesce("component_id", "least_id").alias("least_id"))
    return by_doc.join(of_class, "cls", "left").select("doc_id", "key", "n", "least_id", "group")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: 100 * intersection >= percent * union links two."""
    return groups(docs, doc_id, text, width, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("group").isNotNull(), F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, that with the smallest id (null last); rows without n-grams all stay."""
    found = materialise(groups(docs, doc_id, text))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = found.where("group is not null").groupBy("group").agg(F.min(order).alias("first"))
    marked = found.join(first, "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")))
    gone = common.settled(marked.where(~F.col("stays")).select("doc_id", "key").distinct())
    repeated = common.settled(marked.where("stays").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    left = common.without(docs, gone, native.holds(docs, gone, doc_id, text))
    again = docs.join(repeated, native.holds(docs, repeated, doc_id, text), "left_semi").dropDuplicates([doc_id, text])
    return common.without(left, repeated, native.holds(left, repeated, doc_id, text)).union(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


def sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(1, WIDTH + 1))
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    g AS MATERIALIZED (SELECT DISTINCT doc_id, {gram} AS s FROM (SELECT *, unnest(range(len(w) - {WIDTH - 1})) AS i FROM d WHERE len(w) >= {WIDTH})
          UNION SELECT doc_id, array_to_string(w, ' ') AS s FROM d WHERE len(w) BETWEEN 1 AND {WIDTH - 1}),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
          JOIN n n1 ON n1.doc_id = a JOIN n n2 ON n2.doc_id = b WHERE 100 * c >= {PERCENT} * (n1.n + n2.n - c)),
    r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
    m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id FROM d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
