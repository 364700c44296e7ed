"""Keys that contradict themselves: within a dataset, and between datasets that share them.

``entity_mismatch`` finds keys whose supporting columns differ from dataset to dataset, ``ghost_joins``
finds pairs of datasets whose keys match while what they say about the keys does not, and
``duplicate_keys`` finds keys that several rows of one dataset hold.

Null is a value like any other here: a missing cell contradicts a present one. Rows without a key are
left out. Cells are compared as the text a reviewer sees, so ``3`` and ``3`` agree whatever their column types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.functions.numbers import round_even
from dataheal.operators.joins import detect_join_pairs
from dataheal.operators.profile import union_all
from dataheal.operators.rules import shown
from dataheal.session import local_frame, materialise

#: Hash functions of a signature; each is one more 32-bit number a key and column.
SEEDS = 8
#: What the estimate may be off by before a pair counts as beyond suspicion.
MARGIN = 0.15


# ── cells under a key ──────────────────────────────────────────────────────


def supporting_columns(datasets: dict[str, Dataset], key: str) -> list[str]:
    """Columns beside the key that at least two of the datasets with the key have."""
    holders = [ds for ds in datasets.values() if key in ds.columns]
    names = dict.fromkeys(c for ds in holders for c in ds.columns if c != key)
    return [c for c in names if sum(c in ds.columns for ds in holders) > 1]


def _shared_cells(datasets: dict[str, Dataset], chosen: list[tuple]) -> dict[int, dict[tuple[str, str], None]]:
    """By place, the (join_key, column) that both sides of one of the pairs ``chosen`` (dataset_a, dataset_b, join_key, a, b) have."""
    sides, out = list(datasets.values()), {}
    for _, _, k, a, b in chosen:
        shared = [(k, c) for c in supporting_columns(datasets, k) if all(k in sides[p].columns and c in sides[p].columns for p in (a, b))]
        for p in (a, b):
            out.setdefault(p, {}).update(dict.fromkeys(shared))
    return out


def _cells(datasets: dict[str, Dataset], columns: dict[str, list[str]], at_place: dict[int, dict] | None = None) -> DataFrame:
    """``(place, join_key, key, column, value)``: the cells of the named columns under each key, every dataset read once.

    With ``at_place`` only those that it has (see :func:`_shared_cells`).
    """
    sides = []
    for place, ds in enumerate(datasets.values()):
        pairs = [(k, c) for k, names in columns.items() if k in ds.columns for c in names if c in ds.columns]
        if at_place is not None:
            pairs = [x for x in pairs if x in at_place.get(place, ())]
        if not pairs:
            continue
        structs = [
            F.struct(F.lit(k).alias("join_key"), shown(ds, k).alias("key"), F.lit(c).alias("column"), shown(ds, c).alias("value"))
            for k, c in pairs
        ]
        sides.append(ds.df.select(F.lit(place).alias("place"), F.inline(F.array(*structs))).filter(F.col("key").isNotNull()))
    return union_all(sides)


def _no_cells(datasets: dict[str, Dataset], schema: str) -> DataFrame:
    return local_frame(next(iter(datasets.values())).df.sparkSession, [], schema)


# ── entity mismatch ────────────────────────────────────────────────────────


def entity_mismatch(datasets: dict[str, Dataset], key: str, columns: list[str] | None = None) -> DataFrame:
    """``(join_key, key, column, value, datasets, rows)``: every value of each contradicted cell, with the datasets that hold it.

    A key's column is contradicted if rows of two datasets differ in it, as a join on the key with a
    null-safe comparison would find. All datasets go through one aggregation by (key, column, value), which
    spreads a hot key over its values and combines its rows within tasks; the second one, by key and
    column, reads the same shuffle and keeps two counts. No value list is ever gathered.
    """
    names = supporting_columns(datasets, key) if columns is None else columns
    if not names or not any(key in ds.columns for ds in datasets.values()):
        return _no_cells(datasets, "join_key string, key string, column string, value string, datasets string, rows bigint")
    order = list(datasets)
    held = _cells(datasets, {key: names}).groupBy("join_key", "key", "column", "value").agg(
        *[F.count_if(F.col("place") == i).alias(f"rows_{i}") for i in range(len(order))]
    )
    present = [F.max((F.col(f"rows_{i}") > 0).cast("int")).alias(f"in_{i}") for i in range(len(order))]
    keys = ["join_key", "key", "column"]
    counted = held.groupBy(*keys).agg(F.count("*").alias("values"), *present)
    several = sum((F.col(f"in_{i}") for i in range(len(order))), F.lit(0)) > 1
    found = counted.filter((F.col("values") > 1) & several).select(*keys)
    owners = F.concat_ws(",", *[F.when(F.col(f"rows_{i}") > 0, name) for i, name in enumerate(order)])
    rows = sum((F.col(f"rows_{i}") for i in range(len(order))), F.lit(0))
    # an inner join, as a semi join would be moved below the aggregation and read the datasets again
    return held.join(found, keys).select(*keys, "value", owners.alias("datasets"), rows.cast("bigint").alias("rows"))


def mismatch_summary(mismatches: DataFrame) -> DataFrame:
    """``(join_key, column, keys, values)``: how many keys each column contradicts, and with how many values."""
    by_key = mismatches.groupBy("join_key", "column", "key").agg(F.count("*").alias("values"))
    return by_key.groupBy("join_key", "column").agg(F.count("*").alias("keys"), F.sum("values").alias("values"))


# ── ghost joins ────────────────────────────────────────────────────────────

PAIR = ["dataset_a", "dataset_b", "join_key"]
#: Datasets whose signatures one pass holds side by side, in ``SEEDS`` columns each.
SIDES_AT_ONCE = 8
#: Pairs that one pass counts; their sides have one bit each of a 64-bit number.
PAIRS_AT_ONCE = 30


def _pair_places(pairs: DataFrame, order: list[str]) -> DataFrame:
    """The pairs with their datasets' places; as long as the list of pairs."""
    places = [(r["dataset_a"], r["dataset_b"], r["join_key"], order.index(r["dataset_a"]), order.index(r["dataset_b"])) for r in pairs.collect()]
    return local_frame(pairs.sparkSession, places, "dataset_a string, dataset_b string, join_key string, a int, b int")


def estimated_agreement(datasets: dict[str, Dataset], pairs: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``(dataset_a, dataset_b, join_key, estimate)``: mean similarity of what the sides of each pair say, over shared keys and columns.

    What a dataset says about a key's column is the set of its values there. The least value of each of
    ``seeds`` hash functions stands for the set: two sets share that least value as often as their
    Jaccard similarity says, and always if both are the same single value. Only numbers are shuffled.
    """
    wanted = _pair_places(pairs, list(datasets))
    parts, batch = [], []
    for pair in sorted({tuple(r) for r in wanted.collect()}):
        if len({p for r in [*batch, pair] for p in r[3:]}) > SIDES_AT_ONCE:
            parts, batch = [*parts, batch], []
        batch.append(pair)
    measured = [m for m in (_estimated(datasets, x, seeds) for x in [*parts, batch]) if m is not None]
    if not measured:
        return wanted.select(*PAIR, F.lit(None).cast("double").alias("estimate"))
    return wanted.select(*PAIR).join(F.broadcast(union_all(measured)), PAIR, "left")


def _estimated(datasets: dict[str, Dataset], chosen: list[tuple], seeds: int) -> DataFrame | None:
    """The estimates of the pairs ``chosen`` (dataset_a, dataset_b, join_key, a, b), from one pass and one shuffle; None if no pair has a cell."""
    columns = {k: supporting_columns(datasets, k) for _, _, k, _, _ in chosen}
    at_place = _shared_cells(datasets, chosen)
    if not any(at_place.values()):
        return None
    # with the key in the hash its functions differ from key to key, so chance evens out over the keys
    # the upper half of a hash keeps its order, and does not compress
    text = F.coalesce(F.concat(F.lit("="), "value"), F.lit("-"))
    marks = [F.shiftright(F.xxhash64(F.lit(s), "key", text), 32).cast("int").alias(f"h{s}") for s in range(seeds)]
    # the key goes by two hashes: a pair of keys that share both would weigh as one
    name = [F.xxhash64("join_key", "key", "column").alias("name"), F.xxhash64("column", "key", F.lit(1)).alias("check")]
    # a side's marks have columns of their own, null in the rows of other sides, so all sides of a cell meet in one shuffle
    mins = [F.min(F.when(F.col("place") == p, F.col(f"h{s}"))).alias(f"m{p}_{s}") for p in at_place for s in range(seeds)]
    signed = _cells(datasets, columns, at_place).select("join_key", "place", *name, *marks).groupBy("join_key", "name", "check").agg(*mins)
    totals, rows = [], []
    for i, (name_a, name_b, k, a, b) in enumerate(chosen):
        shares = (F.col("join_key") == k) & F.col(f"m{a}_0").isNotNull() & F.col(f"m{b}_0").isNotNull()
        same = sum(((F.col(f"m{a}_{s}") == F.col(f"m{b}_{s}")).cast("int") for s in range(seeds)), F.lit(0))
        totals.append(F.try_divide(F.sum(F.when(shares, same)), F.count_if(shares) * seeds).alias(f"estimate_{i}"))
        rows.append(F.struct(*[F.lit(x).alias(c) for c, x in zip(PAIR, (name_a, name_b, k))], F.col(f"estimate_{i}").alias("estimate")))
    return signed.agg(*totals).select(F.inline(F.array(*rows)))


def exact_agreement(datasets: dict[str, Dataset], pairs: DataFrame) -> DataFrame:
    """``(dataset_a, dataset_b, join_key, cells, agreement)``: as the estimate, from whole value sets.

    ``cells`` counts the key and column combinations that both sides hold.
    """
    wanted = _pair_places(pairs, list(datasets))
    chosen = sorted({tuple(r) for r in wanted.collect()})
    parts = [_measured(datasets, chosen[k : k + PAIRS_AT_ONCE]) for k in range(0, len(chosen), PAIRS_AT_ONCE)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return wanted.select(*PAIR, F.lit(0).cast("bigint").alias("cells"), F.lit(None).cast("double").alias("agreement"))
    return wanted.select(*PAIR).join(F.broadcast(union_all(parts)), PAIR, "left").fillna(0, ["cells"])


def _measured(datasets: dict[str, Dataset], chosen: list[tuple]) -> DataFrame | None:
    """Cells and agreement of the pairs ``chosen`` (dataset_a, dataset_b, join_key, a, b), from one pass; None if no pair has a cell.

    Only cells that both sides of a pair have are read. A cell goes by its number, its datasets by one bit each, so what is moved
    and held for each value is little more than the key's and the value's text, and all pairs are counted in the same rows.
    """
    sides, at_place = list(datasets.values()), _shared_cells(datasets, chosen)
    numbers = {cell: i for i, cell in enumerate(dict.fromkeys(x for cells in at_place.values() for x in cells))}
    of_pair = [[n for (of, c), n in numbers.items() if of == k and c in sides[a].columns and c in sides[b].columns] for _, _, k, a, b in chosen]
    places = {p: i for i, p in enumerate(sorted(at_place))}  # bit of each place, as few as pairs have sides
    read = []
    for p, cells in at_place.items():
        if not cells:
            continue
        structs = [F.struct(F.lit(numbers[k, c]).alias("cell"), shown(sides[p], k).alias("key"), shown(sides[p], c).alias("value")) for k, c in cells]
        one = sides[p].df.select(F.lit(1 << places[p]).cast("bigint").alias("held"), F.inline(F.array(*structs)))
        read.append(one.filter(F.col("key").isNotNull()))
    if not read:
        return None
    has = lambda p: F.col("held").bitwiseAND(F.lit(1 << places[p]).cast("bigint")) != 0
    values = union_all(read).groupBy("cell", "key", "value").agg(F.bit_or("held").alias("held"))
    counted = values.groupBy("cell", "key").agg(
        *[F.count_if(has(p)).alias(f"in_{p}") for p in places], *[F.count_if(has(r[3]) & has(r[4])).alias(f"both_{i}") for i, r in enumerate(chosen)])
    totals = []
    for i, (_, _, _, a, b) in enumerate(chosen):
        in_a, in_b, both = F.col(f"in_{a}"), F.col(f"in_{b}"), F.col(f"both_{i}")
        shares = F.col("cell").isin(of_pair[i]) & (in_a > 0) & (in_b > 0)
        totals += [F.count_if(shares).alias(f"cells_{i}"), F.avg(F.when(shares, both / (in_a + in_b - both))).alias(f"agreement_{i}")]
    rows = [
        F.struct(*[F.lit(x).alias(name) for name, x in zip(PAIR, r)], F.col(f"cells_{i}").alias("cells"), F.col(f"agreement_{i}").alias("agreement"))
        for i, r in enumerate(chosen)
    ]
    return counted.agg(*totals).select(F.inline(F.array(*rows)))


def ghost_joins(
    datasets: dict[str, Dataset], cfg: QualityConfig, least_match: float = 0.5, most_agreement: float = 0.5, margin: float = MARGIN
) -> DataFrame:
    """``(dataset_a, dataset_b, join_key, match_rate, cells, agreement, is_ghost)`` of every pair that could be joined.

    A ghost join matches at least ``least_match`` of the keys and agrees on at most ``most_agreement`` of what the
    keys stand for. All pairs are estimated, those of eight datasets in one pass; those that match and come within
    ``margin`` of the threshold are counted exactly, so ``cells`` and ``agreement`` are exact, and null for the others.
    """
    quality = detect_join_pairs(datasets, cfg)
    if quality is None:
        return _no_cells(
            datasets, "dataset_a string, dataset_b string, join_key string, match_rate double, cells bigint, agreement double, is_ghost boolean")
    quality = materialise(quality.select(*PAIR, "match_rate"))
    matching = quality.filter(F.col("match_rate") >= least_match)
    suspects = materialise(estimated_agreement(datasets, matching).filter(F.col("estimate") <= most_agreement + margin))
    counted = materialise(exact_agreement(datasets, suspects))
    joined = quality.join(F.broadcast(counted), PAIR, "left")
    return joined.select(
        *PAIR, "match_rate", "cells", round_even(F.col("agreement"), 4).alias("agreement"),
        F.coalesce(F.col("agreement") <= most_agreement, F.lit(False)).alias("is_ghost"),
    )


# ── duplicate keys ─────────────────────────────────────────────────────────


def duplicate_keys(ds: Dataset, key: str | list[str]) -> DataFrame:
    """``(dataset, key columns..., rows, versions)``: keys that more than one row holds, and how many different rows they are.

    Keys are counted by a 64-bit hash first, combined within tasks, so a unique key is moved as one number and
    a key that fills a third of the table as one row by task. Only rows under a hash that occurs again are read
    with their texts, and counted exactly; keys that merely share a hash drop out there.
    """
    names = [key] if isinstance(key, str) else list(key)
    cells = [shown(ds, c).alias(c) for c in names]
    # numbers go into the hashes as they are: they differ where their texts do, which take far longer to write
    plain = lambda c: ds.value(c) if c in ds.numeric else shown(ds, c)
    whole = F.xxhash64(*[x for c in ds.columns for x in (plain(c).isNull(), plain(c))])
    has_key = F.lit(True)
    for c in names:
        has_key = has_key & ds.value(c).isNotNull()
    hashed = ds.df.filter(has_key).select(F.xxhash64(*[plain(c) for c in names]).alias("_hash"), whole.alias("_row"), *cells)
    again = hashed.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash")
    versions = hashed.join(again, "_hash", "left_semi").groupBy(*[F.col(f"`{c}`") for c in names], "_row").agg(F.count("*").alias("_n"))
    counted = versions.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.sum("_n").alias("rows"), F.count("*").alias("versions"))
    return counted.filter(F.col("rows") > 1).select(F.lit(ds.name).alias("dataset"), *[F.col(f"`{c}`") for c in names], "rows", "versions")
