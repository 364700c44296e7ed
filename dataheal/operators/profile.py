"""Column and dataset profiling.

Whatever the number of columns, the table is read three times: for one wide aggregate with
quantile sketches, for one histogram ``(column, value, count)``, and for duplicate rows. Distinct counts,
top values, casing variants, date formats, exact quantiles and outlier counts are all read off the
histogram; a value that fills a third of the table is counted before it is shuffled. The whole profile writes the
counted histogram to the shared folder and reads that, so its cells are merged once, not by each reader.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.config import DATE_PATTERNS, QualityConfig
from dataheal.dataset import Dataset
from dataheal.functions.numbers import round_even
from dataheal.functions.text import percent, render_double, strip
from dataheal.operators.quantiles import BRACKETS, exact_quantiles, search_frame, sketched_brackets
from dataheal.session import local_frame, written


def _long(aggregated: DataFrame, shared: list[str], per_column: list[Column]) -> DataFrame:
    """One wide aggregate row to one row per column."""
    return aggregated.select(*shared, F.inline(F.array(*per_column)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ── schema and size ────────────────────────────────────────────────────────


def dataset_schema(ds: Dataset) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(ds.fields)]
    return local_frame(ds.df.sparkSession, rows, "ordinal int, name string, dtype_raw string")


def row_count(ds: Dataset) -> DataFrame:
    return ds.df.agg(F.count("*").alias("row_count")).select(F.lit(ds.name).alias("dataset"), "row_count")


def column_names(ds: Dataset) -> DataFrame:
    return dataset_schema(ds).select("ordinal", "name")


def dataset_metadata(ds: Dataset, path: str = "") -> DataFrame:
    schema = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in ds.fields]
    return ds.df.agg(F.count("*").alias("row_count")).select(
        F.lit("spark").alias("engine_used"),
        F.lit(path.rstrip("/").rsplit("/", 1)[-1] or ds.name).alias("file_name"),
        F.lit(path).alias("file_path"),
        "row_count",
        F.lit(len(ds.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in ds.columns]).alias("columns"),
        F.array(*schema).alias("schema"),
    )


# ── nulls ──────────────────────────────────────────────────────────────────


def null_profile(ds: Dataset) -> DataFrame:
    counted = ds.clean().agg(
        F.count("*").alias("row_count"), *[F.count(ds.col(c)).alias(f"n{i}") for i, c in enumerate(ds.columns)]
    )
    long = _long(
        counted,
        ["row_count"],
        [F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("non_null")) for i, c in enumerate(ds.columns)],
    )
    nulls = F.col("row_count") - F.col("non_null")
    return long.select(
        "name", nulls.alias("null_count"), _rate(nulls, F.col("row_count")).alias("null_pct")
    )


def null_counts(ds: Dataset) -> DataFrame:
    return null_profile(ds).select("name", "null_count")


def _rate(count: Column, rows: Column) -> Column:
    return round_even(count / F.greatest(rows, F.lit(1)), 4)


# ── histogram and what is read off it ──────────────────────────────────────


def _value_counts(ds: Dataset, columns: list[str], kind: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("name"), ds.value(c).cast(kind).alias("value")) for c in columns])
    return (
        ds.df.select(F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count("*").alias("n"))
    )


def _kind(ds: Dataset, column: str) -> str:
    """How the values of a column are counted: as whole or fractional numbers, else as text."""
    kind = ds.dtype(column)
    if isinstance(kind, T.IntegralType):
        return "whole"
    return "fraction" if isinstance(kind, (T.DoubleType, T.FloatType)) else "decimal" if isinstance(kind, T.DecimalType) else "text"


_COUNTED_AS = {"whole": ("whole", "bigint"), "fraction": ("fraction", "double"), "decimal": ("text", "string"), "text": ("text", "string")}
#: Kinds by number: the maximum of a number is kept in a hash table, that of a string would make Spark sort every cell.
_KIND_NUMBER = {kind: number for number, kind in enumerate(_COUNTED_AS)}


def cell_histogram(ds: Dataset, columns: list[str]) -> DataFrame:
    """``(name, whole, fraction, text, n, kind)``: every distinct non-null cell and its rows, from one read and one shuffle.

    ``kind``, a number, is an aggregate, so a filter on it stays above the shuffle, which all readers share.
    """

    def cell(c: str) -> Column:
        kind = _kind(ds, c)
        slots = [
            (ds.value(c) if _COUNTED_AS[kind][0] == slot else F.lit(None)).cast(as_type).alias(slot)
            for slot, as_type in (("whole", "bigint"), ("fraction", "double"), ("text", "string"))
        ]
        return F.struct(F.lit(c).alias("name"), *slots, F.lit(_KIND_NUMBER[kind]).alias("kind"))

    return (
        ds.df.select(F.inline(F.array(*[cell(c) for c in columns])))
        .filter(F.col("whole").isNotNull() | F.col("fraction").isNotNull() | F.col("text").isNotNull())
        .groupBy("name", "whole", "fraction", "text")
        .agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    )


def by_kind(ds: Dataset, columns: list[str], hist: DataFrame | None = None) -> dict[str, DataFrame]:
    """``(name, value, n)`` over the columns, one frame per kind of value that occurs; all read one histogram, or ``hist``."""
    if not columns:
        return {}
    hist = cell_histogram(ds, columns) if hist is None else hist
    present = {_kind(ds, c) for c in columns}
    return {
        kind: hist.filter(F.col("kind") == _KIND_NUMBER[kind]).select("name", F.col(slot).alias("value"), "n")
        for kind, (slot, _) in _COUNTED_AS.items()
        if kind in present
    }


def number_histograms(ds: Dataset) -> list[DataFrame]:
    """``(name, value, n)`` over the numeric columns, one frame per kind of number."""
    return list(by_kind(ds, ds.numeric).values())


def as_numbers(histograms: list[DataFrame]) -> DataFrame:
    """``(name, num, n)`` from histograms of numeric columns."""
    return union_all(
        [h.select("name", F.col("value").cast("double").alias("num"), "n") for h in histograms]
    )


def text_histogram(ds: Dataset, columns: list[str] | None = None) -> DataFrame:
    """``(name, value, n)`` over the other columns."""
    chosen = [c for c in ds.columns if c not in ds.numeric] if columns is None else columns
    return _value_counts(ds, chosen, "string")


def histograms(ds: Dataset) -> list[DataFrame]:
    return list(by_kind(ds, ds.columns).values())


def histogram(ds: Dataset) -> DataFrame:
    """``(name, value, n)`` for every non-null value of every column, as text."""
    return union_all(
        [h.select("name", F.col("value").cast("string").alias("value"), "n") for h in histograms(ds)]
    )


def distinct_counts(hist: DataFrame) -> DataFrame:
    # Reads ``n`` so that the plan keeps it and shares the histogram's shuffle with the others.
    return hist.groupBy("name").agg(F.count_if(F.col("n") > 0).alias("unique_count"))


def distinct_cells(ds: Dataset) -> DataFrame:
    """``(name, unique_count)`` of every column with a value; the cells of all kinds are merged and counted in one go."""
    return cell_histogram(ds, ds.columns).groupBy("name").agg(F.count("*").alias("unique_count"))


def distinct_profile(ds: Dataset) -> DataFrame:
    rows = ds.df.agg(F.count("*").alias("n"))
    counts = distinct_cells(ds)
    counted = _names(ds).join(F.broadcast(counts), "name", "left")
    unique = F.coalesce("unique_count", F.lit(0))
    return counted.select(
        "name",
        unique.alias("unique_count"),
        _rate(unique, rows.scalar()).alias("uniqueness_ratio"),
    )


def distinct_profile_approx(ds: Dataset, error: float = 0.02) -> DataFrame:
    """As :func:`distinct_profile` from one scan and no shuffle of values, within ``error``."""
    counted = ds.clean().agg(
        F.count("*").alias("row_count"),
        *[F.approx_count_distinct(ds.col(c), error).alias(f"n{i}") for i, c in enumerate(ds.columns)],
    )
    long = _long(
        counted,
        ["row_count"],
        [F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("unique_count")) for i, c in enumerate(ds.columns)],
    )
    return long.select(
        "name", "unique_count", _rate(F.col("unique_count"), F.col("row_count")).alias("uniqueness_ratio")
    )


def _names(ds: Dataset) -> DataFrame:
    return dataset_schema(ds).select("ordinal", "name")


def top_values(ds: Dataset, cfg: QualityConfig, counted: list[DataFrame] | None = None) -> DataFrame:
    """The ``top_k`` most frequent values per column; ties by value."""
    order = Window.partitionBy("name").orderBy(F.desc("n"), F.asc("value"))

    def ranked(hist: DataFrame) -> DataFrame:
        # Spark cuts each partition to top_k per column before the shuffle (WindowGroupLimit).
        top = hist.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.top_k)
        number = isinstance(hist.schema["value"].dataType, T.DoubleType)
        shown = render_double(F.col("value")) if number else F.col("value").cast("string")
        return top.select("name", "rank", shown.alias("value"), F.col("n").alias("count"))

    return union_all([ranked(h) for h in (histograms(ds) if counted is None else counted)])


def casing_groups(hist: DataFrame) -> DataFrame:
    """Per column and lower-case form: number of spellings and rows."""
    return hist.groupBy("name", F.lower("value").alias("folded")).agg(
        F.count("*").alias("spellings"), F.sum("n").alias("rows")
    )


def _has_letters(text: Column) -> Column:
    """What a value needs to have other spellings: no other text has a lower-case form of ASCII digits and marks alone."""
    return (F.lower(text) != F.upper(text)) | (F.octet_length(text) != F.length(text))


def _casing_counts(hist: DataFrame) -> DataFrame:
    """Distinct values per column, and rows of the forms with several spellings; only values with letters are shuffled."""
    mixed = F.sum(F.when(F.col("spellings") > 1, F.col("rows")))
    by_column = casing_groups(hist.filter(_has_letters(F.col("value")))).groupBy("name").agg(F.coalesce(mixed, F.lit(0)).alias("mixed"))
    counted = hist.groupBy("name").agg(F.count("*").alias("unique_count"), F.sum("n").alias("non_null"))
    return counted.join(F.broadcast(by_column), "name", "left").fillna(0, ["mixed"])


def casing_inconsistency(ds: Dataset) -> DataFrame:
    """Rows whose lower-case form occurs in more than one spelling, per text column."""
    counted = _casing_counts(text_histogram(ds, ds.textual))
    return (
        _names(ds)
        .filter(F.col("name").isin(*ds.textual))
        .join(F.broadcast(counted), "name", "left")
        .select("name", F.coalesce("mixed", F.lit(0)).alias("casing_inconsistency_count"))
    )


# ── numeric columns ────────────────────────────────────────────────────────


def column_aggregates(ds: Dataset) -> DataFrame:
    """The wide aggregate: counts for all columns, extremes, moments and quantile brackets for numbers."""
    aggregates = [F.count("*").alias("row_count")]
    rows = []
    for i, f in enumerate(ds.fields):
        aggregates.append(F.count(ds.col(f.name)).alias(f"n{i}"))
        number = f.name in ds.numeric
        if number:
            col = ds.col(f.name).cast("double")
            stats = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
            aggregates += [agg(col).alias(f"{key}{i}") for key, agg in stats.items()]
            aggregates.append(sketched_brackets(col).alias(f"near{i}"))
        got = lambda key: (F.col(f"{key}{i}") if number else F.lit(None).cast("double")).alias(key)
        rows.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("dtype_raw"),
                F.lit(number).alias("is_numeric"),
                F.col(f"n{i}").alias("non_null"),
                *[got(key) for key in ("min", "max", "mean", "std")],
                (F.col(f"near{i}") if number else F.lit(None).cast(BRACKETS)).alias("near"),
            )
        )
    return _long(ds.clean().agg(*aggregates), ["row_count"], rows)


def measure_columns(ds: Dataset) -> list[Row]:
    """Counts, extremes, moments and quantile brackets, collected: one row per column from one read."""
    return column_aggregates(ds).collect()


def _quantiles(numeric_hist: DataFrame, measured: list[Row]) -> DataFrame:
    numbers = [r for r in measured if r["is_numeric"]]
    return exact_quantiles(numeric_hist, search_frame(numeric_hist.sparkSession, numbers))


def _moments(ds: Dataset, measured: list[Row]) -> DataFrame:
    keep = ("ordinal", "name", "row_count", "non_null", "min", "max", "mean", "std")
    schema = "ordinal int, name string, row_count bigint, non_null bigint, min double, max double, mean double, std double"
    rows = [tuple(r[k] for k in keep) for r in measured if r["is_numeric"]]
    return local_frame(ds.df.sparkSession, rows, schema)


def numeric_stats(ds: Dataset) -> DataFrame:
    measured = measure_columns(ds)
    quantiles = F.broadcast(_quantiles(as_numbers(number_histograms(ds)), measured))
    return (
        _moments(ds, measured)
        .join(quantiles, "name", "left")
        .select("name", "min", "max", "mean", "median", "std", "q1", "q3")
    )


def basic_stats(ds: Dataset, column: str) -> DataFrame:
    if column not in ds.numeric:
        raise ValueError(f"Column '{column}' is not numeric.")
    one = Dataset(ds.name, ds.df.select(*[ds.col(c) for c in (*ds.row_order, column)]), ds.row_order)
    return numeric_stats(one).select("name", "min", "max", "mean", "median", "std")


def outlier_bounds(quantiles: DataFrame) -> DataFrame:
    spread = F.col("q3") - F.col("q1")
    return quantiles.select(
        "*",
        (F.col("q1") - 1.5 * spread).alias("lower"),
        (F.col("q3") + 1.5 * spread).alias("upper"),
    )


def _outlier_counts(numeric_hist: DataFrame, bounds: DataFrame) -> DataFrame:
    """The bounds frame, one row per column, with the number of rows outside."""
    outside = (F.col("num") < F.col("lower")) | (F.col("num") > F.col("upper"))
    kept = [c for c in bounds.columns if c != "name"]
    return (
        numeric_hist.join(F.broadcast(bounds), "name")
        .groupBy("name")
        .agg(
            *[F.max(c).alias(c) for c in kept],
            F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_count"),
        )
    )


def iqr_outliers(ds: Dataset) -> DataFrame:
    measured = measure_columns(ds)
    numbers = as_numbers(number_histograms(ds))
    counts = _outlier_counts(numbers, outlier_bounds(_quantiles(numbers, measured)))
    found = F.coalesce("outlier_count", F.lit(0))
    return (
        _moments(ds, measured)
        .join(F.broadcast(counts), "name", "left")
        .select(
            "name",
            "lower",
            "upper",
            found.alias("outlier_count"),
            _rate(found, F.col("row_count")).alias("outlier_pct"),
        )
    )


def outlier_rows(ds: Dataset, column: str) -> DataFrame:
    """The rows of one column's outliers; the two bounds are constants the scan can use."""
    one = Dataset(ds.name, ds.df.select(*[ds.col(c) for c in (*ds.row_order, column)]), ds.row_order)
    numbers = as_numbers(number_histograms(one))
    found = outlier_bounds(_quantiles(numbers, measure_columns(one))).first()
    if found is None:
        return ds.df.limit(0)
    col = ds.col(column)
    return ds.df.filter((col < found["lower"]) | (col > found["upper"]))


# ── samples and dates ──────────────────────────────────────────────────────


def value_sample(ds: Dataset, columns: list[str] | None = None, size: int = 50) -> DataFrame:
    """The first ``size`` non-null values of each text column in row order.

    One read for all columns; each task keeps ``size`` rows of a column at most (WindowGroupLimit).
    """
    chosen = ds.textual if columns is None else columns
    schema = "name string, value string"
    if not chosen:
        return local_frame(ds.df.sparkSession, [], schema)
    order = [ds.col(c) for c in ds.row_order]
    cells = ds.df.select(
        F.struct(*order).alias("at"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), ds.text(c).alias("value")) for c in chosen])),
    ).filter(F.col("value").isNotNull())
    rank = F.row_number().over(Window.partitionBy("name").orderBy("at"))
    return cells.withColumn("rank", rank).filter(F.col("rank") <= size).select("name", "value")


def date_columns(ds: Dataset, cfg: QualityConfig) -> list[str]:
    return [c for c in ds.textual if any(k in c.lower() for k in cfg.date_keywords)]


def date_formats(hist: DataFrame, columns: list[str]) -> DataFrame:
    """Per date column of a text histogram: the formats of all its values, and how many rows match none.

    Other columns of the histogram are passed over.
    """
    text = F.when(F.col("name").isin(*columns), strip(F.col("value")))
    label = reduce(
        lambda seen, p: seen.when(text.rlike(p[1]), p[0]),
        DATE_PATTERNS[1:],
        F.when(text.rlike(DATE_PATTERNS[0][1]), DATE_PATTERNS[0][0]),
    )
    none = F.when(F.col("label").isNull() & (F.col("text") != ""), F.col("n")).otherwise(0)
    return (
        hist.select("name", "n", text.alias("text"), label.alias("label"))
        .groupBy("name")
        .agg(
            F.sort_array(F.collect_set("label")).alias("date_formats_detected"),
            F.sum(none).alias("invalid_date_count"),
        )
    )


def date_format_scan(ds: Dataset, cfg: QualityConfig) -> DataFrame:
    """Per date column: formats of its values and how many rows match none of them."""
    columns = date_columns(ds, cfg)
    if not columns:
        schema = "name string, date_formats_detected array<string>, invalid_date_count bigint"
        return local_frame(ds.df.sparkSession, [], schema)
    return date_formats(text_histogram(ds, columns), columns)


# ── rows ───────────────────────────────────────────────────────────────────


def _comparable(col: Column, kind: T.DataType) -> Column:
    """A map as its sorted entries, which can be grouped; other values as they are."""
    if isinstance(kind, T.MapType):
        return F.when(col.isNotNull(), F.array_sort(F.map_entries(col)))
    return col


def duplicate_rows(ds: Dataset) -> DataFrame:
    """Rows beyond the first of each group of equal rows; nulls are equal.

    One read and one shuffle: equal rows are counted within each task first, so a row that fills
    a third of the table moves once by task.
    """
    rows = ds.df.select(*[_comparable(ds.value(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(ds.fields)])
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    counted = groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    )
    return counted.select(
        F.lit(ds.name).alias("dataset"),
        "duplicate_row_count",
        _rate(F.col("duplicate_row_count"), F.col("rows")).alias("duplicate_row_pct"),
    )


# ── meaning ────────────────────────────────────────────────────────────────


def inferred_type(cfg: QualityConfig) -> Column:
    """Semantic type from ``is_numeric``, ``name``, ``unique_count`` and ``row_count``."""
    name = F.lower("name")
    dated = reduce(lambda a, b: a | b, [name.contains(k) for k in cfg.date_keywords])
    keyed = reduce(lambda a, b: a | b, [name.endswith(k) for k in cfg.identifier_keywords])
    ratio = F.col("unique_count") / F.greatest("row_count", F.lit(1))
    return (
        F.when(F.col("is_numeric"), "numeric")
        .when(dated, "date")
        .when(keyed, "identifier")
        .when(ratio < cfg.categorical_max_ratio, "categorical")
        .otherwise("text")
    )


def _issue_texts(cfg: QualityConfig) -> Column:
    # The issue texts of the report.
    (over_half, _), (high, _), (elevated, _) = cfg.null_tiers
    pct, nulls, critical = F.col("null_pct"), F.col("null_count"), F.col("is_critical_field")
    kind = F.col("inferred_type")
    share = percent(pct, 0)
    nulls_text = (
        F.when(
            pct > over_half,
            F.concat(
                F.when(critical, "Critical field: null rate is ").otherwise("Null rate is "),
                share,
                F.lit(" — over half of values are missing."),
            ),
        )
        .when(pct > high, F.concat(F.lit("High null rate: "), share, F.lit(" of values are missing.")))
        .when(
            pct > elevated,
            F.concat(F.lit("Elevated null rate: "), share, F.lit(" of values are missing.")),
        )
        .when(
            (nulls > 0) & critical,
            F.format_string("Critical field has %d null value(s) (%s).", nulls, percent(pct, 1)),
        )
    )
    outliers = F.when(
        (kind == "numeric") & (F.col("outlier_count") > 0) & (F.col("outlier_pct") > cfg.outlier_rate),
        F.format_string(
            "High outlier rate: %d value(s) are statistical outliers (%s of non-null values).",
            F.col("outlier_count"),
            percent(F.col("outlier_pct"), 0),
        ),
    )
    casing = F.when(
        (kind == "categorical") & (F.col("casing_inconsistency_count") > 0),
        F.format_string(
            "Inconsistent casing: %d value(s) have mixed case variants (e.g. 'Motor' / 'motor' / 'MOTOR').",
            F.col("casing_inconsistency_count"),
        ),
    )
    formats = F.when(
        (kind == "date") & (F.size("date_formats_detected") > 1),
        F.concat(
            F.lit("Multiple date formats detected: "),
            F.array_join("date_formats_detected", ", "),
            F.lit("."),
        ),
    )
    invalid = F.when(
        (kind == "date") & (F.col("invalid_date_count") > 0),
        F.format_string("%d value(s) did not match any known date format.", F.col("invalid_date_count")),
    )
    return F.array_compact(F.array(nulls_text, outliers, casing, formats, invalid))


# ── the profile ────────────────────────────────────────────────────────────


_MEASURED = (
    "ordinal int, name string, dtype_raw string, is_numeric boolean, row_count bigint, "
    "non_null bigint, min double, max double, mean double, std double, unique_count bigint, "
    "mixed bigint, ranked array<struct<rank:int,value:string,count:bigint>>, q1 double, "
    "median double, q3 double, outlier_count bigint, date_formats_detected array<string>, "
    "invalid_date_count bigint"
)


def _summaries(ds: Dataset, cfg: QualityConfig, measured: list[Row], hist: DataFrame) -> DataFrame:
    """Everything read off the histogram, one row per column."""
    found = by_kind(ds, ds.columns, hist)
    texts = [h for kind, h in found.items() if kind == "text"]
    numeric = [h for kind, h in found.items() if kind != "text"]
    counts = [_casing_counts(h) for h in texts]
    if numeric:
        numbers = as_numbers(numeric)
        counts.append(distinct_counts(numbers).withColumns({"non_null": F.lit(None).cast("bigint"), "mixed": F.lit(None).cast("bigint")}))
    top = top_values(ds, cfg, numeric + texts).groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("ranked")
    )
    found = union_all(counts).join(F.broadcast(top), "name", "left")
    if numeric:
        bounds = outlier_bounds(_quantiles(numbers, measured))
        found = found.join(F.broadcast(_outlier_counts(numbers, bounds)), "name", "left")
    dates = date_columns(ds, cfg)
    if dates:
        found = found.join(F.broadcast(date_formats(texts[0].filter(F.col("name").isin(*dates)), dates)), "name", "left")
    return found


def profile_columns(ds: Dataset, cfg: QualityConfig) -> DataFrame:
    """One row per column with every profile field.

    Reads the table three times and holds the results, a few numbers per column, as a local frame, so that
    everything built on a profile costs no further scan. The histogram is written for the time it is read.
    """
    # the wide aggregate is for numbers; what it says of other columns, their cells, is read off the histogram
    numbers = Dataset(ds.name, ds.df.select(*[ds.col(c) for c in (*ds.row_order, *ds.numeric)]), ds.row_order)
    measured = measure_columns(numbers) if ds.numeric else []
    as_dict = lambda r: r.asDict(recursive=True)
    summaries, known = {}, {r["name"]: as_dict(r) for r in measured}
    row_count = measured[0]["row_count"] if measured else ds.df.count()
    if ds.columns:
        with written(cell_histogram(ds, ds.columns)) as hist:
            summaries = {r["name"]: as_dict(r) for r in _summaries(ds, cfg, measured, hist).collect()}
    none = {k: None for k in ("min", "max", "mean", "std")}
    rows = [
        {"is_numeric": f.name in known, "row_count": row_count, "non_null": 0, **none, **summaries.get(f.name, {}), **known.get(f.name, {}),
         "ordinal": i, "name": f.name, "dtype_raw": f.dataType.simpleString()}
        for i, f in enumerate(ds.fields)
    ]
    return describe_columns(local_frame(ds.df.sparkSession, rows, _MEASURED), ds, cfg)


def describe_columns(measured: DataFrame, ds: Dataset, cfg: QualityConfig) -> DataFrame:
    """Rates, semantic type, flags and issue texts from the measured numbers."""
    rows, text = F.col("row_count"), F.col("name").isin(*ds.textual)
    nulls = rows - F.col("non_null")
    unique = F.coalesce("unique_count", F.lit(0))
    none = F.array().cast("array<string>")
    typed = (
        measured.withColumn("unique_count", unique)
        .withColumn("inferred_type", inferred_type(cfg))
        .withColumns(
            {
                "is_critical_field": F.col("name").isin(*cfg.critical_fields),
                "null_count": nulls,
                "null_pct": _rate(nulls, rows),
                "uniqueness_ratio": _rate(F.col("unique_count"), rows),
                "outlier_count": F.when(F.col("is_numeric"), F.coalesce("outlier_count", F.lit(0))),
                "casing_inconsistency_count": F.when(text, F.coalesce("mixed", F.lit(0))),
                "date_formats_detected": F.when(
                    F.col("inferred_type") == "date", F.coalesce("date_formats_detected", none)
                ),
                "invalid_date_count": F.when(
                    F.col("inferred_type") == "date", F.coalesce("invalid_date_count", F.lit(0))
                ),
            }
        )
        .withColumn("outlier_pct", _rate(F.col("outlier_count"), rows))
    )
    unique_share = F.col("unique_count") / F.greatest(rows, F.lit(1))
    pairs = F.transform("ranked", lambda r: F.struct(r["value"].alias("value"), r["count"].alias("count")))
    return typed.select(
        F.lit(ds.name).alias("dataset"),
        "ordinal",
        "name",
        "inferred_type",
        "dtype_raw",
        "is_critical_field",
        "row_count",
        "null_count",
        "null_pct",
        "unique_count",
        "uniqueness_ratio",
        (
            ~F.col("inferred_type").isin("identifier", "numeric")
            & (unique_share > cfg.high_cardinality_ratio)
        ).alias("is_high_cardinality"),
        F.coalesce(pairs, F.array().cast("array<struct<value:string,count:bigint>>")).alias("top_values"),
        "min",
        "max",
        *[round_even(F.col(c), 4).alias(c) for c in ("mean", "median", "std")],
        "q1",
        "q3",
        "outlier_count",
        "outlier_pct",
        "casing_inconsistency_count",
        "invalid_date_count",
        "date_formats_detected",
        _issue_texts(cfg).alias("issues"),
    ).orderBy("ordinal")


def column_issues(profile: DataFrame) -> DataFrame:
    return profile.select(
        "dataset", "ordinal", "name", F.posexplode("issues").alias("issue_order", "issue")
    )


def dataset_issues(profile: DataFrame) -> DataFrame:
    """Issues of critical columns, raised to the dataset."""
    severity = F.when(F.col("null_count") > 0, "critical").otherwise("warning")
    return profile.filter("is_critical_field").select(
        "dataset", F.col("name").alias("column"), severity.alias("severity"), F.explode("issues").alias("detail")
    )


def classify_column(profile: DataFrame) -> DataFrame:
    return profile.select("name", "inferred_type")


def high_cardinality_flag(profile: DataFrame) -> DataFrame:
    return profile.select("name", "uniqueness_ratio", "is_high_cardinality")


def critical_flag(ds: Dataset, cfg: QualityConfig) -> DataFrame:
    return _names(ds).select("name", F.col("name").isin(*cfg.critical_fields).alias("is_critical_field"))


def profile_dataset_row(ds: Dataset, profile: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """The one-row dataset profile that goes with a column profile."""
    duplicates = duplicate_rows(ds) if duplicates is None else duplicates
    shape = profile.agg(
        F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"), F.count("*").alias("column_count")
    ).withColumn("dataset", F.lit(ds.name))
    return shape.join(duplicates, "dataset").select(
        "dataset", "row_count", "column_count", "duplicate_row_count", "duplicate_row_pct"
    )
