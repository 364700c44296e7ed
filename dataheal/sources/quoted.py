"""CSV whose quoted cells hold line breaks, read split by split.

Spark's own reader gives such a file to one task. Here its lines are read as text, which splits anywhere, and
each line is taken as a function on two states: is a quoted cell open before it, and is one open after
it? A line keeps the state, flips it, or sets it. The functions of a block (one split of a file) compose to one
of the same kind, so the state before every block follows from a short list of blocks, and that before
every line from the lines of its block. A line that no open cell precedes starts a record; the others
belong to the record that is open. Single-line records stay as they are, lines of longer ones are put together
by record, across blocks too. Spark's CSV expression parses each record.

Lines end with ``\\n`` or ``\\r\\n``; breaks within cells are kept as they are. A quote opens a cell at its start only
(line start or after a comma), as in Spark's reader, so ``5" pipe`` opens none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataheal.sources.positions import BLOCK, FILE, ID, sums_before

TEXT, STATE, AT = "__quoted_text", "__quoted_open", "__quoted_at"
_OPENS = '(^|,)"'
_CELL = '(^|,)"[^"]*"'


def _open_after(line: Column) -> Column:
    """Whether a line that starts outside of cells ends within a quoted one; doubled quotes are gone from it."""
    return F.regexp_replace(line, _CELL, "$1").rlike(_OPENS)


def _effects(line: Column) -> tuple[Column, Column]:
    """Whether a cell is open after the line: if none was before, and if one was."""
    plain = F.replace(line, F.lit('""'), F.lit(""))
    at = F.instr(plain, '"')
    # what follows the closing quote up to the next comma still belongs to the cell, so no cell starts there
    rest = F.concat(F.lit("x"), F.substr(plain, at + 1))
    return F.when(at > 0, _open_after(plain)).otherwise(False), F.when(at > 0, _open_after(rest)).otherwise(True)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files: file, block, an id that grows within the block, text, and what the line does to the state."""
    texts = spark.read.option("lineSep", "\n").text(path)
    after_none, after_open = _effects(F.col(TEXT))
    lines = texts.select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ID), F.col("value").alias(TEXT),
    )
    both = lines.withColumns({"none": after_none, "open": after_open})
    flips = (F.col("none") & ~F.col("open")).cast("int")
    sets = F.when(F.col("none") == F.col("open"), F.col("none").cast("int"))
    return both.select(FILE, BLOCK, ID, TEXT, flips.alias("flips"), sets.alias("sets"))


def holds_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any line leaves a quoted cell open; without one, every line is a record."""
    return not spark.read.option("lineSep", "\n").text(path).filter(_effects(F.col("value"))[0]).isEmpty()


def _composed(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds ``total`` flips up to each row and ``base``, the state that the last setting row gives without the flips before it.

    The state after a row is ``(base, else the state at the group's start) + total``, modulo 2.
    """
    until = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("total", F.sum("flips").over(until))
    mark = F.when(F.col("sets").isNotNull(), (F.col("sets") + F.col("total")) % 2)
    return marked.withColumn("base", F.last(mark, ignorenulls=True).over(until))


def _blocks(lines: DataFrame) -> DataFrame:
    """The state before each block, from the lines that do not keep it; few numbers a block."""
    changing = lines.filter((F.col("flips") == 1) | F.col("sets").isNotNull()).select(FILE, BLOCK, ID, "flips", "sets")
    last = _composed(changing, [FILE, BLOCK], ID).groupBy(FILE, BLOCK).agg(F.max_by(F.struct("total", "base"), ID).alias("last"))
    # a block is one function again: it flips, or it sets
    whole = last.select(
        FILE, BLOCK,
        F.when(F.col("last.base").isNull(), F.col("last.total") % 2).otherwise(0).alias("flips"),
        ((F.col("last.base") + F.col("last.total")) % 2).alias("sets"),
    )
    every = lines.select(FILE, BLOCK).distinct().join(whole, [FILE, BLOCK], "left").fillna(0, ["flips"])
    after = _composed(every, [FILE], BLOCK).withColumn("after", (F.coalesce("base", F.lit(0)) + F.col("total")) % 2)
    before = F.lag("after", 1, 0).over(Window.partitionBy(FILE).orderBy(BLOCK))
    return after.select(FILE, BLOCK, before.alias(STATE))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, at, record)`` of every record but blank ones; ``at`` numbers the records that start in a block."""
    lines = _lines(spark, path)
    placed = lines.join(F.broadcast(_blocks(lines)), [FILE, BLOCK])
    in_block = Window.partitionBy(FILE, BLOCK).orderBy(ID)
    known = _composed(placed, [FILE, BLOCK], ID)
    # the state before a line is that after the one before it
    previous = (F.coalesce(F.lag("base").over(in_block), F.col(STATE)) + F.coalesce(F.lag("total").over(in_block), F.lit(0))) % 2
    after = (F.coalesce("base", F.col(STATE)) + F.col("total")) % 2
    stated = known.select(FILE, BLOCK, ID, TEXT, (previous == 0).alias("starts"), (after == 0).alias("ends"))
    counted = F.col("starts") & (F.trim(F.translate(TEXT, "\t\r", "  ")) != "")
    until = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = stated.withColumn("counted", counted).withColumn(AT, F.sum(F.col("counted").cast("bigint")).over(until) - 1)
    alone = numbered.filter(F.col("counted") & F.col("ends")).select(FILE, BLOCK, AT, F.col(TEXT).alias("record"))

    # lines of longer records; those at a block's head belong to the last record that starts in a block before it
    parts = numbered.filter(~(F.col("starts") & F.col("ends"))).withColumn(
        "home", F.last(F.when(F.col("starts"), F.struct(F.col(BLOCK).alias("block"), F.col(AT).alias("at"))), ignorenulls=True).over(until)
    )
    heads = parts.groupBy(FILE, BLOCK).agg(F.max("home").alias("last"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(FILE, BLOCK, F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    homed = parts.join(F.broadcast(carried), [FILE, BLOCK]).withColumn("home", F.coalesce("home", "carried"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(BLOCK).alias("b"), F.col(ID).alias("i"), F.col(TEXT).alias("t")))), lambda x: x["t"]), "\n")
    longer = homed.groupBy(FILE, F.col("home.block").alias(BLOCK), F.col("home.at").alias(AT)).agg(text.alias("record"))
    return alone.unionByName(longer)


def parsed(found: DataFrame, names: list[str]) -> DataFrame:
    """The records' cells as text, by the names of the header."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    line = F.when(F.col("record").endswith("\r"), F.expr("substr(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    cells = F.from_csv(line, schema, {"escape": '"', "multiLine": "true"})
    columns = [F.col(f"cells.c{i}").alias(name) for i, name in enumerate(names)]
    return found.select(FILE, BLOCK, AT, cells.alias("cells")).select(FILE, BLOCK, AT, *columns)


def positioned(written: DataFrame, name: str) -> DataFrame:
    """Adds the row's position over all files, by path; the first record of each file is its header and goes."""
    blocks = written.groupBy(FILE, BLOCK).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("before", before)
    files = sums_before(blocks.groupBy(FILE).agg((F.sum("n") - 1).alias("rows")), [FILE], "rows", "offset").drop("rows")
    placed = starts.join(files, FILE).select(FILE, BLOCK, "before", "offset")
    within = F.col("before") + F.col(AT)
    cells = [c for c in written.columns if c not in (FILE, BLOCK, AT)]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in cells]
    return written.join(F.broadcast(placed), [FILE, BLOCK]).filter(within > 0).select((F.col("offset") + within - 1).alias(name), *quoted)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names as Spark reads them from the first record."""
    read = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True)
    names = read.csv(path).columns
    return [*names[:-1], names[-1].removesuffix("\r")] if names else names
