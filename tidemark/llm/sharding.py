"""Hilbert-curve ordering and sharding, in DataFrame operations only.

Several metadata dimensions are quantised to a few bits each, the cell's place on
the Hilbert curve orders the rows, and the ordered rows are cut into runs. Files
cut this way cover a small box of every dimension, so min/max pruning works on all
of them at once.

Nothing is sorted globally. Rows are counted by (cell, spread), where spread is a
hash that splits hot cells; the counts, of which there are at most
2 ** (bits * dims) * spread, give each group the rank of its first row, and a window
inside each group gives the rest. Texts never enter a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one cell are dealt over this many groups.
SPREAD = 64
#: Parts of a run, by id.
SPLIT = 16


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell with integer coordinates in [0, 2 ** bits).

    Skilling's transposition: undo the excess work bit by bit from the top, Gray
    decode, then interleave. Each step is one fold, so that the plan stays linear in
    bits * dims.
    """
    n = len(dims)
    steps = F.expr(f"flatten(transform(sequence({bits - 1}, 1, -1), q -> transform(sequence(0, {n - 1}), i -> named_struct('q', q, 'i', i))))") if bits > 1 else None
    x = F.array(*[d.cast("long") for d in dims])

    def excess(acc: Column, step: Column) -> Column:
        q, i = _power(step["q"]), step["i"]
        low = q - 1
        first, here = acc[0], F.get(acc, i)
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        is_set = here.bitwiseAND(q) != 0

        def coordinate(v: Column, j: Column) -> Column:
            head = F.when(is_set, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(swap))
            return F.when(j == 0, head).when((j == i) & ~is_set, v.bitwiseXOR(swap)).otherwise(v)

        return F.transform(acc, coordinate)

    if steps is not None:
        x = F.aggregate(steps, x, excess)
    powers = F.array(*[F.lit(2**q).cast("long") for q in range(bits - 1, -1, -1)])

    def gray(x: Column) -> Column:
        """Each coordinate takes in the ones before it."""
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))

    def flip(x: Column) -> Column:
        last = F.element_at(x, -1)
        fix = F.aggregate(powers, F.lit(0).cast("long"), lambda a, p: F.when(last.bitwiseAND(p) != 0, a.bitwiseXOR(p - 1)).otherwise(a))
        return _let(fix, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def interleave(x: Column) -> Column:
        return F.aggregate(powers, F.lit(0).cast("long"), lambda a, p: F.aggregate(x, a, lambda b, v: b * 2 + F.when(v.bitwiseAND(p) != 0, 1).otherwise(0)))

    return _let(x, lambda x: _let(gray(x), lambda y: _let(flip(y), interleave)))


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once: inside a lambda every use of an expression would be worked out again."""
    return F.transform(F.array(value), body)[0]


def _power(q: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), q.cast("int"))


def category(value: Column, bits: int) -> Column:
    """A category's code: the leading hex digit of its md5, so rows of one category share a coordinate. Null is 0."""
    assert bits <= 4
    digit = F.conv(F.substring(F.md5(F.encode(value.cast("string"), "UTF-8")), 1, 1), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", digit, F.lit(4 - bits)), F.lit(0))


def magnitude(value: Column, bits: int) -> Column:
    """A count's code: the binary logarithm, rounded down and kept in range, so that all from 2 ** (2 ** bits - 1) on share a code. Null and what is below 1 is 0."""
    top = 2**bits - 1
    return F.coalesce(F.least(F.greatest(F.floor(F.log2(F.greatest(value.cast("double"), F.lit(1.0)))), F.lit(0)), F.lit(top)).cast("int"), F.lit(0))


def shard_by_curve(df: DataFrame, cell: Column, spread: Column, tie: list[Column], shards: int) -> DataFrame:
    """Adds curve rank, shard and slot: equal runs of the curve order, whose row counts differ by one at most.

    The order is (cell, spread, tie); rows that tie in all of these are alike for the
    order and any of them may come first. An empty table gives no rows.
    """
    rows = df.withColumn("_cell", cell).withColumn("_spread", spread.cast("int"))
    counts = rows.groupBy("_cell", "_spread").agg(F.count(F.lit(1)).alias("_n"))
    # Two levels: a running sum inside each cell, then one over the cells alone.
    inside = Window.partitionBy("_cell").orderBy("_spread").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_n")
    cells = counts.groupBy("_cell").agg(F.sum("_n").alias("_m"))
    along = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("_cell", F.coalesce(F.sum("_m").over(along), F.lit(0)).alias("_base"), F.sum("_m").over(whole).alias("_total"))
    # At most one row for each cell of the grid, whatever the input.
    starts = before.join(F.broadcast(cells), "_cell").select("_cell", "_spread", (F.col("_base") + F.col("_in")).alias("_start"), "_total")
    own = Window.partitionBy("_cell", "_spread").orderBy(*tie)
    ranked = rows.withColumn("_r", F.row_number().over(own).cast("long") - 1).join(starts, ["_cell", "_spread"])
    rank = F.col("_start") + F.col("_r")
    first = lambda s: F.expr(f"({s} * _total + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("curve_rank", rank)
        .withColumn("shard", F.expr(f"cast(curve_rank * {shards} div _total as int)"))
        .withColumn("slot", F.col("curve_rank") - first("shard"))
        .drop("_r", "_start", "_total", "_spread")
        .withColumnRenamed("_cell", "curve")
    )


def shard_documents(docs: DataFrame, shards: int = 16, bits: int = 4) -> DataFrame:
    """Documents in `shards` equal runs along the curve over language, source and length.

    Null dimensions take coordinate 0 and null texts have size 1 and the checksum of
    an empty text. Inside a cell rows are in runs by the text's checksum, so equal texts
    of one cell lie in one run; a run is in parts by id, so that a text which fills a
    third of the table is not ordered by one task. Only the named columns are read, so others may have any name.
    """
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    cell = hilbert_index([category(F.col("lang"), bits), category(F.col("source"), bits), magnitude(F.col("n_chars"), bits)], bits)
    rows = docs.select("doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), "lang", "source", "n_chars")
    by_id = F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(SPLIT))
    spread = F.pmod(F.col("text_crc32"), F.lit(SPREAD)) * SPLIT + by_id
    return shard_by_curve(rows, cell, spread, [F.col("text_crc32"), F.col("size"), F.col("doc_id")], shards)


def op10_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart."""
    from tidemark.llm.common import table

    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
