"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.components import components
from daybook.session import durable

#: Vectors of at least this cosine are near duplicates.
LEAST = 0.93
#: A pair exactly at the bound meets in no table with this probability; a closer one with less.
MISS = 1e-4
#: Vectors that share a bucket on average when their directions are spread evenly.
MEAN_BUCKET = 512
#: A bucket of more vectors is cut into blocks of about this many; every two blocks are a task step.
BLOCK = 2_048
#: Tables whose buckets are shuffled before the next ones start: what bounds the disk.
TABLES_A_ROUND = 4
SEED = 12

_GROUP = ("label", "k1", "k2")


def tables_for(rows: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """Sign bits of a bucket and number of tables for so many vectors of one label.

    The bits grow with the logarithm of the rows, so that buckets don't; the tables follow from
    the chance that two vectors at the bound agree in all bits of one.
    """
    bits = min(30, max(1, math.ceil(math.log2(max(1, rows) / MEAN_BUCKET))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, 1 if agree >= 1 else math.ceil(math.log(miss) / math.log1p(-agree))


@functools.lru_cache(maxsize=8)
def _planes(width: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((n, width))


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values end to end, as doubles, and the length of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat, np.diff(column.offsets.to_numpy())


def _units(flat: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors; each is first brought near one by a power of two, which loses nothing."""
    x = flat.reshape(-1, width)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _signed(batch: pa.RecordBatch, bits: int, tables: int) -> pa.RecordBatch:
    """The batch with one more column: per table, the vector's sides of the planes as a number."""
    flat, lengths = _rows_of(batch.column("embedding"))
    starts = np.cumsum(lengths) - lengths
    found, powers = np.zeros((len(lengths), tables), dtype=np.int32), 1 << np.arange(bits)
    for width in np.unique(lengths):
        mine = np.flatnonzero(lengths == width)
        x = _units(flat[starts[mine][:, None] + np.arange(width)], int(width))
        sides = (x @ _planes(int(width), bits * tables).T >= 0).reshape(len(mine), tables, bits)
        found[mine] = sides @ powers
    offsets = pa.array(np.arange(len(lengths) + 1) * tables, pa.int32())
    signs = pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))
    return pa.record_batch([*batch.columns, signs], [*batch.schema.names, "signs"])


def _forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what the symmetric matrix ``near`` joins: one less than each part has."""
    left, a, b = near.any(axis=1), [], []
    for start in np.flatnonzero(left):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            i = todo.pop()
            met = np.flatnonzero(near[i] & left)
            left[met] = False
            a += [i] * len(met)
            b += met.tolist()
            todo += met.tolist()
    return a, b


def block_links(block: pa.Table, least: float, stripe: int = 256) -> pa.Table:
    """Links that one table adds: ``(a, NULL, n)`` the partners of a, ``(a, b, 0)`` a forest.

    A pair counts in the first table where it shares a bucket and in no later one; all cosines of
    the block are taken in double precision.  The forest has fewer links than the block has rows.
    """
    table, first, second = (block.column(c)[0].as_py() for c in ("t", "i", "j"))
    flat, lengths = _rows_of(block.column("embedding"))
    x = _units(flat, int(lengths[0]))
    signs = _rows_of(block.column("signs"))[0].reshape(len(x), -1).astype(np.int32)
    copies, side = block.column("copies").to_numpy(), block.column("mine").to_numpy()
    total, near = np.zeros(len(x), dtype=np.int64), np.zeros((len(x), len(x)), dtype=bool)
    for low in range(0, len(x), stripe):
        r, c = np.nonzero(x[low:low + stripe] @ x.T >= least)
        r += low
        new = (r < c) if first == second else (side[r] == first) & (side[c] == second)
        r, c = r[new], c[new]
        new = np.ones(len(r), dtype=bool)
        for earlier in range(table):
            new &= signs[r, earlier] != signs[c, earlier]
        r, c = r[new], c[new]
        np.add.at(total, r, copies[c])
        np.add.at(total, c, copies[r])
        near[r, c] = near[c, r] = True
    linked = np.flatnonzero(total)
    a, b = _forest(near)
    nodes = block.column("node").combine_chunks()
    n = np.concatenate([total[linked], np.zeros(len(a), dtype=np.int64)])
    return pa.table({"a": pa.concat_arrays([nodes.take(pa.array(linked)),
                                            nodes.take(pa.array(a, pa.int64()))]),
                     "b": pa.concat_arrays([pa.nulls(len(linked), nodes.type),
                                            nodes.take(pa.array(b, pa.int64()))]),
                     "n": pa.array(n)})


def _usable() -> Column:
    """Whether a row can link: labelled, with a finite vector that is not zero."""
    def finite(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    return F.coalesce(F.col("label").isNotNull() & F.forall("embedding", finite)
                      & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _partners(nodes: DataFrame, tables: range, least: float) -> DataFrame:
    """What the buckets of these tables add: rows of :func:`block_links`."""
    places = F.array(*[F.struct(F.lit(t).alias("t"), F.element_at("signs", t + 1).alias("bucket"))
                       for t in tables])
    bucket = ["label", "width", "t", "bucket"]
    rows = nodes.select("*", F.explode(places).alias("at")).select("*", "at.*").drop("at")
    hot = (rows.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
           .filter("blocks > 1"))
    dealt = (rows.join(hot, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
             .drop("blocks", "other"))
    node = nodes.schema["node"].dataType
    schema = T.StructType([T.StructField("a", node), T.StructField("b", node),
                           T.StructField("n", T.LongType())])
    return dealt.groupBy(*bucket, "i", "j").applyInArrow(
        lambda block: block_links(block, least), schema)


def close_vectors(vectors: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """Near duplicates among vectors: ``vec_id, n_links, component_id, kept``, one row per row.

    The project keeps no vectors of its own, so this stays general: ``vectors`` has ``vec_id``
    (any type with an order), ``embedding`` (an array of numbers) and ``label``; other columns are
    ignored.  Rows of one label and one width link when their cosine is ``least`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the least id reachable,
    ``kept`` says whether that is the row's own.

    Equal vectors are gathered first and searched once.  Each distinct one falls into one bucket a
    table, by its sides of that table's random planes; all cosines inside a bucket are taken.  A
    pair exactly at the bound is missed with probability ``miss``, a closer one with less; no pair
    below it is linked.  A bucket of any size is cut into blocks; counts leave a block as one row a
    vector and links as a forest, never as all pairs.  Tables are searched a few at a time, every
    round a checkpoint, so the shuffled copies of the vectors stay a small multiple of the input.

    A NULL label, and a vector that is NULL, empty, zero or holds NULL or a non-finite value, links
    with nothing.  Equal rows, of one id or of several, are linked; rows of one id with different
    vectors are vectors of their own.  A NULL id is never the least while there is another; rows of
    a component without any id are all kept.  Ties can't arise: the least id is unique.  An empty
    table gives an empty table.
    """
    keyed = vectors.select("vec_id", "label", "embedding").withColumns({
        "usable": _usable(), "k1": F.xxhash64("embedding"),
        "k2": F.xxhash64(F.lit(1), F.col("embedding"))})
    usable = keyed.filter("usable")
    most = vectors.filter("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()
    bits, tables = tables_for(most[0] or 0, least, miss)
    groups = usable.groupBy(*_GROUP).agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"),
        F.first("embedding").alias("embedding"))
    groups = groups.select(
        *_GROUP, "copies", F.size("embedding").alias("width"), "embedding",
        F.struct(F.col("low").isNull().alias("nameless"), "low", "k1", "k2").alias("node"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _signed(batch, bits, tables)

    nodes = durable(groups.mapInArrow(sign, T.StructType([
        *groups.schema.fields, T.StructField("signs", T.ArrayType(T.IntegerType()))])))
    slim = nodes.select("label", "width", "copies", "embedding", "signs", "node")
    rounds = [durable(_partners(slim, range(t, min(tables, t + TABLES_A_ROUND)), least))
              for t in range(0, tables, TABLES_A_ROUND)]
    found = functools.reduce(DataFrame.union, rounds)
    partners = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(
        F.sum("n").alias("partners"))
    parts = components(found.filter("b IS NOT NULL").select("a", "b"))
    told = (nodes.select(*_GROUP, "copies", "node").join(partners, "node", "left")
            .join(parts, "node", "left")
            .select(*_GROUP, (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
                    F.coalesce("component", "node")["low"].alias("component_id")))
    linked = usable.drop("embedding").join(told, list(_GROUP)).select(
        "vec_id", "n_links", "component_id")
    alone = keyed.filter("NOT usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
