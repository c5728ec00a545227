"""Aggregation of fixed-width float arrays.

A vector is cut into lanes of at most ``LANE`` numbers; every number of a lane
is one aggregate of the same ``groupBy``, so partial aggregation on the map
side shrinks a hot group before the shuffle and no row per dimension is made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.text import let

LANE = 64


def lane_aggregate(df: DataFrame, keys: Sequence[str], vector: str, width: int,
                   number: Callable[[Column], Column], extra: Sequence[Column] = (),
                   name: str = "features") -> DataFrame:
    """Group by ``keys`` and aggregate the vector element by element.

    ``number`` builds the aggregate of one element from its Column. A vector of
    another length is an error; null vectors are left out.
    """
    sized = F.when(F.size(vector) == width, F.col(vector)).when(F.col(vector).isNotNull(), F.raise_error(
        F.concat(F.lit(f"a vector of {width} numbers is wanted, not of "), F.size(vector).cast("string"))).cast("array<double>"))
    df = df.withColumn(vector, sized)
    if width <= LANE:
        cells = [number(F.get(F.col(vector), F.lit(i))).alias(f"__v{i}") for i in range(width)]
        out = df.groupBy(*keys).agg(*cells, *extra)
        packed = F.array(*[F.col(f"__v{i}") for i in range(width)]).alias(name)
        return out.select(*[c for c in out.columns if not c.startswith("__v")], packed)

    lanes = -(-width // LANE)
    split = (df.withColumn("__lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
               .withColumn("__part", F.slice(F.col(vector), F.col("__lane") * LANE + 1, LANE)))
    cells = [number(F.get(F.col("__part"), F.lit(i))).alias(f"__v{i}") for i in range(LANE)]
    grouped = split.groupBy(*keys, "__lane").agg(*cells, *extra)
    extras = [c for c in grouped.columns if c not in {*keys, "__lane"} and not c.startswith("__v")]
    packed = grouped.select(*keys, "__lane", *extras,
                            F.array(*[F.col(f"__v{i}") for i in range(LANE)]).alias("__part"))
    # Each key has exactly `lanes` rows here.
    joined = packed.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("__lane", "__part"))).alias("__parts"),
        *[F.max(c).alias(c) for c in extras])
    flat = F.flatten(F.transform("__parts", lambda p: p["__part"]))
    return joined.select(*keys, *extras, F.slice(flat, 1, width).alias(name))


def scaled(vector: str, factor: Column) -> Column:
    """Vector times a number, element by element."""
    return F.transform(F.col(vector), lambda x: x * factor)


def unit_length(vector: Column) -> Column:
    """Vector divided by its Euclidean length (zero vectors stay zero)."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return let(norm, lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
