"""Order-dependent work on groups of any size.

``Window.partitionBy(group)`` puts a whole group into one task. When one group may hold a third of all
rows that task is the job. Here the ordering column of such big groups is cut into *pieces* at approximate
quantiles, and windows run over (group, piece), so that no window partition holds more than about
``rows / pieces`` rows, however the rows are spread over groups. Where no group is big, the window is a plain
one. What a piece needs to know about earlier
pieces of its group arrives as extra rows unioned into it:

* ``running``, ``midranks``: one header row with the totals of all earlier pieces (sums, minima, maxima);
* ``trailing``: the last ``span`` rows before the piece, for lags and trailing frames.

Both give exactly what the plain window gives. Headers and carried rows are bounded by
groups x pieces (x span) and are found with map-side aggregation or a pre-shuffle group limit.

The order column is a number, a date, a timestamp or text (in byte order). Split points of text are values of a
random sample of rows; a row finds its piece by binary search among them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tarnkit.operators.joins import equi_join
from tarnkit.session import shuffle_pieces

_ORDER, _PIECE, _PART, _KIND = "_order", "_piece", "_part", "_kind"
_SAMPLED = 8  # sampled texts for each piece


def _is_ordinal(df: DataFrame, name: str) -> bool:
    kinds = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return isinstance(df.schema[name].dataType, kinds)


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def order_number(df: DataFrame, name: str, descending: bool = False, absolute: bool = False) -> Column:
    """An increasing number for a numeric, date or timestamp column; text as it is, ``descending`` or not.

    ``absolute`` orders numbers by their distance from zero.
    """
    kind = df.schema[name].dataType
    column = F.col(name)
    if absolute and not isinstance(kind, T.NumericType):
        raise TypeError(f"{name} must be a number to be ordered by absolute value")
    if absolute:
        column = F.abs(column)
    if _is_text(df, name):
        return column
    if not _is_ordinal(df, name):
        raise TypeError(f"{name} must be a number, date, timestamp or text to be cut into pieces")
    if isinstance(kind, T.DateType):
        column = F.unix_date(column)
    elif isinstance(kind, T.TimestampType):
        column = F.unix_micros(column)
    elif isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(F.to_date(column)).cast("long") * 86_400 + F.hour(column) * 3600 + F.minute(column) * 60
        micros = (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")  # fields of the wall clock: no zone enters
        column = seconds * 1_000_000 + micros
    return -column if descending else column


def quantile_splits(df: DataFrame, column: str, pieces: int) -> tuple[list, dict, int]:
    """Split points holding about equal row counts, the values too frequent to share a piece with the number of
    pieces each of them fills, and the number of pieces that missing values fill (0: they need none of their own).

    One scan of one column, which returns at most ``pieces`` numbers, or ``8 * pieces`` texts.
    """
    missing = F.count_if(F.col(column).isNull()).alias("missing")
    rows = F.count(F.lit(1)).alias("rows")
    if _is_text(df, column):
        counts = df.agg(missing, rows).first()
        found = df.select(column).filter(F.col(column).isNotNull()).orderBy(F.rand(1)).limit(_SAMPLED * pieces).collect()
        sample = sorted(r[0] for r in found)
        points = [sample[i * len(sample) // pieces] for i in range(1, pieces)] if sample else []
    else:
        probabilities = [i / pieces for i in range(1, pieces)]
        sketch = F.percentile_approx(F.col(column).cast("double"), probabilities, 8 * pieces)
        counts = df.agg(sketch.alias("points"), missing, rows).first()
        points = [v for v in counts["points"] or [] if math.isfinite(v)]
    hot = {v: n + 1 for v, n in Counter(points).items() if n > 1}
    return sorted({*points, *map(_next, hot)}), hot, counts["missing"] * pieces // max(counts["rows"], 1)


def _next(value: float | str) -> float | str:
    """The smallest value after this one."""
    return value + "\0" if isinstance(value, str) else math.nextafter(value, math.inf)


def _splits_up_to(column: Column, splits: Sequence[str]) -> Column:
    """How many of the sorted texts are not above the value, by binary search in one array."""
    steps = [1 << i for i in reversed(range(len(splits).bit_length()))]
    texts = F.array(*[F.lit(t) for t in splits])

    def step(at: Column, size: Column) -> Column:
        return F.when(F.get(texts, at + size - 1) <= column, at + size).otherwise(at)  # NULL beyond the last: not taken

    return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), step)


def _bucketed(df: DataFrame, column: str, output: str, splits: Sequence, descending: bool = False) -> DataFrame:
    """Number of the piece: 0 before the first split; len(splits) + 2 for missing values, which come last.

    Text pieces are counted backwards if ``descending`` (numbers are turned before).
    """
    if not splits:
        return df.withColumn(output, F.when(F.col(column).isNull(), 2.0).otherwise(0.0))
    last = F.lit(len(splits) + 2.0)
    if _is_text(df, column):
        piece = _splits_up_to(F.col(column), splits).cast("double")
        piece = len(splits) - piece if descending else piece
        return df.withColumn(output, F.when(F.col(column).isNull(), last).otherwise(piece))
    number = f"{output}_in"
    cut = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=number, outputCol=output, handleInvalid="keep")
    placed = cut.transform(df.withColumn(number, F.col(column).cast("double"))).drop(number)
    return placed.withColumn(output, F.coalesce(output, last))


def big_groups(df: DataFrame, keys: Sequence[str], pieces: int) -> DataFrame | None:
    """Keys of the groups with more than 1/pieces of all rows, or None. There are fewer than ``pieces``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # no Dataset.observe here: a session that has observed cannot serialise Spark ML's forests with their summaries
    total = counts.agg(F.sum("_n")).scalar()
    found = counts.filter(F.col("_n") * pieces > total).select(*keys).collect()
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    return df.sparkSession.createDataFrame(found, schema) if found else None


def _mark_big(df: DataFrame, keys: Sequence[str], big: DataFrame | None) -> DataFrame:
    if big is None:
        return df.withColumn("_big", F.lit(True))
    marked = equi_join(df, F.broadcast(big.withColumn("_found", F.lit(True))), keys, "left", null_safe=True)
    return marked.withColumn("_big", F.col("_found").isNotNull()).drop("_found")


def in_pieces(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    ties: Sequence[str] = (),
    pieces: int | None = None,
    weigh: DataFrame | None = None,
    descending: bool = False,
) -> tuple[DataFrame, bool]:
    """Add ``_order``, ``_piece`` and ``_part``; within keys, (piece, part, order, ties) sorts like (order, ties).

    Only groups with more than 1/pieces of all rows are cut; the second result tells whether there are any.
    A value frequent enough to fill a piece, and missing values, get a piece of their own, subdivided at quantiles
    of the first tie-break column among its rows when that is a number, date or timestamp. ``descending`` says that
    an order column of text is to be read backwards. Group sizes and split points come from ``weigh``, a cheaper table with the same keys and order column, if given; they decide the
    balance of the pieces, not the result.
    """
    pieces = pieces or shuffle_pieces(df.sparkSession)
    weigh = df if weigh is None else weigh
    df = df.withColumn(_ORDER, order)
    big = big_groups(weigh, keys, pieces) if keys else None
    if keys and big is None:
        return df.withColumns({_PIECE: F.lit(0.0), _PART: F.lit(0.0)}), False
    df = _mark_big(df, keys, big)
    weighed = _mark_big(weigh.withColumn(_ORDER, order), keys, big).filter("_big")
    splits, hot, missing = quantile_splits(weighed, _ORDER, pieces)
    backwards = descending and _is_text(df, _ORDER)
    df = _bucketed(df, _ORDER, _PIECE, splits, backwards)
    df = df.withColumn(_PIECE, F.when(F.col("_big"), F.col(_PIECE)).otherwise(0.0))
    if not ((hot or missing) and ties and _is_ordinal(df, ties[0])):
        return df.withColumn(_PART, F.lit(0.0)).drop("_big"), True
    own = [s in hot for s in [None, *splits]]
    own = [*(reversed(own) if backwards else own), False, True]
    is_hot = F.expr(f"array({', '.join(str(o).lower() for o in own)})")
    df = df.withColumn("_hot", F.col("_big") & is_hot[F.col(_PIECE).cast("int")])
    tie = order_number(df, ties[0]).cast("double")
    ends = df.filter("_hot").agg(F.min(tie), F.max(tie)).first()
    if ends[0] is None:
        return df.drop("_hot", "_big").withColumn(_PART, F.lit(0.0)), True
    share = (tie - F.lit(ends[0])) / F.lit(max(ends[1] - ends[0], 1e-300))
    share = F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0))  # missing tie-breaks sort first
    df = df.withColumn("_place", F.col(_PIECE) + share * 0.999)
    points, _, _ = quantile_splits(df.filter("_hot"), "_place", sum(hot.values()) + missing + 1)
    df = _bucketed(df, "_place", _PART, points)
    df = df.withColumn(_PART, F.when(F.col("_hot"), F.col(_PART)).otherwise(0.0))
    return df.drop("_hot", "_place", "_big"), True


def _drop_marks(df: DataFrame) -> DataFrame:
    return df.drop(_ORDER, _PIECE, _PART, _KIND)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    *,
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    peers: Mapping[str, Column] | None = None,
    descending: bool = False,
    absolute: bool = False,
    pieces: int | None = None,
    weigh: DataFrame | None = None,
) -> DataFrame:
    """Cumulative sums, minima and maxima within ``keys`` in ascending order, the row itself included.

    With ``ties``, (keys, order, ties) identifies a row and rows are taken one by one. Without, rows of equal
    order are taken together, and ``peers`` are sums over them. ``totals`` are sums over the whole group,
    repeated on each of its rows. Missing order values come last. ``descending`` turns the order of any type,
    ``absolute`` takes numbers by their distance from zero.
    """
    keys, ties = list(keys), list(ties)
    sums, mins, maxs, totals, peers = (dict(m or {}) for m in (sums, mins, maxs, totals, peers))
    if peers and ties:
        raise ValueError("peers are rows of equal order, so there can be no tie-break")
    inputs = {f"_in_{n}": col for group in (sums, mins, maxs, totals, peers) for n, col in group.items()}
    rows, cut = in_pieces(df, keys, order_number(df, order, descending, absolute), ties, pieces, weigh, descending)
    rows = rows.withColumns(inputs)
    along_order = F.desc_nulls_last(_ORDER) if descending and _is_text(df, order) else F.asc_nulls_last(_ORDER)

    def along(window: WindowSpec, kept: Mapping[str, WindowSpec]) -> dict[str, Column]:
        local = (window.rowsBetween if ties else window.rangeBetween)(Window.unboundedPreceding, Window.currentRow)
        equal = window.rangeBetween(Window.currentRow, Window.currentRow)
        return (
            {n: F.sum(f"_in_{n}").over(local) for n in sums}
            | {n: F.min(f"_in_{n}").over(local) for n in mins}
            | {n: F.max(f"_in_{n}").over(local) for n in maxs}
            | {n: F.sum(f"_in_{n}").over(kept.get("totals", local)) for n in totals}
            | {n: F.sum(f"_in_{n}").over(equal) for n in peers}
        )

    if not cut:
        group = Window.partitionBy(*keys)
        outputs = along(group.orderBy(along_order, *ties), {"totals": group})
        return _drop_marks(rows.withColumns(outputs).drop(*inputs))

    combine = {f"_in_{n}": F.sum for n in (*sums, *totals)} | {f"_in_{n}": F.min for n in mins}
    combine |= {f"_in_{n}": F.max for n in maxs}
    per_piece = rows.groupBy(*keys, _PIECE, _PART).agg(*[f(F.col(n)).alias(n) for n, f in combine.items()])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(_PIECE, _PART).rowsBetween(Window.unboundedPreceding, -1)
    header = per_piece.select(
        *keys,
        _PIECE,
        _PART,
        *[
            combine[n](F.col(n)).over(group if n[4:] in totals else earlier).alias(n)
            for n in combine
        ],
        F.lit(0).alias(_KIND),
    )
    whole = rows.withColumns({_KIND: F.lit(1)} | {f"_in_{n}": F.lit(None) for n in totals})
    mixed = whole.unionByName(header, allowMissingColumns=True)
    piece = Window.partitionBy(*keys, _PIECE, _PART)
    outputs = along(piece.orderBy(_KIND, along_order, *ties), {})
    result = mixed.withColumns(outputs).filter(F.col(_KIND) == 1)
    return _drop_marks(result.drop(*inputs))


def positions(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], name: str = "position", **options
) -> DataFrame:
    """Row number within ``keys`` in the order of (order, ties)."""
    return running(df, keys, order, ties, sums={name: F.lit(1).cast("bigint")}, **options)


def midranks(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "midrank", pieces: int | None = None
) -> DataFrame:
    """Average rank of every row within its group; NULL for NULL values, which enter no window.

    Rows are shuffled once and nothing is joined back. Rows of a value with a piece of its own all get the
    middle of that piece, so they may be spread over parts in any way; they are by the task that read them.
    """
    keys = list(keys)
    pieces = pieces or shuffle_pieces(df.sparkSession)
    missing = df.filter(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double"))
    df = df.filter(F.col(value).isNotNull())
    rows = df.withColumn(_ORDER, order_number(df, value))
    big = big_groups(df, keys, pieces) if keys else None
    splits, hot = [], {}
    if big is not None or not keys:
        rows = _mark_big(rows, keys, big)
        splits, hot, _ = quantile_splits(rows.filter("_big"), _ORDER, pieces)
        rows = _bucketed(rows, _ORDER, _PIECE, splits)
        rows = rows.withColumn(_PIECE, F.when(F.col("_big"), F.col(_PIECE)).otherwise(-1.0)).drop("_big")
    else:
        rows = rows.withColumn(_PIECE, F.lit(-1.0))
    counts = ", ".join(str(hot.get(s, 1)) for s in [None, None, *splits, None, None])
    parts = F.expr(f"array({counts})")[F.col(_PIECE).cast("int") + 1]
    per_piece = rows.groupBy(*keys, _PIECE).agg(F.count(_ORDER).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    header = per_piece.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *keys, _PIECE, "_before", "_n", (parts > 1).alias("_own"), F.lit(0).alias(_KIND),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias(_PART),
    )
    spread = rows.withColumn(_PART, F.pmod(F.spark_partition_id(), parts)).withColumn(_KIND, F.lit(1))
    mixed = spread.unionByName(header, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, _PIECE, _PART).orderBy(_KIND, F.col(_ORDER).asc_nulls_last())
    facts = {c: F.max(c).over(inside) for c in ("_before", "_n", "_own")} | {
        "_rank": F.rank().over(inside) - 1,
        "_peers": F.count(F.lit(1)).over(inside.rangeBetween(Window.currentRow, Window.currentRow)),
    }
    within = F.when(F.col("_own"), (F.col("_n") + 1) / 2).otherwise(F.col("_rank") + (F.col("_peers") - 1) / 2)
    ranked = mixed.withColumns(facts).filter(F.col(_KIND) == 1)
    ranked = ranked.withColumn(name, (F.col("_before") + within).cast("double"))
    return _drop_marks(ranked.drop("_before", "_n", "_own", "_rank", "_peers")).unionByName(missing)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    span: int,
    columns: Callable[[object], Mapping[str, Column]],
    ties: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Window columns that look back at most ``span`` rows within ``keys``.

    ``columns`` receives the ordered window and returns the columns to add: ``F.lag(x, k)`` with
    ``k <= span``, frames ``w.rowsBetween(-k, 0)`` with ``k <= span``, and ``F.row_number()``, which is
    exact up to ``span`` and larger than ``span`` from there on. (keys, order, ties) identifies a row.
    """
    keys, ties = list(keys), list(ties)
    rows, cut = in_pieces(df, keys, order_number(df, order), ties, pieces)
    if not cut:
        window = Window.partitionBy(*keys).orderBy(F.col(_ORDER).asc_nulls_last(), *ties)
        return _drop_marks(rows.withColumns(dict(columns(window))))
    place = [*keys, _PIECE, _PART]
    backwards = Window.partitionBy(*place).orderBy(F.col(_ORDER).desc_nulls_first(), *[F.desc(t) for t in ties])
    lasts = rows.withColumn("_back", F.row_number().over(backwards)).filter(F.col("_back") <= span)

    group = Window.partitionBy(*keys).orderBy(_PIECE, _PART)
    counts = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    through = F.sum("_n").over(group)
    bounds = counts.select(*place, (through - F.col("_n") + 1).alias("_first"), through.alias("_last"))
    bounds = bounds.select(*[F.col(c).alias(f"_b{c}") for c in place], "_first", "_last")
    same_keys = F.lit(True)
    for key in keys:
        same_keys = same_keys & F.col(key).eqNullSafe(F.col(f"_b{key}"))
    same_place = same_keys & (F.col(_PIECE) == F.col(f"_b{_PIECE}")) & (F.col(_PART) == F.col(f"_b{_PART}"))
    placed = lasts.join(bounds, same_place).withColumn("_at", F.col("_last") - F.col("_back") + 1)
    placed = placed.select(*rows.columns, "_at", F.explode(F.sequence(F.lit(1), F.lit(span))).alias("_ahead"))
    starts = F.col("_at") + F.col("_ahead") == F.col("_first")
    carried = placed.join(bounds, same_keys & starts).select(
        *[c for c in rows.columns if c not in (_PIECE, _PART)],
        F.col(f"_b{_PIECE}").alias(_PIECE),
        F.col(f"_b{_PART}").alias(_PART),
        F.lit(0).alias(_KIND),
    )
    mixed = rows.withColumn(_KIND, F.lit(1)).unionByName(carried)
    window = Window.partitionBy(*place).orderBy(_KIND, F.col(_ORDER).asc_nulls_last(), *ties)
    return _drop_marks(mixed.withColumns(dict(columns(window))).filter(F.col(_KIND) == 1))
