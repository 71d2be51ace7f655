"""Quality rules: base rules on words, and robust multivariate outliers by language and source.

Texts that pass the base rules become vectors of transformed statistics (`FEATURES`). For each language and source the minimum
covariance determinant is sought by concentration steps over all rows: the share `SHARE` of rows nearest to the present centre
gives the next centre and covariance, from two starts (medians with deviations, medians with the correlations of squashed
values), and the lower determinant wins. Distances are made consistent at their median. Rows further than the cutoff go.

All steps are grouped aggregates of a stored table; a group's parameters are one row. Groups of fewer than `MIN_ROWS` rows
are estimated together with the other small ones of their language, then with those of all languages; what is still fewer is kept.
`FLOORS` are standard deviations below which no feature counts as spread out: features that are zero in nearly all texts would
else reject every text that has a trace of them. Those of duplicate lines and repeated words are the resolution of these shares: one
line of 20, one repeated window (six words) of 120. The shares are taken as they are, so that traces stay small and much of either rejects.

Defined results: a null text has no words and fails the base rules, like an empty one. Null languages and sources are groups of
their own. Repeated rows count each. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.tables import cut, extended, small_side, unused

WORDS = re.compile("[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature: expression over the counts and the number of lines with a word, and the floor of its standard deviation.
FEATURES = {
    "word_length": ("ln(word_chars / n_words)", 0.06),
    "symbols": ("sqrt(n_symbols / word_chars)", 0.04),
    "dup_lines": ("n_dup_lines / n_lines", 0.05),
    "repeats": ("n_repeat_words / n_words", 0.05),
}
SHARE, MIN_ROWS, STEPS = 0.75, 100, 5
#: Fixed values of the chi-squared distribution with four degrees of freedom: median and quantile 0.9999.
CHI2_MEDIAN, CHI2_CUTOFF = 3.3567, 23.5127


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    repeated = 0
    if n > 2:
        ids: dict[str, int] = {}
        k = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        pair = np.unique(k[:-1] * len(ids) + k[1:], return_inverse=True)[1]
        _, of, count = np.unique(pair[:-1] * np.int64(len(ids)) + k[2:], return_inverse=True, return_counts=True)
        twice = count[of] > 1
        marked = np.zeros(n, bool)
        for shift in range(3):
            marked[shift:shift + len(twice)] |= twice
        repeated = int(marked.sum())
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Columns (key, *keep, counts, n_lines, base_failed) of each whole text."""
    names, columns = [key, *keep], [*COUNTS, "n_lines"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_counts(x.as_py()) for x in batch.column(len(names))], np.int64).reshape(-1, len(columns))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found.T.copy())], names=[*names, *columns])

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    picked = docs.select(*names, F.col(text).alias("__text"))
    return picked.mapInArrow(work, extended(docs, names, ", ".join(f"{c} long" for c in columns))).withColumn("base_failed", failed)


def pooled(rows: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> tuple[DataFrame, int]:
    """Rows with a column `pool`: their group if it has enough rows, else what small groups share, null if that is too small; number of groups."""
    whole = F.to_json(F.struct(*[F.col(g) for g in groups]), {"ignoreNullFields": "false"})
    first = F.to_json(F.struct(F.col(groups[0])), {"ignoreNullFields": "false"})
    sizes = cut(rows.groupBy(whole.alias("whole"), first.alias("first")).agg(F.count("*").alias("n")))
    small = sizes.where(F.col("n") < MIN_ROWS)
    wider = small.groupBy("first").agg(F.sum("n").alias("n_first"))
    rest = wider.where(F.col("n_first") < MIN_ROWS).agg(F.coalesce(F.sum("n_first"), F.lit(0))).first()[0]
    number = sizes.count()
    pools = sizes.join(small_side(wider, number), "first", "left").select("whole", F.when(F.col("n") >= MIN_ROWS, F.col("whole")).when(
        F.col("n_first") >= MIN_ROWS, F.concat(F.lit("rest of "), "first")).when(F.lit(rest >= MIN_ROWS), F.lit("rest")).alias("pool"))
    return rows.withColumn("whole", whole).join(small_side(pools, number), "whole").drop("whole"), number


def distance(names: list[str]) -> Column:
    """Squared distance of the features from a pool's centre: forward substitution in the Cholesky factor."""
    z: list[Column] = []
    for i, x in enumerate(names):
        off = F.col(x) - F.col("centre")[i]
        for k in range(i):
            off = off - F.col(f"l{i}{k}") * z[k]
        z.append(off / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for x in z:
        total = total + x * x
    return total


def parameters(moments: DataFrame, floors: list[float], keys: list[str], tasks: int) -> DataFrame:
    """Rows (keys, centre, Cholesky factor of the covariance in columns l00, l10, ..., logdet) from means and means of products."""
    p = len(floors)
    out = moments.withColumn("centre", F.col("mean"))
    for i in range(p):
        for j in range(i + 1):
            rest = F.col("products")[i * p + j] - F.col("mean")[i] * F.col("mean")[j] + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(p)), F.lit(0.0))
    return cut(out.withColumn("logdet", logdet).drop("mean", "products").coalesce(tasks))


def moments(rows: DataFrame, names: list[str], keys: list[str], given: Column) -> DataFrame:
    mean = F.array(*[F.avg(F.when(given, F.col(x))) for x in names])
    products = F.array(*[F.avg(F.when(given, F.col(x) * F.col(y))) for x in names for y in names])
    return rows.groupBy(*keys).agg(mean.alias("mean"), products.alias("products")).where(F.col("mean")[0].isNotNull())


def minimum_covariance(rows: DataFrame, names: list[str], floors: list[float], number: int) -> DataFrame:
    """Rows (pool, centre, factor, scale): the minimum-covariance-determinant estimate of each of up to `number` pools."""
    tasks = number // 5000 + 1
    middle = cut(rows.groupBy("pool").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"{x}_mid") for x in names]).coalesce(tasks))
    spread = rows.join(small_side(middle, number), "pool").groupBy("pool").agg(
        *[F.first(f"{x}_mid").alias(f"{x}_mid") for x in names],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"{x}_mid")), 0.5, 1000).alias(f"{x}_dev") for x in names])
    spread = cut(spread.coalesce(tasks))
    sd = {x: F.sqrt(F.pow(1.4826 * F.col(f"{x}_dev"), 2) + f * f) for x, f in zip(names, floors)}
    squashed = rows.join(small_side(spread, number), "pool").select("pool", F.lit("squashed").alias("start"), *[
        (F.tanh((F.col(x) - F.col(f"{x}_mid")) / sd[x]) * sd[x] + F.col(f"{x}_mid")).alias(x) for x in names])
    mean = F.array(*[F.col(f"{x}_mid") for x in names])
    plain = spread.select("pool", F.lit("deviations").alias("start"), mean.alias("mean"), F.array(*[
        F.col(f"{x}_mid") * F.col(f"{y}_mid") + (F.pow(1.4826 * F.col(f"{x}_dev"), 2) if x == y else F.lit(0.0))
        for x in names for y in names]).alias("products"))
    keys = ["pool", "start"]
    found = parameters(plain.unionByName(moments(squashed, names, keys, F.lit(True))), floors, keys, tasks)
    for _ in range(STEPS):
        near = rows.join(small_side(found, 2 * number), "pool").select(*keys, *names, distance(names).alias("d2"))
        bound = cut(near.groupBy(*keys).agg(F.percentile_approx("d2", SHARE, 1000).alias("bound")).coalesce(tasks))
        near = near.join(small_side(bound, 2 * number), keys)
        found = parameters(moments(near, names, keys, F.col("d2") <= F.col("bound")), floors, keys, tasks)
    factor = [f"l{i}{j}" for i in range(len(names)) for j in range(i + 1)]
    best = found.groupBy("pool").agg(F.min_by(F.struct("centre", *factor), F.struct("logdet", "start")).alias("x")).select("pool", "x.*")
    best = cut(best.coalesce(tasks))
    scale = rows.join(small_side(best, number), "pool").groupBy("pool").agg(F.percentile_approx(distance(names), 0.5, 1000).alias("half"))
    return cut(best.join(scale, "pool").withColumn("scale", F.greatest(F.col("half") / CHI2_MEDIAN, F.lit(1.0))).drop("half").coalesce(tasks))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Columns (key, counts, base_failed, distance, kept) of all documents; distance is null where nothing was estimated."""
    rows = cut(statistics(docs, key, text, groups))
    names, floors = list(FEATURES), [f for _, f in FEATURES.values()]
    passed = rows.where("not base_failed")
    dealt, number = pooled(passed, groups)
    vectors = cut(dealt.select(key, *COUNTS, "base_failed", "pool", *[F.expr(sql).alias(x) for x, (sql, _) in FEATURES.items()]))
    found = minimum_covariance(vectors.where("pool is not null").select("pool", *names), names, floors, number)
    scored = vectors.join(small_side(found, number), "pool", "left").select(
        key, *COUNTS, "base_failed", (distance(names) / F.col("scale")).alias("distance"))
    failed = rows.where("base_failed").select(key, *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CHI2_CUTOFF))
    return scored.unionByName(failed).withColumn("kept", kept)


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """`docs` without the rows that the rules reject. Rows equal in key, text and groups share a verdict.

    Rows are told apart by 128 bits of a hash of key, text and groups; the rejected ones are taken from the table by them.
    """
    row, again = unused(docs, "row", "again")
    marked = docs.withColumns({row: F.xxhash64(key, text, *groups), again: F.xxhash64(F.lit(1), *[F.col(c) for c in (key, text, *groups)])})
    place = F.struct(F.col(row).alias("row"), F.col(again).alias("again"))
    judged = judge(marked.select(place.alias("place"), F.col(text).alias("text"), *groups), "place", "text", groups)
    gone = cut(judged.where("not kept").select(F.col("place.row").alias(row), F.col("place.again").alias(again)).distinct())
    return marked.join(small_side(gone, gone.count()), [row, again], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
