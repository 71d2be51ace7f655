"""A log-bilinear language model, trained in numpy with noise-contrastive estimation, and log probabilities of whole texts.

Tokens are counted over all training texts. The `OWN` most frequent tokens and the end of text are units of their own, all
others belong to one of `CLASSES` classes by their last letters; a token's probability is that of its unit after the `CONTEXT`
units before it, times its share of the unit (counts plus 0.1, with one unknown token for each class). The unit is predicted by
the log-bilinear model: the context's vectors, weighted by position, add up to a prediction whose products with all unit
vectors, plus biases, are normalised by a batched matrix product.

Training takes all training texts: each task starts from the same parameters, takes noise-contrastive steps over its texts, and the
tasks' parameters are averaged, weighted by tokens, in rounds of bounded fan-in; a first round over a quarter of the texts gives
the second, over all, its start.

The `LISTED` most frequent tokens of at most `LETTERS` bytes go to all tasks with their counts; a text's other tokens meet
the count table in a join. Both give the same numbers; the list only keeps the common tokens out of the shuffle.

Defined results: a null text is an empty one, that is the end alone. Letters A-Z are lower-cased, words are runs without space or
control white space. With no training text, counts are 0 and units equally likely. A null id counts as empty in the hash.
Repeated rows are scored and counted each. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.langid import crc_of
from tarnkit.llm.tables import cut, extended

WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
OWN, CLASSES, CONTEXT, WIDTH = 191, 64, 3, 16
UNITS, END = OWN + 1 + CLASSES, OWN
LISTED, LETTERS, ADDED = 150_000, 64, 0.1
BATCH, NOISE, RATE, COUNTED, FAN_IN = 2048, 64, 0.15, 400_000, 256
#: Places of a unit's numbers in a flat table.
CELLS = np.arange(UNITS * WIDTH).reshape(UNITS, WIDTH)
#: Tokens that are scored at once, so that the products with all units stay in the processor's cache.
SCORED = 1024


def words_of(text: bytes | None) -> list[bytes]:
    return WORDS((text or b"").translate(LOWER))


def class_of(word: bytes) -> int:
    return OWN + 1 + crc32(word[-3:]) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (word, class, n) of all words in the column `body`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) >= COUNTED:
                    yield from flush(counts)
                    counts = Counter()
        yield from flush(counts)

    def flush(counts):
        words = list(counts)
        for k in range(0, len(words), 50_000):
            part = words[k:k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([class_of(w) for w in part], pa.int32()), pa.array([counts[w] for w in part], pa.int64())],
                names=["word", "class", "n"])

    return texts.mapInArrow(work, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of listed words, units and the sizes of units."""

    def __init__(self, listed: list[tuple[bytes, int]], texts: int, classes: dict[int, tuple[int, int]]):
        listed = sorted(listed, key=lambda x: (-x[1], x[0]))
        self.place = {w: k for k, (w, _) in enumerate(listed)}
        self.counts = np.array([n for _, n in listed] + [texts], np.int64)
        self.tokens = sum(n for n, _ in classes.values()) + texts
        self.distinct = sum(v for _, v in classes.values()) + (texts > 0)
        self.unit = np.array([k if k < OWN else class_of(w) for k, (w, _) in enumerate(listed)] + [END], np.int64)
        self.size = np.zeros(UNITS, np.int64)
        self.kinds = np.zeros(UNITS, np.int64)
        for k, (n, v) in classes.items():
            self.size[k], self.kinds[k] = n, v
        for k, (w, n) in enumerate(listed[:OWN]):
            self.size[k], self.kinds[k] = n, 1
            self.size[class_of(w)] -= n
            self.kinds[class_of(w)] -= 1
        self.size[END] = texts
        own = self.unit <= END
        self.share = np.where(own, 0.0, np.log10((self.counts + ADDED) / self.whole()[self.unit]))
        self.base = np.log10((self.counts + ADDED) / self.base_whole())

    def whole(self) -> np.ndarray:
        return self.size + ADDED * (self.kinds + 1)

    def base_whole(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place in the list (-1: not listed) and unit of each word, then of the end."""
        get = self.place.get
        places = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        units = self.unit[places]
        for k in np.flatnonzero(places < 0).tolist():
            units[k] = class_of(words[k])
        return np.append(places, len(self.counts) - 1), np.append(units, END)


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    classes = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    short = counts.where(F.octet_length("word") <= LETTERS)
    steps = short.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in steps:
        total += row["v"]
        if total > LISTED:
            break
        least = row["step"]
    listed = [] if least is None else short.where(F.floor(F.log2("n") * 16) >= least).select("word", "n").collect()
    return Vocabulary([(bytes(r["word"]), r["n"]) for r in listed], texts, classes)


class Model:
    """Unit vectors and biases, context vectors, and weights by position."""

    def __init__(self, sizes: np.ndarray):
        draw = np.random.default_rng(1)
        self.noise = ((sizes + 1.0) / (sizes + 1.0).sum()).astype(np.float64)
        self.out = draw.normal(0, 0.1, (UNITS, WIDTH)).astype(np.float32)
        self.seen = draw.normal(0, 0.5, (UNITS, WIDTH)).astype(np.float32)
        self.weight = np.array([[1 / (i + 1)] * WIDTH for i in range(CONTEXT)], np.float32)
        self.bias = np.log(self.noise).astype(np.float32)

    def names(self) -> list[str]:
        return ["out", "seen", "weight", "bias"]

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.names()])

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for n in self.names():
            shape = getattr(self, n).shape
            size = math.prod(shape)
            setattr(self, n, values[at:at + size].reshape(shape).astype(np.float32))
            at += size

    def predicted(self, context: np.ndarray) -> np.ndarray:
        return self.added([self.seen[context[:, i]] for i in range(CONTEXT)])

    def added(self, vectors: list[np.ndarray]) -> np.ndarray:
        """The weighted sum of the context's vectors, position by position."""
        total = vectors[0] * self.weight[0]
        for i in range(1, CONTEXT):
            total += vectors[i] * self.weight[i]
        return total

    def log_probabilities(self, context: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of units after their contexts."""
        out = np.concatenate([self.out, self.bias[:, None]], axis=1).T.copy()
        found = []
        for k in range(0, len(units), SCORED):
            h = self.predicted(context[k:k + SCORED])
            scores = np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1) @ out
            scores -= scores.max() - 40
            own = scores[np.arange(len(h)), units[k:k + SCORED]].astype(np.float64)
            sums = np.exp(scores, out=scores).sum(axis=1, dtype=np.float64)
            found.append(own - np.log(sums))
        return np.concatenate(found) if found else np.zeros(0)


class Trainer:
    """Noise-contrastive steps with step sizes that fall with the gradients seen."""

    def __init__(self, model: Model, seed: int):
        self.model, self.draw = model, np.random.default_rng(seed)
        self.past = {n: np.full(getattr(model, n).shape, 1e-2, np.float32) for n in model.names()}
        self.offset = np.log(NOISE * model.noise).astype(np.float32)

    def step(self, context: np.ndarray, units: np.ndarray) -> None:
        m, n = self.model, len(units)
        noise = self.draw.choice(UNITS, NOISE, p=m.noise)
        vectors = [m.seen[context[:, i]] for i in range(CONTEXT)]
        h = m.added(vectors)
        own, others = m.out[units], m.out[noise]
        data = (h * own).sum(axis=1) + m.bias[units] - self.offset[units]
        down = h @ others.T
        down += m.bias[noise] - self.offset[noise]
        np.clip(down, -30, 30, out=down)
        np.exp(np.negative(down, out=down), out=down)
        down += 1
        np.divide(-1, down, out=down)
        up = 1 / (1 + np.exp(np.clip(data, -30, 30)))
        toward = up[:, None] * own + down @ others
        gradient = {n: np.zeros_like(getattr(m, n)) for n in m.names()}
        gradient["bias"] += np.bincount(units, up, UNITS).astype(np.float32)
        np.add.at(gradient["bias"], noise, down.sum(axis=0))
        gradient["out"] += summed(units, up[:, None] * h)
        np.add.at(gradient["out"], noise, down.T @ h)
        for i in range(CONTEXT):
            gradient["seen"] += summed(context[:, i], toward * m.weight[i])
            gradient["weight"][i] = (toward * vectors[i]).sum(axis=0)
        for name, g in gradient.items():
            g /= n
            self.past[name] += g * g
            setattr(m, name, getattr(m, name) + RATE * g / np.sqrt(self.past[name]))


def summed(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of value rows by unit."""
    width = values.shape[1]
    return np.bincount(CELLS[rows].ravel(), values.ravel(), UNITS * width).reshape(UNITS, width).astype(np.float32)


def contexts(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (the unit before first) and units of texts, one after another; before a text stands the end."""
    flat = np.concatenate(units).astype(np.int64)
    starts = np.cumsum([0, *map(len, units)])[:-1]
    context = np.empty((len(flat), CONTEXT), np.int64)
    for i in range(CONTEXT):
        context[i + 1:, i] = flat[:max(len(flat) - i - 1, 0)]
        for k in range(i + 1):
            context[np.minimum(starts + k, len(flat) - 1)[starts + k < np.append(starts[1:], len(flat))], i] = END
    return context, flat


def train(texts: DataFrame, sizes: np.ndarray, model: Model) -> Model:
    """The average of the parameters that tasks reach from `model`, each over its texts (column `units`)."""
    shared = texts.sparkSession.sparkContext.broadcast((sizes, model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begun = shared.value
        own = Model(known)
        own.unpack(begun.packed())
        part = TaskContext.get().partitionId()
        trainer, held, tokens, size = Trainer(own, part), [], 0, 0
        for batch in batches:
            for coded in batch.column(0):
                units = np.frombuffer(coded.as_py(), np.uint8)
                held.append(units)
                size += len(units)
                if size >= 32 * BATCH:
                    tokens += steps(trainer, held)
                    held, size = [], 0
        if held:
            tokens += steps(trainer, held)
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([own.packed().astype("<f4").tobytes()], pa.binary())],
                names=["part", "tokens", "values"])

    def steps(trainer, held):
        context, units = contexts(held)
        order = trainer.draw.permutation(len(units))
        for k in range(0, len(units), BATCH):
            trainer.step(context[order[k:k + BATCH]], units[order[k:k + BATCH]])
        return len(units)

    def average(table: pa.Table) -> pa.Table:
        tokens, values = merged(zip(table.column("tokens").to_pylist(), table.column("values").to_pylist()))
        return pa.table({"part": table.column("part").slice(0, 1), "tokens": [tokens], "values": [values]},
                        schema=pa.schema([("part", pa.int64()), ("tokens", pa.int64()), ("values", pa.binary())]))

    kinds = "part long, tokens long, values binary"
    found, rows = texts.mapInArrow(work, kinds), max(1, texts.rdd.getNumPartitions())
    while rows > FAN_IN:
        rows = -(-rows // FAN_IN)
        found = found.groupBy(F.pmod(F.xxhash64("part"), F.lit(rows)).alias("group")).applyInArrow(average, kinds)
    tokens, values = merged((r["tokens"], bytes(r["values"])) for r in found.select("tokens", "values").collect())
    out = Model(sizes)
    out.unpack(np.frombuffer(values, "<f4") if tokens else model.packed())
    return out


def merged(parts) -> tuple[int, bytes]:
    total, sums = 0, 0.0
    for tokens, values in parts:
        total += tokens
        sums = sums + tokens * np.frombuffer(values, "<f4").astype(np.float64)
    return total, (sums / max(total, 1)).astype("<f4").tobytes() if total else b""


def code(texts: DataFrame, words: Vocabulary, keep: list[str]) -> DataFrame:
    """Columns `keep`, n_tokens, units (one byte each), known, base and share as far as the list goes, and the other words with class and number."""
    shared = texts.sparkSession.sparkContext.broadcast(words)
    more = ("n_tokens long, n_known long, base double, listed double, units binary, "
            "rest array<struct<word:binary,class:int,n:int>>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        rest_kind = pa.list_(pa.struct([("word", pa.binary()), ("class", pa.int32()), ("n", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rest_kind)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows: list[tuple] = []
                for text in part.column(len(keep)):
                    found = words_of(text.as_py())
                    places, units = known.coded(found)
                    here = places[places >= 0]
                    rest = Counter(found[i] for i in np.flatnonzero(places < 0).tolist())
                    rows.append((len(places), int((known.counts[here] > 0).sum()), float(known.base[here].sum()), float(known.share[here].sum()),
                                 units.astype(np.uint8).tobytes(), [{"word": w, "class": class_of(w), "n": n} for w, n in rest.items()]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *[pa.array(x, t) for x, t in zip(zip(*rows), kinds)]],
                    names=[*keep, "n_tokens", "n_known", "base", "listed", "units", "rest"])

    return texts.select(*keep, "body").mapInArrow(work, extended(texts, keep, more))


def unit_scores(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` and `unit_score`, the log10 probability of each row's units."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                units = [np.frombuffer(x.as_py(), np.uint8) for x in part.column(len(keep))]
                logs = own.log_probabilities(*contexts(units))
                sums = np.add.reduceat(logs, np.cumsum([0, *map(len, units[:-1])])) / math.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sums)], names=[*keep, "unit_score"])

    return rows.select(*keep, "units").mapInArrow(work, extended(rows, keep, "unit_score double"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Rows (key, held_out, n_tokens, n_known, train_tokens, base_score, score), learned where crc32 of the key modulo `folds` is not 0."""
    crc = crc_of(key)
    texts = docs.select(key, (crc % folds == 0).alias("held_out"), F.pmod(F.floor(crc / folds), F.lit(4)).alias("share"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    learned = texts.where("not held_out")
    counts = cut(count_words(learned.select("body")))
    words = vocabulary(counts, learned.count())
    rows = cut(code(texts, words, [key, "held_out", "share"])).withColumn("row", F.monotonically_increasing_id())
    model = train(rows.where("not held_out and share = 0").select("units"), words.size, Model(words.size))
    model = train(rows.where("not held_out").select("units"), words.size, model)
    rest = rows.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.class", "x.n")
    met = rest.join(counts.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = F.element_at(F.array(*[F.lit(float(x)) for x in words.whole()]), F.col("class") + 1)
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + ADDED) / F.lit(float(words.base_whole())))).alias("more_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + ADDED) / whole)).alias("more_listed"))
    zero = F.lit(0)
    scored = unit_scores(rows, model, ["row", key, "held_out", "n_tokens", "n_known", "base", "listed"])
    return scored.join(more, "row", "left").select(
        key, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("unit_score") + F.col("listed") + F.coalesce("more_listed", zero)).alias("score"))
