"""Language by cross-parsing: the language whose labelled text needs the fewest normalised phrases to spell a text wins.

The suffix automaton of a language's labelled text follows the longest match of a text from left to right; where it cannot go
on, a phrase ends and the next begins. Phrases times the logarithm of the labelled length estimate the cross entropy. Automata
are fitted on a bounded sample: `sample_rows` different rows for each language, chosen by a hash of their ids and texts, and
`sample_letters` consecutive letters of each row, at a place chosen by the same hash. All rows are then parsed whole. Parses restart every
`PIECE` symbols, the same for all languages, so that a very long text is parsed side by side like many short ones.

Every letter of a sample is a symbol of its own. The `DENSE` most frequent have a column in the table of transitions; the
transitions by all others are looked up among sorted pairs of state and symbol.

Defined results: letters are lower-cased, all else after a letter counts as one space, at the end too. A null text and a text without a
letter have language `und` and score 0, like every text where nothing was learned. Among equal languages the first by name
wins. Null labels and null texts teach nothing. A null id counts as empty in the hash. Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.tables import cut, extended, short_batches, small_side

PIECE, SPACE, OTHER, DENSE, FEW = 1024, 0, 1, 250, 20
#: Rows and letters that are parsed side by side.
ROWS, LETTERS = 1024, 1 << 20


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state 0 first."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in nexts[p]:
            nexts[p][s] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(s) == q:
                    nexts[p][s] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


class Models:
    """Letters and, for all languages, one table: row and symbol to (next row's start, phrases that end).

    `keys` (row times the number of symbols, plus symbol) and `targets` are the transitions by symbols that the table has no column for.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        seen = Counter(c for texts in samples.values() for x in texts for c in x.lower() if c.isalpha())
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        self.symbol = {c: k + 2 for k, c in enumerate(letters)}
        self.symbols, self.width = len(letters) + 2, min(len(letters), DENSE) + 2
        rows: list[np.ndarray] = []
        rare: list[tuple[int, int]] = []
        self.starts, self.weights, base = [], [], 0
        for name in self.names:
            symbols: list[int] = []
            for text in samples[name]:
                coded = self.coded(text)
                symbols += [s for s, before in zip(coded, [-1, *coded]) if s != SPACE or before != SPACE]
            nexts = automaton(symbols)
            table = np.full((len(nexts), self.width), -1, np.int64)
            for state, steps in enumerate(nexts):
                for s, to in steps.items():
                    if s < self.width:
                        table[state, s] = to
                    else:
                        rare.append(((base + state) * self.symbols + s, (base + to) * self.width * 4))
            known = table >= 0
            first = np.where(known[0], table[0], 0)
            ended = np.where(known, 0, 1 + ~known[0][None, :])
            ended[0] = ~known[0]
            rows.append((np.where(known, table, first[None, :]) + base) * self.width * 4 + ended)
            self.starts.append(base * self.width)
            self.weights.append(np.log2(len(symbols) + 2))
            base += len(nexts)
        self.kind = np.int32 if base * self.width * 4 < 1 << 31 else np.int64
        self.table = np.concatenate(rows).ravel().astype(self.kind) if rows else np.zeros(0, self.kind)
        self.keys, self.targets = np.array(sorted(rare), np.int64).reshape(-1, 2).T.copy()

    def coded(self, text: str) -> list[int]:
        return [self.symbol.get(c, OTHER) if c.isalpha() else SPACE for c in text.lower()]

    def found(self, at: np.ndarray, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Entries of the table for rows' starts `at` by language and a symbol each; `begin` has each language's first row's start."""
        if self.symbols == self.width:
            return self.table[at + symbols]
        out = self.table[at + np.where(symbols < self.width, symbols, OTHER)]
        rare = np.flatnonzero(symbols >= self.width)
        if len(rare):
            here, first = at[:, rare], np.broadcast_to(begin, (len(begin), len(rare)))
            steps, known = self.sparse(here, symbols[rare])
            anew, starts = self.sparse(first, symbols[rare])
            ended = np.where(known, 0, np.where(here == first, 1, 2 - starts))
            out[:, rare] = np.where(known, steps, np.where(starts & (here != first), anew, first * 4)) + ended
        return out

    def sparse(self, at: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Targets of transitions by symbols without a column, and whether there are such."""
        wanted = at.astype(np.int64) // self.width * self.symbols + symbols
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.targets[place], self.keys[place] == wanted

    def alphabet(self) -> np.ndarray:
        """Symbol of each code point."""
        out = np.zeros(sys.maxunicode + 1, np.int32)
        for k in range(sys.maxunicode + 1):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                out[k] = self.symbol.get(low if len(low) == 1 else c, OTHER)
        return out


def phrases(models: Models, alphabet: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text by language, and each text's number of symbols (0: no letter)."""
    n = len(texts)
    letters = alphabet[np.frombuffer("".join(f"{x}\n" for x in texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    ends = np.cumsum([len(x) + 1 for x in texts])
    owner = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    kept = letters != SPACE
    kept[1:] |= letters[:-1] != SPACE
    symbols, owner = letters[kept], owner[kept]
    sizes = np.bincount(owner, minlength=n)
    pieces = -(-sizes // PIECE)
    of = np.repeat(np.arange(n), pieces)
    within = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(sizes) - sizes)[of] + within * PIECE
    lengths = np.minimum(PIECE, sizes[of] - within * PIECE)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, of = starts[order], lengths[order], of[order]
    languages = len(models.names)
    begin = np.array(models.starts, models.kind)[:, None]
    at = np.repeat(begin, len(of), axis=1)
    ended = np.zeros((languages, len(of)), np.int32)
    live = np.searchsorted(-lengths, -np.arange(1, PIECE + 1), side="right")
    for step in range(int(lengths[0]) if len(lengths) else 0):
        k = live[step]
        found = models.found(at[:, :k], symbols[starts[:k] + step], begin)
        ended[:, :k] += found & 3
        at[:, :k] = found >> 2
    ended += at != begin
    total = np.stack([np.bincount(of, x, minlength=n) for x in ended]) if languages else np.zeros((0, n))
    has_letter = np.bincount(owner, symbols != SPACE, minlength=n) > 0
    return total, np.where(has_letter, sizes, 0)


def crc_of(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 48,
        sample_letters: int = 500) -> Models:
    """Automata of the languages that occur, from a bounded sample of labelled rows."""
    place = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(7), F.col(text))
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    picked = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), place.alias("place"))
    bounds = cut(picked.groupBy("lang").agg(F.count("*").alias("rows")))
    bounds = small_side(bounds, bounds.count())
    share = F.least(F.lit(1.0), 4.0 * sample_rows / F.col("rows"))
    chosen = picked.join(bounds, "lang").where(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30))
    at = 1 + F.pmod("place", F.greatest(F.lit(1), F.length("text") - sample_letters)).cast("int")
    found = chosen.dropDuplicates(["lang", "place"]).select("lang", F.struct("place", F.substring("text", at, F.lit(sample_letters)).alias("part")).alias("x"))
    best = found.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("x")), 1, sample_rows).alias("x")).collect()
    samples = {row["lang"]: [x["part"] for x in row["x"]] for row in best}
    return Models({k: v for k, v in samples.items() if any(c.isalpha() for x in v for c in x)})


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch and their texts (the last column), at most `ROWS` and, but for one longer text, `LETTERS` at once."""
    begin, texts, size = 0, [], 0
    for k, x in enumerate(batch.column(batch.num_columns - 1)):
        text = x.as_py() or ""
        if texts and (len(texts) == ROWS or size + len(text) > LETTERS):
            yield batch.slice(begin, len(texts)), texts
            begin, texts, size = k, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield batch.slice(begin, len(texts)), texts


def predict(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns (key, *keep, lang_pred, score, rate, n_phrases, n_symbols): score is the margin to the next language, rate the bits for each symbol."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((models, models.alphabet()))
    names = [key, *keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, alphabet = shared.value
        weights = np.array(own.weights)[:, None]
        labels = [*own.names, "und"]
        for batch in batches:
            for part, texts in slices(batch):
                counts, sizes = phrases(own, alphabet, texts)
                bits = np.concatenate([counts * weights, np.full((2, part.num_rows), np.inf)])
                best = np.argmin(bits, axis=0)
                least, second = np.partition(bits, 1, axis=0)[:2]
                known = (sizes > 0) & np.isfinite(least)
                with np.errstate(invalid="ignore"):
                    score = np.where(known, np.where(np.isfinite(second), 1 - least / second, 1.0), 0.0)
                    rate = np.where(known, least / np.maximum(sizes, 1), 0.0)
                least_phrases = np.where(known, np.rint(least / weights[np.minimum(best, len(weights) - 1), 0]), 0) if len(weights) else np.zeros(len(best))
                best = np.where(known, np.minimum(best, len(own.names)), len(own.names))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([labels[x] for x in best], pa.string()), pa.array(score), pa.array(rate),
                     pa.array(least_phrases.astype(np.int64)), pa.array(sizes.astype(np.int64))],
                    names=[*names, "lang_pred", "score", "rate", "n_phrases", "n_symbols"])

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(
        work, extended(docs, names, "lang_pred string, score double, rate double, n_phrases long, n_symbols long"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """Rows (key, held_out, lang_pred, score, rate) of all documents, learned from those whose crc32 modulo `folds` is not 0."""
    held = (crc_of(key) % folds == 0).alias("held_out")
    models = fit(docs.where(crc_of(key) % folds != 0), key, text, lang)
    return predict(docs.select(key, text, held), models, key, text, ("held_out",)).drop("n_phrases", "n_symbols")


def limits(parsed: DataFrame) -> DataFrame:
    """Rows (language, most, root): most phrases a symbol and a root of symbols that parsed labelled documents suggest, by language and for all (null).

    The second is four standard deviations, by the median deviation or as of independent symbols. With it, documents need a number
    of phrases a symbol; the first is their median rate plus three times the distance from there to the 99th percentile of these
    numbers, at least 1.5 medians. A language with fewer than `FEW` documents has no limits of its own.
    """
    rows = parsed.select("n_phrases", "n_symbols", (F.col("n_phrases") / F.col("n_symbols")).alias("rate"), F.explode(
        F.array("lang_pred", F.lit(None).cast("string"))).alias("language"))
    middles = cut(rows.groupBy("language").agg(F.percentile_approx("rate", 0.5, 1000).alias("middle"), F.count("*").alias("n")).where(
        F.col("language").isNull() | (F.col("n") >= FEW)))
    few = middles.count()

    def beside(table: DataFrame) -> DataFrame:
        renamed = table.withColumnRenamed("language", "_of")
        return rows.join(small_side(renamed, few), F.col("language").eqNullSafe(F.col("_of"))).drop("_of", "n")

    apart = F.abs(F.col("rate") - F.col("middle")) * F.sqrt("n_symbols")
    deviation = F.greatest(F.sqrt(F.col("middle") * F.greatest(F.lit(0.0), 1 - F.col("middle"))), 1.4826 * F.percentile_approx(apart, 0.5, 1000))
    roots = cut(beside(middles).groupBy("language", "middle").agg((4 * deviation).alias("root")))
    needed = (F.col("n_phrases") - 1 - F.col("root") * F.sqrt("n_symbols")) / F.col("n_symbols")
    most = F.greatest(3 * F.percentile_approx(needed, 0.99, 1000) - 2 * F.col("middle"), 1.5 * F.col("middle"))
    return cut(beside(roots).groupBy("language", "middle", "root").agg(most.alias("most")).select("language", "most", "root"))


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most_bits: float = 8.0) -> DataFrame:
    """`docs` without texts that have no letter or need more phrases than the documents of their best language do.

    The limit (`limits`) comes from the labelled documents that are not learned from; it grows with the length, and by its root, as
    short texts vary. A document whose label is the predicted language stays. Where there are no labelled documents outside the sample,
    texts go that need more than `most_bits` a symbol. Where nothing was learned, only texts without a letter go.
    Only hashes of rows (128 bits of key and text) leave the parse; rows that go are taken from the table by them.
    """
    models = fit(docs.where(crc_of(key) % 5 != 0), key, text, lang)
    if not models.names:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    names = {"__row": F.xxhash64(key, text), "__again": F.xxhash64(F.lit(1), F.col(key), F.col(text))}
    own = docs.select(*[x.alias(c) for c, x in names.items()], F.col(lang).alias("__lang"), (crc_of(key) % 5 == 0).alias("__held"), F.col(text).alias("__whole"))
    parsed = cut(predict(own, models, "__row", "__whole", ("__again", "__lang", "__held")))
    good = F.col("lang_pred") != "und"
    known = limits(parsed.where(good & F.col("__held") & F.col("__lang").isNotNull()))
    count = known.count()
    if count:
        general = known.where("language is null").select(F.col("most").alias("_most"), F.col("root").alias("_root")).first()
        limited = parsed.join(small_side(known, count), F.col("lang_pred") == F.col("language"), "left")
        most, root = (F.coalesce(c, F.lit(general[f"_{c}"])) for c in ("most", "root"))
        fits = F.col("n_phrases") <= 1 + most * F.col("n_symbols") + root * F.sqrt("n_symbols")
    else:
        limited, fits = parsed, F.col("rate") <= most_bits
    stays = good & (fits | F.coalesce(F.col("__lang") == F.col("lang_pred"), F.lit(False)))
    gone = cut(limited.where(~stays).select(*names).distinct())
    return docs.withColumns(names).join(small_side(gone, gone.count()), list(names), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
