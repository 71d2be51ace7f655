"""Small awkward tables for the training-data operators."""

import random

import pytest

CLASHING = "ids array<int>, decoded string, row string, rate double, score double, piece int, pool string, body string, ref string, print string"


def prose(seed: int, words: int, letters: str = "etaoinshr") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, near copies, and extra columns with clashing names."""
    base = prose(1, 400)
    near = base.split(" ")
    near[200] = "changed"
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: prose(2, 120) + "\n" + base[300:700] + "\n" + prose(3, 90), 5: None, 6: "", 7: "\n \t",
        8: prose(4, 30_000), 9: "a" * 700, 10: "zzzzz " * 300, 11: "l'été 中文 <|endoftext|> 12²   x  y'll", 12: prose(5, 60, "xyzäöü"),
        13: "12 34 ... !", 14: "line of words here\n" * 40, 15: base[:150],
    }
    rows = [(k, x, ["en", "de", None][k % 3], ["web", None][k % 2], len(x or "")) for k, x in texts.items()]
    rows += [rows[0], rows[3], (None, base[:500], "en", None, None), (None, None, None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = [x.strip().split(" ", 1) for x in CLASHING.replace("array<int>", "array").split(",")]
    kinds = {"array": "array<int>"}
    from pyspark.sql import functions as F
    return plain.select("*", *[F.lit(None).cast(kinds.get(kind, kind)).alias(name) for name, kind in more]).repartition(3)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")
