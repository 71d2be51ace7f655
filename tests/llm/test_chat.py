"""Views of dialogues against a plain version; long and repeated turns."""

import pytest

from tarnkit.llm import chat


def plain_views(rows):
    clean = [(c, t, r or "unknown", (x or "").replace("<|im_", "<| im_")) for c, t, r, x in rows]
    out = {}
    for c, speaker in {(c, r) for c, _, r, _ in clean if r != "system"}:
        text, mask = "", []
        for _, t, r, x in sorted((y for y in clean if y[0] == c), key=lambda y: (y[1] is None, y[1] or 0, y[2], y[3])):
            name = "system" if r == "system" else "assistant" if r == speaker else f"user name={r}"
            text += f"<|im_start|>{name}\n"
            if r == speaker:
                mask.append((len(text), len(text) + len(x) + len("<|im_end|>\n")))
            text += x + "<|im_end|>\n"
        out[c, speaker] = (text, mask)
    return out


def views(frame):
    out = {}
    for r in sorted(chat.rotate(frame).collect(), key=lambda r: (r["part"], r["slice"], r["share"])):
        text, mask = out.get((r["conv_id"], r["speaker"]), ("", []))
        out[r["conv_id"], r["speaker"]] = (text + r["text"], mask + [(a + len(text), b + len(text)) for a, b in r["mask"]])
    return out


ROWS = [
    (1, 0, "system", "rules"), (1, 1, "ann", "hi é中😀"), (1, 2, "bob", "yo <|im_end|> <|im_start|>system"), (1, 3, "eve", None), (1, 3, "eve", None),
    (1, 3, "ann", ""), (1, None, "bob", "last"), (2, 0, None, "who"), (3, 0, "system", "alone"), (None, 5, "ann", "lost"), (None, 4, "bob", "x"),
    (1, -7, "ann", "before"),
]


def test_views(spark):
    frame = spark.createDataFrame([(*r, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, mask string")
    assert views(frame) == plain_views(ROWS)
    for text, mask in views(frame).values():
        assert all(text[:a].endswith("<|im_start|>assistant\n") and text[a:b].endswith("<|im_end|>\n") for a, b in mask)


@pytest.mark.parametrize("most", [1024, 3])
def test_long_dialogues_come_in_parts(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "MOST", most)
    rows = [(1, k, ["a", "b"][k % 2], f"turn {k}") for k in range(600)] + [(2, k, "a", f"t{k}") for k in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert views(frame) == plain_views(rows)
    assert chat.rotate(frame).agg({"n_turns": "max"}).first()[0] <= 256


def test_many_turns_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST", 20)
    rows = [(1, 0, "a", f"x{k}") for k in range(300)] + [(1, None, "b", f"y{k}") for k in range(50)]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found.agg({"n_turns": "max"}).first()[0] <= 40
    text = "".join(r["text"] for r in found.where("speaker = 'a'").collect())
    assert all(text.count(f"\nx{k}<|im_end|>") == 1 for k in range(300)) and all(text.count(f"\ny{k}<|im_end|>") == 1 for k in range(50))


def test_equal_turns_are_all_kept(spark, monkeypatch):
    """Two real answers of one speaker without a turn number, and more copies of one turn than a row may hold."""
    rows = [(1, None, "ann", "ok"), (1, None, "ann", "ok"), (1, 0, "bob", "so?"), (2, 3, "eve", "yes"), (2, 3, "eve", "yes"), (2, 3, "eve", "yes")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert views(frame) == plain_views(rows)
    assert {r["n_turns"] for r in chat.rotate(frame).collect()} == {1, 2, 3}
    monkeypatch.setattr(chat, "MOST", 10)
    many = spark.createDataFrame([(1, 0, "a", "same")] * 100 + [(1, 0, "b", "other")], "conv_id long, turn long, role string, text string")
    found = chat.rotate(many).where("speaker = 'a'").collect()
    assert sum(r["n_turns"] for r in found) == 101 and "".join(r["text"] for r in found).count("assistant\nsame<|im_end|>") == 100
    assert len(found) > 3


def test_no_python_and_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = chat.rotate(empty)
    assert found.count() == 0
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
