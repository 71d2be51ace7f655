"""Alignment and link counts against plain versions with the tokenizers' own libraries."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tarnkit.llm import alignment, bpe

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain_groups(a, b):
    """Groups of indices between ends that both lists have, and all pairs of overlapping ranges."""
    common = sorted(set(a) & set(b))
    bounds = [(x, y) for x, y in zip([0, *common], common)]
    groups = [([i for i, e in enumerate(a) if x < e <= y], [j for j, e in enumerate(b) if x < e <= y]) for x, y in bounds]
    ranges = [list(zip([0, *x], x)) for x in (a, b)]
    links = [(i, j) for i, (p, q) in enumerate(ranges[0]) for j, (r, s) in enumerate(ranges[1]) if max(p, r) < min(q, s)]
    return groups, links


def test_alignment_of_random_ends():
    draw = random.Random(4)
    for _ in range(500):
        n = draw.randint(1, 60)
        share = draw.choice([0.2, 0.7, 0.95, 1.0])
        a = sorted({n, *(k for k in range(1, n) if draw.random() < share)})
        b = sorted({n, *(k for k in range(1, n) if draw.random() < draw.choice([share, 1.0]))})
        a_bounds, b_bounds, one, other = alignment.align(np.array(a, np.int32), np.array(b, np.int32), draw.choice([1, 2, 8]))
        groups, links = plain_groups(a, b)
        spread = [(list(range(i, k)), list(range(j, m))) for i, k, j, m in zip([0, *a_bounds], a_bounds, [0, *b_bounds], b_bounds)]
        assert spread == groups
        single = [(i[0], j[0]) for i, j in groups if len(i) == len(j) == 1]
        found = [*zip(one.tolist(), other.tolist())]
        assert sorted({*found, *single}) == sorted(links) and len(found) == len(set(found))


def libraries():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    a.no_truncation()
    return a, b


def test_texts_encode_as_the_libraries_do():
    own = alignment.Tokenizers(alignment.read_source(PATHS[0]), open(PATHS[1], "rb").read())
    a, b = libraries()
    draw = random.Random(8)
    texts = ["".join(draw.choice("ab  \n\té日\u3000\xa0\0'.<s>0x") for _ in range(draw.randint(1, 40))) for _ in range(2000)]
    texts += ["<|endoftext|> x <s>", " ", "a ", "  a", "\n", "ﬁ ①½ 日本語", "word " * 500, "x" * 3000]
    for text in texts:
        ids = own.encode(text)
        assert ids[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert ids[1].tolist() == b.encode(text), repr(text)
    assert own.encode("") is None and own.encode(None) is None and own.encode("a▁b") is None


def test_each_token_encodes_to_itself():
    """Then ranks and merges agree: what stands between two token ends was merged as it is merged alone."""
    words = bpe.Vocabulary(alignment.read_source(PATHS[0]))
    ids = [words.automaton.get(x.decode("latin-1")) for x in words.tokens[:50256]]
    assert ids == list(range(50256))
    for k, (a, b) in enumerate(words.parts[:50256]):
        assert a < 0 or words.tokens[a] + words.tokens[b] == words.tokens[k] and not words.stands(a, b)
    for k, x in enumerate(words.tokens[:50256]):
        parts = [(x[:n], x[n:]) for n in range(1, len(x))]
        for left, right in parts:
            pair = words.automaton.get(left.decode("latin-1"), -1), words.automaton.get(right.decode("latin-1"), -1)
            assert min(pair) < 0 or not words.stands(*pair), x


def plain_rows(rows):
    a, b = libraries()
    lengths = [[len(x) for x in own] for own in (
        bpe.Vocabulary(alignment.read_source(PATHS[0])).tokens,
        [b"x" if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())])]
    texts, pairs = [], Counter()
    for key, text in rows:
        if not text or "▁" in text:
            texts.append((key, [], [], [], []))
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        groups, links = plain_groups(*(np.cumsum([n[k] for k in x]).tolist() for n, x in zip(lengths, ids)))
        linked = [(ids[0][i], ids[1][j]) for i, j in links]
        pairs.update(set(linked))
        texts.append((key, *ids, groups, linked))
    best = {}
    for (i, _), n in pairs.items():
        best[i] = max(best.get(i, 0), n)
    for key, x, y, groups, linked in texts:
        listed = ";".join(",".join(str(x[i]) for i in p) + "|" + ",".join(str(y[j]) for j in q) for p, q in groups)
        yield (key, len(x), len(y), len(groups), len(linked), sum(pairs[p] == best[p[0]] for p in linked),
               sum(pairs[p] for p in linked), sha256(listed.encode()).hexdigest() if x else "")


def test_documents(documents):
    short = documents.where("length(coalesce(text, '')) < 10000")
    rows = [tuple(r) for r in alignment.link_counts(short, *PATHS).collect()]
    assert sorted(rows, key=str) == sorted(plain_rows([(r["doc_id"], r["text"]) for r in short.select("doc_id", "text").collect()]), key=str)
    assert any(r[3] != r[1] for r in rows)
    assert alignment.link_counts(documents, *PATHS).count() == documents.count()


def test_parts_count_together(spark, monkeypatch):
    """Many small parts and one large give the same rows, and so do joined and broadcast sums."""
    texts = ["the cat sat on the mat", "the unbelievable cat, antidisestablishment", "▁", None, "", "zzqx the cat  sat\n\non"] * 9
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = sorted(tuple(r) for r in alignment.link_counts(frame, *PATHS).collect())
    assert whole == sorted(plain_rows(list(enumerate(texts))))
    monkeypatch.setattr(alignment, "PART", 30)
    monkeypatch.setattr(alignment, "small_side", lambda frame, rows: frame)
    assert sorted(tuple(r) for r in alignment.link_counts(frame, *PATHS).collect()) == whole


def test_no_documents(no_documents):
    assert alignment.link_counts(no_documents, *PATHS).count() == 0
