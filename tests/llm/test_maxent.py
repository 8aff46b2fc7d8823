"""The language model against plain sums, and as a distribution."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sortline.llm import maxent as M

SHAPE = "doc_id long, text string, lang string"


def brute(rows):
    """n_tokens, n_known, N and base score of each row."""
    of = lambda text: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), M.END]
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 7
    counts = Counter(t for i, text, _ in rows if fold(i) != 2 for t in of(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text, _ in rows:
        tokens = of(text)
        out.append((i, fold(i) == 2, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return out


def scored(spark, rows):
    return M.score_texts(spark.createDataFrame(rows, SHAPE)).collect()


def assert_base(spark, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted((tuple(r)[:6] for r in scored(spark, rows)), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9, abs=1e-9)


def test_base_score_of_odd_rows(spark):
    texts = [None, "", " \t\n ", "One two. ÀÉ One", "a b c\x0bd", "x " * 5000, "rare", "Two"]
    rows = [(i if i % 9 else None, texts[i % len(texts)], [None, "en", "fr"][i % 3]) for i in range(60)]
    assert_base(spark, rows + rows[:5])


def test_words_outside_of_the_tree(spark, monkeypatch):
    """More words than the tree has places for."""
    monkeypatch.setattr(M.Tree, "of", staticmethod(lambda ranked, total, distinct, of=M.Tree.of: of(ranked[:20], total, distinct)))
    rows = [(i, " ".join(f"w{(i * k) % 91}" for k in range(i % 40)), "en") for i in range(200)]
    assert_base(spark, rows)
    monkeypatch.setattr(M.frequent_words, "__defaults__", (40,))  # and than tasks have counts of
    assert_base(spark, rows)


def test_empty_and_nothing_to_learn_from(spark):
    assert scored(spark, []) == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = scored(spark, [(held, "a b", None)])
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 5, "x", 0)], SHAPE + ", key int, slice string, score int")
    assert [r.n_tokens for r in M.score_texts(docs).collect()] == [3]


def test_held_out_documents_gain_and_runs_agree(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = {r.doc_id: r for r in M.score_texts(docs).collect()}
    base, score, tokens = (sum(getattr(r, c) for r in first.values() if r.held_out) for c in ("base_score", "score", "n_tokens"))
    assert score > base + 0.05 * tokens
    assert {r.doc_id: r.score for r in M.score_texts(docs).collect()} == pytest.approx({i: r.score for i, r in first.items()}, rel=1e-5)


def tree():
    rng = np.random.default_rng(5)
    counts = sorted(rng.integers(1, 1000, 300).tolist(), reverse=True)
    ranked = [(f"w{i}", c, ["en", "fr", "de"][i % 3]) for i, c in enumerate(counts)]
    return M.Tree.of(ranked, sum(counts) + 500, 400)


def random_model(t):
    rng = np.random.default_rng(6)
    return M.Model(t.biases(), rng.normal(0, 0.5, (M.TABLE_ROWS, M.WAYS)).astype(np.float32))


def test_frequent_words_are_all_from_a_count_on(spark):
    counts = spark.createDataFrame([(f"w{c}-{i}", c, 0) for c in (1, 2, 3, 9, 500) for i in range(c % 7 + 1)], "word string, c long, lang int")
    for most, want in ((100, [500] * 4 + [9] * 3 + [3] * 4 + [2] * 3 + [1] * 2), (8, [500] * 4 + [9] * 3), (3, [])):
        got = M.frequent_words(counts, most)
        assert [c for _, c, _ in got] == want and got == sorted(got, key=lambda r: (-r[1], r[0]))


def test_shares_sum_to_one():
    """Over all words of the tree, and the class of the others, after any words."""
    t = tree()
    model, symbols = random_model(t), np.array(sorted(t.symbols.values()))
    assert len(symbols) == len(set(symbols)) == 300
    every = np.append(symbols, M.WORDS).astype(np.uint16)
    context = [symbols[7], symbols[200], M.WORDS + 9]
    docs = np.concatenate([np.append(context, x) for x in every]).astype(np.uint16)
    logs = model.log_share(docs, np.full(len(every), 4))[3::4]
    assert (10**logs).sum() == pytest.approx(1, abs=1e-5)


def test_untrained_model_is_the_unigram_model():
    t = tree()
    model = M.Model(t.biases(), np.zeros((M.TABLE_ROWS, M.WAYS), np.float32))
    symbols = np.array(sorted(t.symbols.values()), np.uint16)
    shares = 10 ** model.log_share(symbols, np.array([len(symbols)]))
    assert shares == pytest.approx(t.counts[symbols] / (t.total + sum([1, t.rest[1]])), rel=1e-4)


def test_sums_equal_plain_ones():
    t = tree()
    model, rng = random_model(t), np.random.default_rng(8)
    symbols = rng.choice(np.append(list(t.symbols.values()), [M.WORDS + 3, M.WORDS + 70]), 400).astype(np.uint16)
    sizes = np.array([150, 1, 0, 249])
    seen, expected = np.zeros((2, M.TABLE_ROWS, M.WAYS), np.float32)
    model.sums(symbols, sizes, seen, expected)
    want_seen, want = np.zeros_like(seen, float), np.zeros_like(expected, float)
    for _, block in M.blocks(symbols, sizes):
        for step, some, node, way, rows in block.steps():
            for i in range(len(some)):
                share = model.shares(step, node[i : i + 1], [r[i : i + 1] for r in rows])[0]
                assert share.sum() == pytest.approx(1, abs=1e-5)
                for r in rows:
                    want_seen[r[i], way[i]] += 1
                    want[r[i]] += share
    assert np.array_equal(seen, want_seen) and np.allclose(expected, want, atol=1e-3)
    better = model.moved(seen, expected, 0.2)
    assert better.log_share(symbols, sizes).sum() > model.log_share(symbols, sizes).sum()


def test_words_before_end_with_their_document():
    symbols, sizes = np.arange(1, 7).astype(np.uint16), np.array([2, 0, 4])
    ((_, block),) = M.blocks(symbols, sizes)
    b = M.BEFORE
    assert block.last.tolist() == [b, 1, b, 3, 4, 5]
    assert block.second.tolist() == [b, b, b, b, 3, 4]
    assert block.third.tolist() == [b, b, b, b, b, 3]


def test_tokens_of_long_texts_are_whole():
    words, codes, sizes = M.tokens(pa.array(["A b\x0bA", None, "b " * 100_000]))
    assert sizes.tolist() == [4, 1, 100_001]
    assert words.take(pa.array(codes[:4])).to_pylist() == ["a", "b", "a", "\n"]
