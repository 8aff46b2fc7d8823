"""Automata and phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sortline.llm import collocations as K
from sortline.llm.automata import Automaton

SHAPE = "text string, lang string"


def phrases(texts):
    """Counts of runs of one to four words by language, and the number of words of each."""
    counts, sizes = Counter(), Counter()
    for text, lang in texts:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, 5):
                counts.update((lang, *words[i : i + n]) for i in range(len(words) - n + 1))
    return counts, sizes


def brute(texts, top=K.TOP):
    counts, sizes = phrases(texts)
    rows = {}
    for (lang, *words), a in counts.items():
        if len(words) > 1 and a >= 30:
            cuts = [(2000000 * a // (counts[lang, *words[:k]] + counts[lang, *words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows[lang, *words] = (a, counts[lang, *words[:k]], counts[lang, *words[k:]], score)
    inside = {
        (lang, *words[i : i + n])
        for (lang, *words), (f, *_) in rows.items()
        for n in range(2, len(words))
        for i in range(len(words) - n + 1)
        if 100 * f >= 80 * counts[lang, *words[i : i + n]]
    }
    by_lang = defaultdict(list)
    for (lang, *words), row in rows.items():
        if (lang, *words) not in inside:
            by_lang[lang].append((-row[3], -row[0], " ".join(words).encode(), row))
    return sorted((lang, i + 1, p.decode(), *row[:3], sizes[lang], row[3]) for lang, own in by_lang.items() for i, (_, _, p, row) in enumerate(sorted(own)[:top]))


def ours(spark, texts, top=K.TOP):
    return sorted(map(tuple, K.collocations(spark.createDataFrame(texts, SHAPE), top).collect()))


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "çà", "naïve", "x y", "zebra", "0", "new", "york", "end\x0bless", "𝄞"]
    weights = [9, 7, 3, 3, 2, 1, 1, 4, 3, 3, 1, 2]
    out = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 40))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "!"]) for w in words)
        out.append((text if rng.random() > 0.02 else None, rng.choice(["en", "en", "en", "fr", None])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    texts = corpus(seed)
    assert ours(spark, texts) == brute(texts)
    assert ours(spark, texts, 3) == brute(texts, 3)


def test_small_shards_and_ranges_change_nothing(spark, monkeypatch):
    texts = [*corpus(3), ("one two three four five six " * 300, "en"), ("Hot Word " * 2000, "fr")]
    want = brute(texts)
    for name, value in (("SHARD_WORDS", 50), ("RANGE_BYTES", 2_000), ("SLICE_BYTES", 300), ("UNITE", 40), ("SAMPLE_STEP", 3)):
        monkeypatch.setattr(K, name, value)
    monkeypatch.setattr(K._shards, "__defaults__", (50,))
    assert ours(spark, texts) == want


def test_no_rows_nulls_and_repeats(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(None, None), ("", "en"), (" \t. ", "en")]) == []
    assert ours(spark, [("Big deal", None)] * 30) == [("und", 1, "big deal", 30, 30, 30, 60, 1000000)]
    assert ours(spark, [("Big deal", None)] * 29) == []


def test_clashing_columns_are_not_read(spark):
    docs = spark.createDataFrame([("a b", "en", 1, "x")] * 30, "text string, lang string, rank int, phrase string")
    assert [tuple(r) for r in K.collocations(docs).collect()] == [("en", 1, "a b", 30, 30, 30, 60, 1000000)]


def test_scores_are_exact_beyond_64_bits():
    assert K.score(10**13 + 1, 10**13 + 1, 10**13 + 3) == 2_000_000 * (10**13 + 1) // (2 * 10**13 + 4)


def automaton(counter, depths=3):
    words = pa.array(sorted({w for p in counter for w in p}, key=str.encode), pa.string())
    place = {w: i for i, w in enumerate(words.to_pylist())}
    by_length = defaultdict(list)
    for p in counter:
        by_length[len(p)].append([place[w] for w in p])
    out = Automaton.of_paths(words, [np.array(v) for v in by_length.values()], depths)
    for k, d in enumerate(out.depths):
        symbols, _ = out.paths(k, np.arange(len(d)))
        spelled = out.spell(symbols.ravel())
        d.weight[:] = [counter.get(tuple(spelled[i : i + k + 1]), 0) for i in range(0, len(spelled), k + 1)]
    return out


def weights(a):
    out = {}
    for k, d in enumerate(a.depths):
        symbols, on = a.paths(k, np.arange(len(d)))
        spelled = a.spell(symbols.ravel())
        out |= {tuple(spelled[i * (k + 1) : (i + 1) * (k + 1)]): int(on[i, k]) for i in range(len(d))}
    return out


def closed(rng, n):
    """Random phrases with all their beginnings."""
    out = {}
    for _ in range(n):
        p = tuple(rng.choices("abcdé", k=rng.randrange(1, 4)))
        for k in range(1, len(p) + 1):
            out[p[:k]] = rng.randrange(1, 50)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_union_cut_compose_and_pack(seed):
    rng = random.Random(seed)
    a, b = closed(rng, 12), closed(rng, 9)
    x, y = automaton(a), automaton(b)
    both = Automaton.union([x, y])
    assert weights(both) == {p: a.get(p, 0) + b.get(p, 0) for p in {*a, *b}}
    assert weights(Automaton.union([x, y], most=True)) == {p: max(a.get(p, 0), b.get(p, 0)) for p in {*a, *b}}
    assert weights(x.compose(y)) == {p: b.get(p, 0) for p in a}
    assert weights(Automaton.unpack(x.pack())) == a
    kept = {p for p in a if all(a[p[:k]] >= 10 for k in range(1, len(p) + 1))}
    mask = [np.array([p in kept for p in sorted((q for q in a if len(q) == k + 1), key=lambda q: [w.encode() for w in q])], bool) for k in range(3)]
    assert weights(x.keep(mask)) == {p: a[p] for p in kept}
    bounds = sorted({tuple(rng.choices("abcdéf", k=rng.randrange(1, 4))) for _ in range(4)})
    seen = {}
    for i, part in x.parts(bounds):
        low = bounds[i - 1] if i else None
        got = weights(part)
        spine = {low[:k] for k in range(1, len(low))} if low else set()
        inside = {p for p in a if (low is None or p >= low) and (i == len(bounds) or p < bounds[i])}
        assert got == {p: a[p] for p in inside | (spine & set(a))}
        own = [m for m in part.owned(low)]
        assert sum(m.sum() for m in own) == len(inside)
        seen |= {p: a[p] for p in inside}
    assert seen == a
