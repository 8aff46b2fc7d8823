"""Hashed maximum-entropy language model with a class-factored softmax.

The frequent words of the training documents are the leaves of a tree: classes by language and rank, groups of a class, words of a group, with at most 32 ways at each step; one class stands
for all other words, which share its probability by their counts. So a token is told in up to three steps, and each is a softmax over the ways at a node, with weights from
features of the words before: the last, the one before it, both, and the last with the third last (a skip). The rows of weights that features at nodes use are hashed into a table
of fixed size. Biases start at the logarithms of counts, so the untrained model is the unigram model.

Training reads every training document once. Slices of them are read one after the other, and what a slice sums to over all tasks (observed ways less expected ones, for each row of the
table) moves the weights before the next is read. Tasks hold tokens as symbols of two bytes and work on blocks of them.

Null texts are empty: they have the end alone. A null id counts as an empty text under crc32, so it is learnt from. Repeated rows are documents of their own and get a row each. Texts may be
of any length. Other columns aren't read. If nothing can be learnt from, every word is unknown, and the model gives an end or word all probability that its class has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

FOLDS, HELD_OUT = 7, 2
#: The end of a document as a word; no word has white space.
END = "\n"
UNKNOWN = "und"
#: Languages are told apart by a hash; those that share one share classes.
LANG_CODES = 1 << 20

#: Ways at a node. The last class is that of all other words.
WAYS = 32
REST = WAYS - 1
WORDS = REST * WAYS * WAYS
#: Most frequent words whose counts all tasks have at hand, tree or not. Those of the others come by a join.
KNOWN_WORDS = 1 << 17
#: Symbols: words of the tree, then hashes of others, then what stands before a document.
SYMBOLS = 1 << 16
BEFORE = SYMBOLS - 1

#: Rows of the table for each feature at each step, as powers of two.
ROW_BITS = ((11, 11, 11, 11), (12, 12), (13,))
#: Slices that the training documents are read in.
SLICES = 4
RATE = 0.6
PRIOR = 4.0
LEAST_STEP, MOST_STEP = -0.8, 20.0
#: Logits are kept where their exponentials are finite.
MOST_LOGIT = np.float32(80)
ONES = np.ones(WAYS, np.float32)
#: Rows of the table that travel together.
BLOCK_ROWS = 1 << 10
#: Tokens at a time in the sums; documents are cut to slices of about so many bytes of text, or tokens.
BLOCK, SLICE_BYTES, SLICE_TOKENS = 1 << 14, 4 << 20, 1 << 19


def _fold() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0).cast("long"))


def held_out() -> Column:
    """Whether a document is kept from training, by its doc_id."""
    return _fold() % FOLDS == HELD_OUT


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about `most`."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield at, end
        at = end


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the tokens as positions in them, and the number of tokens of each text; each text ends with END."""
    plain = pc.replace_substring_regex(pc.ascii_lower(texts.fill_null("")), r"[\x09-\x0D]", " ")
    lists = pc.split_pattern(pc.binary_join_element_wise(plain, END, " "), " ")
    sizes = lists.value_lengths().to_numpy()
    held = lists.flatten().dictionary_encode()
    codes = held.indices.to_numpy()
    kept = codes != pc.index_in(pa.array([""]), value_set=held.dictionary).fill_null(-1)[0].as_py()
    counts = np.add.reduceat(kept, np.cumsum(sizes) - sizes, dtype=np.int64) if len(sizes) else sizes
    return held.dictionary, codes[kept], counts


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at, end in _pieces(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), SLICE_BYTES):
        yield batch.slice(at, end - at)


def count_words(docs: DataFrame) -> DataFrame:
    """Tokens of the training documents: word, c, and a code of the language that most of it are in (the greatest code of equals)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for part in _texts(batch):
                words, codes, sizes = tokens(part.column("text"))
                langs = part.column("lang").fill_null(UNKNOWN).dictionary_encode()
                coded = np.array([zlib.crc32(x.encode()) % LANG_CODES for x in langs.dictionary.to_pylist()], np.int32)
                key = codes.astype(np.int64) * len(coded) + np.repeat(langs.indices.to_numpy(), sizes)
                seen, c = np.unique(key, return_counts=True)
                word, lang = np.divmod(seen, len(coded))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), pa.array(coded[lang]), pa.array(c)], names=["word", "lang", "c"])

    learnt = docs.filter(~held_out()).select("text", "lang")
    by_lang = learnt.mapInArrow(run, "word string, lang int, c long").groupBy("word", "lang").agg(F.sum("c").alias("c"))
    # count and code in one number, which sums up by hash
    most = F.max(F.col("c") * LANG_CODES + F.col("lang")) % LANG_CODES
    return by_lang.groupBy("word").agg(F.sum("c").alias("c"), most.cast("int").alias("lang"))


@dataclass
class Tree:
    """Where each word of the tree is, and counts of all ways. total, distinct: of all training tokens."""

    symbols: dict[str, int]
    counts: np.ndarray  # of each symbol of the tree
    total: int
    distinct: int

    @property
    def rest(self) -> tuple[int, int]:
        """Tokens and distinct words outside of the tree."""
        return self.total - int(self.counts.sum()), self.distinct - len(self.symbols)

    def biases(self) -> list[np.ndarray]:
        """For each step, a row of logarithms of shares for every node. Ways that lead nowhere have minus infinity."""
        by_word = self.counts.reshape(REST, WAYS, WAYS).astype(float)
        by_class = np.append(by_word.sum((1, 2)), sum(self.rest) + 1)
        out = []
        for counts in (by_class[None, :], by_word.sum(2), by_word.reshape(-1, WAYS)):
            share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            out.append(np.log(share, where=share > 0, out=np.full(share.shape, -np.inf)).astype(np.float32))
        return out

    @staticmethod
    def of(ranked: list[tuple[str, int, int]], total: int, distinct: int) -> Tree:
        """ranked: word, count and language, by descending count. A language has classes by its share of these tokens, one at least; their sizes double from 32 to 1,024 words,
        so frequent words are in small classes. Of many languages the first 31 have classes."""
        by_lang: dict[int, list[tuple[str, int]]] = {}
        for word, c, lang in ranked:
            by_lang.setdefault(lang, []).append((word, c))
        mass = sorted(((sum(c for _, c in own), lang) for lang, own in by_lang.items()), key=lambda x: (-x[0], x[1]))[:REST]
        whole, spare = sum(m for m, _ in mass), REST - len(mass)
        shares = {lang: 1 + spare * m // max(1, whole) for m, lang in mass}
        for _, lang in mass[: REST - sum(shares.values())]:
            shares[lang] += 1
        symbols, counts, first = {}, np.zeros(WORDS, np.int64), 0
        for _, lang in mass:
            own, at = by_lang[lang], 0
            for nth in range(shares[lang]):
                each = min(WAYS, 1 << nth)  # words of a group
                for i, (word, c) in enumerate(own[at : at + WAYS * each]):
                    symbols[word] = (first + nth) * WAYS * WAYS + i // each * WAYS + i % each
                    counts[symbols[word]] = c
                at += WAYS * each
            first += shares[lang]
        return Tree(symbols, counts, total, distinct)


def frequent_words(counts: DataFrame, most: int = KNOWN_WORDS) -> list[tuple[str, int, int]]:
    """(word, c, lang) by descending count: all words from some count on, as low as their number allows, which is at most `most`."""
    step = F.floor(F.log2("c") * 16)
    left, least = most, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():  # some hundreds of steps
        if row["n"] > left:
            break
        left, least = left - row["n"], row["c"]
    if least is None:
        return []
    found = counts.filter(F.col("c") >= least).select("word", "c", "lang").toArrow()
    return sorted(zip(*(c.to_pylist() for c in found.columns)), key=lambda r: (-r[1], r[0]))


def encode(docs: DataFrame, tree: Tree, known: list[tuple[str, int, int]]) -> DataFrame:
    """A row for each document: key (its own), doc_id, slice (-1: held out), n_tokens, symbols (two bytes each), n_known and log_tree and log_rest (sums of log10(c + 1) of known words in
    the tree and outside of it), other words and how often each comes."""
    places = {word: i for i, (word, *_) in enumerate(known)}
    symbols_of = np.array([tree.symbols.get(word, -1) for word, *_ in known] + [-1], np.int64)
    logs_of = np.log10(np.array([c for _, c, _ in known] + [0], float) + 1)
    shared = docs.sparkSession.sparkContext.broadcast((places, symbols_of, logs_of))

    def run(batches: Iterable[pa.RecordBatch]):
        places, symbols_of, logs_of = shared.value
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _texts(batch):
                words, codes, sizes = tokens(part.column("text"))
                spelled = words.to_pylist()
                place = np.fromiter((places.get(w, -1) for w in spelled), np.int64, len(spelled))
                symbol = symbols_of[place]
                hashed = np.flatnonzero(symbol < 0)
                symbol[hashed] = [WORDS + zlib.crc32(spelled[i].encode()) % (BEFORE - WORDS) for i in hashed.tolist()]
                symbols, at_hand, log = symbol[codes].astype(np.uint16), (place >= 0)[codes], logs_of[place][codes]
                ends = np.cumsum(sizes)
                inside = symbols < WORDS
                sums = [np.add.reduceat(x, ends - sizes) for x in (at_hand.astype(np.int64), np.where(inside, log, 0.0), np.where(inside, 0.0, log))]
                outside = np.flatnonzero(~at_hand)
                doc = np.searchsorted(ends, outside, side="right")
                seen, n = np.unique(doc * len(words) + codes[outside], return_counts=True)
                of_doc, word = np.divmod(seen, max(1, len(words)))
                split = np.searchsorted(of_doc, np.arange(len(sizes) + 1)).astype(np.int32)
                other = pa.ListArray.from_arrays(pa.array(split), words.take(pa.array(word)))
                times = pa.ListArray.from_arrays(pa.array(split), pa.array(n.astype(np.int64)))
                raw = pa.py_buffer(symbols.astype("<u2").tobytes())
                offsets = pa.py_buffer(np.append(0, 2 * ends).astype(np.int32).tobytes())
                columns = [
                    pa.array(key + np.arange(len(sizes))),
                    part.column("doc_id"),
                    part.column("slice"),
                    pa.array(sizes.astype(np.int64)),
                    pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, raw]),
                    *map(pa.array, sums),
                    other,
                    times,
                ]
                key += len(sizes)
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "slice", "n_tokens", "symbols", "n_known", "log_tree", "log_rest", "other", "times"])

    slice_ = F.when(held_out(), -1).otherwise(F.floor(_fold() / FOLDS) % SLICES).cast("int").alias("slice")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"key long, doc_id {kind}, slice int, n_tokens long, symbols binary, n_known long, log_tree double, log_rest double, other array<string>, times array<long>"
    return docs.select("doc_id", "text", slice_).mapInArrow(run, shape)


def _bucket(bits: int, salt: int, *of: np.ndarray) -> np.ndarray:
    h = np.full(len(of[0]), salt * 2654435761 % (1 << 32), np.uint32)
    for x in of:
        h = (h ^ x.astype(np.uint32)) * np.uint32(2246822519)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(3266489917)) >> np.uint32(32 - bits)


@dataclass
class Block:
    """Tokens and the words before them."""

    now: np.ndarray
    last: np.ndarray
    second: np.ndarray
    third: np.ndarray

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Which step, the tokens that take it, their node and way, and the rows of the table that their features use."""
        now, last, second, third = (x.astype(np.int64) for x in (self.now, self.last, self.second, self.third))
        inside = now < WORDS
        kind = np.where(inside, now // (WAYS * WAYS), REST)
        none = np.zeros(len(now), np.int64)
        yield 0, np.arange(len(now)), none, kind, _rows(0, (last,), (second,), (last, second), (last, third))
        some = np.flatnonzero(inside)
        now, kind, last, second = now[some], kind[some], last[some], second[some]
        group = now // WAYS
        yield 1, some, kind, group % WAYS, _rows(1, (kind, last), (kind, last, second))
        yield 2, some, group, now % WAYS, _rows(2, (group, last))


def _rows(step: int, *features: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    first = sum(1 << b for bits in ROW_BITS[:step] for b in bits)
    out = []
    for nth, (bits, of) in enumerate(zip(ROW_BITS[step], features)):
        out.append(_bucket(bits, 8 * step + nth + 1, *of).astype(np.int64) + first)
        first += 1 << bits
    return out


TABLE_ROWS = sum(1 << b for bits in ROW_BITS for b in bits)


def blocks(symbols: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, Block]]:
    """Tokens of documents one after the other, some at a time, and where the first of them is."""
    starts = np.cumsum(sizes) - sizes
    before = []
    for back in (1, 2, 3):
        shifted = np.full(len(symbols), BEFORE, np.uint16)
        shifted[back:] = symbols[:-back]
        for k in range(back):
            at = starts[sizes > k] + k
            shifted[at] = BEFORE
        before.append(shifted)
    for at in range(0, len(symbols), BLOCK):
        yield at, Block(*(x[at : at + BLOCK] for x in (symbols, *before)))


@dataclass
class Model:
    biases: list[np.ndarray]
    weights: np.ndarray  # TABLE_ROWS x WAYS

    def shares(self, step: int, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the ways at each token's node."""
        z = self.logits(step, node, rows)
        np.exp(z, out=z)
        z /= (z @ ONES)[:, None]
        return z

    def logits(self, step: int, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        z = self.weights.take(rows[0], axis=0)
        for r in rows[1:]:
            z += self.weights.take(r, axis=0)
        z += self.biases[step].take(node, axis=0) if step else self.biases[0]
        return np.minimum(z, MOST_LOGIT, out=z)

    def log_share(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of every token, of other words that of their class."""
        out = np.zeros(len(symbols))
        for at, block in blocks(symbols, sizes):
            for step, some, node, way, rows in block.steps():
                z = self.logits(step, node, rows)
                own = z[np.arange(len(way)), way]
                np.exp(z, out=z)
                out[at + some] += own - np.log(z @ ONES)
        return out / np.log(10)

    def sums(self, symbols: np.ndarray, sizes: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> None:
        """Add to `seen` how often each way is taken where a row of the table is used, and to `expected` how often by the model."""
        for _, block in blocks(symbols, sizes):
            taken = []
            for step, _, node, way, rows in block.steps():
                shares = self.shares(step, node, rows)
                for r in rows:
                    taken.append(r * WAYS + way)
                    order = np.argsort(r.astype(np.uint16), kind="stable")
                    ordered = r[order]
                    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
                    if len(starts):
                        expected[ordered[starts]] += np.add.reduceat(shares.take(order, axis=0), starts, axis=0)
            seen += np.bincount(np.concatenate(taken), minlength=seen.size).reshape(seen.shape)

    def moved(self, seen: np.ndarray, expected: np.ndarray, rate: float) -> Model:
        """After a step along the gradient, seen less expected, scaled by what is expected: a way that is k times as frequent as expected moves by the logarithm of k, less
        where little is known."""
        ratio = np.clip((seen - expected) / (expected + PRIOR), LEAST_STEP, MOST_STEP)
        return Model(self.biases, (self.weights + rate * np.log1p(ratio)).astype(np.float32))


def _symbols(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch, some at a time: from, to, their symbols one after the other, their numbers of tokens."""
    sizes = batch.column("n_tokens").to_numpy()
    for at, end in _pieces(sizes, SLICE_TOKENS):
        yield at, end, np.frombuffer(b"".join(batch.column("symbols").slice(at, end - at).to_pylist()), "<u2"), sizes[at:end]


def fit(encoded: DataFrame, tree: Tree, slices: int = SLICES, rate: float = RATE) -> Model:
    """Read the slices one after the other. The tasks' sums meet by blocks of rows of the table, whose size is fixed."""
    model = Model(tree.biases(), np.zeros((TABLE_ROWS, WAYS), np.float32))
    context = encoded.sparkSession.sparkContext
    for nth in range(slices):
        shared = context.broadcast(model)

        def sums(batches, shared=shared):
            seen, expected = (np.zeros((TABLE_ROWS, WAYS), np.float32) for _ in range(2))
            some = False
            for batch in batches:
                for _, _, symbols, sizes in _symbols(batch):
                    shared.value.sums(symbols, sizes, seen, expected)
                    some = True
            if some:
                for at in range(0, TABLE_ROWS, BLOCK_ROWS):
                    yield _block(at, seen[at : at + BLOCK_ROWS], expected[at : at + BLOCK_ROWS])

        def total(batches):
            held = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    at = batch["at"][i].as_py()
                    got = np.stack([np.frombuffer(batch[c][i].as_py(), "<f4").astype(float) for c in ("seen", "expected")])
                    held[at] = held[at] + got if at in held else got
            for at, got in held.items():
                yield _block(at, *got)

        shape = "at int, seen binary, expected binary"
        read = encoded.filter(F.col("slice") == nth).select("symbols", "n_tokens")
        rows = read.mapInArrow(sums, shape).repartition("at").mapInArrow(total, shape).collect()
        seen, expected = (np.zeros((TABLE_ROWS, WAYS)) for _ in range(2))
        for at, *got in rows:
            for to, raw in zip((seen, expected), got):
                to[at : at + BLOCK_ROWS] = np.frombuffer(raw, "<f4").reshape(-1, WAYS)
        model = model.moved(seen, expected, rate)
        shared.destroy()
    return model


def _block(at: int, seen: np.ndarray, expected: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([a.astype("<f4").tobytes()], pa.binary()) for a in (seen, expected))], names=["at", "seen", "expected"])


def score(encoded: DataFrame, counts: DataFrame, tree: Tree, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document. Counts of words that aren't at hand come by a join, as those grow with the corpus."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = ("key", "doc_id", "slice", "n_tokens", "n_known", "log_tree", "log_rest")

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for at, end, symbols, sizes in _symbols(batch):
                logs, inside = shared.value.log_share(symbols, sizes), symbols < WORDS
                starts = np.cumsum(sizes) - sizes
                sums = [pa.array(np.add.reduceat(x, starts, dtype=kind)) for x, kind in ((logs, float), (inside, np.int64))]
                own = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *sums], names=[*kept, "log_share", "inside"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    shape = f"key long, doc_id {kind}, slice int, n_tokens long, n_known long, log_tree double, log_rest double, log_share double, inside long"
    told = encoded.select(*kept, "symbols").mapInArrow(run, shape)
    others = encoded.select("key", F.explode(F.arrays_zip("other", "times")).alias("o")).select("key", F.col("o.other").alias("word"), F.col("o.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    sums = others.join(counts.select("word", "c"), "word", "left").groupBy("key").agg(F.sum(F.col("times") * F.log10(c + 1)).alias("log_others"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known_others"))
    rest, kinds = tree.rest
    whole, share = (F.log10(F.lit(float(n))) for n in (tree.total + tree.distinct + 1, rest + kinds + 1))
    outside = F.col("log_rest") + F.coalesce("log_others", F.lit(0.0))
    return told.join(sums, "key", "left").select(
        "doc_id",
        (F.col("slice") < 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_others", F.lit(0))).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("log_tree") + outside - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("log_share") + outside - (F.col("n_tokens") - F.col("inside")) * share).alias("score"),
    )


def score_texts(docs: DataFrame, slices: int = SLICES, rate: float = RATE) -> DataFrame:
    """Fit on the training documents among docs (doc_id, text, lang) and score all of them."""
    counts = materialize(count_words(docs.select("doc_id", "text", "lang")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = frequent_words(counts)
    tree = Tree.of(known[:WORDS], total, distinct)
    encoded = materialize(encode(docs.select("doc_id", "text"), tree, known), "symbols", "slice")
    model = fit(encoded, tree, slices, rate)
    scored = materialize(score(encoded, counts, tree, model), "scores")
    discard(counts)
    discard(encoded)
    return scored
