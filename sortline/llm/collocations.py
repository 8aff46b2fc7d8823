"""Phrase collocations by weighted acyclic automata.

Every task counts the runs of one to four words of its shard of the corpus in an automaton, built in steps from sorted runs. Shards are cut at the same phrases, so that
each range of phrases meets in one place, where its automata are united and their weights summed. States of rare phrases are dropped once their sum is known. The weights of a candidate's
beginnings lie on its own path. Those of its ends lie in other ranges: the ends that a range asks for are an automaton too, cut at the same phrases, composed with the counts of
the range that has them, and sent back. An end is asked for once by a range however many candidates have it, so a frequent word makes no large group.

A phrase of n words is a path of n + 1 symbols: its language comes first, and the weight of that is the number of words of the language.

Null texts are empty, and a null language is `und`. Repeated rows count as often as they come. Phrases of one weight and score are in order of their UTF-8 bytes. Other
columns aren't read. No documents, or none with a frequent phrase, give no rows. A text may be of any length: shards are cut after a number of words, also within a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automata import Automaton, in_order
from .common import materialize

MOST_WORDS = 4
LEAST = 30
SCALE = 2_000_000
TOP = 2_000
UNKNOWN = "und"
#: A candidate inside a longer one goes if that is at least so many hundredths as frequent.
COVERED = 80

#: Words of a shard; a task holds the counts of one.
SHARD_WORDS = 1_500_000
#: Bytes of text for each range of phrases, and of the sample that shows where the ranges begin. The sample decides how even the ranges are, and nothing of the result.
RANGE_BYTES = 16 << 20
SAMPLE_BYTES = 16 << 20
#: Of the sample's phrases, one in so many is looked at.
SAMPLE_STEP = 32
#: Bytes of text that are cut to words at once.
SLICE_BYTES = 4 << 20
#: States that are united at once.
UNITE = 2_000_000

ENDS = r"[.,;:!?\n\x0b\x0c\r]+"
OWN = -1

PARTS = "to int, asks int, packed binary"
SCORED = "lang string, words int, phrase string, a long, l long, r long, n long, score long"


def tokens(texts: pa.Array, langs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words in sorted order, and for each place of the texts the language and the word as positions in them; -1 where a piece ends."""
    low = pc.replace_substring_regex(pc.ascii_lower(texts.fill_null("")), ENDS, " \n ")
    lists = pc.split_pattern(pc.binary_join_element_wise(pc.replace_substring(low, "\t", " "), "\n", " "), " ")
    sizes = lists.value_lengths().to_numpy()
    held = pa.concat_arrays([lists.flatten(), langs.fill_null(UNKNOWN)]).dictionary_encode()
    words, place = in_order(held.dictionary)
    symbols = place[held.indices.to_numpy()]
    symbols, heads = symbols[: sizes.sum()], np.repeat(symbols[sizes.sum() :], sizes)
    gaps = pc.index_in(pa.array(["", "\n"]), value_set=words).fill_null(-1).to_pylist()
    kept = symbols != gaps[0]
    symbols, heads = symbols[kept], heads[kept]
    return words, heads, np.where(symbols == gaps[1], -1, symbols)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
        yield batch.column("text").slice(at, end - at), batch.column("lang").slice(at, end - at)
        at = end


def _shards(batches: Iterable[pa.RecordBatch], shard_words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """Automata of about so many words each. A longer slice of texts is cut; a part of it counts the runs that begin there, and reads on as far as those go."""
    held, size = [], 0
    for batch in batches:
        for texts, langs in _slices(batch):
            words, heads, symbols = tokens(texts, langs)
            if len(symbols) > shard_words:
                for at in range(0, len(symbols), shard_words):
                    end = at + shard_words
                    yield Automaton.of_tokens(words, heads[at : end + MOST_WORDS - 1], symbols[at : end + MOST_WORDS - 1], MOST_WORDS, shard_words).trimmed()
                continue
            held.append((words, heads, symbols))
            size += len(symbols)
            if size >= shard_words:
                yield _counted(held)
                held, size = [], 0
    if held:
        yield _counted(held)


def _counted(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Automaton:
    """The automaton of some slices, of which each has words of its own."""
    joined = pa.concat_arrays([w for w, _, _ in held]).dictionary_encode()
    words, place = in_order(joined.dictionary)
    moved, at, heads, symbols = place[joined.indices.to_numpy()], 0, [], []
    for w, h, s in held:
        own = np.append(moved[at : at + len(w)], -1)  # -1 stays -1
        at += len(w)
        heads.append(own[h])
        symbols.append(own[s])
    return Automaton.of_tokens(words, np.concatenate(heads), np.concatenate(symbols), MOST_WORDS).trimmed()


def _batch(to: int, asks: int, a: Automaton) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([asks], pa.int32()), pa.array([a.pack()], pa.binary())], names=["to", "asks", "packed"])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, Automaton]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch["to"][i].as_py(), batch["asks"][i].as_py(), Automaton.unpack(batch["packed"][i].as_py())


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, Automaton]]]]:
    """Rows by range; they come sorted by it. A group has to be read before the next."""
    for to, rows in groupby(_read(batches), key=lambda row: row[0]):
        yield to, ((asks, a) for _, asks, a in rows)


def _united(parts: Iterable[Automaton], most: bool = False) -> Automaton:
    """Their union, by some at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= UNITE and len(held) > 1:
            held = [Automaton.union(held, most)]
            size = max(0, len(held[0]) - UNITE)
    return Automaton.union(held, most)


def _to_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """One range to each partition, what is its own first."""
    return rows.repartitionById(ranges, "to").sortWithinPartitions("to", "asks")


def _bounds(docs: DataFrame) -> list[tuple[str, ...]]:
    """Phrases at which the ranges begin, from a sample of bounded size."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(size / RANGE_BYTES))

    def run(batches):
        for shard in _shards(batches):
            k = MOST_WORDS - 1
            some = np.arange(len(shard.depths[k]))[SAMPLE_STEP // 2 :: SAMPLE_STEP]
            symbols, _ = shard.paths(k, some)
            spelled = shard.spell(symbols.ravel())
            width = symbols.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([spelled[i : i + width] for i in range(0, len(spelled), width)], pa.list_(pa.string()))], names=["path"])

    sample = docs.sample(fraction=min(1.0, SAMPLE_BYTES / size), seed=11) if size > SAMPLE_BYTES else docs
    paths = sorted(tuple(r[0]) for r in sample.mapInArrow(run, "path array<string>").collect())
    picked = dict.fromkeys(paths[len(paths) * i // ranges] for i in range(1, ranges)) if paths else {}
    return list(picked)


def _frequent(docs: DataFrame, bounds: list[tuple[str, ...]]) -> DataFrame:
    """For each range the automaton of its frequent phrases, counted over all documents."""

    def count(batches):
        for shard in _shards(batches):
            for to, part in shard.parts(bounds):
                yield _batch(to, OWN, part)

    def unite(batches):
        for to, rows in _grouped(batches):
            whole = _united(a for _, a in rows)
            yield _batch(to, OWN, whole.keep([d.weight >= LEAST for d in whole.depths]))

    return _to_ranges(docs.mapInArrow(count, PARTS), len(bounds) + 1).mapInArrow(unite, PARTS)


def _candidates(counts: Automaton, bound: tuple[str, ...] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of words, paths and weights along them of the phrases of two words and more that the range owns."""
    for k, own in enumerate(counts.owned(bound)):
        if k >= 2:
            yield k, *counts.paths(k, np.flatnonzero(own))


def _ends(k: int, paths: np.ndarray) -> list[np.ndarray]:
    """The ends of phrases of k words, cut after 1 to k - 1 words, below their language."""
    return [np.delete(paths, np.s_[1 : 1 + cut], axis=1) for cut in range(1, k)]


def score(a: int, left: int, right: int) -> int:
    return SCALE * a // (left + right)


def _scored(counts: Automaton, answers: Automaton, bound: tuple[str, ...] | None) -> Iterator[pa.RecordBatch]:
    for k, paths, weights in _candidates(counts, bound):
        rights = np.column_stack([answers.weights_of(counts.words, p) for p in _ends(k, paths)]).tolist()
        spelled, rows = counts.spell(paths.ravel()), []
        for i, (on, right) in enumerate(zip(weights.tolist(), rights)):
            a = on[k]
            worst, _, left, end = min((score(a, x, y), cut, x, y) for cut, (x, y) in enumerate(zip(on[1:k], right)))
            lang, *words = spelled[i * (k + 1) : (i + 1) * (k + 1)]
            rows.append((lang, k, " ".join(words), a, left, end, on[0], worst))
        for at in range(0, len(rows), 10_000):
            columns = list(zip(*rows[at : at + 10_000]))
            kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["lang", "words", "phrase", "a", "l", "r", "n", "score"])


def candidates(docs: DataFrame) -> DataFrame:
    """All frequent phrases of two to four words with the counts of their worst cut, before any is dropped: lang, words, phrase, a, l, r, n, score."""
    docs = docs.select(F.col("text"), F.col("lang"))
    bounds = _bounds(docs)
    ranges = len(bounds) + 1
    lower = lambda to: bounds[to - 1] if to else None
    counted = materialize(_frequent(docs, bounds), "counts")

    def ask(batches: Iterable[pa.RecordBatch]):
        for own, _, counts in _read(batches):
            asked = [p for k, paths, _ in _candidates(counts, lower(own)) for p in _ends(k, paths) if len(p)]
            if asked:
                for to, part in Automaton.of_paths(counts.words, asked, MOST_WORDS).trimmed().parts(bounds):
                    yield _batch(to, own, part)

    def answer(batches: Iterable[pa.RecordBatch]):
        for _, rows in _grouped(batches):
            counts = None
            for asks, part in rows:
                if asks == OWN:
                    counts = part
                else:
                    yield _batch(asks, asks, part.compose(counts) if counts else part)

    def judge(batches: Iterable[pa.RecordBatch]):
        for to, rows in _grouped(batches):
            _, counts = next(rows)
            answers = [a for _, a in rows]
            if answers:
                yield from _scored(counts, _united(answers, most=True), lower(to))

    dealt: Callable = lambda rows, run, out: _to_ranges(counted.unionByName(rows), ranges).mapInArrow(run, out)
    answers = dealt(counted.mapInArrow(ask, PARTS), answer, PARTS)
    return dealt(answers, judge, SCORED)


def uncovered(found: DataFrame) -> DataFrame:
    """Without the phrases that lie inside a longer one which is nearly as frequent."""
    words = F.split("phrase", " ")
    inner = [(at, n) for n in range(2, MOST_WORDS) for at in range(1, MOST_WORDS - n + 2)]
    inside = F.array(*(F.when((F.lit(n) < F.col("words")) & (F.lit(at + n - 1) <= F.col("words")), F.array_join(F.slice(words, at, n), " ")) for at, n in inner))
    longer = found.filter("words > 2").select("lang", F.explode(F.array_compact(inside)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    covered = wide("around") * 100 >= wide("a") * COVERED
    return found.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("around")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score. docs has text and lang."""
    found = materialize(candidates(docs), "candidates")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = uncovered(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
