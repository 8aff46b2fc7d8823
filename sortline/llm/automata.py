"""Weighted acyclic automata over phrases: each state is a phrase that was seen, its weight how often.

States are kept by depth, in the order of their phrases, as three arrays: the state that a state comes from, the symbol that leads to it, its weight. Symbols are positions in a
sorted list of words, so the order of states is the order of phrases by UTF-8 bytes, and a range of phrases is a slice of every depth. Tails aren't shared between states, as
states with the same weights below them are rare; so a state stands for one phrase, and what a path passes are the weights of all beginnings of its phrase.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard


@dataclass
class Depth:
    """parent: state of the depth above; word: symbol; weight. Sorted by parent, then word."""

    parent: np.ndarray
    word: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.word)


def _empty() -> Depth:
    return Depth(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64))


def _keys(d: Depth, size: int) -> np.ndarray:
    return d.parent.astype(np.int64) * size + d.word


def _summed(key: np.ndarray, weight: np.ndarray | None, size: int, most: bool = False) -> tuple[Depth, np.ndarray]:
    """The depth with a state for every distinct key (parent * size + word), and where each key went. Weights of equal keys add up, or the most of them counts; without weights
    each key weighs 1."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(len(key), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(first)
    where = np.empty(len(key), np.int32)
    where[order] = np.cumsum(first, dtype=np.int32) - 1
    if not len(starts):
        return _empty(), where
    if weight is None:
        sums = np.diff(starts, append=len(key))
    else:
        sums = (np.maximum.reduceat if most else np.add.reduceat)(weight[order], starts)
    parent, word = np.divmod(ordered[starts], size)
    return Depth(parent.astype(np.int32), word.astype(np.int32), sums), where


@dataclass
class Automaton:
    words: pa.Array
    depths: list[Depth]

    def __len__(self) -> int:
        return sum(map(len, self.depths))

    # building

    @staticmethod
    def of_tokens(words: pa.Array, heads: np.ndarray, symbols: np.ndarray, most_words: int, starts: int | None = None) -> Automaton:
        """Counts of all runs of 1 to most_words symbols below their head (such as a language), of those alone that begin in the first `starts` places if it is given.
        heads: the head of each place; symbols: -1 parts runs. words: sorted."""
        size, at = len(words), np.flatnonzero(symbols[:starts] >= 0)
        depth, node = _summed(heads[at].astype(np.int64), None, size)
        depths = [depth]
        for k in range(most_words):
            # `at` holds the starts of runs of k words; those stay that the next symbol lengthens
            ends = at + k
            inside = ends < len(symbols)
            at, node, ends = at[inside], node[inside], ends[inside]
            longer = symbols[ends] >= 0
            at, node = at[longer], node[longer]
            depth, node = _summed(node.astype(np.int64) * size + symbols[at + k], None, size)
            depths.append(depth)
        return Automaton(words, depths)

    @staticmethod
    def of_paths(words: pa.Array, paths: Sequence[np.ndarray], depths: int) -> Automaton:
        """The automaton of given paths (rows of symbols, a matrix for each length) and their beginnings; weights are 0."""
        size, out, nodes = len(words), [], [np.zeros(len(p), np.int64) for p in paths]
        for k in range(depths):
            on = [i for i, p in enumerate(paths) if p.shape[1] > k]
            if not on:
                out.append(_empty())
                continue
            key = np.concatenate([nodes[i].astype(np.int64) * size + paths[i][:, k] for i in on])
            depth, where = _summed(key, np.zeros(len(key), np.int64), size)
            out.append(depth)
            for i, part in zip(on, np.split(where, np.cumsum([len(paths[i]) for i in on])[:-1])):
                nodes[i] = part
        return Automaton(words, out)

    @staticmethod
    def union(parts: Sequence[Automaton], most: bool = False) -> Automaton:
        """All phrases of the parts, with the sum of their weights (or the most)."""
        if len(parts) == 1:
            return parts[0]
        held = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
        words, own = in_order(held.dictionary)
        symbols = own[held.indices.to_numpy()]
        of = np.split(symbols, np.cumsum([len(p.words) for p in parts])[:-1])
        size, out, nodes = max(1, len(words)), [], [np.zeros(1, np.int64) for _ in parts]
        for k in range(max(len(p.depths) for p in parts)):
            on = [(i, p.depths[k]) for i, p in enumerate(parts) if k < len(p.depths)]
            key = np.concatenate([nodes[i][d.parent].astype(np.int64) * size + of[i][d.word] for i, d in on])
            depth, where = _summed(key, np.concatenate([d.weight for _, d in on]), size, most)
            out.append(depth)
            for (i, _), part in zip(on, np.split(where, np.cumsum([len(d) for _, d in on])[:-1])):
                nodes[i] = part
        return Automaton(words, out)

    # parts of it

    def keep(self, kept: Sequence[np.ndarray]) -> Automaton:
        """The states for which `kept` (a mask for each depth) holds; a kept state's parent must be kept."""
        out, moved = [], np.zeros(1, np.int32)
        for d, some in zip(self.depths, kept):
            out.append(Depth(moved[d.parent[some]], d.word[some], d.weight[some]))
            moved = np.cumsum(some, dtype=np.int32) - 1
        return Automaton(self.words, out).trimmed()

    def trimmed(self) -> Automaton:
        """Without words that no state uses."""
        marks = np.zeros(len(self.words), bool)
        for d in self.depths:
            marks[d.word] = True
        used = np.flatnonzero(marks)
        place = np.cumsum(marks, dtype=np.int32) - 1
        return Automaton(self.words.take(pa.array(used)), [Depth(d.parent, place[d.word], d.weight) for d in self.depths])

    def cuts(self, bound: Sequence[str]) -> tuple[list[int], list[int]]:
        """For each depth: the first state whose phrase isn't below `bound`, and the first that a part from `bound` on has to hold: a beginning of `bound` itself comes first there."""
        at, own = [], []
        last, inside = 0, True  # `last`: parents before it are below the bound; inside: parent `last` is a beginning of it
        for k, d in enumerate(self.depths):
            lo = int(np.searchsorted(d.parent, last))
            match = False
            if inside and k < len(bound):
                hi = int(np.searchsorted(d.parent, last + 1))
                sym = self._symbol(bound[k])
                cut = lo + int(np.searchsorted(d.word[lo:hi], sym))
                match = cut < hi and d.word[cut] == sym and self.words[int(sym)].as_py() == bound[k]
            else:
                cut = lo
            proper = match and k + 1 < len(bound)
            at.append(cut + 1 if proper else cut)
            own.append(cut)
            last, inside = cut, match
        return at, own

    def _symbol(self, word: str) -> int:
        """Where the word is in the list, or would be."""
        lo, hi, raw = 0, len(self.words), word.encode()
        while lo < hi:
            mid = (lo + hi) // 2
            if self.words[mid].as_py().encode() < raw:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def parts(self, bounds: Sequence[Sequence[str]]) -> Iterable[tuple[int, Automaton]]:
        """The automaton cut at phrases in order: part i has what isn't below bounds[i - 1] and is below bounds[i], and the beginnings of bounds[i - 1] with their weights.
        Parts without a state aren't given."""
        none = [0] * len(self.depths)
        starts = [(none, none), *(self.cuts(b) for b in bounds)]
        ends = [s[0] for s in starts[1:]] + [[len(d) for d in self.depths]]
        for i, ((_, own), end) in enumerate(zip(starts, ends)):
            if any(e > o for o, e in zip(own, end)):
                out, before = [], 0
                for d, o, e in zip(self.depths, own, end):
                    out.append(Depth(d.parent[o:e] - before, d.word[o:e], d.weight[o:e]))
                    before = o
                yield i, Automaton(self.words, out).trimmed()

    def owned(self, bound: Sequence[str] | None) -> list[np.ndarray]:
        """For each depth, which states aren't there as beginnings of the lower bound alone."""
        at = self.cuts(bound)[0] if bound else [0] * len(self.depths)
        return [np.arange(len(d)) >= a for d, a in zip(self.depths, at)]

    # reading

    def paths(self, k: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and weights along the paths to states `some` of depth k: two matrices with a column for each depth."""
        symbols, weights, node = [], [], some
        for d in reversed(self.depths[: k + 1]):
            symbols.append(d.word[node])
            weights.append(d.weight[node])
            node = d.parent[node]
        return np.column_stack(symbols[::-1]), np.column_stack(weights[::-1])

    def spell(self, symbols: np.ndarray) -> list[str]:
        return self.words.take(pa.array(symbols)).to_pylist()

    def compose(self, counts: Automaton) -> Automaton:
        """This automaton with the weights that `counts` gives its phrases, 0 where it has none."""
        own = pc.index_in(self.words, value_set=counts.words).fill_null(-1).to_numpy().astype(np.int64)
        size, out, node = max(1, len(counts.words)), [], np.zeros(1, np.int64)
        for k, d in enumerate(self.depths):
            there = counts.depths[k] if k < len(counts.depths) else _empty()
            parent, word = node[d.parent], own[d.word]
            key = np.where((parent >= 0) & (word >= 0), parent * size + word, -1)
            keys = _keys(there, size)
            at = np.searchsorted(keys, key)
            found = np.zeros(len(d), bool)
            some = at < len(keys)
            found[some] = keys[at[some]] == key[some]
            node = np.where(found, at, -1)
            weight = np.zeros(len(d), np.int64)
            weight[found] = there.weight[at[found]]
            out.append(Depth(d.parent, d.word, weight))
        return Automaton(self.words, out)

    def weights_of(self, words: pa.Array, paths: np.ndarray) -> np.ndarray:
        """Weights of paths whose symbols are those of another sorted list of words."""
        asked = Automaton.of_paths(words, [paths], paths.shape[1]).compose(self)
        node = np.zeros(len(paths), np.int64)
        for k, d in enumerate(asked.depths):
            node = np.searchsorted(_keys(d, len(words)), node * len(words) + paths[:, k])
        return asked.depths[-1].weight[node]

    # rows

    def pack(self) -> bytes:
        """Words and the arrays of all depths, each in the least width that holds it, compressed. Words have no line feed."""
        words = "\n".join(self.words.to_pylist()).encode()
        out = [len(self.words).to_bytes(8, "little"), len(words).to_bytes(8, "little"), words]
        for d in self.depths:
            steps = np.diff(d.parent, prepend=0)
            for a in (steps, d.word, d.weight):
                width = next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << (8 * w))
                out += [bytes([width]), len(a).to_bytes(8, "little"), a.astype(f"<u{width}").tobytes()]
        return zstandard.compress(b"".join(out), 3)

    @staticmethod
    def unpack(packed: bytes) -> Automaton:
        raw = zstandard.decompress(packed)
        n, size = (int.from_bytes(raw[i : i + 8], "little") for i in (0, 8))
        words, at = pa.array(raw[16 : 16 + size].decode().split("\n") if n else [], pa.string()), 16 + size
        depths = []
        while at < len(raw):
            got = []
            for kind in (np.int32, np.int32, np.int64):
                width, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
                got.append(np.frombuffer(raw, f"<u{width}", n, at + 9).astype(kind))
                at += 9 + width * n
            depths.append(Depth(np.cumsum(got[0], dtype=np.int32), got[1], got[2]))
        return Automaton(words, depths)


def in_order(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words sorted by their bytes, and the new place of each."""
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(words), dtype=np.int32)
    return words.take(pa.array(order)), place
