"""SimHash near-duplicates through an inverted index on byte positions.

Fingerprints of 64 bits are 8 positional bytes. Two that differ in at most d bits differ in at most d bytes, so they
share at least 8 - d positional bytes: the guaranteed minimum that candidates are filtered by. A posting list of a
single byte would hold 1/256 of all documents, so the index's keys are groups of four positional bytes: the 14 groups of the
Steiner system S(3, 4, 8), of which two fingerprints share 14, 7, 3 or 1 just if they share 8, 7, 6 or 5 bytes, and no more than 1 with fewer. Lists are
tallied by pair, pairs with fewer matches than the minimum go, and the others are verified.

Posting lists longer than `longest` (near copies share most of their bytes) aren't paired off: their fingerprints are linked through the values at
half the distance from them, which is exact and takes rows in proportion to the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SEED = 42
#: Longest posting list whose pairs are tallied; longer ones go the exact linear way.
LONGEST = 32
CHUNK = 1 << 20
#: Groups of byte positions that are the index's keys: any three positions are together in one of them.
GROUPS = [g for g in combinations(range(8), 4) if not g[0] ^ g[1] ^ g[2] ^ g[3]]
#: Groups that fingerprints share which differ in so many bits at most.
LEAST_MATCHES = {0: 14, 1: 7, 2: 3}


def _word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """Words of an ASCII-lower-cased text, some hundred thousand at a time so that very long texts need little memory."""
    at = 0
    while at < len(data):
        to = at + CHUNK
        while to < len(data) and data[to] not in b" \t\n\v\f\r":
            to += 1
        yield data[at:to].lower().split()
        at = to


def _fingerprint(data: bytes | None, size: int) -> int:
    ones, total, carry = np.zeros(64, np.int64), 0, []

    def add(shingles) -> None:
        nonlocal total
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        for part in range(0, len(h), 1 << 14):
            bits = np.unpackbits(h[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[:] += bits.sum(axis=0, dtype=np.int32)
        total += len(h)

    for words in _word_chunks(data or b""):
        words = carry + words
        add(map(b" ".join, zip(*(words[k:] for k in range(size)))))
        carry = words[len(words) - size + 1 :] if len(words) >= size else words
    if not total and carry:
        add([b" ".join(carry)])
    return int(sum(1 << k for k in range(64) if 2 * ones[k] > total)) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = np.array([_fingerprint(t.as_py(), size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def _mask(positions) -> int:
    mask = sum(255 << 8 * k for k in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, distance: int = 2, longest: int = LONGEST) -> DataFrame:
    """Edges a, b whose connected components are those of the graph "differ in at most `distance` bits" (0 to 2) over the
    distinct values of column fp. From short posting lists come linked pairs; from long ones, stars."""
    if distance not in LEAST_MATCHES:
        raise ValueError("fingerprints are linked at a distance of 0, 1 or 2")
    keys = [F.struct(F.lit(n).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("held")) for n, g in enumerate(GROUPS)]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.slot", "k.held")
    counts = postings.groupBy("slot", "held").agg(F.count("*").alias("n")).filter("n > 1")
    listed = materialize(postings.join(counts, ["slot", "held"]), "postings")
    short = listed.filter(F.col("n") <= longest).groupBy("slot", "held").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    met = short.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
    # a pair that a long list holds too is linked there, so matches in short lists are all that the others have
    tally = met.groupBy("a", "b").agg(F.count("*").alias("matches")).filter(F.col("matches") >= LEAST_MATCHES[distance])
    pairs = tally.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    near = listed.filter(F.col("n") > longest).select("fp").distinct().select("fp", F.explode(_near_values(F.col("fp"), distance)).alias("mid"))
    if distance == 1:  # values in between are fingerprints themselves
        near = near.join(listed.select(F.col("fp").alias("mid")).distinct(), "mid", "left_semi")
    stars = near.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1).select("a", F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def _near_values(fp, distance: int):
    """Values within half of `distance` bits of fp, rounded up. Two fingerprints differ in two bits at most just if they share one such value, and in one bit at most just if
    that is a fingerprint; the list of any one value has 65 members at most."""
    return F.array(fp, *(fp.bitwiseXOR(F.lit((1 << k) if k < 63 else -(1 << 63))) for k in range(64 if distance else 0)))


def _rooted(least: DataFrame) -> DataFrame:
    """least (a, m), a forest by m < a or m = a at its roots: a and the root of its tree. Each round doubles how far m is up."""
    while True:
        up = least.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        jump = materialize(least.join(up, "m").select("a", F.col("mm").alias("m"), (F.col("m") != F.col("mm")).alias("moved")), "jump")
        done = jump.filter("moved").isEmpty()
        discard(least)
        least = jump
        if done:
            return least


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fp and root (the least member of its connected component) for every row of nodes (distinct column fp).

    Each round gives every node its least neighbour, if less than itself, follows these up to their roots, and contracts the graph, until no edges are left. A round leaves
    only nodes that were less than all their neighbours, and takes as many steps as the logarithm of the longest way up, so a chain of any length takes few.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    known = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        roots = _rooted(least)
        to = lambda c: roots.select(F.col("a").alias(c), F.col("m").alias(f"new_{c}"))
        left = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        new = materialize(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(edges)
        edges = new
        if known is None:
            known = roots
        else:
            up = roots.select(F.col("a").alias("m"), F.col("m").alias("root"))
            new = materialize(known.join(up, "m", "left").select("a", F.coalesce("root", "m").alias("m")), "known")
            discard(known)
            discard(roots)
            known = new
    discard(edges)
    if known is None:
        return nodes.select("fp", F.col("fp").alias("root"))
    return nodes.join(known.select(F.col("a").alias("fp"), "m"), "fp", "left").select("fp", F.coalesce("m", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, distance: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST
) -> DataFrame:
    """For every row: doc_id, fingerprint (16 hex digits), component_id (least doc_id linked with it over any number of links of `distance` bits, 0 to 2),
    text_key (xxhash64 of the text) and root (names the component).

    Null, empty and blank texts have the fingerprint zero and link like any other. Rows with equal texts or ids each give
    a row. Null ids never become a component_id unless all of the component's are null. Other columns are ignored.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    roots = components(groups, links(groups.select("fp"), distance, longest))
    ids = groups.join(roots, "fp").select("root", "first").groupBy("root").agg(F.min("first").alias("component_id"))
    known = roots.join(ids, "root").select("fp", "root", "component_id")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(known, "fp").select("doc_id", fingerprint, "component_id", "text_key", "root")
