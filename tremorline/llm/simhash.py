"""Near duplicates by SimHash fingerprints and BK-trees.

1. *Fingerprints*: each row's text is hashed where it lies; only (id, fingerprint) goes on.
2. *Shards*: two fingerprints that differ in at most ``radius`` bits agree on at least one
   of ``radius + 1`` bands of their bits, so every fingerprint goes to the shard of each of
   its bands. A shard with more than ``shard_size`` members is dealt out again by bands of
   the bits that are still free, up to ``LEVELS`` times, which again loses no pair. After
   that a shard's free bits alone bound its size.
3. *BK-trees*: a shard's fingerprints form a tree whose children are keyed by their whole
   Hamming distance to the parent. A tree travels with its shard to the task that asks it
   (a broadcast of all trees to all executors would grow with the input); every member asks
   the tree built so far and follows only edges within ``radius`` of its own distance. The
   members of a shard are joined up as they are found, and at most one link less than it
   has members comes out, however many pairs are near each other.
4. *Components*: links are contracted by alternating star operations on tables that are
   written down each round; a node with very many links only ever meets a minimum.

Copies share a fingerprint, and everything after step 1 works on distinct fingerprints, so
a group of copies of any size is one node.

Defined cases: a missing text is an empty one; a text without words has fingerprint zero,
linked like any other; a text with fewer words than a shingle is one shingle; rows without
an id take part, and a component of such rows only has no component id; repeated rows are
returned each; a very long text is hashed a chunk of shingles at a time; an empty table
gives no rows; other columns are ignored.

After three levels a shard has at most 20 free bits, so at most 1,048,576 members.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.session import stage

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
SHARD_SIZE = 2000
LEVELS = 3
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: bit i is set if it is set in over half of the shingle hashes."""
    from xxhash import xxh64_intdigest

    words = [w for w in _SPACE.split((text or "").translate(_LOWER)) if w]
    if not words:
        return 0
    if len(words) < shingle_words:
        return xxh64_intdigest(" ".join(words), SEED)
    ones, n = np.zeros(BITS, np.int64), len(words) - shingle_words + 1
    for start in range(0, n, _CHUNK):
        part = words[start : start + _CHUNK + shingle_words - 1]
        shingles = map(" ".join, zip(*(part[k:] for k in range(shingle_words))))
        hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(id, fingerprint) of every row; the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long")


class BKTree:
    """Fingerprints in a tree whose edges carry whole Hamming distances."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the members within ``radius`` of ``value``."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            edges = self.children[node]
            if len(edges) <= 2 * radius + 1:
                stack += [child for edge, child in edges.items() if abs(edge - distance) <= radius]
            else:
                stack += [edges[e] for e in range(distance - radius, distance + radius + 1) if e in edges]
        return found

    def add(self, value: int) -> None:
        """Insert a value that the tree does not hold yet."""
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        node = 0
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join up the distinct ``values`` of a shard as far as they are near."""
    tree, links, parent = BKTree(), [], list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for other in tree.near(value, radius):
            a, b = root(i), root(other)
            if a != b:
                parent[a] = b
                links.append((value, values[other]))
        tree.add(value)
    return links


def _bands(free: list[int], count: int) -> list[list[int]]:
    """``free`` bit positions cut into ``count`` runs of about equal length."""
    return [part.tolist() for part in np.array_split(np.array(free), count)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def shards(distinct: DataFrame, radius: int, shard_size: int, levels: int = LEVELS) -> DataFrame:
    """(shard, fingerprint) for shards of two or more members."""
    bands = radius + 1
    # path: the bands taken so far; their bits are what the members of a shard agree on
    paths = {(): list(range(BITS))}
    open_rows = distinct.select("fingerprint", F.lit("").alias("shard"), F.lit("").alias("path"))
    done = []
    for level in range(levels):
        options = []
        next_paths = {}
        for path, free in paths.items():
            for i, bits in enumerate(_bands(free, bands)):
                next_paths[(*path, i)] = [b for b in free if b not in bits]
                options.append(("".join(map(str, path)), str(i), _mask(bits)))
        cells = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(i).alias("i"), F.lit(m).alias("m")) for p, i, m in options))
        dealt = open_rows.select(
            "fingerprint", "shard", "path", F.explode(F.filter(cells, lambda c: c["p"] == F.col("path"))).alias("c")
        ).select(
            "fingerprint",
            F.concat("path", "c.i").alias("path"),
            F.concat_ws(
                ",", "shard", F.concat_ws(":", "c.i", F.col("fingerprint").bitwiseAND(F.col("c.m")))
            ).alias("shard"),
        )
        dealt = stage(dealt, "dealt")
        sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sizes = stage(sizes, "shard_sizes")
        sized = dealt.join(sizes, "shard")
        last = level == levels - 1
        done.append(sized.filter(F.lit(last) | (F.col("n") <= shard_size)).select("shard", "fingerprint"))
        if last or sizes.filter(F.col("n") > shard_size).isEmpty():
            break
        open_rows = sized.filter(F.col("n") > shard_size).select("fingerprint", "shard", "path")
        paths = next_paths
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(u, v) links between fingerprints: enough to join up everything near each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by shard; a shard may go on in the next batch
        shard, values = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            names, prints = batch["shard"].to_numpy(), batch["fingerprint"].to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != shard:
                    found += shard_links(values, radius)
                    shard, values = names[a], []
                values += prints[a:b].tolist()
            yield _frame(found)
        yield _frame(shard_links(values, radius))

    members = shards(distinct, radius, shard_size)
    return members.repartition("shard").sortWithinPartitions("shard", "fingerprint").mapInPandas(run, "u long, v long")


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"u": ends[:, 0], "v": ends[:, 1]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node reachable.

    Large-star, then small-star, until nothing changes: each node's larger neighbours,
    then its smaller ones, are hung on the smallest of them. Edges always point from a
    node to a smaller one, and both steps are a grouped minimum and a join.
    """
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "lowest")
        large = (
            both.filter("v > u")
            .join(lowest, "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        large = stage(large, "large_star")
        least = stage(large.groupBy("u").agg(F.min("v").alias("low")), "least")
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        )
        small = stage(small.filter("u <> v").distinct(), "small_star")
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (a long) and component_id, the smallest
    id among the rows whose fingerprints are reachable by links."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = stage(prints.groupBy("fingerprint").agg(F.min("id").alias("low")), "distinct_fingerprints")
    roots = components(links(distinct, radius, shard_size))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = stage(rooted, "rooted")
    lows = stage(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "component_ids")
    named = stage(rooted.join(lows, "root").select("fingerprint", "component_id"), "named_fingerprints")
    return prints.join(named, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Rows repeated with that id stay all; rows without an id stay only where nothing in
    their component has one.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    leaders = stage(
        found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("leader")).distinct(),
        "leaders",
    )
    # A merge join at every size: there are about as many leaders as documents.
    return docs.join(leaders.hint("merge"), docs[id_col].eqNullSafe(leaders["leader"]), "left_semi")
