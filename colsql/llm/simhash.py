"""Near duplicates by SimHash, found with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, components, drop, map_arrow, written

SEED, MAX_BITS, FAN, GROUP = 42, 2, 16, 1024
LANES = np.uint64(0x0101010101010101)
ONE = np.uint64(1)


# fingerprints


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; bytes.lower() and bytes.split() know ASCII only, as wanted."""
    return text.lower().split() if text else []


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of size words, repeats included; the whole sequence if there are fewer words; [] for none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)))]


def hashes(texts: list[bytes], seed: int = SEED) -> np.ndarray:
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), texts), np.uint64, len(texts))


def simhash(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of h; 0 for none. Eight counters of a byte each share a word, for up to 255 rows."""
    if not len(h):
        return 0
    starts = np.arange(0, len(h), 255)
    counts = np.empty((8, 8), np.int64)  # [byte, bit of it]
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & LANES, starts)
        counts[:, k] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), axis=1, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        fp = [signed(simhash(hashes(shingles(words_of(x), size)))) for x in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row. A null, empty or blank text has fingerprint 0."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), partial(_fingerprints, size=size), "doc_id long, fp long")


# the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class GrayIndex:
    """Codes sorted by Gray rank; each FAN neighbours share a node that holds their common bits (mask, pattern), and so on up.

    A node keeps only the bits that its parent doesn't already hold. A search starts at the top, adds up the differences
    on these bits, and leaves a node with all that is below it once they exceed the limit; at a code the sum is its distance.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        pattern, mask = codes[self.order], np.full(len(codes), ~np.uint64(0))
        levels = [(pattern, mask)]
        while len(pattern) > FAN:
            at = np.arange(0, len(pattern), FAN)
            apart = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[at], FAN)[: len(pattern)], at)
            mask = np.bitwise_and.reduceat(mask, at) & ~apart
            pattern = pattern[at] & mask
            levels.append((pattern, mask))
        self.levels = [(p, m & ~np.repeat(levels[i + 1][1], FAN)[: len(m)] if i + 1 < len(levels) else m) for i, (p, m) in enumerate(levels)]

    def search(self, queries: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query's place, code's place) at no more than limit bits."""
        top, mask = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(top))
        node = np.tile(np.arange(len(top)), len(queries))
        far = np.bitwise_count((queries[q] ^ top[node]) & mask[node]).astype(np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = far <= limit
            q, node, far = q[keep], node[keep], far[keep]
            if level:
                pattern, mask = self.levels[level - 1]
                q, far, node = np.repeat(q, FAN), np.repeat(far, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(pattern)
                q, far, node = q[there], far[there], node[there]
                far = far + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
        return q, self.order[node]


def forest(codes: np.ndarray, limit: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest over codes at no more than limit bits: fewer links than codes, the same components."""
    index, up = GrayIndex(codes), list(range(len(codes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    out = []
    for at in range(0, len(codes), 128):
        for q, c in zip(*(x.tolist() for x in index.search(codes[at : at + 128], limit)), strict=True):
            a, b = root(q + at), root(c)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((q + at, c))
    return out


# distribution: nodes of the upper levels are masked bit patterns, each dealt to a task


@lru_cache(maxsize=100_000)
def finer(mask: int, limit: int = MAX_BITS) -> tuple[int, ...]:
    """Masks that fix limit more of limit + 2 equal blocks of the bits that mask leaves free. Two codes that agree on mask
    and differ in no more than limit bits agree on one of them at least. () if no bits are left."""
    free = [i for i in range(64) if not mask >> i & 1]
    n = limit + 2
    if len(free) < n:
        return ()
    blocks = [sum(1 << i for i in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]
    return tuple(mask | sum(x) for x in combinations(blocks, 2))


def _refine(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Each (slot, mask, fp) under each finer mask."""
    for b in batches:
        slot, mask, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for m in np.unique(mask):
            at = mask == m
            for x in finer(int(m) & (1 << 64) - 1, limit):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (slot[at], np.full(at.sum(), signed(x)), fp[at])], ["slot", "mask", "fp"])


OUT = ["kind", "slot", "mask", "a", "b"]


def _search(batches: Iterator[pa.RecordBatch], limit: int, last: bool, group: int) -> Iterator[pa.RecordBatch]:
    """Rows (slot, mask, fp) sorted by slot, mask and pattern, the bits of fp that mask fixes. A pattern of up to group codes is
    searched with an index: kind 0, a link of codes a and b. Those of a larger one go on, unless last: kind 1, code a.
    No more than a batch and a group are held."""
    held: list[np.ndarray] = []  # rows of the pattern at the end of the last batch
    over = None

    def give(kind: int, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(x[: len(a), 0]), pa.array(x[: len(a), 1]), pa.array(a), pa.array(b)], OUT)

    def close(x: np.ndarray) -> pa.RecordBatch | None:
        if len(x) < 2:
            return None
        i = np.array(forest(x[:, 3].copy().view(np.uint64), limit), np.int64).reshape(-1, 2)
        return give(0, x, x[i[:, 0], 3], x[i[:, 1], 3]) if len(i) else None

    for b in batches:
        slot, mask, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        x = np.stack([slot, mask, fp & mask, fp], axis=1)
        if not len(x):
            continue
        x = np.concatenate([*held, x]) if held else x
        cut = np.flatnonzero((x[1:, :3] != x[:-1, :3]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]])
        for k in np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0)):
            y, key = x[starts[k] : ends[k]], tuple(x[starts[k], :3])
            ended = k < len(starts) - 1
            if key == over or (len(y) > group and not last):
                over = key
                yield give(1, y, y[:, 3], y[:, 3])
            elif ended and (found := close(y)):
                yield found
        tail = x[starts[-1] :]
        held = [] if tuple(tail[0, :3]) == over else [tail]
    if held and (found := close(held[0])):
        yield found


def node_of(slot: Column, fp: Column) -> Column:
    """A number for a code of a slot; the code itself in slot 0 alone would do, but not in several."""
    return F.xxhash64(slot.cast("long"), fp)


def links(codes: DataFrame, limit: int = MAX_BITS, group: int = GROUP, node: Callable[[Column, Column], Column] = node_of) -> Written:
    """(a, b): links of codes(slot, fp), distinct, by their nodes' numbers, enough of them that whatever is connected by codes
    of one slot at no more than limit bits is connected by links.

    Codes are dealt to tasks by masked patterns that any two such codes share at least once; a pattern with over group
    codes is dealt out again under finer masks, until few bits are left, so that no group of any size meets in one task.
    """
    rows, found = codes.select(F.col("slot").cast("long"), F.lit(0).cast("long").alias("mask"), "fp"), []
    by = ("slot", "mask", F.col("fp").bitwiseAND(F.col("mask")))
    for level in range(3):
        dealt = map_arrow(rows, partial(_refine, limit=limit), "slot long, mask long, fp long")
        dealt = dealt.repartition(*by).sortWithinPartitions(*by)
        out = written(map_arrow(dealt, partial(_search, limit=limit, last=level == 2, group=group), "kind byte, slot long, mask long, a long, b long"))
        found.append(out)
        rows = out.where("kind = 1").select("slot", "mask", F.col("a").alias("fp"))
        if rows.isEmpty():
            break
    both = found[0]
    for x in found[1:]:
        both = both.union(x)
    out = written(both.where("kind = 0").select(node(F.col("slot"), F.col("a")).alias("a"), node(F.col("slot"), F.col("b")).alias("b")).distinct())
    drop(*found)
    return out


def near_duplicates(docs: DataFrame, size: int = 3, limit: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp long, component_id, links): every row's fingerprint, the smallest doc_id that links of at most limit bits
    reach from it, and how many rows share its fingerprint besides itself.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows and equal fingerprints are one node of
    the graph; a doc_id that repeats with other texts is in as many components as these are. A row with a null doc_id takes
    part; component_id is null if no row that it reaches has one. doc_id may be any long. Extra columns of docs are not looked
    at; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, size))
    codes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")))
    found = links(codes.select(F.lit(0).alias("slot"), "fp"), limit, node=lambda slot, fp: fp)
    roots = components(found.toDF("u", "v"))
    drop(found)
    rooted = written(codes.join(roots.toDF("fp", "root"), "fp", "left").select("fp", "doc", "n", F.coalesce("root", "fp").alias("root")))
    least = written(rooted.groupBy("root").agg(F.min("doc").alias("component_id")))
    labels = written(rooted.join(least, "root").select("fp", "component_id", (F.col("n") - 1).alias("links")))
    drop(codes, roots, rooted, least)
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id", "links")


def hex16(fp: str = "fp"):
    """Sixteen lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
