"""Near copies by Jaccard similarity of shingle sets: SimHash candidates, an exact check, and an exact join for what is left.

1. Each text gets TABLES fingerprints, each the SimHash of the shingles that come first under one hash function (a sample that
   near copies share with a probability of about similarity ** SAMPLE). The Gray-order index links them at up to a bit.
2. In what is so linked, each text is compared with the first of its group; where that leaves several components in a group,
   with the group's centre. So there are as many comparisons as texts, however large the group.
3. Of texts that are still apart, those that can be alike share one of their rarest shingles. They are compared, too: first
   with the nearest of each other component, then, where this found nothing, with all. So no pair is missed.

Texts with equal XXH64 count as equal: one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Written, components, drop, map_arrow, written
from .simhash import ONE, SEED, links, node_of, signed, simhash, words_of

#: Fingerprints a text, shingles in a sample, and bits that fingerprints of one sample may differ in.
TABLES, SAMPLE, LIMIT = 8, 3, 1
#: Whole fingerprints of texts at similarity 0.8 differ in 9.7 bits on average, by a standard deviation of 2.9. Pairs further
#: apart are left to the exact join.
FAR = 20
#: Counters of shingles, dealt to CHUNKS rows: a fixed size. They only order the shingles; any order gives the same pairs.
CELLS, CHUNKS = 1 << 20, 256
#: A shingle of so many texts, or of so many times the mean cell, isn't gathered to see whether it is shared: it is.
HOT, HOT_TIMES = 1 << 16, 16
#: Rows of a shingle that meet in one task; more are dealt to several.
MEET = 1 << 16
#: Rows of a shingle up to which plain loops are faster than arrays.
SMALL = 8
#: Comparisons that are held at once.
BLOCK = 250_000
#: Texts whose repetition a task remembers.
REMEMBERED = 1 << 20

_ORDER = np.random.default_rng(SEED).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + ONE


def key_of(text: str = "text") -> Column:
    """XXH64 of a text's UTF-8, seed 42, as a long; Spark's function and xxhash agree."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Ascending distinct hashes of a text's runs of size words (the whole sequence, if it has fewer): word hashes, mixed in order."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : i + n]) * _ORDER[0]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def _prints(batches: Iterator[pa.RecordBatch], size: int, tables: int, sample: int) -> Iterator[pa.RecordBatch]:
    mixers = np.random.default_rng(SEED).integers(1, 1 << 62, tables, dtype=np.uint64) * np.uint64(2) + ONE
    for b in batches:
        n, whole, fps = [], [], []
        for text in b.column(2).to_pylist():
            h = shingle_set(text, size)
            n.append(len(h))
            whole.append(signed(simhash(h)))
            orders = [(x := h * m) ^ x >> np.uint64(29) for m in mixers] if len(h) else []
            fps.append([signed(simhash(h[np.argpartition(x, sample - 1)[:sample]] if len(h) > sample else h)) for x in orders])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(whole, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], ["doc", "key", "n", "whole", "fps"])


def _sets(batches: Iterator[pa.RecordBatch], size: int, asked) -> Iterator[pa.RecordBatch]:
    bits = asked.value
    for b in batches:
        at = b.column(0).to_numpy().view(np.uint64) & np.uint64(FILTER_BITS - 1)
        b = b.filter(pa.array((bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & ONE).astype(bool)))
        sets = [np.unique(shingle_set(x, size).astype(np.uint32)).view(np.int32) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32()))], ["key", "set"])


def _counted_cells(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for b in batches:
        h = [shingle_set(x, size) for x in b.column(1).to_pylist()]
        if h:
            counts += np.bincount((np.concatenate(h) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    if counts.any():
        rows = [x.tobytes() for x in np.minimum(counts, (1 << 32) - 1).astype(np.uint32).reshape(CHUNKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(rows, pa.binary())], ["chunk", "counts"])


def _summed_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
    rows = [np.minimum(x, (1 << 32) - 1).astype(np.uint32).tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], ["chunk", "counts"])


def frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """About how many of texts(key, text) hold a shingle, by its hash modulo CELLS."""
    out, schema = np.zeros((CHUNKS, CELLS // CHUNKS), np.uint32), "chunk int, counts binary"
    for r in map_arrow(map_arrow(texts, partial(_counted_cells, size=size), schema).repartition("chunk"), _summed_cells, schema).collect():
        out[r.chunk] = np.frombuffer(r.counts, np.uint32)
    return out.ravel()


def _least(x: np.ndarray | int | float) -> np.ndarray:
    """The least whole number that isn't below x, whatever rounding has added to x."""
    return np.ceil(np.asarray(x) - 1e-9).astype(np.int64)


# of a text's n shingles, rarest first, those up to the place where the first shared one must be

PACKED = "part int, given boolean, keys binary, sizes binary, lengths binary, tokens binary, places binary"
SHARED = "token long, key long, n int, at int"


def _postings(batches: Iterator[pa.RecordBatch], size: int, similarity: float, cells, parts: int, hold: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Arrays of postings, dealt to parts by token; those of hot tokens by text, as given. Equal texts of a task come once."""
    order = cells.value
    hot = max(HOT, HOT_TIMES * float(order.mean()))
    seen: set[int] = set()
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # key, size, tokens, their counts are hot
    n_held = 0

    def give() -> pa.RecordBatch:
        lengths = np.array([len(x[2]) for x in held], np.int64)
        which = np.repeat(np.arange(len(held)), lengths)
        token = np.concatenate([x[2] for x in held])
        place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        is_hot = np.concatenate([x[3] for x in held])
        keys, sizes = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int32)
        mixed = np.where(is_hot, keys[which].view(np.uint64), token) * _ORDER[1]
        part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64) * 2 + is_hot
        by = np.argsort(part, kind="stable")
        part, which, token, place = part[by], which[by], token[by], place[by].astype(np.int32)
        rows = []
        for lo, hi in zip(e := np.flatnonzero(np.diff(part, prepend=-1)), [*e[1:], len(part)], strict=True):
            texts, count = np.unique(which[lo:hi], return_counts=True)
            rows.append((int(part[lo]) >> 1, bool(part[lo] & 1), keys[texts].tobytes(), sizes[texts].tobytes(), count.astype(np.int32).tobytes(), token[lo:hi].tobytes(), place[lo:hi].tobytes()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), *[pa.binary()] * 5), strict=True)], [x.split()[0] for x in PACKED.split(", ")])

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(key)
            h = shingle_set(text, size)
            if len(h):
                count = order[(h % np.uint64(CELLS)).astype(np.int64)]
                first = np.lexsort((h, count))[: len(h) - int(_least(similarity * len(h))) + 1]
                held.append((key, len(h), h[first], count[first] > hot))
                n_held += len(first)
                if n_held >= hold:
                    yield give()
                    n_held = 0
    if held:
        yield give()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: the postings whose token another text of the part has too, and all that are given."""
    held: dict[str, list] = {"at": None, "x": []}

    def give(x: np.ndarray, all_: bool) -> pa.RecordBatch:
        if not all_:
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            new = np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(axis=1)])
            x = x[new]
            same = x[1:, 0] == x[:-1, 0]
            x = x[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32)), pa.array(x[:, 3].astype(np.int32))], ["token", "key", "n", "at"])

    for b in batches:
        for part, given, keys, sizes, lengths, tokens, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
            times = np.frombuffer(lengths, np.int32)
            x = np.stack([np.frombuffer(tokens, np.int64), np.repeat(np.frombuffer(keys, np.int64), times), np.repeat(np.frombuffer(sizes, np.int32), times), np.frombuffer(places, np.int32)], axis=1)
            if given:
                yield give(x, True)
                continue
            if part != held["at"] and held["x"]:
                yield give(np.concatenate(held["x"]), False)
                held["x"] = []
            held["at"] = part
            held["x"].append(x)
    if held["x"]:
        yield give(np.concatenate(held["x"]), False)


MIXED = SHARED + ", whole long, root long"


def _mixed(batches: Iterator[pa.RecordBatch], hold: int = MEET) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token: those whose token has rows of several roots. Of a token with more than hold rows, maybe all."""
    held: list[pa.RecordBatch] = []
    n, token, root, open_ = 0, None, None, False  # of the token at hand: rows held, its first root, whether its rows are given out
    for b in batches:
        if not len(b):
            continue
        t, r = b.column(0).to_numpy(), b.column(5).to_numpy()
        cut = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if t[lo] != token:
                held, n, token, root, open_ = [], 0, t[lo], r[lo], False
            part = b.slice(lo, hi - lo)
            if not open_ and ((r[lo:hi] != root).any() or n + hi - lo > hold):
                open_ = True
                yield from held
                held = []
            if open_:
                yield part
            else:
                held.append(part)
                n += hi - lo


def _across(batches: Iterator[pa.RecordBatch], similarity: float, best: bool) -> Iterator[pa.RecordBatch]:
    """Rows (token, deal, few, n, at, key, whole, root) sorted by token and deal: pairs of texts of one token and different roots that can be
    alike by their sizes and the token's places. best: of those with one text and one root, the nearest by whole fingerprint.
    Only texts outside of a token's largest root are compared with the others: few says which, where a token has several deals."""
    share = similarity / (1 + similarity)
    pairs: list[tuple[int, int]] = []  # of small groups, not yet given

    def small(rows: list[list[int]]) -> None:
        """The same as close, for a few rows: most tokens have two or three."""
        roots = [r[7] for r in rows]
        if len(set(roots)) < 2:
            return
        main = max(set(roots), key=lambda q: (roots.count(q), q))
        many = [q == main for q in roots] if rows[0][2] < 0 else [r[2] == 0 for r in rows]
        for (_, deal, _, n, at, key, whole, root), is_many in zip(rows, many, strict=True):
            if is_many:
                continue
            nearest: dict[int, tuple[int, int]] = {}
            for (_, _, _, n2, at2, key2, whole2, root2), other in zip(rows, many, strict=True):
                if root2 == root or not (other or key < key2 and deal == 0):
                    continue
                need = math.ceil(share * (n + n2) - 1e-9)
                if at + need <= n and at2 + need <= n2:
                    if best:
                        found = (((whole ^ whole2) & (1 << 64) - 1).bit_count(), key2)
                        nearest[root2] = min(nearest.get(root2, found), found)
                    else:
                        pairs.append((key, key2))
            pairs.extend((key, k) for _, k in nearest.values())

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])
        pairs.clear()
        return out

    def close(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(x) <= SMALL:
            small(x.tolist())
            if len(pairs) >= 10_000:
                yield given()
            return
        x = x[np.argsort(x[:, 7], kind="stable")]
        deal, few, n, at, key, whole, root = x[:, 1:].T
        starts = np.flatnonzero(np.diff(root, prepend=root[0] - 1))
        group = np.cumsum(np.isin(np.arange(len(root)), starts)) - 1
        if few[0] < 0:
            many = group == np.diff([*starts, len(root)]).argmax()
        else:
            many = few == 0
        if len(starts) < 2:
            return
        rest = np.flatnonzero(~many)
        step = max(1, BLOCK // len(x))
        bits = whole.view(np.uint64)
        for k in range(0, len(rest), step):
            i = rest[k : k + step]
            need = _least(share * (n[i][:, None] + n[None, :]))
            fits = (at[i] + need.T <= n[i]).T & (at + need <= n) & (group[i][:, None] != group) & (many | ((key[i][:, None] < key) & (deal[0] == 0)))
            if best:
                far = np.where(fits, np.bitwise_count(bits[i][:, None] ^ bits), 99).astype(np.int64) << 32 | np.arange(len(x))
                far = np.minimum.reduceat(far, starts, axis=1)
                q, r = np.nonzero(far < 99 << 32)
                c = far[q, r] & 0xFFFFFFFF
            else:
                q, c = np.nonzero(fits)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i[q]], key[c])), pa.array(np.maximum(key[i[q]], key[c]))], ["a", "b"])

    held: list[np.ndarray] = []  # rows of the last token and deal
    for b in batches:
        if not len(b):
            continue
        x = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(8)], axis=1)
        cut = [0, *(np.flatnonzero((x[1:, :2] != x[:-1, :2]).any(axis=1)) + 1).tolist(), len(x)]
        for k in range(len(cut) - 1):
            part = x[cut[k] : cut[k + 1]]
            if held and (held[0][0, :2] != part[0, :2]).any():
                yield from close(np.concatenate(held))
                held = []
            held.append(part)
    if held:
        yield from close(np.concatenate(held))
    yield given()


def _tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle whose work isn't in its bytes, so that adaptive execution doesn't make few of them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_postings(texts: DataFrame, size: int, similarity: float, hold: int = 1 << 18) -> Written:
    """(token, key, n, at) of texts(key, text): the postings of prefixes whose token several texts have.

    With shingles in one order everywhere, two sets that share s of theirs have a shingle in common among the first n - s + 1
    of each, n its size; at a similarity of j, s is j / (1 + j) of both sizes at least. Rare shingles come first, so what a
    family has in common is hardly ever asked for.
    """
    spark = texts.sparkSession
    cells = spark.sparkContext.broadcast(frequencies(texts, size))
    parts = 8 * _tasks(spark)
    packed = map_arrow(texts, partial(_postings, size=size, similarity=similarity, cells=cells, parts=parts, hold=hold), PACKED)
    return written(map_arrow(packed.repartition(_tasks(spark), "part").sortWithinPartitions("part"), _shared, SHARED))


def apart(shared: DataFrame, labels: DataFrame) -> Written:
    """The postings whose token texts of different roots have, with whole and root from labels(key, whole, root)."""
    labelled = shared.join(labels, "key").select(*(x.split()[0] for x in MIXED.split(", ")))
    return written(map_arrow(labelled.repartition(_tasks(shared.sparkSession), "token").sortWithinPartitions("token"), _mixed, MIXED))


def pairs_apart(mixed: DataFrame, similarity: float, best: bool, meet: int = MEET) -> Written:
    """(a, b): pairs of texts of mixed, of different roots, that can be alike; best: only the nearest of each other root.

    Tokens with over meet rows are dealt to several tasks: a row of the token's largest root to one, the others to all.
    """
    counted = mixed.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("rows"), F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("c"))
    large = written(counted.where(F.col("rows") > meet).select("token", "main", F.ceil(F.col("rows") / meet).cast("int").alias("deals")))
    names = ["n", "at", "key", "whole", "root"]
    if large.isEmpty():
        rows = mixed.select("token", F.lit(0).cast("long").alias("deal"), F.lit(-1).cast("long").alias("few"), *names)
    else:
        few = F.col("root") != F.col("main")
        own = F.array(F.pmod(F.xxhash64("key"), F.col("deals")).cast("int"))
        deals = F.when(F.col("deals").isNull(), F.array(F.lit(0))).when(few, F.sequence(F.lit(0), F.col("deals") - 1)).otherwise(own)
        rows = mixed.join(large, "token", "left").select("token", F.explode(deals).cast("long").alias("deal"), F.coalesce(few.cast("long"), F.lit(-1).cast("long")).alias("few"), *names)
    dealt = rows.repartition(_tasks(mixed.sparkSession), "token", "deal").sortWithinPartitions("token", "deal")
    out = written(map_arrow(dealt, partial(_across, similarity=similarity, best=best), "a long, b long").distinct())
    drop(large)
    return out


#: Bits of the filter by which tasks know the texts whose sets are asked for: a fixed size. A full filter costs time, not results.
FILTER_BITS = 1 << 26


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each key, by its last bits; FILTER_BITS / 64 words at most reach the driver."""
    at = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 AS int))")
    found = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def sets_of(texts: DataFrame, keys: DataFrame, size: int) -> Written:
    """(key, set): the shingles' hashes of texts(key, text), of keys(key) at least, each text once."""
    asked = texts.sparkSession.sparkContext.broadcast(_filter_of(keys))
    return written(map_arrow(texts, partial(_sets, size=size, asked=asked), "key long, set array<int>").dropDuplicates(["key"]))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> Written:
    """(u, v): the pairs(a, b) whose sets(key, set) are as alike."""
    sizes = F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").where(sizes)
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _grouped(texts: DataFrame, limit: int) -> Written:
    """(group, key, n, whole): the texts(key, n, whole, fps) of each group of two or more that the index makes, by sample."""
    slots = texts.select("key", "n", "whole", F.posexplode("fps").alias("slot", "fp"))
    codes = written(slots.groupBy("slot", "fp").agg(F.count("*").alias("c")))
    found = links(codes.select("slot", "fp"), limit)
    roots = components(found.toDF("u", "v"))
    node = node_of(F.col("slot"), F.col("fp"))
    busy = written(codes.withColumn("node", node).join(roots, "node", "left").where("c > 1 or root is not null").select("slot", "fp", F.coalesce("root", "node").alias("group")))
    out = written(slots.join(busy, ["slot", "fp"]).select("group", "key", "n", "whole"))
    drop(codes, found, roots, busy)
    return out


def _near(n: str, whole: str, other: str, similarity: float) -> Column:
    """Whether two texts can be alike by their sizes, and probably are by their fingerprints."""
    size = F.col(f"{other}.n")
    return (F.least(n, size) >= similarity * F.greatest(F.col(n), size)) & (F.bit_count(F.col(whole).bitwiseXOR(F.col(f"{other}.whole"))) <= FAR)


def _with_first(rows: DataFrame, similarity: float) -> Written:
    """(a, b): each text with the first of its group."""
    first = written(rows.groupBy("group").agg(F.min(F.struct("key", "n", "whole")).alias("o")))
    out = rows.join(first, "group").where((F.col("key") != F.col("o.key")) & _near("n", "whole", "o", similarity))
    out = written(out.select(F.least("key", "o.key").alias("a"), F.greatest("key", "o.key").alias("b")).distinct())
    drop(first)
    return out


def _with_centre(rows: DataFrame, labels: DataFrame, similarity: float) -> Written:
    """(a, b): each text of a group of several roots with the group's centre, the text that is nearest to what most of
    their whole fingerprints have at each bit, if it has another root."""
    rooted = written(rows.join(labels.select("key", "root"), "key"))
    bits = [F.sum(F.shiftrightunsigned("whole", k).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"b{k}") for k in range(32)]  # two counters each
    sums = rooted.groupBy("group").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"), *bits).where("low != high")
    most = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"b{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"b{k}", 32)
        for count, at in ((low, k), (high, k + 32)):
            most = most.bitwiseOR(F.when(2 * count > F.col("c"), F.lit(signed(1 << at))).otherwise(F.lit(0).cast("long")))
    most = written(sums.select("group", most.alias("most")))
    far = F.bit_count(F.col("whole").bitwiseXOR(F.col("most")))
    centre = written(rooted.join(most, "group").groupBy("group").agg(F.min_by(F.struct("key", "n", "whole", "root"), F.struct(far, "key")).alias("o")))
    out = rooted.join(centre, "group").where((F.col("root") != F.col("o.root")) & _near("n", "whole", "o", similarity))
    out = written(out.select(F.least("key", "o.key").alias("a"), F.greatest("key", "o.key").alias("b")).distinct())
    drop(rooted, most, centre)
    return out


def _joined(labels: Written, edges: DataFrame) -> Written:
    """labels(key, whole, root) with the roots that edges(u, v) connect made one, the smallest."""
    of = labels.select("key", "root")
    between = edges.join(of.toDF("u", "x"), "u").join(of.toDF("v", "y"), "v").select("x", "y")
    roots = components(between.toDF("u", "v"))
    out = written(labels.join(roots.toDF("root", "new"), "root", "left").select("key", "whole", F.coalesce("new", "root").alias("root")))
    drop(labels, roots)
    return out


def classes(texts: DataFrame, prints: DataFrame, size: int, similarity: float, limit: int = LIMIT) -> Written:
    """(key, root): the texts(key, text) whose links of that similarity connect them share a root. prints(key, n, whole, fps):
    each text once."""
    rows = _grouped(prints, limit)
    shared = shared_postings(texts, size, similarity)
    sets = sets_of(texts, rows.select("key").union(shared.select("key")), size)
    labels = written(prints.select("key", "whole", F.col("key").alias("root")))
    pairs = _with_first(rows, similarity)
    edges = alike(pairs, sets, similarity)
    labels = _joined(labels, edges)
    drop(pairs, edges)
    pairs = _with_centre(rows, labels, similarity)
    edges = alike(pairs, sets, similarity)
    labels = _joined(labels, edges)
    drop(pairs, edges, rows)
    for best in (True, False):
        mixed = apart(shared, labels)
        drop(shared)
        pairs = pairs_apart(mixed, similarity, best)
        edges = alike(pairs, sets, similarity)
        labels = _joined(labels, edges)
        drop(pairs, edges)
        shared = mixed.select("token", "key", "n", "at")
        shared.path = mixed.path
    drop(shared, sets)
    return labels


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, tables: int = TABLES, sample: int = SAMPLE, limit: int = LIMIT) -> Written:
    """(doc_id, key, rows, component_id, first): a row for each distinct doc_id and text of docs. Near copies, by Jaccard
    similarity of the sets of size-word shingles, are links; component_id is the smallest doc_id that links reach, null if
    none of these texts has one. first: whether this is the text that stays for all of its component: of the smallest doc_id, a null
    one last, then of the smallest key (key_of(text)). rows: how many rows of docs are equal to it.

    Equal texts are one node. Texts without a word (null, empty, blank) are no copies of anything: each has its own doc_id as
    component_id, and is first. A doc_id may come with several texts; each has a result. Extra columns are not looked at; an
    empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), key_of().alias("key"), F.col("text").cast("binary").alias("text"))
    texts = base.where(F.length(F.regexp_replace(F.col("text").cast("string"), f"[{SPACE}]+", "")) > 0).select("key", "text")
    prints = written(map_arrow(base, partial(_prints, size=size, tables=tables, sample=sample), "doc long, key long, n int, whole long, fps array<long>"))
    distinct = written(prints.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("whole").alias("whole"), F.first("fps").alias("fps")))
    labels = classes(texts, distinct, size, similarity, limit)
    rows = prints.groupBy("doc", "key", F.col("n") > 0).agg(F.count("*").alias("rows")).toDF("doc", "key", "worded", "rows")
    rooted = written(rows.join(labels.select("key", "root"), "key", "left"))
    best = written(rooted.where("worded").groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "key")).alias("best")))
    named = rooted.join(best, "root", "left")
    first = ~F.col("worded") | (F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("key") == F.col("best.key")))
    out = written(named.select(F.col("doc").alias("doc_id"), "key", "rows", F.when(F.col("worded"), F.col("best.doc")).otherwise(F.col("doc")).alias("component_id"), first.alias("first")))
    drop(prints, distinct, labels, rooted, best)
    return out


def keep_first(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each component of near copies one row of docs, all columns, the first by near_copies; of rows equal in doc_id and text,
    any one. Texts without a word stay, every row of them.

    Rows with a null doc_id take part like any other; columns may have any names; an empty table gives no rows.
    """
    found = near_copies(docs, size, similarity)
    names = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumns({"doc": F.col(names[docs.columns.index("doc_id")]).cast("long"), "key": key_of(names[docs.columns.index("text")])})
    blank = F.length(F.regexp_replace(F.coalesce(names[docs.columns.index("text")], F.lit("")), f"[{SPACE}]+", "")) == 0
    keep = written(found.where("first").select(F.col("doc_id").alias("doc_"), F.col("key").alias("key_"), "rows"))
    named = rows.join(keep, rows.doc.eqNullSafe(keep.doc_) & (rows.key == keep.key_)).withColumn("blank", blank)
    once = named.where("blank or rows = 1").select(*names)
    if not keep.where("rows > 1").isEmpty():
        once = once.union(named.where("not blank and rows > 1").dropDuplicates(["doc", "key"]).select(*names))
    drop(found)
    return once.toDF(*docs.columns)
