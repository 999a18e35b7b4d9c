"""Document fingerprints by SpotSigs: chains of content words after common-word anchors. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, written

#: Anchors: very common words of several languages.
ANCHORS = (
    "the a an of to and in is was that for it with by on at be this are from or as "
    "der die das und ist ein eine den dem des mit von zu im nicht auf für sich als auch "
    "le la les un une des de du et est que qui dans pour en au avec sur pas "
    "el los las una y se no por con para lo es del al su"
).split()
#: First hex digits of the MD5 of words that are anchors where no word is one of those: an eighth of all.
SPOTS = ("0", "1")
#: Content words in a chain, and the words after an anchor among which they are looked for.
CHAIN, REACH = 2, 6


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; [] for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, f"[{SPACE}]+"), lambda w: w != "")


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, reach: int = REACH) -> Column:
    """The ascending distinct hashes (8 hex digits, of MD5) of a text's spot signatures: an anchor and the next content words
    after it, joined by spaces.

    In a text without such a signature, one of another language, words whose own MD5 begins with one of SPOTS are the anchors. A
    text without a signature by these, too, has one of its words as a whole, a space before each, so that equal texts are alike
    and others aren't.
    """

    def digest(parts: Column) -> Column:
        return F.substring(F.md5(F.concat_ws(" ", parts).cast("binary")), 1, 8)

    def sigs(ws: Column, is_anchor: Callable[[Column], Column]) -> Column:
        def of(w: Column, i: Column) -> Column:
            found = F.slice(F.filter(F.slice(ws, i + 2, reach), lambda x: ~is_anchor(x)), 1, chain)
            return F.when(is_anchor(w) & (F.size(found) > 0), digest(F.concat(F.array(w), found)))

        return F.array_distinct(F.array_compact(F.transform(ws, of)))

    def bound(value: Column, f: Callable[[Column], Column]) -> Column:
        """f of a value that is computed once."""
        return F.transform(F.array(value), f)[0]

    listed: Callable[[Column], Column] = lambda w: w.isin(anchors)
    hashed: Callable[[Column], Column] = lambda w: F.substring(F.md5(w.cast("binary")), 1, 1).isin(*SPOTS)

    def or_else(s: Column, other: Callable[[], Column]) -> Column:
        return F.when(F.size(s) > 0, F.sort_array(s)).otherwise(other())

    def all_of(ws: Column) -> Column:
        whole = lambda: F.array(digest(F.concat(F.array(F.lit("")), ws)))
        return bound(sigs(ws, listed), lambda s: or_else(s, lambda: bound(sigs(ws, hashed), lambda t: or_else(t, whole))))

    return bound(words(text), all_of)


def fingerprint(sigs: Column) -> Column:
    """Signatures in text form, in order."""
    return F.array_join(sigs, "")


def members(print_: Column) -> Column:
    """The signatures of a fingerprint."""
    return F.regexp_extract_all(print_, F.lit(".{8}"), F.lit(0))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets. Sets whose sizes alone keep it below least aren't compared: 0."""
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.least(n, m) < F.greatest(n, m) * F.lit(least), F.lit(0.0)).otherwise(shared / (n + m - shared))


#: Buckets at most, whatever the number of rows.
BUCKETS = 16_384


class Buckets:
    """Ranges of a key by its quantiles, dense numbers from 0 in order, none empty: of about rows rows each, or more if there would be over
    BUCKETS. A key with rows of more than one range is dealt by a hash, so that no bucket is much larger than the others."""

    def __init__(self, rows: DataFrame, key: str, hash_: Column, per: int) -> None:
        """rows: a table whose column key is never null; hash_: a long of it, evenly spread."""
        n = rows.count()
        parts = min(BUCKETS, -(-n // per))
        shares = [i / parts for i in range(1, parts)]
        found = rows.agg(F.percentile_approx(key, shares, 10 * parts).alias("q")).first().q if shares else []
        self.key, self.bounds = F.col(key), sorted(set(found or []))
        self.times = [found.count(b) for b in self.bounds]
        self.hash = hash_ if any(t > 1 for t in self.times) else F.lit(0).cast("long")  # else not read
        self.starts, at = [], 1
        for t in self.times:
            self.starts.append(at)
            at += t + 1
        present = sorted(r.b for r in rows.groupBy(self._sparse().alias("b")).count().collect())
        self.dense = [0] * at
        for i, b in enumerate(present):
            self.dense[b] = i
        self.n = len(present)

    def _sparse(self) -> Column:
        """By binary search: 0 below all bounds; then for each bound as many numbers as it occurs, for keys equal to it if it occurs
        more than once, and one for those above."""
        if not self.bounds:
            return F.lit(0)
        bounds, starts, times = (F.lit(x) for x in (self.bounds, self.starts, self.times))
        steps = [1 << i for i in range(len(self.bounds).bit_length() - 1, -1, -1)]

        def step(at: Column, width: Column) -> Column:
            to = at + width
            return F.when((to < len(self.bounds)) & (F.get(bounds, to) <= self.key), to).otherwise(at)

        place = F.aggregate(F.lit(steps), F.lit(-1), step)
        unit = F.shiftrightunsigned(self.hash, 11).cast("double") / F.lit(float(1 << 53))

        def number(i: Column) -> Column:
            own = F.floor((F.when(unit < 0.5, unit + 0.5).otherwise(unit - 0.5)) * F.get(times, i)).cast("int")  # in the order of signed hashes
            return F.when(i < 0, F.lit(0)).otherwise(F.get(starts, i) + F.when((F.get(bounds, i) == self.key) & (F.get(times, i) > 1), own).otherwise(F.get(times, i)))

        return F.transform(F.array(place), number)[0].cast("int")

    def of(self) -> Column:
        return F.get(F.lit(self.dense), self._sparse()) if self.bounds else F.lit(0)


def with_next(docs: DataFrame, key: str, values: list[str], rows: int = 1000, **derived: Callable[[Column], Column]) -> DataFrame:
    """docs with a struct `next` of the values of the row's successor by key (after the last: the first); rows with equal
    keys follow one another in some order that their values determine. A null key comes first. derived: more columns of a row and of `next`, each
    made once a row from the struct of values.

    Rows move once, to a bucket of neighbouring keys; only the first row of each bucket moves again, to the bucket before.
    """
    keyed = docs.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    buckets = Buckets(keyed, "_k", F.xxhash64(*values), rows)
    keyed = keyed.withColumn("_h", buckets.hash).withColumn("_b", buckets.of())
    low = F.broadcast(keyed.groupBy("_b").agg(F.min(F.struct("_k", "_h")).alias("_l")).select("_b", "_l._k", "_l._h"))  # a row for each bucket: BUCKETS, twice at most
    first = keyed.join(low, ["_b", "_k", "_h"], "left_semi").groupBy("_b").agg(F.min(F.struct("_k", "_h", *values)).alias("_own"))
    own = F.struct(*(F.col("_own")[v].alias(v) for v in values)).alias("_own")
    others = [f for f in docs.schema.fields if f.name not in values]
    heads = first.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in others), F.lit(None).cast("long").alias("_k"), F.lit(None).cast("long").alias("_h"), F.pmod(F.col("_b") - 1, F.lit(max(1, buckets.n))).alias("_b"), own, F.lit(True).alias("_last"))
    both = keyed.select(*(f.name for f in others), "_k", "_h", "_b", F.struct(*values).alias("_own"), F.lit(False).alias("_last")).unionByName(heads).repartition("_b")
    if derived:  # after the rows have moved: what is derived doesn't move
        both = both.withColumn("_own", F.struct("_own.*", *(f(F.col("_own")).alias(c) for c, f in derived.items())))
    w = Window.partitionBy("_b").orderBy("_last", "_k", "_h", *(f"_own.{v}" for v in values))
    own = [F.col("_own")[c].alias(c) if c in values else F.col(c) for c in docs.columns]
    return both.withColumn("next", F.lead("_own").over(w)).where(~F.col("_last")).select(*own, *(F.col("_own")[c].alias(c) for c in derived), "next")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """For every row (doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint): fingerprints of the text, of
    the text whose second half is replaced by as much of the next document's beginning, and of the next document.

    Null texts count as empty. A table of one row follows itself. Rows with a null doc_id come first. Extra columns are not
    looked at; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(base, "doc_id", ["text"], fingerprint=lambda own: fingerprint(signatures(own["text"])))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next")["text"], F.lit(1), half))
    out = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next")["fingerprint"].alias("next_fingerprint"))
    return out.withColumn("edited_fingerprint", fingerprint(signatures(F.col("edited"))))


def matches(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of fingerprint classes, by their smallest doc_id, at that likeness or more; class_of gives members.

    Sets are dealt out by length partition, each bounded by what the similarity allows, and within it by the signatures
    that are rarest over all texts: of two alike sets, one such signature is shared (prefix filtering), so that common
    signatures never bring texts together. Pairs are compared only if their sizes allow the similarity.

    Null and empty texts share a class (the words of none). Rows with equal sets are one class, so they give no pairs; a class of
    rows without ids has a null id and no pairs. Extra columns are not looked at; an empty table gives no rows.
    """
    classes = written(class_of(docs).groupBy("class").agg(F.first("sigs").alias("sigs")))
    n = F.size("sigs")
    counted = classes.select("class", n.alias("n"), F.explode("sigs").alias("sig"))
    df = written(counted.groupBy("sig").agg(F.count("*").alias("df")))
    ranked = counted.join(df, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("df", "sig")))
    rare = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1).select("class", "n", "sig")
    # length partitions: n falls in one, and alike sets in the same or the next
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity))).cast("int")
    left = rare.select(F.col("class").alias("a"), F.col("n").alias("na"), "sig", part.alias("part"))
    right = rare.select(F.col("class").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(part - 1, part, part + 1)).alias("part"))
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * similarity)
    pairs = left.join(right, ["part", "sig"]).where(close).select("a", "b").distinct()
    x, y = classes.select(F.col("class").alias("a"), F.col("sigs").alias("x")), classes.select(F.col("class").alias("b"), F.col("sigs").alias("y"))
    found = pairs.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("x"), F.col("y"), similarity).alias("likeness"))
    return found.where(F.col("likeness") >= similarity)


def class_of(docs: DataFrame) -> DataFrame:
    """(doc_id, class, sigs): rows with equal signature sets share the smallest doc_id as class, null if none has one. Null and empty
    texts are equal. Every row has a result, repeated ones, too; extra columns are not looked at; an empty table gives no rows."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("sigs")).withColumn("key", F.xxhash64("sigs")))
    least = written(rows.groupBy("key").agg(F.min("doc_id").alias("class")))
    return rows.join(least, "key").select("doc_id", "class", "sigs")
