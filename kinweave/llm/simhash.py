"""SimHash near-duplicates by pivot distance tables.

Every fingerprint gets its Hamming distances to fixed reference fingerprints, whole and by block
of 16 bits. Two fingerprints with at most 2 differing bits agree in at least two of the four
blocks, so they have equal coordinates there: an equi-join on the block coordinates finds all of
them. A pair is discarded when a coordinate differs by more than the radius (triangle inequality),
and survivors are verified.

Equal fingerprints are one class before any pair is made. In a bucket with many classes, each
member is first paired with the least member round each of its 33 local references (it and its
neighbours by one bit in the blocks that may differ): two members link just when some local
reference lies within one bit of both, so this keeps every component with a fixed number of pairs
a member. All pairs, of small and of large buckets, pass the same discarding and verification.

Two rules are offered. dedup() links fingerprints within RADIUS bits (the digest query).
near_dedup() links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more: their fingerprints differ in 10 bits at that similarity and in up to NEAR_RADIUS at the
worst, where blocks can't be matched any more, so its candidates meet in the texts' sketches (the
SKETCH least shingle hashes); reference distances and fingerprints discard, and the whole shingle
sets verify. The first SKETCH hashes of the union of two similar texts have none in common with a
chance of 0.2 ** SKETCH, less than that of two texts having one 64-bit hash.

A bucket of near copies makes no square of pairs: each class is held against HUBS members first,
and members that this has joined are not held against each other again. In a bucket of over CROWD
classes (a passage that many texts quote) no pairs are made at all: similar texts meet in a smaller
bucket unless all that their sketches have in common is in such buckets, and for texts of which
that can be true a prefix join over their whole sets decides. With the elements that are rarest
among these texts first, two sets of similarity t have one in common in their first n - t n + 1
elements; what a text adds of its own to a passage comes first, so the passage's buckets stay empty
unless texts consist of little else.

Defined cases: null and empty texts have fingerprint zero and no shingles, and are linked like any
other; texts shorter than a shingle give one shingle; texts of any length are read whole; a null
id takes part, and is not a component id unless all ids of its component are null; of tied
representatives the least id stays; repeated rows are kept by dedup(); an empty table gives an
empty table; other columns are ignored by dedup() and near_dedup() and kept by representatives().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import connected_components, rooted, stars

SEED = 42
SHINGLE = 3
RADIUS = 2
BLOCK_BITS, BLOCKS = 16, 4
REFERENCES = 15
#: Buckets with more classes than this are paired through local references.
PAIRED = 16
#: near_dedup(): shingle size, similarity as a fraction (so that no rounding decides), elements of a sketch.
NEAR_SHINGLE, SIMILARITY, SKETCH = 5, (4, 5), 28
#: Differing bits of the fingerprints of similar texts with more than SKETCH elements, at most: at the similarity itself a bit differs with probability acos(8/9) / pi, and more than 32 of 64 do once in 80 billion pairs.
NEAR_RADIUS = 32
#: Elements that the sketches of such texts have in common at least; they have some 22, and fewer than this once in 300 billion pairs.
OVERLAP = 6
HUBS, TRIED = 6, 4
#: Classes of a large bucket; elements of large buckets in the sketch of a text that may have no rarer one in common with a similar text (with fewer the chance is one in a billion).
CROWD, CROWDED = 64, 8
#: Buckets in which the elements of crowded texts are counted.
COUNTED = 1 << 20
#: Ids and elements up to this number are broadcast; above it the planner decides.
FEW = 500_000
_CHUNK = 1 << 16


def hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, in order, repeats included; bytes.lower() and bytes.split() touch A-Z and the six ASCII blanks only."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1))).tolist()
    ends = ends[min(shingle, len(found)) - 1 :].tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends))


def majority(found: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed integer; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), _CHUNK):
        bits = np.unpackbits(found[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (signed) for every row."""

    @F.pandas_udf("long")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in column], dtype="int64")

    return docs.select(F.col(key).alias("key"), of(F.col(text).cast("binary")).alias("fp"))


def references() -> list[int]:
    """The fixed reference fingerprints: hashes of 1, 2, ..."""
    return [xxhash.xxh64_intdigest(b"reference %d" % (k + 1), SEED) for k in range(REFERENCES)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_coordinates(fp: Column, block: int) -> Column:
    """The distances within one block to all references, as digits of one long (17^15 < 2^63)."""
    mask = (1 << BLOCK_BITS) - 1
    part = F.shiftrightunsigned(fp, BLOCK_BITS * block).bitwiseAND(F.lit(mask).cast("long"))
    digits = [F.bit_count(part.bitwiseXOR(F.lit((r >> BLOCK_BITS * block) & mask).cast("long"))).cast("long") for r in references()]
    return reduce(lambda a, d: a * (BLOCK_BITS + 1) + d, digits)


def _within(a: Column, b: Column, radius: int) -> Column:
    """Whether two fingerprints pass: no distance to a reference differs by more than radius, nor do more bits."""
    to = lambda fp, r: F.bit_count(fp.bitwiseXOR(F.lit(_signed(r)).cast("long")))
    gap = F.greatest(*[F.abs(to(a, r) - to(b, r)) for r in references()])
    return (gap <= radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)


def links(classes: DataFrame) -> DataFrame:
    """fp, other: edges between different fingerprints that give the components of all pairs within RADIUS bits."""
    tables = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
    blocks = classes.select("fp", *[_block_coordinates(F.col("fp"), b).alias(f"b{b}") for b in range(BLOCKS)])
    keyed = blocks.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"b{i}").alias("ka"), F.col(f"b{j}").alias("kb")) for t, (i, j) in enumerate(tables)])).alias("k")).select("fp", "k.*")
    buckets = keyed.groupBy("t", "ka", "kb").agg(F.count("*").alias("n")).filter("n > 1")
    members = common.saved(keyed.join(buckets, ["t", "ka", "kb"]))
    few = members.filter(F.col("n") <= PAIRED)
    a, b = few.select("t", "ka", "kb", "fp"), few.select("t", "ka", "kb", F.col("fp").alias("other"))
    pairs = a.join(b.hint("merge"), ["t", "ka", "kb"]).filter((F.col("fp") < F.col("other")) & _within(F.col("fp"), F.col("other"), RADIUS)).select("fp", "other")
    # Local references in large buckets: the member itself and its neighbours in the blocks that may differ.
    free = [[0] + [_signed(1 << (BLOCK_BITS * b + k)) for b in range(BLOCKS) if b not in t for k in range(BLOCK_BITS)] for t in tables]
    flips = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in free]), F.col("t") + 1)
    near = members.filter(F.col("n") > PAIRED).select("t", "fp", F.explode(flips).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("ref"))
    # At most 33 fingerprints lie round a local reference, so this grouping has no large group.
    hung = near.groupBy("t", "ref").agg(F.array_agg("fp").alias("fps")).filter(F.size("fps") > 1)
    hung = hung.select(F.array_min("fps").alias("fp"), F.explode("fps").alias("other")).filter((F.col("fp") != F.col("other")) & _within(F.col("fp"), F.col("other"), RADIUS))
    return pairs.unionByName(hung).distinct()


def _named(classes: DataFrame, links_: DataFrame, a: str, b: str) -> DataFrame:
    """cls, least (key) of classes -> cls, component_id (the smallest key reachable), rep (the class that holds it)."""
    roots = connected_components(links_, a, b)
    named = common.saved(classes.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.when(F.col("least").isNotNull(), F.struct("least", "cls"))).alias("rep"))
    return common.saved(named.join(ids, "root").select("cls", "component_id", F.col("rep.cls").alias("rep")))


def components(signed: DataFrame) -> DataFrame:
    """key, fp -> cls (the fingerprint), component_id, rep."""
    classes = common.saved(signed.groupBy("fp").agg(F.min("key").alias("least")))
    return _named(classes.withColumnRenamed("fp", "cls"), links(classes), "fp", "other")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fingerprint (hex), component_id for every row."""
    signed = common.saved(fingerprints(docs, key, text, shingle))
    df = signed.join(components(signed), F.col("fp") == F.col("cls"))
    return df.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicates by shingle sets ----------------------------------------------------------


def elements(text: bytes | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, as signed integers."""
    return np.unique(hashes(text, shingle).view(np.int64))


def class_of(found: np.ndarray) -> int:
    """One hash of a whole set of elements."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))


def sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """key, cls (of the whole set), n (its size), fp (its fingerprint), sketch (its least elements) for every row."""
    df = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, n, fp, sketch = [], [], [], []
            for x in b.column(1):
                found = elements(x.as_py(), shingle)
                cls.append(class_of(found))
                n.append(len(found))
                fp.append(majority(found))
                sketch.append(found[:SKETCH])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), _lists(sketch)], ["key", "cls", "n", "fp", "sketch"])

    return df.mapInArrow(of, f"key {df.schema['key'].dataType.simpleString()}, cls long, n int, fp long, sketch array<long>")


def _whole(docs: DataFrame, key: str, text: str, shingle: int, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, elements of the classes in wanted(cls): small sets are whole in their sketches, others are made again from the texts of their rows."""
    asked = common.saved(classes.join(wanted.distinct(), "cls", "left_semi").select("cls", "least", "n", "sketch"))
    small = asked.filter(F.col("n") <= SKETCH).select("cls", F.col("sketch").alias("elements"))
    want = asked.filter(F.col("n") > SKETCH).select("cls", "least")
    row = common.fresh(docs, "least")
    rows = docs.join(common.broadcast_if(want.select(F.col("least").alias(row)).distinct(), FEW), F.col(key).eqNullSafe(F.col(row)), "left_semi").select(F.col(text).cast("binary").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [elements(x.as_py(), shingle) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), _lists(sets)], ["cls", "elements"])

    found = rows.mapInArrow(of, "cls long, elements array<long>")
    return common.saved(found.join(common.broadcast_if(want.select("cls"), FEW), "cls", "left_semi").dropDuplicates(["cls"]).unionByName(small))


def _similar(pairs: DataFrame, whole: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    up, down = similarity
    df = pairs.join(whole.select(F.col("cls").alias("a"), F.col("elements").alias("xa")), "a").join(whole.select(F.col("cls").alias("b"), F.col("elements").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb")).cast("long")
    return df.withColumn("both", both).filter(F.col("both") * (up + down) >= (F.size("xa") + F.size("xb")) * up).select("a", "b")


def _prefixes(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """cls, n, fp, root, at, token: the first elements of each set, those that a similar set must have one of, in an order in which rare elements come first.

    Any order will do that is the same for all sets. This one goes by how often the elements of an
    element's bucket occur, of a fixed number of buckets (one count each is broadcast), then by the element;
    what is alone in its bucket is in no other set and goes."""
    up, down = similarity
    mask, spark = COUNTED - 1, sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTED, np.int64)
        for b in batches:
            seen += np.bincount(b.column(0).flatten().to_numpy() & mask, minlength=COUNTED)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "c"])

    found = sets.select("elements").mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(COUNTED, np.int64)
    counts[found["bucket"].to_numpy()] = found["c"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            places, tokens, sizes = [], [], []
            for x in b.column(4):
                x = x.values.to_numpy()
                often = shared.value[x & mask]
                order = np.lexsort((x, often))[: len(x) - -(-len(x) * up // down) + 1]
                at = np.flatnonzero(often[order] > 1)
                places.append(at.astype(np.int32))
                tokens.append(x[order[at]])
                sizes.append(len(at))
            rows = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(rows) for k in range(4)], pa.array(np.concatenate(places)), pa.array(np.concatenate(tokens))], ["cls", "n", "fp", "root", "at", "token"])

    return sets.select("cls", "n", "fp", "root", "elements").mapInArrow(first, "cls long, n int, fp long, root long, at int, token long")


def near_links(docs: DataFrame, classes: DataFrame, key: str, text: str, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """a, b: pairs of different classes that give the components of all similar pairs: similar ones, and stars in place of those that were already joined."""
    up, down = similarity
    keyed = classes.select("cls", "n", "fp", F.explode("sketch").alias("token"))
    # Most elements occur in one class only and go here.
    sizes = common.saved(keyed.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"))
    members = common.saved(keyed.join(common.broadcast_if(sizes, FEW), "token"))

    def candidates(df: DataFrame) -> DataFrame:
        p, q = F.col("p.n").cast("long"), F.col("q.n").cast("long")
        # A few elements say little by their majorities; their sketches say all.
        near = (F.least(p, q) <= SKETCH) | _within(F.col("p.fp"), F.col("q.fp"), NEAR_RADIUS)
        fits = (F.col("p.cls") != F.col("q.cls")) & (F.least(p, q) * down >= F.greatest(p, q) * up) & near
        return df.filter(fits).select(F.least("p.cls", "q.cls").alias("a"), F.greatest("p.cls", "q.cls").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs; those whose sketches say that they aren't go before the whole sets are made."""
        sketch = lambda who: classes.select(F.col("cls").alias(who), F.col("n").alias(f"n{who}"), F.col("sketch").alias(f"s{who}"))
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        sure = F.greatest("na", "nb") <= SKETCH
        close = F.when(sure, both * (up + down) >= (F.col("na") + F.col("nb")) * up).otherwise(both >= OVERLAP)
        pairs = common.saved(pairs.join(sketch("a"), "a").join(sketch("b"), "b").filter(close).select("a", "b", sure.alias("sure")))
        rest = pairs.filter(~F.col("sure")).select("a", "b")
        found = _similar(rest, _whole(docs, key, text, shingle, classes, rest.select(F.col("a").alias("cls")).distinct().unionByName(rest.select(F.col("b").alias("cls")).distinct())), similarity)
        return common.saved(found.unionByName(pairs.filter("sure").select("a", "b")))

    hub = lambda k: F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "n", "fp")).dropFields("h")
    hubs = members.groupBy("token").agg(F.array_distinct(F.array(*[hub(k) for k in range(HUBS)])).alias("hubs"))
    me = F.struct("cls", "n", "fp").alias("p")
    first = verified(candidates(members.join(hubs, "token").select(me, F.explode("hubs").alias("q"))))
    met = stars(first, "a", "b")
    roots = rooted(met).withColumnRenamed("node", "cls")
    named = common.saved(members.join(roots, "cls", "left").select("token", "m", "cls", "n", "fp", F.coalesce("root", "cls").alias("root")))

    def mixed(df: DataFrame) -> DataFrame:
        """The members of buckets with several components, with the bucket's most frequent one."""
        main = df.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots"))
        return common.saved(df.join(main.filter("roots > 1").select("token", F.col("most.root").alias("main")), "token"))

    def across(df: DataFrame, at: Column) -> DataFrame:
        """The pairs of different components within buckets: any has a side outside the most frequent one. at is an element's place in the order of its set, in which the first common element leaves room for the similarity.

        What room there is follows from the two sizes and places alone, so a bucket's different (size, place) are held against each other first, and members meet only where theirs fit: a bucket of texts that have too much of their own makes no pairs at all, however many they are."""
        df = df.withColumn("at", at)
        kinds = df.groupBy("token", "n", "at").agg(F.max((F.col("root") != F.col("main"))).alias("apart"))
        p = kinds.filter("apart").select("token", F.col("n").alias("pn"), F.col("at").alias("pa"))
        q = kinds.select("token", F.col("n").alias("qn"), F.col("at").alias("qa"))
        long = lambda c: F.col(c).cast("long")
        room = F.least(long("pn") - long("pa"), long("qn") - long("qa")) * (up + down) >= (long("pn") + long("qn")) * up
        fits = p.join(q.hint("merge"), "token").filter(room & (F.least(long("pn"), long("qn")) * down >= F.greatest(long("pn"), long("qn")) * up))
        me = lambda who: F.struct("cls", "n", "fp").alias(who)
        one = df.filter("root <> main").select("token", F.col("n").alias("pn"), F.col("at").alias("pa"), F.col("root").alias("pr"), me("p")).join(fits, ["token", "pn", "pa"])
        two = df.select("token", F.col("n").alias("qn"), F.col("at").alias("qa"), "main", F.col("root").alias("qr"), me("q"))
        pairs = one.join(two.hint("merge"), ["token", "qn", "qa"])
        return pairs.filter((F.col("pr") != F.col("qr")) & ((F.col("qr") == F.col("main")) | (F.col("p.cls") < F.col("q.cls"))))

    several = mixed(named)
    rest = across(several.filter(F.col("m") <= CROWD), F.lit(0))
    # Texts that can be similar to another without a rarer element of the sketches in common.
    crowd = several.filter(F.col("m") > CROWD).groupBy("cls", "n", "fp", "root").agg(F.count("*").alias("c")).filter(F.when(F.col("n") <= SKETCH, F.col("c") * down >= F.col("n") * up).otherwise(F.col("c") >= CROWDED))
    crowd = common.saved(crowd.select("cls", "n", "fp", "root"))
    prefixes = common.saved(_prefixes(crowd.join(_whole(docs, key, text, shingle, classes, crowd.select("cls")), "cls"), similarity))
    # A group of near copies that the hubs left in parts: its stragglers are held against a few members of each of their buckets before they are held against all.
    ranked = mixed(prefixes)
    some = [F.min(F.struct(F.xxhash64("cls", "token", F.lit(k)).alias("h"), "cls", "n", "fp")).dropFields("h") for k in range(TRIED)]
    near = ranked.filter("root = main").groupBy("token").agg(F.array_distinct(F.array(*some)).alias("hubs"))
    tried = verified(candidates(ranked.filter("root <> main").join(near, "token").select(F.struct("cls", "n", "fp").alias("p"), F.explode("hubs").alias("q"))))
    met = stars(met.toDF("a", "b").unionByName(tried), "a", "b")
    again = rooted(met).toDF("cls", "now")
    left = mixed(ranked.drop("main").join(again, "cls", "left").withColumn("root", F.coalesce("now", "root")).drop("now"))
    rest = candidates(rest).unionByName(candidates(across(left, F.col("at")))).distinct()
    return met.toDF("a", "b").unionByName(verified(rest))


def _near(docs: DataFrame, key: str, text: str, shingle: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """key, cls of every row, and the classes' names."""
    rows = common.saved(sketches(docs, key, text, shingle))
    classes = common.saved(rows.groupBy("cls").agg(F.min("key").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")))
    return rows.select("key", "cls"), _named(classes, near_links(docs, classes, key, text, shingle, similarity), "a", "b")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """key, component_id (the smallest key reachable over similar pairs) for every row."""
    rows, named = _near(docs, key, text, shingle, similarity)
    return rows.join(named, "cls").select(F.col("key").alias(key), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, similarity: tuple[int, int] | None = SIMILARITY) -> DataFrame:
    """One row of docs for each component: that of the least key, with its own text if the key repeats. Components are near_dedup()'s, or dedup()'s with similarity None. Rows without a key can't stand for a group or be told apart, and stay."""
    if similarity:
        rows, named = _near(docs, key, text, shingle, similarity)
    else:
        signed = common.saved(fingerprints(docs, key, text, shingle))
        rows, named = signed.select("key", F.col("fp").alias("cls")), components(signed)
    row, mine = common.fresh(docs, "row"), common.fresh(docs, "cls")
    stay = common.saved(named.filter("cls = rep").select("component_id", "cls"))
    again = common.saved(rows.filter("key is not null").groupBy("key").count().filter("count > 1").select("key"))
    # Those that go are the fewer, and the texts need no shuffle while they are few.
    gone = common.saved(rows.filter("key is not null").join(stay, F.col("key") == F.col("component_id"), "left_anti").select("key").unionByName(again).distinct().withColumnRenamed("key", row))
    kept = docs.filter(F.col(key).isNotNull()).join(common.broadcast_if(gone, FEW), F.col(key) == F.col(row), "left_anti")
    if not again.isEmpty():
        of = (lambda t: class_of(elements(t, shingle))) if similarity else (lambda t: fingerprint(t, shingle))
        cls = F.udf(lambda t: of(None if t is None else bytes(t)), "long")
        more = docs.join(again.select(F.col("key").alias(row)), F.col(key) == F.col(row), "left_semi").withColumn(mine, cls(F.col(text).cast("binary")))
        want = stay.select(F.col("component_id").alias(row), F.col("cls").alias(f"{mine}_want"))
        more = more.join(want, (F.col(key) == F.col(row)) & (F.col(mine) == F.col(f"{mine}_want")), "left_semi").dropDuplicates([key, mine])
        kept = kept.unionByName(more.drop(mine))
    return kept.unionByName(docs.filter(F.col(key).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over all documents."""
    return dedup(common.table(spark, sf_dir, "documents"))
