"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece crosses. The most frequent units of the whole corpus (at
most HOT) are encoded relationally: their substrings of bounded length are exploded and
equi-joined to the piece table, the edges are grouped by unit, and Spark's higher-order
aggregate() folds each group into its tokens. The fold follows the model's own rule: Viterbi by
total score for unigram models; for BPE models, merges in score order on a bit mask of the cut
points, as Viterbi over BPE scores gives other tokens than the tokenizer.

The encoded units are a table of bounded size, so it is broadcast; texts are then assembled from
it in one pass without a shuffle, and units outside it (rarer, or longer than LONGEST characters)
are encoded on the spot by the same rule, with a bounded memo.

Decoding looks the pieces up in Spark expressions, without Python workers.

Defined cases: a null text has null ids and decodes to null, an empty one has none; a text of any
length is encoded whole; a literal "▁" decodes as a space, as in the library; ids that the model
lacks decode to nothing; of pieces with equal score the leftmost merges first (BPE), the longest
last piece wins (unigram); repeated rows are encoded row by row; an empty table gives an empty
table; other columns are kept, but a column named like the result is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .pieces import BLANK, BPE, MODEL, UNKNOWN_PENALTY, Pieces

#: Units in the broadcast table, at most.
HOT = 200_000
#: Characters of a unit in the lattice, at most: cut points are bits of one long.
LONGEST = 60
#: Units that a counting task holds before it passes them on.
FLUSH = 100_000

#: Characters of rarer units that a worker remembers, and the longest unit that it does.
RARE_CHARS, RARE_UNIT = 1_000_000, 200

_LOADED: dict = {}


def unit_counts(docs: DataFrame, model: Pieces, text: str = "text") -> DataFrame:
    """unit, n over all whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("unit", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, seen = shared.value.units, Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)
            seen.clear()
            return batch

        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen.update(units(x or ""))
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    partial = docs.select(text).mapInArrow(count, "unit string, n long")
    return partial.groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, hot: int = HOT) -> DataFrame:
    """The units whose count is so high that no more than hot units reach it; counts are compared by eighths of a power of two, so the report has some hundred rows."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > hot:
            break
        least = row["step"]
    return counts.filter(step >= least) if least is not None else counts.limit(0)


def piece_table(spark: SparkSession, model: Pieces) -> DataFrame:
    """piece, id, score, rank (equal for equal scores, 0 the best)."""
    ranks = {s: k for k, s in enumerate(sorted({model.scores[i] for i in model.ids.values()}, reverse=True))}
    rows = [(p, i, float(model.scores[i]), ranks[model.scores[i]]) for p, i in model.ids.items()]
    return spark.createDataFrame(rows, "piece string, id int, score float, rank long")


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """unit, edges array<struct<e, s, score, id, rank>>: all pieces in each unit with their places, grouped by unit."""
    n = F.char_length("unit")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - s)), lambda k: F.struct(s.alias("s"), (s + k).alias("e")))))
    cut = units.select("unit", F.explode(spans).alias("x")).select("unit", "x.s", "x.e", F.expr("substring(unit, x.s + 1, x.e - x.s)").alias("piece"))
    # The piece table is the model file's vocabulary: tens of thousands of rows whatever the corpus.
    edges = cut.join(F.broadcast(pieces), "piece").select("unit", F.struct("e", "s", "score", "id", "rank").alias("edge"))
    return units.join(edges.groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges")), "unit", "left").withColumn("edges", F.coalesce("edges", F.expr("array()").cast("array<struct<e:int,s:int,score:float,id:int,rank:bigint>>")))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _merged(edges: Column, size: Column) -> Column:
    """BPE fold: the cut points left (bits) after joining, again and again, the best piece that spans just two parts."""
    joined = F.transform(F.filter(edges, lambda x: x["e"] - x["s"] > 1), lambda x: F.struct(x["rank"].alias("rank"), x["s"].alias("s"), _bit(x["s"]).bitwiseOR(_bit(x["e"])).alias("ends"), (_bit(x["e"]) - _bit(x["s"] + 1)).alias("inner")))

    def fold(best: Column) -> Column:
        fits = lambda cuts: F.filter(best, lambda x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inner"])) == 1))
        step = lambda cuts, _: F.coalesce(cuts.bitwiseAND(F.bitwise_not(F.get(fits(cuts), F.lit(0))["inner"])), cuts)
        return F.aggregate(F.sequence(F.lit(1), size), _bit(size + 1) - 1, step)

    # Best first: by rank, then from the left.
    return common.let(F.sort_array(joined), fold)


def encode_units(units: DataFrame, model: Pieces) -> DataFrame:
    """unit, ids for distinct units of 1 to LONGEST characters; an id below zero is a character without a piece (-1 less its code point, so that NUL has one too)."""
    long = lambda x: F.lit(x).cast("long")
    # A set number of partitions: the units are few bytes but much work, and adaptive execution would put them in one task.
    spark = units.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    df = lattice(units.repartition(parts, "unit"), piece_table(spark, model), model.longest).withColumn("size", F.char_length("unit"))
    code = lambda s: -1 - F.ascii(F.substring(F.col("unit"), s + 1, F.lit(1)))
    if model.kind == BPE:
        places = lambda cuts: F.filter(F.sequence(F.lit(0), F.col("size")), lambda k: cuts.bitwiseAND(_bit(k)) != 0)
        token = lambda at, s, i: F.coalesce(F.get(F.filter("edges", lambda x: (x["s"] == s) & (x["e"] == F.get(at, i + 1))), F.lit(0))["id"], code(s))
        tokens = lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda s, i: token(at, s, i))
        return df.select("unit", common.let(_merged(F.col("edges"), F.col("size")), lambda cuts: common.let(places(cuts), tokens)).alias("ids"))
    unknown = min(model.scores[i] for i in model.ids.values()) - UNKNOWN_PENALTY
    lone = F.transform(F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda s: ~F.exists("edges", lambda x: (x["s"] == s) & (x["e"] == s + 1))), lambda s: F.struct((s + 1).alias("e"), s.alias("s"), F.lit(unknown).cast("float").alias("score"), code(s).alias("id"), long(0).alias("rank")))
    df = df.withColumn("edges", F.sort_array(F.concat("edges", lone)))
    state = "struct<best:float,from:int,id:int>"

    def reach(states: Column, end: Column) -> Column:
        """The states with the best way to end; edges come by start, so the longest last piece wins a tie."""
        ways = F.transform(F.filter("edges", lambda x: x["e"] == end), lambda x: F.struct((F.get(states, x["s"])["best"] + x["score"]).alias("best"), x["s"].alias("from"), x["id"].alias("id")).cast(state))
        return F.concat(states, F.array(F.aggregate(ways, F.lit(None).cast(state), lambda a, x: F.when(a.isNull() | (x["best"] > a["best"]), x).otherwise(a))))

    df = df.withColumn("states", F.aggregate(F.sequence(F.lit(1), F.col("size")), F.array(F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("from"), F.lit(0).alias("id")).cast(state)), reach))
    back = F.aggregate(
        F.sequence(F.lit(1), F.col("size")),
        F.struct(F.col("size").alias("at"), F.expr("array()").cast("array<int>").alias("ids")),
        lambda a, _: F.when(a["at"] > 0, F.struct(F.get("states", a["at"])["from"].alias("at"), F.concat(F.array(F.get("states", a["at"])["id"]), a["ids"]).alias("ids"))).otherwise(a),
        lambda a: a["ids"],
    )
    return df.select("unit", back.alias("ids"))


class _Spelled(dict):
    """Unit -> its ids as bytes; units that aren't there are encoded, and some of them remembered."""

    def __init__(self) -> None:
        self.model, self.rare, self.chars = None, {}, 0

    def __missing__(self, unit: str) -> bytes:
        found = self.rare.get(unit)
        if found is None:
            found = np.array(self.model.encode_unit(unit), np.int32).tobytes()
            if len(unit) <= RARE_UNIT:
                if self.chars > RARE_CHARS:
                    self.rare.clear()
                    self.chars = 0
                self.chars += len(unit)
                self.rare[unit] = found
        return found


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: Pieces | None = None, hot: int = HOT) -> DataFrame:
    """docs with the token ids of each text in column out (array<int>)."""
    model = model or Pieces.read(MODEL)
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out.lower() and c != text])
    counts = common.saved(unit_counts(docs, model, text))
    units = frequent(counts.filter(F.char_length("unit").between(1, LONGEST)), hot).select("unit")
    table = encode_units(units, model).toArrow().combine_chunks()
    common.discard(counts)
    shared = spark.sparkContext.broadcast((model, table.column("unit").to_pylist(), _flat(table.column("ids"))))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    names_in = docs.columns
    place = names_in.index(text)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names, (offsets, values) = shared.value
        if _LOADED.get("names") is not names:
            known = _Spelled()
            for u, lo, hi in zip(names, offsets, offsets[1:]):
                part = values[lo:hi]
                if (part < 0).any():
                    part = np.array([y for x in part.tolist() for y in ([x] if x >= 0 else model.fallback(chr(-1 - x)))], np.int32)
                known[u] = part.tobytes()
            _LOADED.update(names=names, known=known)
        known = _LOADED["known"]
        known.model = model
        for batch in batches:
            texts = batch.column(place)
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256).to_pylist()
                coded = [None if x is None else b"".join(map(known.__getitem__, model.units(x))) for x in part]
                ends = np.cumsum([0] + [len(x or b"") // 4 for x in coded]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(x or b"" for x in coded), np.int32)), mask=pa.array([x is None for x in coded]))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, 256).columns, ids], names=[*names_in, out])

    return docs.mapInArrow(assemble, schema)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    one = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    return np.asarray(one.offsets), np.asarray(one.values).astype(np.int32)


def decode(coded: DataFrame, ids: str = "ids", out: str = "decoded", model: Pieces | None = None) -> DataFrame:
    """coded with the text of each list of ids in column out. The pieces' bytes are joined as hexadecimal digits, as byte pieces are parts of characters."""
    model = model or Pieces.read(MODEL)
    spelled = F.split(F.lit(",".join(x.hex() for x in model.spelled)), ",")
    digits = F.array_join(F.transform(F.col(ids), lambda i: F.get(spelled, i)), "")
    text = F.make_valid_utf8(F.unhex(digits).cast("string"))
    if model.dummy_prefix:
        text = F.when(text.startswith(" "), F.substring(text, 2, 2147483647)).otherwise(text)
    return coded.withColumn(out, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents encoded and decoded again; ids as their number and hash, and whether the round trip gave the text."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    df = decode(encode(docs))
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.replace("text", F.lit(BLANK), F.lit(" "))).alias("round_trip"),
    )
