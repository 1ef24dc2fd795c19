"""Regular path queries: who is reached from each anchor by a path whose predicates match an expression.

Expressions are built from step(predicate) with + (then), | (or), ~ (walked backwards), star(),
plus(), maybe() and times(): (step("hasMother") | step("hasFather")).plus() + step("hasBrother").
An expression becomes an automaton of as many states as it has steps, those that behave alike put
together. The walk is a breadth-first search over (anchor, state, node): each round joins the last
round's rows with the automaton's moves (a few rows, as many as the expression has) and with the edges,
and keeps what no round has seen. Every round is a written table.

An expression without repetition walks as many rounds as its longest path; others until nothing new is
found, which is at most the states times the nodes. Where repetition can't go in circles (lines of descent) and
most nodes are anchors, each node's answer is instead put together once from those of the nodes a step on, one array
a node, as soon as those are known: the work is that of the answers, whatever the
number of rounds. It is done from the ends of the paths where that side has more nodes, so shorter arrays.

Defined cases: an expression that matches the empty path reaches the anchor itself at distance 0;
edges and anchors with nulls match nothing; repeated edges and anchors count once; empty tables
give an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import discard, spread, written


@dataclass(frozen=True)
class Path:
    """A regular expression over predicates."""

    kind: str  # step, then, either, star
    parts: tuple = ()
    pred: str = ""
    back: bool = False

    def __add__(self, other: Path) -> Path:
        return Path("then", (self, other))

    def __or__(self, other: Path) -> Path:
        return Path("either", (self, other))

    def __invert__(self) -> Path:
        """The same paths walked backwards."""
        if self.kind == "step":
            return Path("step", pred=self.pred, back=not self.back)
        turned = tuple(~p for p in self.parts)
        return Path(self.kind, turned[::-1] if self.kind == "then" else turned)

    def star(self) -> Path:
        """Any number of times, none included."""
        return Path("star", (self,))

    def plus(self) -> Path:
        """Once or more."""
        return self + self.star()

    def maybe(self) -> Path:
        """Once or not at all."""
        return self | NOTHING

    def times(self, least: int, most: int | None = None) -> Path:
        """From least to most times (as often as least where most is left out)."""
        most = least if most is None else most
        if not 0 <= least <= most:
            raise ValueError(f"times({least}, {most})")
        rest = reduce(lambda later, _: (self + later).maybe(), range(most - least), NOTHING)
        return reduce(lambda a, b: a + b, [self] * least, NOTHING) + rest


#: The empty path.
NOTHING = Path("then")


def step(pred: str) -> Path:
    """One edge of a predicate."""
    return Path("step", pred=pred)


def any_of(*preds: str) -> Path:
    """One edge of any of the predicates."""
    return reduce(Path.__or__, map(step, preds))


@dataclass(frozen=True)
class Automaton:
    """Moves (state, pred, back, to) from state 0, the states that end a path, and whether a state can come back to itself."""

    moves: tuple[tuple[int, str, bool, int], ...]
    ends: frozenset[int]
    cyclic: bool


def automaton(path: Path) -> Automaton:
    """The automaton of an expression, with a state for each of its steps, and states of equal future merged."""
    symbols: list[tuple[str, bool]] = [("", False)]  # state 0 is entered by no symbol
    after: dict[int, set[int]] = {0: set()}

    def place(p: Path) -> tuple[set[int], set[int], bool]:
        """The states that can begin and end p, and whether p can be empty."""
        if p.kind == "step":
            symbols.append((p.pred, p.back))
            at = len(symbols) - 1
            after[at] = set()
            return {at}, {at}, False
        if p.kind == "star":
            first, last, _ = place(p.parts[0])
            for a in last:
                after[a] |= first
            return first, last, True
        found = [place(x) for x in p.parts]
        if p.kind == "either":
            return set().union(*[f for f, _, _ in found]), set().union(*[x for _, x, _ in found]), any(e for _, _, e in found)
        first, last, empty = set(), set(), True
        for f, x, e in found:
            for a in last:
                after[a] |= f
            first |= f if empty else set()
            last = x | (last if e else set())
            empty = empty and e
        return first, last, empty

    first, last, empty = place(path)
    after[0] = first
    ends = last | ({0} if empty else set())
    # States with the same moves and the same say on ending are one, until no two are.
    group = {s: int(s in ends) for s in after}
    while True:
        kinds = {s: (group[s], frozenset((symbols[t], group[t]) for t in after[s])) for s in after}
        names = {k: i for i, k in enumerate(dict.fromkeys(kinds[s] for s in sorted(after)))}
        merged = {s: names[kinds[s]] for s in after}
        if len(set(merged.values())) == len(set(group.values())):
            break
        group = merged
    moves = {(merged[s], *symbols[t], merged[t]) for s in after for t in after[s]}
    reach = {a: {a2 for s, _, _, a2 in moves if s == a} for a in merged.values()}
    for _ in reach:
        reach = {a: xs.union(*[reach[x] for x in xs]) for a, xs in reach.items()}
    return Automaton(tuple(sorted(moves)), frozenset(merged[s] for s in ends), any(a in xs for a, xs in reach.items()))


def _directed(edges: DataFrame, moves: tuple) -> DataFrame:
    """node, pred, back, next: the edges that some move can take, in the direction in which it does."""
    wanted = sorted({(pred, back) for _, pred, back, _ in moves})
    ways = [edges.filter(F.col("pred").isin([p for p, b in wanted if b == back])).select(F.col("dst" if back else "src").alias("node"), "pred", F.lit(back).alias("back"), F.col("src" if back else "dst").alias("next")) for back in {b for _, b in wanted}]
    return reduce(DataFrame.unionByName, ways).dropna().distinct()


#: Nodes that one array may hold; where some node reaches more, rows are walked.
ARRAY = 1 << 17
_STEP = "state", "at", "letter", "of", "to", "alone"


def _letters(plan: Automaton) -> dict[str, str]:
    """A letter for each step. Letters are in the order of the predicates, so words compare as their lists do, in UTF-8 as in UTF-16."""
    said = sorted({("^" if back else "") + pred for _, pred, back, _ in plan.moves})
    if len(said) > 0x7000:
        raise ValueError(f"{len(said)} different steps; 28,672 at most")
    return {s: chr(0x30 + k) for k, s in enumerate(said)}


def _spelled(word: Column, letters: dict[str, str]) -> Column:
    """A word as the list of its steps."""
    none = F.array().cast("array<string>")
    if not letters:
        return none
    marks = [chr(0xE000 + k) for k in range(len(letters) + 1)]  # private characters: the steps, and what stands before each
    if len(letters) > 64 or any(m in s for s in letters for m in marks):
        names = F.create_map(*[F.lit(x) for s, c in letters.items() for x in (c, s)])
        return F.when(F.length(word) == 0, none).otherwise(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.element_at(names, F.substr(word, i, F.lit(1)))))
    text = F.translate(word, "".join(letters.values()), "".join(marks[:-1]))
    for mark, name in zip(marks, letters):
        text = F.replace(text, F.lit(mark), F.lit(marks[-1] + name))
    return F.when(F.length(word) == 0, none).otherwise(F.split(F.substr(text, F.lit(2)), marks[-1]))


def _steps(ways: DataFrame, starts: DataFrame, plan: Automaton, letters: dict[str, str]) -> tuple[DataFrame, bool, dict[int, int]]:
    """state, at, letter, of, to, alone: what is known of at in state holds what is known of to in of, a letter longer, and where alone also to itself; whether that is seen from the ends of the paths; states that know the same by the one that stands for them."""
    reach = {a: {t for s, _, _, t in plan.moves if s == a} for m in plan.moves for a in (m[0], m[3])}
    for _ in reach:
        reach = {a: xs.union(*[reach[x] for x in xs]) for a, xs in reach.items()}
    again = {(pred, back) for s, pred, back, to in plan.moves if s in reach[to]}
    repeated = ways.filter(F.array_contains(F.array(*[F.lit(f"{int(b)}{p}") for p, b in sorted(again)]), F.concat(F.col("back").cast("int").cast("string"), "pred")))
    from_, to_ = repeated.agg(F.count_distinct("node"), F.count_distinct("next")).first()
    ends = to_ > from_
    beside = {s: frozenset((s0, p, b) for s0, p, b, t in plan.moves if t == s) if ends else frozenset((p, b, t) for s0, p, b, t in plan.moves if s0 == s) for s in reach}
    first = {s: min(x for x in reach if beside[x] == beside[s]) for s in reach}
    if ends:
        rows = {(first[t], p, b, letters["^" * b + p], first[s], s == 0) for s, p, b, t in plan.moves}
    else:
        rows = {(first[s], p, b, letters["^" * b + p], first[t], t in plan.ends) for s, p, b, t in plan.moves}
    moves = F.broadcast(ways.sparkSession.createDataFrame(sorted(rows), "state int, pred string, back boolean, letter string, of int, alone boolean"))
    at, to = ("next", "node") if ends else ("node", "next")
    steps = ways.join(moves, ["pred", "back"]).select("state", F.col(at).alias("at"), "letter", "of", F.col(to).alias("to"), "alone")
    if ends:  # a path that begins at to counts if that is asked for
        steps = steps.join(starts.select(F.col("anchor").alias("to"), F.lit(True).alias("asked")), "to", "left").withColumn("alone", F.col("alone") & F.col("asked").isNotNull())
    return written(steps.select(*_STEP)), ends, first


def _nearest(found: Column) -> Column:
    """(node, dist, word) once a node, the least; in order."""
    return F.get(F.transform(F.array(F.sort_array(found)), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x["node"] != F.get(xs, i - 1)["node"]))), F.lit(0))


def _pulled(ways: DataFrame, starts: DataFrame, plan: Automaton, letters: dict[str, str]) -> DataFrame | None:
    """anchor, node, dist, word of all paths of a step or more, by arrays; None where walks can go on for ever or a node reaches too many. A round takes those of whose steps on all are known; what others know so far is carried on."""
    steps, ends, first = _steps(ways, starts, plan, letters)
    key = ["state", "at"]
    inner = steps.select(F.col("state").alias("of"), F.col("at").alias("to")).distinct().withColumn("inner", F.lit(True))
    steps = steps.join(inner, ["of", "to"], "left").withColumn("inner", F.col("inner").isNotNull())
    asked = written(steps.groupBy(*key).agg(F.count_if("inner").alias("need")))
    steps = written(steps.join(asked, key))
    kind = steps.schema["to"].dataType.simpleString()
    none = F.array().cast(f"array<struct<node:{kind},dist:int,word:string>>")
    one = F.when(F.col("alone"), F.array(F.struct(F.col("to").alias("node"), F.lit(1).alias("dist"), F.col("letter").alias("word")))).otherwise(none)
    longer = lambda w: F.concat(w, "letter") if ends else F.concat("letter", w)
    grown = F.transform("found", lambda x: F.struct(x["node"].alias("node"), (x["dist"] + 1).alias("dist"), longer(x["word"]).alias("word")))
    left = asked.count()
    if not left:
        return None
    more = steps.filter("not inner").select(*key, "need", F.lit(0).alias("got"), one.alias("x"))
    known: list[DataFrame] = []
    while left:
        seen = Observation()
        df = spread(more, *key).groupBy(*key, "need").agg(F.sum("got").alias("got"), F.flatten(F.collect_list("x")).alias("x")).withColumn("ready", F.col("got") == F.col("need"))
        df = df.withColumn("x", F.when(F.col("ready"), _nearest(F.col("x"))).otherwise(F.col("x")))
        df = written(df.observe(seen, F.count_if("ready").alias("ready"), F.max(F.size("x")).alias("most"), F.count("*").alias("rows")))
        if not seen.get["ready"] or seen.get["most"] > ARRAY:
            return None
        left -= seen.get["ready"]
        known.append(df.filter("ready").select(*key, F.col("x").alias("found")))
        theirs = known[-1].withColumnsRenamed({"state": "of", "at": "to"})
        more = steps.filter("inner").join(theirs, ["of", "to"]).select(*key, "need", F.lit(1).alias("got"), F.concat(grown, one).alias("x"))
        if seen.get["rows"] > seen.get["ready"]:
            more = more.unionByName(df.filter("not ready").select(*more.columns))
    last = {first[s] for s in plan.ends if s in first} if ends else {first[0]}
    all_ = reduce(DataFrame.unionByName, known).filter(F.col("state").isin(list(last))).select("at", "found")
    if len(last) > 1:
        all_ = all_.groupBy("at").agg(_nearest(F.flatten(F.collect_list("found"))).alias("found"))
    if not ends:
        all_ = all_.join(starts.withColumnRenamed("anchor", "at"), "at", "left_semi")
    rows = all_.select("at", F.explode("found").alias("x")).select(*[c.alias(n) for c, n in ((F.col("x.node" if ends else "at"), "anchor"), (F.col("at" if ends else "x.node"), "node"), (F.col("x.dist"), "dist"), (F.col("x.word"), "word"))])
    return rows


def reach(edges: DataFrame, anchors: DataFrame, path: Path) -> DataFrame:
    """anchor, node, dist, word: every node reached from each of anchors (id) along edges (src, pred, dst) by path, with the length of the shortest such path and, of the predicates along those, the least list in order (^ marks an edge walked backwards)."""
    plan = automaton(path)
    letters = _letters(plan)
    starts = written(anchors.select(F.col("id").alias("anchor")).dropna().distinct())
    ways = written(_directed(edges, plan.moves)) if plan.moves else None
    found = None
    if plan.cyclic and 2 * starts.count() >= ways.select("node").distinct().count():
        found = _pulled(ways, starts, plan, letters)
        if found is not None and 0 in plan.ends:
            itself = starts.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("dist"), F.lit("").alias("word"))
            found = itself.unionByName(found.filter("anchor <> node"))
    if found is None:
        found = _walked(ways, starts, plan, letters)
    if ways is not None:
        discard(ways)
    return found.select("anchor", "node", "dist", _spelled(F.col("word"), letters).alias("word"))


def _walked(ways: DataFrame | None, starts: DataFrame, plan: Automaton, letters: dict[str, str]) -> DataFrame:
    """anchor, node, dist, word by a row for each (anchor, state, node), round by round."""
    spark = starts.sparkSession
    rounds = [written(starts.select("anchor", F.lit(0).alias("state"), F.col("anchor").alias("node"), F.lit(0).alias("dist"), F.lit("").alias("word")))]
    if plan.moves:
        moves = spark.createDataFrame([(s, p, b, to, letters[("^" if b else "") + p]) for s, p, b, to in plan.moves], "state int, pred string, back boolean, to int, letter string")
        while not rounds[-1].isEmpty():
            # The least word of a row grows from the least word of a row before it.
            grown = rounds[-1].join(F.broadcast(moves), "state").join(ways, ["node", "pred", "back"])
            grown = grown.groupBy("anchor", F.col("to").alias("state"), F.col("next").alias("node")).agg(F.min(F.concat("word", "letter")).alias("word")).withColumn("dist", F.lit(len(rounds)))
            if plan.cyclic:
                seen = reduce(DataFrame.unionByName, [r.select("anchor", "state", "node") for r in rounds])
                grown = grown.join(seen, ["anchor", "state", "node"], "left_anti")
            rounds.append(written(grown.select("anchor", "state", "node", "dist", "word")))
    ended = reduce(DataFrame.unionByName, [r.filter(F.col("state").isin(list(plan.ends))) for r in rounds])
    best = ended.groupBy("anchor", "node").agg(F.min(F.struct("dist", "word")).alias("x"))
    return best.select("anchor", "node", "x.dist", "x.word")


def exactly(edges: DataFrame, anchors: DataFrame, preds: list[str], hops: int) -> DataFrame:
    """anchor, node, words: who is reached by walks of exactly so many edges of the given predicates, but the anchor itself, with all predicate lists that lead there, in order. No list of paths is needed; each hop's rows are distinct before the next."""
    ways = written(edges.filter(F.col("pred").isin(preds)).select("src", "pred", "dst").dropna().distinct())
    front = anchors.select(F.col("id").alias("anchor"), F.col("id").alias("node")).dropna().distinct().withColumn("word", F.array().cast("array<string>"))
    for _ in range(hops):
        front = written(front.join(ways, F.col("node") == F.col("src")).select("anchor", F.col("dst").alias("node"), F.concat("word", F.array("pred")).alias("word")).distinct())
    return front.filter("anchor <> node").groupBy("anchor", "node").agg(F.array_sort(F.collect_set("word")).alias("words"))
