"""Kinship relations derived from persons(id, sex, father_id, mother_id, spouse_id) by equi-joins.

Every relation is a DataFrame of (src, pred, dst). Pairs are only ever made inside a shared
parent, ancestor or clan, never over all persons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import sibships as S
from kinweave.sources.shared import spread, written


def _edges(df: DataFrame, src: str, pred: Column | str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), (F.lit(pred) if isinstance(pred, str) else pred).alias("pred"), F.col(dst).alias("dst"))


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def by_sex(male: str, female: str, sex: str = "sex") -> Column:
    """A predicate name by sex."""
    return F.when(F.col(sex) == "M", male).otherwise(female)


def parent_edges(p: DataFrame) -> DataFrame:
    """hasMother, hasFather, hasParent, hasChild, and hasSon or hasDaughter from the parent."""
    known = _union(p.filter("mother_id is not null").select("id", "sex", F.col("mother_id").alias("parent"), F.lit("hasMother").alias("by")), p.filter("father_id is not null").select("id", "sex", F.col("father_id").alias("parent"), F.lit("hasFather").alias("by")))
    up, down = F.array(F.col("by"), F.lit("hasParent")), F.array(F.lit("hasChild"), by_sex("hasSon", "hasDaughter"))
    return _union(known.select(F.col("id").alias("src"), F.explode(up).alias("pred"), F.col("parent").alias("dst")), known.select(F.col("parent").alias("src"), F.explode(down).alias("pred"), F.col("id").alias("dst")))


def spouse_edges(p: DataFrame) -> DataFrame:
    """hasSpouse, and hasWife or hasHusband by the subject's sex."""
    return p.filter("spouse_id is not null").select(F.col("id").alias("src"), F.explode(F.array(F.lit("hasSpouse"), by_sex("hasWife", "hasHusband"))).alias("pred"), F.col("spouse_id").alias("dst"))


def siblings(p: DataFrame) -> DataFrame:
    """src, dst, sex (of dst): different persons with all four parents known who share a mother or a father."""
    full = p.filter("mother_id is not null and father_id is not null")
    one = lambda parent: full.select(F.col("id").alias("src"), F.col(parent).alias("via")).join(full.select(F.col("id").alias("dst"), "sex", F.col(parent).alias("via")), "via").filter("src <> dst").select("src", "dst", "sex")
    return one("mother_id").unionByName(one("father_id")).distinct()


def sibling_edges(p: DataFrame, sib: DataFrame | None = None) -> DataFrame:
    """hasSibling, and hasBrother or hasSister by the other's sex. sib: siblings(p), where it is there already."""
    return (siblings(p) if sib is None else sib).select("src", F.explode(F.array(F.lit("hasSibling"), by_sex("hasBrother", "hasSister"))).alias("pred"), "dst")


def grandparent_edges(p: DataFrame) -> DataFrame:
    """The four sided grandparent predicates, hasGrandmother or hasGrandfather, hasGrandparent and the inverse hasGrandchild."""
    parents = lambda via: p.select("id", F.explode(F.array(F.struct(F.lit("Maternal").alias("side"), F.col("mother_id").alias("to"), F.lit("mother").alias("who")), F.struct(F.lit("Paternal").alias("side"), F.col("father_id").alias("to"), F.lit("father").alias("who")))).alias(via)).filter(f"{via}.to is not null")
    two = parents("a").join(parents("b").withColumnRenamed("id", "mid"), F.col("a.to") == F.col("mid"))
    names = F.array(F.concat(F.lit("has"), F.col("a.side"), F.lit("Grand"), F.col("b.who")), F.concat(F.lit("hasGrand"), F.col("b.who")), F.lit("hasGrandparent"))
    up = two.select(F.col("id").alias("src"), F.explode(names).alias("pred"), F.col("b.to").alias("dst"))
    return _union(up, two.select(F.col("b.to").alias("src"), F.lit("hasGrandchild").alias("pred"), F.col("id").alias("dst"))).distinct()


def parents_siblings(p: DataFrame, sib: DataFrame | None = None) -> DataFrame:
    """src, side (Maternal or Paternal), dst, sex: siblings of each known parent."""
    sib = (siblings(p) if sib is None else sib).select(F.col("src").alias("parent"), "dst", "sex")
    side = lambda col, name: p.select(F.col("id").alias("src"), F.col(col).alias("parent"), F.lit(name).alias("side")).filter("parent is not null")
    return side("mother_id", "Maternal").unionByName(side("father_id", "Paternal")).join(sib, "parent").select("src", "side", "dst", "sex")


def aunt_uncle_edges(p: DataFrame, sib: DataFrame | None = None) -> DataFrame:
    """hasUncle or hasAunt, and the sided predicate."""
    who = by_sex("Uncle", "Aunt")
    return parents_siblings(p, sib).select("src", F.explode(F.array(F.concat(F.lit("has"), who), F.concat(F.lit("has"), F.col("side"), who))).alias("pred"), "dst").distinct()


def basic_edges(p: DataFrame) -> DataFrame:
    """All biological edges but cousins; siblings are found once."""
    sib = written(siblings(p))
    return _union(parent_edges(p), spouse_edges(p), sibling_edges(p, sib), grandparent_edges(p), aunt_uncle_edges(p, sib))


#: Low bits of a packed ancestor: the distance, and one bit in which mrca() marks the second person. The id stands above.
_DIST_BITS, _LOW_BITS, _ID_BITS = 15, 16, 32


def _packed(who: Column | str, dist: int | Column) -> Column:
    who = F.col(who) if isinstance(who, str) else who
    return F.shiftleft(who.cast("long"), _LOW_BITS) + (F.lit(dist).cast("long") if isinstance(dist, int) else dist.cast("long"))


def _who(x: Column) -> Column:
    return F.shiftright(x, _LOW_BITS)


def _dist(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _DIST_BITS) - 1).cast("long"))


def _nearest(packed: Column) -> Column:
    """A sorted array with each ancestor once, at the least distance."""
    ordered = F.array_sort(packed)
    return F.get(F.transform(F.array(ordered), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (_who(x) != _who(F.get(xs, i - 1))))), F.lit(0))


def _doubled(p: DataFrame, depth: int | None = None) -> DataFrame:
    """id, ancs: one sorted array a person that holds all ancestors (or those within depth steps) and oneself, each packed with the least distance.

    By doubling: who knows the ancestors up to k steps away asks those exactly k steps away for theirs,
    which gives all up to 2 k; so the joins are as many as the logarithm of the depth, and each is a
    written table. An array is as long as a person has ancestors."""
    low, high = p.agg(F.min(F.least("id", "mother_id", "father_id")), F.max(F.greatest("id", "mother_id", "father_id"))).first()
    if low is not None and not 0 <= low <= high < 1 << _ID_BITS:
        raise ValueError(f"ids must lie from 0 to 2^{_ID_BITS} - 1; found {low} to {high}")
    own = F.filter(F.array(_packed("id", 0), _packed("mother_id", 1), _packed("father_id", 1)), lambda x: x.isNotNull())
    df, k = written(spread(p.select("id", _nearest(own).alias("ancs")), "id")), 1
    while depth is None or k < depth:
        if k >= 1 << _DIST_BITS - 1:
            raise ValueError(f"a line of 2^{_DIST_BITS - 1} generations or more")
        # Columns are built at once, so the lambdas see this round's k.
        ends = df.select("id", F.explode(F.transform(F.filter("ancs", lambda x: _dist(x) == k), _who)).alias("end"))
        theirs = df.filter(F.size("ancs") > 1).select(F.col("id").alias("end"), F.transform(F.filter("ancs", lambda x: _dist(x) > 0), lambda x: x + k).alias("far"))
        more = ends.join(theirs, "end").groupBy("id").agg(F.flatten(F.collect_list("far")).alias("far"))
        after = written(spread(df, "id").join(more.hint("merge"), "id", "left").select("id", F.when(F.col("far").isNull(), F.col("ancs")).otherwise(_nearest(F.concat("ancs", "far"))).alias("ancs"), F.col("far").isNotNull().alias("grown")))
        if after.filter("grown").isEmpty():
            break
        df, k = after.select("id", "ancs"), 2 * k
    return df if depth is None else df.select("id", F.filter("ancs", lambda x: _dist(x) <= depth).alias("ancs"))


def ancestor_arrays(p: DataFrame, depth: int | None = None) -> DataFrame:
    """id, ancs of all persons, see _doubled()."""
    return _doubled(p, depth)


def closure(p: DataFrame, depth: int | None = None) -> DataFrame:
    """id, anc, dist: all ancestors (or those within depth steps) with their least distance, oneself at 0, one row each from ancestor_arrays()."""
    df = ancestor_arrays(p, depth).select("id", F.explode("ancs").alias("x"))
    return df.select("id", _who(F.col("x")).cast("int").alias("anc"), _dist(F.col("x")).cast("int").alias("dist"))


def _chosen(df: DataFrame, *pair: str) -> DataFrame:
    """The pair (a, b), mrca, da, db from x, the least packed long (sum, ancestor, da) of each pair."""
    pair = pair or ("a", "b")
    cut = lambda low, bits: F.shiftright(F.col("x"), low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    df = df.select(*pair, cut(_DIST_BITS, _ID_BITS).alias("mrca"), cut(0, _DIST_BITS).alias("da"), cut(_ID_BITS + _DIST_BITS, _LOW_BITS).alias("sum"))
    return df.select(*pair, "mrca", "da", (F.col("sum") - F.col("da")).alias("db"))


def _choice(anc: Column, da: Column, db: Column) -> Column:
    """The sort key of a common ancestor: least sum of distances, then least id; the smaller da of equal ones."""
    long = lambda c: c.cast("long")
    return F.shiftleft(long(da + db), _ID_BITS + _DIST_BITS) + F.shiftleft(long(anc), _DIST_BITS) + long(da)


#: Generations that pairs are followed upwards at a time.
STEP = 4


def _met(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with met: the choices of all ancestors in both of_a and of_b. Put together and sorted, an ancestor of both stands beside itself."""
    second = F.lit(1 << _DIST_BITS).cast("long")
    df = df.withColumn("m", F.array_sort(F.concat(f"of_{a}", F.transform(f"of_{b}", lambda x: x + second))))
    beside = F.zip_with(F.slice("m", 1, F.size("m") - 1), F.slice("m", 2, F.size("m") - 1), lambda x, y: F.when(_who(x) == _who(y), _choice(_who(x), _dist(x), _dist(y))))
    return df.withColumn("met", F.filter(F.when(F.size("m") > 1, beside).otherwise(F.array().cast("array<long>")), lambda x: x.isNotNull())).drop("m")


def _climbed(asked: DataFrame, p: DataFrame, depth: int | None) -> DataFrame:
    """u, v, x, near of asked(u, v), first persons of sibships: x is the least choice (null: none) among the ancestors that all of one and all of the other sibship have.

    Pairs go up STEP generations at a time and only as far as they must: one that has met by a sum below
    the distance looked at can't meet by a less one, nor can its members be ancestors of each other at that
    sum, and one whose ancestors are all known has nothing left. near: a parent of one side is an ancestor of the
    other, or one side has no parents; then members may be ancestors themselves, and x says nothing."""
    base = _doubled(p, STEP if depth is None else depth)
    left, up, k, done = asked, base, STEP, []
    while True:
        if k >= 1 << _DIST_BITS - 1:
            raise ValueError(f"a line of 2^{_DIST_BITS - 1} generations or more")
        of = lambda who: up.select(F.col("id").alias(who), F.filter("ancs", lambda x: _dist(x) > 0).alias(f"of_{who}"))  # noqa: B023, E731
        df = _met(spread(left, "u").join(of("u"), "u").join(of("v"), "v"), "u", "v")
        total = lambda x: F.shiftright(x, _ID_BITS + _DIST_BITS)
        close = F.exists("met", lambda x: (_dist(x) == 1) | (total(x) - _dist(x) == 1)) & (F.col("u") != F.col("v"))
        near = close | ((F.size("of_u") == 0) != (F.size("of_v") == 0))
        more = F.lit(False) if depth is not None else F.exists("of_u", lambda x: _dist(x) == k) | F.exists("of_v", lambda x: _dist(x) == k)
        df = written(df.select("u", "v", F.array_min("met").alias("x"), near.alias("near"), more.alias("more")))
        over = F.col("near") | ~F.col("more") | F.coalesce(total(F.col("x")) < k, F.lit(False))
        done.append(df.filter(over).select("u", "v", "x", "near"))
        left = df.filter(~over).select("u", "v")
        if depth is not None or left.isEmpty():
            return _union(*done)
        mine = up.join(left.select(F.col("u").alias("id")).union(left.select("v")).distinct(), "id")
        ends = mine.select("id", F.explode(F.transform(F.filter("ancs", lambda x: _dist(x) == k), _who)).alias("end"))
        theirs = base.filter(F.size("ancs") > 1).select(F.col("id").alias("end"), F.transform(F.filter("ancs", lambda x: _dist(x) > 0), lambda x: x + k).alias("far"))
        far = ends.join(theirs, "end").groupBy("id").agg(F.flatten(F.collect_list("far")).alias("far"))
        up = written(mine.join(far, "id", "left").select("id", F.when(F.col("far").isNull(), F.col("ancs")).otherwise(_nearest(F.concat("ancs", "far"))).alias("ancs")))
        k += STEP


def _lineage(p: DataFrame, who: DataFrame, depth: int | None) -> DataFrame:
    """Those of p that are in who(id) or their ancestors (within depth steps), by a walk that asks each person once."""
    kin, last, known, k = p.select("id", "mother_id", "father_id"), written(who.distinct()), [], 0
    while not last.isEmpty() and (depth is None or k <= depth):
        known.append(last)
        up = kin.join(last, "id").select(F.explode(F.array("mother_id", "father_id")).alias("id")).filter("id is not null").distinct()
        last, k = written(up.join(_union(*known), "id", "left_anti")), k + 1
    return p.join(_union(*known), "id", "left_semi") if known else p.limit(0)


def _related(p: DataFrame, pairs: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """sides(a, b, own, u, v, turned: u stands for b) of the different persons of pairs, and kin(own, u, v, mrca, da, db), the most recent common ancestors of u and v.

    Brothers and sisters of both parents stand for one another (_climbed()), which leaves few pairs. Where members of
    one sibship may be ancestors of those of the other, persons stand for themselves (own), and all their ancestors are compared."""
    members = written(S.sibships(p))
    of = lambda who: members.select(F.col("id").alias(who), F.col("ship").alias(f"of_{who}"))
    both = written(spread(pairs.select("a", "b").filter("a <> b").distinct(), "a").join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("of_a", "of_b").alias("u"), F.greatest("of_a", "of_b").alias("v"), (F.col("of_a") > F.col("of_b")).alias("turned")))
    found = _climbed(both.select("u", "v").distinct(), p, depth)
    near = found.filter("near").select("u", "v", F.lit(True).alias("near"))
    own = F.col("near").isNotNull()
    sides = written(both.join(near, ["u", "v"], "left").select("a", "b", own.alias("own"), F.when(own, F.col("a")).otherwise(F.col("u")).alias("u"), F.when(own, F.col("b")).otherwise(F.col("v")).alias("v"), (F.col("turned") & ~own).alias("turned")))
    alone = sides.filter("own").select("a", "b")
    arrays = ancestor_arrays(written(_lineage(p, alone.select(F.col("a").alias("id")).union(alone.select("b")), depth)), depth)
    whole = lambda who: arrays.select(F.col("id").alias(who), F.col("ancs").alias(f"of_{who}"))
    met = _met(spread(alone, "a", "b").join(whole("a"), "a").join(whole("b"), "b"), "a", "b").select(F.lit(True).alias("own"), F.col("a").alias("u"), F.col("b").alias("v"), F.array_min("met").alias("x"))
    kin = _union(met, found.filter("not near").select(F.lit(False).alias("own"), "u", "v", "x")).filter("x is not null")
    return sides, _chosen(kin, "own", "u", "v")


def mrca(p: DataFrame, pairs: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """a, b, mrca, da, db for every ordered pair of different persons (or of pairs(a, b) only) with a common ancestor: the least da + db, then the least id.

    Given pairs are followed upwards until they meet. Without pairs the result has a row for each related pair, found by joining on the
    ancestor, with minima that combine on the map side; large populations ask for the pairs they need."""
    if pairs is None:
        up = written(closure(p, depth))
        both = up.select(F.col("id").alias("a"), "anc", F.col("dist").alias("da")).join(up.select(F.col("id").alias("b"), "anc", F.col("dist").alias("db")), "anc")
        return _chosen(both.filter("a <> b").groupBy("a", "b").agg(F.min(_choice(F.col("anc"), F.col("da"), F.col("db"))).alias("x")))
    sides, kin = _related(p, pairs, depth)
    turn = lambda one, two: F.when(F.col("turned"), F.col(two)).otherwise(F.col(one)).alias(one)
    return sides.join(kin, ["own", "u", "v"]).select("a", "b", "mrca", turn("da", "db"), turn("db", "da"))


def linking_relatives(need: DataFrame, p: DataFrame) -> DataFrame:
    """need(x, m, n: m is n >= 2 steps above x) with link, through whom x descends from m: a walk of n - 1 rounds that steps to the mother, then to the father of the node reached, and ends at m or a child of m; without one, the parent below m where n is 2, else by the same test. Rows whose walk ends at a person without parents are dropped."""
    kin = written(p.select("id", "mother_id", "father_id"))
    node = lambda tag: kin.select(F.col("id").alias(tag), F.col("mother_id").alias(f"{tag}_m"), F.col("father_id").alias(f"{tag}_f"))
    meets = lambda tag: F.coalesce(F.col(tag).eqNullSafe(F.col("m")) | F.col(f"{tag}_m").eqNullSafe(F.col("m")) | F.col(f"{tag}_f").eqNullSafe(F.col("m")), F.lit(False)) & F.col(tag).isNotNull()
    walking, found, k = written(need.select("x", "m", "n", F.col("x").alias("cur"))), [], 0
    while not walking.isEmpty():
        k += 1
        df = walking.join(node("c"), F.col("cur") == F.col("c"), "left").filter("c_m is not null or c_f is not null")
        df = df.join(node("up"), F.col("c_m") == F.col("up"), "left").withColumn("then", F.when(F.col("c_m").isNotNull(), F.col("up_f")).otherwise(F.col("c_f")))
        df = df.join(node("on"), F.col("then") == F.col("on"), "left")
        df = df.withColumn("link", F.when(meets("up"), F.col("up")).when(meets("on"), F.col("on")))
        df = written(df.select("x", "m", "n", "link", F.coalesce("then", "c_m", "cur").alias("cur")))
        found.append(df.filter("link is not null").select("x", "m", "n", "link"))
        over = df.filter((F.col("link").isNull()) & (F.col("n") <= k + 1)).select("x", "m", "n")
        over = over.join(node("c"), F.col("x") == F.col("c")).join(node("up"), F.col("c_m") == F.col("up"), "left")
        found.append(over.select("x", "m", "n", F.when(F.col("up_m").eqNullSafe(F.col("m")) | F.col("up_f").eqNullSafe(F.col("m")), F.col("c_m")).otherwise(F.col("c_f")).alias("link")))
        walking = df.filter((F.col("link").isNull()) & (F.col("n") > k + 1)).select("x", "m", "n", "cur")
    return _union(*found) if found else need.select("x", "m", "n", F.col("x").alias("link")).limit(0)


def cousins(p: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """src, dst, degree, type: parallel if both linking relatives have one sex, else cross; pairs of any degree whose most recent common ancestor is as many steps, two or more, above both."""
    sides, kin = (None, mrca(p).withColumnsRenamed({"a": "u", "b": "v"})) if pairs is None else _related(p, pairs)
    level = written(kin.filter("da = db and da >= 2"))
    side = lambda who: level.select(F.col(who).alias("x"), F.col("mrca").alias("m"), F.col("da").alias("n"))
    linked = linking_relatives(side("u").unionByName(side("v")).distinct(), p)  # of a sibship's first person: the walk starts at the parents
    sexed = written(linked.join(p.select(F.col("id").alias("link"), "sex"), "link").select("x", "m", "n", "sex"))
    of = lambda who, out: sexed.select(F.col("x").alias(who), F.col("m").alias("mrca"), F.col("n").alias("da"), F.col("sex").alias(out))
    df = level.join(of("u", "su"), ["u", "mrca", "da"]).join(of("v", "sv"), ["v", "mrca", "da"])
    df = df.withColumn("degree", F.col("da") - 1).withColumn("type", F.when(F.col("su") == F.col("sv"), "parallel").otherwise("cross"))
    if sides is None:
        return df.select(F.col("u").alias("src"), F.col("v").alias("dst"), "degree", "type")
    return sides.join(df.select("own", "u", "v", "degree", "type"), ["own", "u", "v"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), "degree", "type")


def _walks(heads: DataFrame, p: DataFrame, rounds: int) -> DataFrame:
    """ship, m, n (the round), first, sex: the nodes that linking_relatives() looks at from each of heads(ship), each under itself and its parents as m; first orders the two nodes of a round."""
    kin = written(p.select("id", "sex", "mother_id", "father_id"))
    node = lambda tag: kin.select(F.col("id").alias(tag), F.col("sex").alias(f"{tag}_s"), F.col("mother_id").alias(f"{tag}_m"), F.col("father_id").alias(f"{tag}_f"))
    walking, seen = heads.select("ship", F.col("ship").alias("cur")), []
    for k in range(1, rounds + 1):
        df = walking.join(node("c"), F.col("cur") == F.col("c")).filter("c_m is not null or c_f is not null")
        df = df.join(node("up"), F.col("c_m") == F.col("up"), "left").withColumn("then", F.when(F.col("c_m").isNotNull(), F.col("up_f")).otherwise(F.col("c_f")))
        df = written(df.join(node("on"), F.col("then") == F.col("on"), "left"))
        for first, tag in enumerate(("up", "on")):
            at = df.filter(F.col(tag).isNotNull()).select("ship", F.explode(F.array(tag, f"{tag}_m", f"{tag}_f")).alias("m"), F.lit(2 * k + first).alias("turn"), F.col(f"{tag}_s").alias("sex"))
            seen.append(at.filter("m is not null"))
        walking = df.select("ship", F.coalesce("then", "c_m").alias("cur"))
        if walking.isEmpty():
            break
        seen.append(df.select("ship", F.lit(None).cast("int").alias("m"), F.lit(2 * k).alias("turn"), F.lit(None).cast("string").alias("sex")))
    return _union(*seen)


def _coded(above: DataFrame, p: DataFrame) -> DataFrame:
    """above(ship, anc, dist) with code: 1 or 2 for a male or female linking relative, 3 for one of unknown sex, 0 for none; linking_relatives() of all sibships and ancestors at once, by one walk a sibship."""
    depth = above.agg(F.max("dist")).first()[0] or 0
    if depth < 2:
        return above.withColumn("code", F.lit(0))
    heads = above.select("ship").distinct()
    walks = written(_walks(heads, p, depth - 1))
    met = walks.filter("m is not null").groupBy("ship", F.col("m").alias("anc")).agg(F.min(F.struct("turn", "sex")).alias("hit"))
    rounds = walks.groupBy("ship").agg((F.max("turn") / 2).cast("int").alias("rounds"))  # as long as there are parents
    kin = p.select("id", "sex", "mother_id", "father_id")
    own = heads.join(kin.select(F.col("id").alias("ship"), F.col("mother_id").alias("mo"), F.col("father_id").alias("fa")), "ship")
    own = own.join(kin.select(F.col("id").alias("mo"), F.col("sex").alias("mo_s"), F.col("mother_id").alias("mo_m"), F.col("father_id").alias("mo_f")), "mo", "left").join(kin.select(F.col("id").alias("fa"), F.col("sex").alias("fa_s")), "fa", "left")
    df = above.join(met, ["ship", "anc"], "left").join(rounds, "ship", "left").join(own, "ship", "left")
    through_mother = F.coalesce(F.col("mo_m").eqNullSafe(F.col("anc")) | F.col("mo_f").eqNullSafe(F.col("anc")), F.lit(False))
    code = lambda who, sex: F.when(who.isNull(), 0).when(sex == "M", 1).when(sex == "F", 2).otherwise(3)
    met_in_time = F.col("hit").isNotNull() & (F.floor(F.col("hit.turn") / 2) <= F.col("dist") - 1)
    other = F.when(through_mother, code(F.col("mo"), F.col("mo_s"))).otherwise(code(F.col("fa"), F.col("fa_s")))
    return df.select("ship", "anc", "dist", F.when(F.col("dist") < 2, 0).when(met_in_time, code(F.col("hit.turn"), F.col("hit.sex"))).when(F.coalesce("rounds", F.lit(0)) >= F.col("dist") - 1, other).otherwise(0).alias("code"))


def _ship_totals(p: DataFrame, typed: bool) -> DataFrame:
    """sibships.relatives() of persons, with the sexes of linking relatives where cousins are typed."""
    members = written(S.sibships(p))
    heads = members.select(F.col("ship").alias("id")).distinct()
    above = closure(p).join(heads, "id").filter("dist > 0").select(F.col("id").alias("ship"), "anc", "dist")
    return S.relatives(members, _coded(written(above), p) if typed else above.withColumn("code", F.lit(0)), typed)


def mrca_totals(p: DataFrame) -> DataFrame:
    """a, da, db, n, sum_b, sum_mrca: mrca() of all pairs, counted by a and both distances without a row for each pair."""
    df = _ship_totals(p, False)
    return df.select(F.col("subject").cast("int").alias("a"), F.col("one").alias("da"), F.col("two").alias("db"), "n", "sum_b", "sum_mrca")


def cousin_totals(p: DataFrame) -> DataFrame:
    """src, degree, type, n, sum_dst: cousins() of all pairs, counted by src, degree and type without a row for each pair."""
    df = _ship_totals(p, True)
    return df.select(F.col("subject").cast("int").alias("src"), F.col("one").alias("degree"), F.when(F.col("two") == 1, "parallel").otherwise("cross").alias("type"), "n", F.col("sum_b").alias("sum_dst"))


def cousin_edges(p: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """hasCousin."""
    return _edges(cousins(p) if found is None else found, "src", "hasCousin", "dst")


def clans(p: DataFrame, line: str = "mother_id") -> DataFrame:
    """id, founder: the end of a person's maternal (or paternal) line, by pointer doubling until nothing moves: log(generations) joins, each over the written result of the one before."""
    df, moved = written(p.select("id", F.coalesce(line, "id").alias("founder"))), True
    while moved:
        up = df.select(F.col("id").alias("mid"), F.col("founder").alias("up"))
        after = df.join(up, F.col("founder") == F.col("mid"), "left").select("id", F.coalesce("up", "founder").alias("founder"), (F.col("up") != F.col("founder")).alias("moved"))
        after = written(after)
        moved, df = not after.filter("moved").isEmpty(), after.select("id", "founder")
    return df


def clan_members(p: DataFrame, system: str) -> DataFrame:
    """id, clan: the lines are numbered by their founders' ids. crow counts maternal lines, omaha paternal ones; the window holds one row a clan."""
    line = clans(p, "mother_id" if system == "crow" else "father_id")
    numbers = line.select("founder").distinct().withColumn("clan", F.row_number().over(Window.orderBy("founder")))
    return line.join(numbers, "founder").select("id", "clan")


def _clan_sides(p: DataFrame, system: str) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    """(id, own, theirs) of subjects with a known parent of the other line, (id, founder) of all, the two predicates."""
    line, other, names = ("mother_id", "father_id", ("sameMatriclan", "fathersMatriclan")) if system == "crow" else ("father_id", "mother_id", ("samePatriclan", "mothersPatriclan"))
    clan = clans(p, line)
    me = p.filter(F.col(other).isNotNull()).select("id", F.col(other).alias("parent")).join(clan.withColumnRenamed("founder", "own"), "id").join(clan.select(F.col("id").alias("parent"), F.col("founder").alias("theirs")), "parent")
    return me.select("id", "own", "theirs"), clan, names


def clan_degrees(p: DataFrame, system: str) -> DataFrame:
    """src, pred, n, sum_dst: how many clan relations of each kind a subject has, and the sum of their ids, from each clan's totals less the subject: no pairs are made."""
    me, clan, (same, theirs) = _clan_sides(p, system)
    totals = clan.groupBy("founder").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    own = me.join(totals, F.col("own") == F.col("founder")).select(F.col("id").alias("src"), F.lit(same).alias("pred"), (F.col("n") - 1).alias("n"), (F.col("ids") - F.col("id")).alias("sum_dst"))
    other = me.filter("own <> theirs").join(totals, F.col("theirs") == F.col("founder")).select(F.col("id").alias("src"), F.lit(theirs).alias("pred"), "n", F.col("ids").alias("sum_dst"))
    return own.filter("n > 0").unionByName(other)


def clan_edges(p: DataFrame, system: str) -> DataFrame:
    """crow: sameMatriclan, else fathersMatriclan, of subjects with a known father; omaha: samePatriclan, else mothersPatriclan, of subjects with a known mother. One row a pair, as a graph file has them; clan_degrees() has the totals."""
    me, clan, (first, second) = _clan_sides(p, system)
    all_ = clan.select(F.col("id").alias("dst"), F.col("founder").alias("clan"))
    same = me.join(all_, F.col("own") == F.col("clan")).filter("id <> dst").select(F.col("id").alias("src"), F.lit(first).alias("pred"), "dst")
    theirs = me.filter("own <> theirs").join(all_, F.col("theirs") == F.col("clan")).select(F.col("id").alias("src"), F.lit(second).alias("pred"), "dst")
    return same.unionByName(theirs)


def kin_edges(p: DataFrame, system: str, found: DataFrame | None = None) -> DataFrame:
    """The relations of one kinship system beyond the biological ones; eskimo and sudanese have none. found: cousins(p), where it is there already."""
    if system in ("crow", "omaha"):
        return clan_edges(p, system)
    if system not in ("iroquois", "dravidian", "hawaiian"):
        return _edges(p.limit(0), "id", "", "id")
    of_cousin, of_sibling = _kin_rules(system)
    c, u = cousins(p) if found is None else found, parents_siblings(p)
    return _held(c, of_cousin, "dst").unionByName(_held(u, of_sibling, "dst")).distinct()


def _held(df: DataFrame, rules: list, *rest: str) -> DataFrame:
    """src, pred and rest of the predicates that hold; df is read once."""
    return df.select("src", F.explode(F.filter(F.array(*[F.when(c, n) for c, n in rules]), lambda x: x.isNotNull())).alias("pred"), *rest)


def _kin_rules(system: str) -> tuple[list, list]:
    """(condition, predicate) over cousins and over parents' siblings."""
    parallel, cross = F.col("type") == "parallel", F.col("type") == "cross"
    same = (F.col("side") == "Maternal") == (F.col("sex") == "F")  # mother's sister, father's brother
    if system == "hawaiian":
        of_cousin, of_sibling = [(F.lit(True), "hasClassificatorySibling")], []
    else:
        of_cousin = [(parallel, "hasParallelCousin"), (parallel, "hasClassificatorySibling"), (cross, "hasCrossCousin")]
        of_sibling = [(~same & (F.col("sex") == "M"), "hasCrossUncle"), (~same & (F.col("sex") == "F"), "hasCrossAunt")]
    if system == "dravidian":
        of_cousin.append((cross & (F.col("degree") == 1), "hasPotentialSpouse"))
        of_sibling += [(~same & (F.col("sex") == "M"), "hasMama"), (~same & (F.col("sex") == "F"), "hasAthai")]
    of_sibling.append((same, "hasClassificatoryParent"))
    return of_cousin, of_sibling


def kin_totals(p: DataFrame, system: str) -> DataFrame:
    """src, pred, n, sum_dst: kin_edges() of iroquois, dravidian or hawaiian, counted by subject; cousins without a row for each pair. No predicate holds of both cousins and parents' siblings, so the two add up."""
    of_cousin, of_sibling = _kin_rules(system)
    c = _held(cousin_totals(p), of_cousin, "n", "sum_dst")
    u = _held(parents_siblings(p), of_sibling, "dst").distinct().select("src", "pred", F.lit(1).cast("long").alias("n"), F.col("dst").cast("long").alias("sum_dst"))
    return c.unionByName(u).groupBy("src", "pred").agg(F.sum("n").alias("n"), F.sum("sum_dst").alias("sum_dst"))


def marriage_mix(couples: DataFrame, p: DataFrame) -> DataFrame:
    """type (parallel, cross or other), n: how the spouses of couples(a, b) are related."""
    kin = cousins(p, couples).select(F.col("src").alias("a"), F.col("dst").alias("b"), "type")
    return couples.join(kin, ["a", "b"], "left").groupBy(F.coalesce("type", F.lit("other")).alias("type")).agg(F.count("*").alias("n"))


def marriage_allowed(pairs: DataFrame, p: DataFrame, system: str) -> DataFrame:
    """pairs(a, b) with allowed: no siblings, no parent and child, and the system's own prohibition."""
    of = lambda who: p.select(F.col("id").alias(who), F.col("mother_id").alias(f"{who}_m"), F.col("father_id").alias(f"{who}_f"))
    df = spread(pairs, "a").join(of("a"), "a", "left").join(of("b"), "b", "left")
    c = F.col
    parents = c("a_m").isNotNull() & c("a_f").isNotNull() & c("b_m").isNotNull() & c("b_f").isNotNull()
    is_sibling = (c("a") != c("b")) & parents & ((c("a_m") == c("b_m")) | (c("a_f") == c("b_f")))
    no = reduce(Column.__or__, [F.coalesce(x, F.lit(False)) for x in (is_sibling, c("a_m") == c("b"), c("a_f") == c("b"), c("b_m") == c("a"), c("b_f") == c("a"))])
    df = df.select(*pairs.columns, no.alias("no"))
    if system in ("eskimo", "hawaiian", "sudanese"):
        # Where da and db are 2 at most, their sum is 4 at most, and whatever precedes that lies within 4 steps of both.
        df = df.join(mrca(p, pairs, None if system == "hawaiian" else 4), ["a", "b"], "left")
        rule = {"eskimo": (F.col("da") == 2) & (F.col("db") == 2), "hawaiian": (F.col("da") >= 2) & (F.col("db") >= 2), "sudanese": (F.col("da") <= 2) & (F.col("db") <= 2)}[system]
    elif system in ("iroquois", "dravidian"):
        df = df.join(cousins(p, pairs).select(F.col("src").alias("a"), F.col("dst").alias("b"), "type"), ["a", "b"], "left")
        rule = F.col("type") == "parallel"
    else:
        own, other = ("mother_id", "father_id") if system == "crow" else ("father_id", "mother_id")
        clan = clans(p, own)
        table = p.select("id", F.col(other).alias("parent")).join(clan.withColumnRenamed("founder", "own"), "id").join(clan.select(F.col("id").alias("parent"), F.col("founder").alias("theirs")), "parent", "left")
        for tag in ("a", "b"):
            df = df.join(table.select(F.col("id").alias(tag), F.col("own").alias(f"{tag}_own"), F.col("theirs").alias(f"{tag}_theirs")), tag)
        rule = (F.col("a_own") == F.col("b_own")) | (F.col("a_own") == F.col("b_theirs")) | (F.col("b_own") == F.col("a_theirs"))
    return df.select("a", "b", (~(F.col("no") | F.coalesce(rule, F.lit(False)))).alias("allowed"))
