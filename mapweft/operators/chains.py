"""Lines joined end to end: lists ranked by pointer doubling, however long they are.

Every line can be walked two ways; each way is an arc that leads to the arc of the line
that is mated with its far end. In each round an arc's pointer jumps as far again as it
has come, and what lies between is added up, so a list of n lines takes log2(n) rounds of
one join, and no list, relation or street is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import store, tasks_for


def c(name: str):
    return F.col(name)


def mated_ends(lines: DataFrame, strict: bool) -> DataFrame:
    """(l, side, mate): the line end that meets each line end; mate is struct(l, side).

    Ends at one place are mated in the order of their lines, the first with the second and
    so on; with `strict` only where exactly two ends meet.
    """
    sides = F.array(F.struct(F.lit(0).alias("side"), c("a").alias("k")), F.struct(F.lit(1).alias("side"), c("b").alias("k")))
    ends = lines.where("a <> b").select(c("line").alias("l"), F.explode(sides).alias("e")).select("l", "e.side", "e.k")
    here = W.partitionBy("k").orderBy("l", "side")
    own = F.struct("l", "side")
    mate = F.when(F.row_number().over(here) % 2 == 1, F.lead(own).over(here)).otherwise(F.lag(own).over(here))
    found = ends.select("l", "side", mate.alias("mate"), F.count(F.lit(1)).over(W.partitionBy("k")).alias("n"))
    return found.where("mate IS NOT NULL").where((c("n") == 2) if strict else F.lit(True)).select("l", "side", "mate")


def _doubled(state: DataFrame) -> DataFrame:
    """Arcs (arc, nxt, low, last, d) whose pointers have jumped to the end of their list, or around their ring.

    Each round the pointers jump twice as far. In a round, some arcs of a list come to its
    end as long as one has not; and when no arc of a ring has learnt of a smaller one, all
    know the smallest, because stretches as long as the jump lie around the ring in turn.
    """
    state = state.select("arc", "nxt", "low", "last", "d", F.lit(True).alias("moved"))
    while not state.where("moved").isEmpty():
        on = state.where("nxt IS NOT NULL")
        ahead = state.select(c("arc").alias("_arc"), c("nxt").alias("_nxt"), c("low").alias("_low"), c("last").alias("_last"), c("d").alias("_d"))
        jumped = on.join(ahead, c("nxt") == c("_arc")).select(
            "arc", c("_nxt").alias("nxt"), F.least("low", "_low").alias("low"), c("_last").alias("last"), (c("d") + c("_d")).alias("d"),
            (c("_nxt").isNull() | (c("_low") < c("low"))).alias("moved"))
        state = store(state.where("nxt IS NULL").withColumn("moved", F.lit(False)).unionByName(jumped))
    return state.drop("moved")


def chained(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(line, forward, chain, closed, at): each line's place in the chain it belongs to.

    `lines` has line (unique), a, b (keys of its ends; put what must stay apart into the
    keys) and w, its length. A chain is named by its smallest line, which runs forward;
    `at` is the length before the line. A closed chain begins with its smallest line.
    Chains are closed when they come back to where they began.
    """
    lines = store(lines.select("line", "a", "b", c("w").cast("bigint").alias("w")))
    alone = lines.where("a = b").select("line", F.lit(True).alias("forward"), c("line").alias("chain"), F.lit(True).alias("closed"), F.lit(0).cast("bigint").alias("at"))
    both = lines.where("a <> b")
    arcs = both.select(F.explode(F.array(*[F.struct(c("line").alias("l"), F.lit(s).alias("s")) for s in (0, 1)])).alias("arc"), c("line").alias("_l"), "w")
    # An arc that enters at one side leaves at the other, and enters the mate's line at the mate's side.
    onward = mated_ends(lines, strict).select(F.struct(c("l"), (1 - c("side")).alias("s")).alias("arc"), F.struct(c("mate.l").alias("l"), c("mate.side").alias("s")).alias("nxt"))
    start = store(arcs.join(onward, "arc", "left").select("arc", "nxt", c("arc").alias("low"), c("arc").alias("last"), c("w").alias("d")))
    ranked = _doubled(start)
    # Open: the list's end is known, and the length from each arc to it.
    paths = ranked.where("nxt IS NULL")
    heads = paths.groupBy("last").agg(F.min("arc").alias("low"), F.max("d").alias("total")).where("low.s = 0")
    placed = paths.drop("low").join(heads, "last").select("arc", "low", (c("total") - c("d")).alias("at"), F.lit(False).alias("closed"))
    # Closed: every arc knows the smallest of its ring; cut before it, the ring is a list.
    rings = ranked.where("nxt IS NOT NULL AND low.s = 0").select("arc", c("low").alias("ring"))
    cut = start.join(rings, "arc").select("arc", F.when(c("nxt") != c("ring"), c("nxt")).alias("nxt"), "low", "last", "d")
    turned = _doubled(store(cut))
    whole = turned.groupBy("last").agg(F.min("arc").alias("ring"), F.max("d").alias("total"))
    around = turned.join(whole, "last").select("arc", c("ring").alias("low"), (c("total") - c("d")).alias("at"), F.lit(True).alias("closed"))
    out = placed.unionByName(around).select(c("arc.l").alias("line"), (c("arc.s") == 0).alias("forward"), c("low.l").alias("chain"), "closed", "at")
    return out.unionByName(alone)


def assemble_rings(members: DataFrame, drop_open: bool = False) -> DataFrame:
    """Points (rel_id, role, ring_no, closed, seq, x, y) of the rings that member lines make, end to end.

    `members` has rel_id, role, way_no (unique in them) and pts (array of x, y). Rings come
    first, then what does not close, or closes with less than four points. A closed ring
    ends with its first point again.
    """
    named = members.where(F.size("pts") >= 2).withColumn("line", F.struct("rel_id", "role", "way_no"))
    end = lambda p: F.struct(c("rel_id"), c("role"), p["x"].alias("x"), p["y"].alias("y"))
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    chains = store(chained(named.select("line", end(first).alias("a"), end(last).alias("b"), (F.size("pts") - 1).alias("w"))))
    sizes = chains.join(named.select("line", (F.size("pts") - 1).alias("w")), "line").groupBy("chain").agg(
        F.first("closed").alias("back"), (F.sum("w") + 1).alias("points")).withColumn("closed", c("back") & (c("points") >= 4))
    sizes = sizes.where("closed") if drop_open else sizes
    order = W.partitionBy("chain.rel_id", "chain.role").orderBy((~c("closed")).cast("int"), "chain")
    rings = sizes.select("chain", "closed", (F.row_number().over(order) - 1).alias("ring_no"))
    placed = named.join(chains.select("line", "forward", "chain", "at"), "line").join(rings, "chain")
    walked = placed.withColumn("_p", F.when(c("forward"), c("pts")).otherwise(F.reverse("pts"))).select("rel_id", "role", "ring_no", "closed", "at", F.posexplode("_p").alias("_i", "p"))
    # Where lines meet, the point belongs to the one before.
    return walked.where("_i > 0 OR at = 0").select("rel_id", "role", "ring_no", "closed", (c("at") + c("_i")).alias("seq"), "p.x", "p.y")


def ring_arrays(points: DataFrame) -> DataFrame:
    """(rel_id, role, ring_no, closed, pts): each ring's points as one array, where a ring is known to fit a row."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    return points.groupBy("rel_id", "role", "ring_no", "closed").agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))


def street_table(segs: DataFrame, least: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Streets by name: (stretches, their segments in order).

    `segs` has name, akey, bkey, len, width. A segment that several roads of one name have
    is one. Segments merge where exactly two of a name meet, so a stretch runs from
    crossing to crossing. Stretches: name, stretch (its smallest segment), width (at least
    3, that of the street's widest part), length, segments, closed; those shorter than
    `least` are dropped. Segments: name, stretch, line, forward, at (segments before).
    """
    low, high = F.least("akey", "bkey"), F.greatest("akey", "bkey")
    once = segs.where("name IS NOT NULL AND akey <> bkey").groupBy("name", low.alias("a"), high.alias("b")).agg(F.min("len").alias("len"), F.max("width").alias("width"))
    named = store(once.withColumn("line", F.struct("name", "a", "b")))
    end = lambda k: F.struct("name", c(k).alias("k"))
    placed = store(chained(named.select("line", end("a").alias("a"), end("b").alias("b"), F.lit(1).alias("w")), strict=True))
    wide = named.groupBy("name").agg(F.greatest(F.lit(3.0), F.round(F.max("width"))).alias("width"))
    stretches = placed.join(named.select("line", "len"), "line").groupBy("chain").agg(
        F.sum("len").alias("length"), F.count(F.lit(1)).alias("segments"), F.first("closed").alias("closed")).where(c("length") >= least)
    stretches = stretches.select(c("chain.name").alias("name"), c("chain").alias("stretch"), "length", "segments", "closed").join(wide, "name")
    kept = placed.withColumnRenamed("chain", "stretch").join(stretches.select("stretch"), "stretch", "left_semi")
    return stretches, kept.select(c("stretch.name").alias("name"), "stretch", "line", "forward", "at")


def street_pieces(segs: DataFrame) -> DataFrame:
    """Stretches of one road that nothing else of its name touches: (name, line, a, b, length, segments, width, alone).

    `segs` has name, way_id, pos, akey, bkey, len, width, those of a road dealt out together.
    Only places where a name comes more than once are sent back to the roads, which are cut
    there; a piece whose ends are no such places is `alone`, a whole stretch. `line` is its
    smallest segment. A piece that comes back to its beginning is two.
    """
    segs = segs.where("name IS NOT NULL AND akey <> bkey")
    along = W.partitionBy("name", "way_id").orderBy("pos")
    joined = F.coalesce(F.lag("bkey").over(along) == c("akey"), F.lit(False))
    roads = segs.withColumn("_joined", joined)
    # A place that two segments of a road share is one visit, that of the first one's far end.
    far, near = F.struct(c("bkey").alias("k"), (2 * c("pos") + 1).alias("e")), F.struct(c("akey").alias("k"), (2 * c("pos")).alias("e"))
    visits = roads.select("name", "way_id", F.explode(F.when(c("_joined"), F.array(far)).otherwise(F.array(far, near))).alias("v"))
    here = F.count(F.lit(1)).over(W.partitionBy("name", "v.k"))
    touched = visits.withColumn("n", here).where("n > 1").select(c("way_id").alias("_way"), "v.e").repartition(tasks_for(segs), "_way") \
        .groupBy("_way").agg(F.collect_list("e").alias("_touched"))
    hit = lambda e: F.coalesce(F.array_contains("_touched", e), F.lit(False))
    marked = roads.join(touched, c("way_id") == c("_way"), "left").select(*segs.columns, "_joined", hit(2 * c("pos")).alias("_at_a"), hit(2 * c("pos") + 1).alias("_at_b"))
    on = c("_joined") & ~F.lag("_at_b").over(along) & (F.lag("akey").over(along) != c("bkey"))
    ends = marked.withColumn("_first", ~F.coalesce(on, F.lit(False))).withColumn("_goes", F.coalesce(F.lead("akey").over(along) == c("bkey"), F.lit(False)))
    numbered = ends.withColumn("_piece", F.sum(c("_first").cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    line, rest = F.struct(F.least("akey", "bkey").alias("a"), F.greatest("akey", "bkey").alias("b")), ~c("_first")
    pieces = numbered.groupBy("name", "way_id", "_piece").agg(
        F.min_by("akey", "pos").alias("a"), F.min_by("bkey", "pos").alias("m"), F.max_by("bkey", "pos").alias("b"), F.max("width").alias("width"),
        F.min(F.when(c("_first"), line)).alias("l0"), F.min(F.when(rest, line)).alias("l1"),
        F.sum(F.when(c("_first"), c("len"))).alias("d0"), F.coalesce(F.sum(F.when(rest, c("len"))), F.lit(0.0)).alias("d1"), F.count(F.when(rest, F.lit(1))).alias("n1"),
        F.min_by(~c("_joined") & ~c("_at_a"), "pos").alias("_free_a"), F.max_by(~c("_goes") & ~c("_at_b"), "pos").alias("_free_b"))

    def piece(a, b, line, length, segments):
        return F.struct(a.alias("a"), b.alias("b"), line.alias("line"), length.alias("length"), segments.cast("bigint").alias("segments"))

    whole = piece(c("a"), c("b"), F.least("l0", "l1"), c("d0") + c("d1"), c("n1") + 1)
    halves = F.array(piece(c("a"), c("m"), c("l0"), c("d0"), F.lit(1)), piece(c("m"), c("b"), c("l1"), c("d1"), c("n1")))
    out = pieces.select("name", "width", (c("_free_a") & c("_free_b")).alias("alone"), F.explode(F.when(c("a") == c("b"), halves).otherwise(F.array(whole))).alias("p"))
    return out.select("name", F.struct(c("name"), c("p.line.a"), c("p.line.b")).alias("line"), "p.a", "p.b", "p.length", "p.segments", "width", "alone")


def street_stretches(segs: DataFrame, least: float = 10.0) -> DataFrame:
    """The stretches of `street_table` for segments that lie along roads (`street_pieces`).

    Most roads meet no other of their name: only pieces that something touches are ranked as lists.
    """
    pieces = store(street_pieces(segs))
    once = store(pieces.where("NOT alone").groupBy("line").agg(
        F.min(F.least("a", "b")).alias("a"), F.max(F.greatest("a", "b")).alias("b"), F.min("length").alias("length"), F.min("segments").alias("segments")))
    end = lambda k: F.struct(c("line.name").alias("name"), c(k).alias("k"))
    placed = chained(once.select("line", end("a").alias("a"), end("b").alias("b"), F.lit(1).alias("w")), strict=True)
    merged = placed.join(once.select("line", "length", "segments"), "line").groupBy("chain").agg(
        F.sum("length").alias("length"), F.sum("segments").alias("segments"), F.first("closed").alias("closed"))
    alone = pieces.where("alone").select(c("line").alias("chain"), "length", "segments", F.lit(False).alias("closed"))
    wide = pieces.groupBy("name").agg(F.greatest(F.lit(3.0), F.round(F.max("width"))).alias("width"))
    kept = alone.unionByName(merged).where(c("length") >= least)
    return kept.select(c("chain.name").alias("name"), c("chain").alias("stretch"), "length", "segments", "closed").join(wide, "name")
