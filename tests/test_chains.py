"""Lines joined end to end: order of points, rings and open lines, long chains, crossings of lines."""

import random

import pytest

from mapweft.operators import chains as CH

MEMBERS = "rel_id long, role string, way_no int, pts array<struct<x:double,y:double>>"


def rings_of(spark, rows, **kw):
    frame = spark.createDataFrame([(r, role, n, [{"x": float(x), "y": float(y)} for x, y in pts]) for r, role, n, pts in rows], MEMBERS).repartition(3)
    out = {}
    for p in sorted(CH.assemble_rings(frame, **kw).collect(), key=lambda p: (p.rel_id, p.role, p.ring_no, p.seq)):
        got = out.setdefault((p.rel_id, p.role, p.ring_no), (p.closed, []))
        assert p.seq == len(got[1])
        got[1].append((p.x, p.y))
    return out


def test_lines_grow_at_both_ends(spark):
    rows = [(1, "outer", 0, [(1, 0), (2, 0)]), (1, "outer", 1, [(0, 0), (1, 0)]), (1, "outer", 2, [(2, 0), (3, 0)]),
            (2, "outer", 5, [(0, 0), (1, 0)]), (2, "outer", 6, [(1, 1), (1, 0)]), (2, "outer", 7, [(1, 1), (0, 0)]),
            (2, "inner", 0, [(9, 9), (8, 9), (8, 8), (9, 9)]), (2, "inner", 1, [(0, 0), (0, 1)]), (3, "outer", 0, [(0, 0), (5, 5), (0, 0)]), (3, "outer", 1, [(7, 7)])]
    assert rings_of(spark, rows) == {
        (1, "outer", 0): (False, [(0, 0), (1, 0), (2, 0), (3, 0)]), (2, "outer", 0): (True, [(0, 0), (1, 0), (1, 1), (0, 0)]),
        (2, "inner", 0): (True, [(9, 9), (8, 9), (8, 8), (9, 9)]), (2, "inner", 1): (False, [(0, 0), (0, 1)]), (3, "outer", 0): (False, [(0, 0), (5, 5), (0, 0)])}
    assert set(rings_of(spark, rows, drop_open=True)) == {(2, "outer", 0), (2, "inner", 0)}
    assert rings_of(spark, []) == {}


@pytest.mark.parametrize("closed", [True, False])
def test_a_long_relation_keeps_its_order(spark, closed):
    """Thousands of members in any order and direction come out as one walk along them."""
    rng = random.Random(3)
    n = 3000
    places = [(i, i * i % 7) for i in range(2 * n)] + ([(0, 0)] if closed else [(2 * n, -1)])
    parts = [places[2 * i : 2 * i + 3] for i in range(n)]
    names = list(range(n))
    rng.shuffle(names)
    flipped = {k: rng.random() < 0.5 for k in names}
    rows = [(1, "outer", k, p[::-1] if flipped[k] else p) for k, p in zip(names, parts)]
    (key, (back, got)), = rings_of(spark, rows).items()
    walk = places[:-1] if closed else places
    first = names.index(0)
    if closed:
        turned = walk[2 * first :] + walk[: 2 * first]
        want = turned + turned[:1]
        if flipped[0]:
            turned = [walk[(2 * first + 2 - i) % len(walk)] for i in range(len(walk))]
            want = turned + turned[:1]
    else:
        want = walk[::-1] if flipped[0] else walk
    assert back == closed and got == [(float(x), float(y)) for x, y in want]


def test_strict_chains_end_at_crossings(spark):
    lines = [(0, "a", "b"), (1, "b", "c"), (2, "c", "d"), (3, "c", "e"), (4, "e", "f"), (5, "x", "x"), (6, "g", "f")]
    frame = spark.createDataFrame([(*r, 10) for r in lines], "line long, a string, b string, w int")
    strict = {r.line: (r.chain, r.forward, r.at, r.closed) for r in CH.chained(frame, strict=True).collect()}
    assert strict == {0: (0, True, 0, False), 1: (0, True, 10, False), 2: (2, True, 0, False), 3: (3, True, 0, False), 4: (3, True, 10, False), 6: (3, False, 20, False), 5: (5, True, 0, True)}
    loose = {r.line: r.chain for r in CH.chained(frame).collect()}
    assert loose[0] == loose[1] == loose[2] == 0 and loose[3] == loose[4] == loose[6] == 3


def test_streets_run_from_crossing_to_crossing(spark):
    """Shared segments count once, another name does not part a street, a side street does; short stretches go."""
    rows = [("A", 1, 2, 6.0, 8.0), ("A", 2, 1, 6.0, 8.0), ("A", 2, 3, 6.0, 12.0), ("A", 3, 4, 9.0, 8.0), ("A", 3, 5, 11.0, 8.0), ("B", 2, 9, 20.0, 2.0), (None, 1, 5, 30.0, 8.0), ("B", 9, 9, 0.0, 2.0)]
    stretches, parts = CH.street_table(spark.createDataFrame(rows, "name string, akey long, bkey long, len double, width double"))
    got = sorted((r.name, r.stretch.a, r.stretch.b, r.width, r.length, r.segments) for r in stretches.collect())
    assert got == [("A", 1, 2, 12.0, 12.0, 2), ("A", 3, 5, 12.0, 11.0, 1), ("B", 2, 9, 3.0, 20.0, 1)]
    assert sorted((r.name, r.at, r.line.a, r.line.b, r.forward) for r in parts.collect()) == [("A", 0, 1, 2, True), ("A", 0, 3, 5, True), ("A", 1, 2, 3, True), ("B", 0, 2, 9, True)]


@pytest.mark.parametrize("seed, places", [(1, 12), (2, 40), (3, 400)])
def test_streets_by_roads_are_those_by_segments(spark, seed, places):
    """Roads that touch, cross, turn back, close, stand still or run over each other, of one or two names."""
    rng = random.Random(seed)
    ways = [[rng.randrange(places) for _ in range(rng.randrange(2, 8))] for _ in range(60)]
    ways += [[1000, 1001, 1002, 1000], [1010, 1011, 1010], [1020, 1021, 1022, 1020, 1023], [1030, 1030, 1031, 1031, 1032], [1040, 1041, 1042], [1042, 1041, 1040], [1050, 1051, 1052, 1053, 1050], [1053, 1060]]
    rows = []
    for w, keys in enumerate(ways):
        for pos, (a, b) in enumerate(zip(keys, keys[1:]), 1):
            name = None if w % 13 == 5 else "two" if w % 7 == 3 and pos > 2 else f"s{w % 3}" if w < 60 else "ring"
            rows.append((name, w, pos, a, b, float(4 + (a * b) % 9), float(2 + w % 5)))
    segs = spark.createDataFrame(rows, "name string, way_id long, pos long, akey long, bkey long, len double, width double").repartition(4)
    pick = lambda df: sorted((r.name, r.stretch.a, r.stretch.b, r.width, r.length, r.segments, r.closed) for r in df.collect())
    want = pick(CH.street_table(segs)[0])
    assert pick(CH.street_stretches(segs)) == want and any(r[-1] for r in want) and any(r[5] > 2 for r in want)


def test_only_touched_roads_are_ranked(spark):
    """A road that meets no other of its name is one piece, whole; one that is met is cut at that place only."""
    rows = [("A", 1, p, p, p + 1, 5.0, 8.0) for p in range(1, 6)] + [("A", 2, p, 10 + p, 11 + p, 5.0, 8.0) for p in range(1, 6)] + [("A", 3, 1, 13, 30, 5.0, 8.0), ("B", 4, 1, 3, 40, 5.0, 8.0)]
    segs = spark.createDataFrame(rows, "name string, way_id long, pos long, akey long, bkey long, len double, width double")
    got = sorted((r.a, r.b, r.segments, r.alone) for r in CH.street_pieces(segs).collect())
    assert got == [(1, 6, 5, True), (3, 40, 1, True), (11, 13, 2, False), (13, 16, 3, False), (13, 30, 1, False)]
