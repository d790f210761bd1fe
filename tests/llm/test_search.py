"""Filter audit, periodic runs and nearest neighbours against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweft.llm import forest
from mapweft.llm.audit import FILTERS, audit_filters, contract, selectors
from mapweft.llm.forest import nearest
from mapweft.llm.q_search import op12_collapse_runs, op13_search_nearest, with_planted_runs
from mapweft.llm.runs import collapse_runs, find_runs, word_numbers

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, cell int, part string, n long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DOCS).repartition(3)


# Filter audit


def audit_rows():
    rng = random.Random(11)
    words = ["plain", "Words", "of", "ANY", "kind", "ü", "one#", "a|b"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 199, 200, 350]))) for _ in range(60)]
    texts += ["low " * 250, "UP " * 250, "UP " + " ".join(f"v{i}" for i in range(220)), None, "", " \n", "é" * 5000 + "A" * 100, "# " + " ".join(f"v{i}" for i in range(400))]
    rows = [(i, t, rng.choice(["a", "b", "", None])) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 9], rng.choice(["a", "b", "c"])) for i in range(40)]
    rows += [(300, texts[61], "a")] * 3 + [(None, texts[61], "a"), (None, None, None), (5, "other text", "c")]
    return rows


def audit_by_force(rows, labels):
    fails = []
    for doc_id, text, part in rows:
        text = text or ""
        words = text.encode().split()
        upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text)
        smaller = any(o[0] is not None and doc_id is not None and o[0] < doc_id and (o[1] or "") == text for o in rows)
        fails.append({"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * upper > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": smaller})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        gone_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, c in enumerate(order, 1):
                gone = [x for x in left if x[1][c]]
                kept = [x for x in left if not x[1][c]]
                gone_by[c] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(f[c] for _, f in mine) - len(gone), sum(f[c] and sum(f.values()) == 1 for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(gone_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_filters(spark):
    rows = audit_rows()
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 140, 2)] + [(0, 1, 1), (0, 0, 0), (999, 1, 1), (None, 1, 1)]
    labels = [(d, int(q), int(t)) for d, q, t in labels] + [(7, None, None)]
    got = audit_filters(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {tuple(r[:3]): tuple(r[3:]) for r in got}
    assert len(found) == len(got) == 600 * len({r[2] or "" for r in rows})
    assert found == audit_by_force(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(frame(spark, []), labels).count() == 0
    got = audit_filters(frame(spark, [(1, None, None)]), labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [tuple(r) for r in got[:2]] == [("", "ABCDE", 1, 0, 1, 0, 1, 0, 0, 120), ("", "ABCDE", 2, 0, 0, 0, 0, 0, 0, 0)]


def test_contraction_selects():
    steps, chosen = selectors("xyz")
    tensor = np.arange(16).reshape(2, 2, 2, 2)
    kept = contract(tensor, chosen["kept"])
    at = steps.index(("yxz", 2))
    assert kept[:, at].tolist() == [0 + 1, 8 + 9]  # x and y pass, z is free
    assert len(steps) == 18 and list(FILTERS) == ["A", "B", "C", "D"]


# Periodic runs


def runs_by_force(words):
    out = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                piece = words[i : i + length]
                if not any(all(piece[t] == piece[t + d] for t in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_find_runs_is_brute_force():
    rng = random.Random(12)
    texts = []
    for _ in range(400):
        words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(0, 40))]
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        words += (unit * 12)[: rng.randrange(1, 9 * len(unit))]
        texts.append(words + [rng.randrange(3) for _ in range(rng.randrange(4))])
    texts += [[], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 3 + [1], [1, 2, 3] * 200 + [1, 2] * 80]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = {}
    for doc, *run in find_runs(np.array([w for t in texts for w in t], np.int32), bounds):
        got.setdefault(doc, []).append(tuple(run))
    for i, t in enumerate(texts):
        assert got.get(i, []) == runs_by_force(t), t


def answer(doc_id, text):
    words = (text or "").encode().split()
    runs = runs_by_force(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    tight = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *tight, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def test_collapse_runs(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["a", "b", "ü"]) for _ in range(rng.randrange(60))) for _ in range(50)]
    texts += [None, "", " \t\n", "x " * 9000, "one word " * 7, "p q r\n" * 40 + "z", ("ab cd ef gh " * 30 + "x ") * 5]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[55], "s")]
    got = collapse_runs(frame(spark, rows)).collect()
    long = {53}  # nine thousand equal words: too long for brute force
    assert by_id(tuple(r)[:8] for r in got if r.doc_id not in long) == by_id(answer(d, t) for d, t, _ in rows if d not in long)
    one = next(r for r in got if r.doc_id == 53)
    assert (one.start, one.length, one.period, one.exponent_milli, one.collapsed) == (0, 9000, 1, 9_000_000, "x")
    assert [tuple(x) for x in one.runs] == [(0, 9000, 1)]
    assert collapse_runs(frame(spark, [])).count() == 0


def test_long_text_is_cut_at_white_space(monkeypatch):
    from mapweft.llm import runs

    monkeypatch.setattr(runs, "SLICE", 7)
    text = b"alpha beta  gamma\n" * 30 + b"tail" * 20
    seen = {}
    numbers = word_numbers(text, seen)
    assert [list(seen)[i] for i in numbers] == text.split()


def test_planted_runs_query(spark):
    """The query on small rows: the plant by the contract's words, then brute force."""
    docs = [(d, " ".join(f"w{(i * i + d) % 37}" for i in range(d % 90)) if d % 11 else None, None) for d in range(400)]
    planted = []
    for d, text, _ in docs:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        planted.append((d, " ".join(words)))
    want = by_id(answer(*p) for p in planted)
    assert by_id(tuple(r) for r in collapse_runs(with_planted_runs(frame(spark, docs)), outputs=False).collect()) == want
    assert sum(r[1] > 0 for r in want) > 10
    got = op12_collapse_runs(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and got.where("n_runs > 0").count() > 5


# Nearest neighbours


def nearest_by_force(rows, k, every):
    rows = [r for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    out = []
    for i, (d, v) in enumerate(rows):
        if d % every == 0:
            near = sorted(((-float(np.dot(v, w)), e) for j, (e, w) in enumerate(rows) if j != i and len(w) == len(v)))[:k]
            out += [(d, rank, e, -s) for rank, (s, e) in enumerate(near, 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, row int, shard string").repartition(3)


def test_nearest_small_is_exact(spark):
    """With few rows the ascent reaches the root, so every neighbour is found: ties, copies and unsound rows."""
    rng = np.random.default_rng(1)
    base = rng.integers(-3, 4, (40, 4)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, base[0].tolist()) for i in range(30)] + [(200, [0.0] * 4), (220, None), (221, []), (240, [1.0, None, 0.0, 1.0])]
    rows += [(260, [float("nan"), 1.0, 1.0, 1.0]), (261, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (280, [1.0, 2.0]), (300, [3.0, -1.0]), (20, [5.0, 5.0, 5.0, 5.0])]
    got = nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(nearest_by_force(rows, 5, 20))
    assert nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["plain", "clusters", "norms"])
def test_recall(spark, monkeypatch, kind):
    """Recall over several shards, and far fewer candidates than rows where vectors cluster."""
    monkeypatch.setattr(forest, "LEAST_ROWS", 1000)
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((3000, 24))
    if kind == "clusters":
        rows = rng.standard_normal((60, 24))[rng.integers(0, 60, 3000)] + 0.2 * rows
    if kind == "norms":
        rows *= rng.uniform(0.1, 3, (3000, 1))
    table = [(i, v.tolist()) for i, v in enumerate(rows)]
    got = nearest(vectors(spark, table), F.col("vec_id") % 50 == 0, 20).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    want = {(d, e) for d, _, e, _ in nearest_by_force(table, 20, 50)}
    assert len(got) == len(found) == len(want) and len(found & want) >= 0.9 * len(want)
    assert all(abs(r.score - rows[r.query_id] @ rows[r.vec_id]) < 1e-9 for r in got)


def test_clusters_need_few_candidates():
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((200, 32))[rng.integers(0, 200, 8000)] + 0.1 * rng.standard_normal((8000, 32))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    trees = forest.Forest(np.arange(8000), np.arange(8000), rows, forest.planes_of(32), 21)
    queries = rows[:50]
    bounds = np.sort(queries @ rows.T, axis=1)[:, -21]
    depth = trees.depth_for(bounds, np.linalg.norm(queries, axis=1), forest.MISS)
    units = np.column_stack([queries, np.zeros(50)])
    begin, end = trees._spans([forest._spell(units, p) for p in trees.planes], depth)
    assert (end - begin).sum(axis=0).mean() < 0.25 * 8000


def test_query_is_all_of_its_operator(spark):
    got = op13_search_nearest(spark, SF).toPandas()
    ids = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    asked = ids.vec_id[ids.vec_id % 20 == 0]
    assert set(got.query_id) == set(asked) and (got.groupby("query_id").size() == min(20, len(ids) - 1)).all()
    table = list(zip(ids.vec_id.tolist(), [np.asarray(v, float).tolist() for v in ids.embedding]))
    want = {(d, e) for d, _, e, _ in nearest_by_force(table, 20, 20)}
    assert len(set(zip(got.query_id, got.vec_id)) & want) >= 0.9 * len(want)
