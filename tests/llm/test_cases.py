"""Cases that once went wrong: shared ids, null sites, white space, clashing names, one stage after another."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from mapweft.llm import lines, near_vectors, toxicity
from mapweft.llm.lines import drop_spread_lines
from mapweft.llm.near_vectors import link_vectors

SF = "/root/testdata/sf0.001"


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_different_vectors_of_one_id_keep_their_links(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (1, [1.0, 0.05]), (2, [0.05, 1.0]), (9, [-1.0, 0.0])]
    got = Counter(tuple(r)[:3] for r in link_vectors(vector_frame(spark, rows)).collect())
    assert got == Counter([(5, 1, 1), (5, 1, 2), (1, 1, 1), (2, 1, 2), (9, 0, 9)])


def test_cosine_on_the_threshold_links(spark):
    rows = [(1, [5.0, 0.0]), (2, [3.0, 4.0]), (3, [2.9, 4.1])]
    got = {r.vec_id: r.n_links for r in link_vectors(vector_frame(spark, rows), 0.6).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("block", [7, 60])
def test_blocks_out_of_reach_hold_no_links(spark, monkeypatch, block):
    """Many small blocks along a wide axis: every link is found, and few blocks meet."""
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "MOST", block)
    rng = np.random.default_rng(6)
    rows = rng.standard_normal((300, 3)) * [4, 1, 1]
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in link_vectors(vector_frame(spark, [(i, v.tolist()) for i, v in enumerate(rows)])).collect()}
    assert got == dict(enumerate(links.tolist()))


DOCS = "doc_id long, text string, source string, _bad int, _id int, _kept int, n_lines int"


def spread_by_force(rows, least):
    seen = {}
    for d, text, site in rows:
        for x in set((text or "").split("\n")):
            if x.strip(" \t\r\x0b\x0c"):
                seen.setdefault(x, []).append((d, site))
    bad = {}
    for x, where in seen.items():
        if len({s for _, s in where if s is not None}) >= least:
            bad[x] = min((d for d, _ in where if d is not None), default=math.inf)
    return {d: text and "\n".join(x for x in text.split("\n") if bad.get(x, d) == d) for d, text, site in rows}


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_null_sites_white_space_and_names(spark, monkeypatch, broadcast):
    """At exactly five sites a document without a site may keep the first copy; ways of joining agree."""
    monkeypatch.setattr(lines, "BROADCAST_LINES", broadcast)
    common = "shared line\nown {}\n\r\n\t\n  \n\x0b\x0c\r"
    rows = [(1, common.format(1), None)] + [(i, common.format(i), "abcde"[i - 2]) for i in range(2, 7)]
    rows += [(10 + i, f"seen by four\n\r\nx{i}", "abcd"[i]) for i in range(4)] + [(20 + i, "by ten\n\t", f"s{i}") for i in range(10)] + [(40, None, "a"), (41, "", None)]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DOCS).repartition(4)
    got = drop_spread_lines(frame, 5).collect()
    assert {r.doc_id: r.text for r in got} == spread_by_force(rows, 5)
    assert all((r._bad, r._id, r._kept) == (1, 2, 3) for r in got)
    assert next(r for r in got if r.doc_id == 1).n_removed == 0 and next(r for r in got if r.doc_id == 2).n_removed == 1


def test_scores_by_hand(spark):
    """Every score is the logistic function of the weighted n-grams that a text has."""
    docs = [(i, "good words here" if i % 2 else "bad toxic words", "s") for i in range(40)] + [(50, "", "s"), (51, None, "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, labels)
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert len({round(got[i], 12) for i in range(1, 40, 2)}) == 1 and got[50] == got[51]
    assert got[0] > 0.5 > got[1]


# The stages of the pipeline

STAGE_DOCS = "doc_id long, text string, lang string, source string, n_chars long, _toxic int, _lines int, _key int, _copy int, _source int, n_removed int"


def stage_frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, 2, 3, 4, 5, 6) for d, t, s in rows], STAGE_DOCS).repartition(3)


def words(n, start=0):
    return " ".join(f"word{i}" for i in range(start, start + n))


def test_one_of_each_group_by_id_and_text(spark):
    a, b = words(60), words(60, 500)
    rows = [(1, a, "x"), (5, a + " more", "x"), (5, b, "x"), (7, b, "y"), (7, b, "y"), (None, b, "z"), (8, None, "x"), (8, "", "x"), (8, "", "x"), (9, " \n", "x"), (3, "lone", "x")]
    frame = stage_frame(spark, rows)
    got = corpus_pipeline.keep_one_of_each_group(spark, frame, SF)
    assert got.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (5, b), (8, None), (8, ""), (8, ""), (9, " \n"), (3, "lone")])


def test_stages_take_odd_rows(spark):
    """Nulls, repeats, an empty table and clashing names pass every stage; the columns stay."""
    rows = [(i, words(30, 7 * i), f"s{i % 4}") for i in range(30)]
    rows += [rows[0], rows[0], (None, words(9), None), (None, None, None), (40, None, "s1"), (41, "", "s1"), (42, "\t\n", None), (43, "only\n" + words(40, 900), "s2")]
    for table in (rows, []):
        docs = stage_frame(spark, table) if table else stage_frame(spark, rows).limit(0)
        names = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == names
        found = docs.collect()
        assert bool(found) == bool(table)
        for r in found:
            assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_repeats_follow_the_mix(spark):
    rows = [(1, words(10), "a"), (1, words(10), "a"), (2, words(1000, 50), "b"), (3, None, "a"), (None, words(5), None)]
    frame = stage_frame(spark, rows)
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.repeat_to_weights(spark, frame, SF).collect())
    again = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.repeat_to_weights(spark, frame.repartition(5), SF).collect())
    assert got == again and got[1, words(10), "a"] <= 6 and all(k[1] for k in got)
