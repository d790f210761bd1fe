"""Round trips through files and streams."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from mapweft.operators import edits
from mapweft.sources import readers, writers
from mapweft.streaming import streams


def test_elements_and_sequences(spark, tmp_path):
    payload = {"elements": [
        {"type": "way", "id": 1, "tags": {"highway": "path"}, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]},
        {"type": "way", "id": 2, "geometry": []}, {"type": "node", "id": 3, "lat": 4.0, "lon": 5.0}, {"type": "node", "id": 4},
        {"type": "relation", "id": 5, "members": [{"type": "way", "role": "outer", "geometry": [{"lat": 0.0, "lon": 0.0}]}, {"type": "way", "role": "inner"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(payload))
    got = {r.osm_id: (r.kind, len(r.rings)) for r in readers.scan_osm_elements(spark, str(tmp_path / "a.json")).collect()}
    assert got == {1: ("way", 1), 3: ("node", 1), 5: ("relation", 1)}
    lines = ['\x1e{"type":"Feature","properties":{"@id":"way/9","a":"b"},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}', "broken",
             '{"type":"Feature","properties":{"building":"yes"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}}']
    (tmp_path / "b.seq").write_text("\n".join(lines))
    rows = {r.kind: r for r in readers.scan_geojsonseq(spark, str(tmp_path / "b.seq")).collect()}
    assert rows["way"].osm_id == 9 and rows["way"].tags == {"a": "b"} and rows["way"].rings[0].pts[0].lat == 2.0
    assert rows["relation"].osm_id < 0 and [r.role for r in rows["relation"].rings] == ["outer", "inner"]


def test_grid_round_trip_prunes(spark, tmp_path):
    rows = [(i, 0.1 * i, 0.05 * i, 0.1 * i + 0.02, 0.05 * i + 0.02) for i in range(40)] + [(99, 0.0, 0.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "fid long, s double, w double, n double, e double")
    path = str(tmp_path / "grid")
    writers.write_grid(writers.region_grid(df), path)
    got = readers.scan_feature_grid(spark.read.parquet(path), (1.0, 0.4, 2.0, 1.2), 0.25, ["fid"])
    want = sorted(r[0] for r in rows if not (r[3] < 1.0 or r[1] > 2.0 or r[4] < 0.4 or r[2] > 1.2))
    assert sorted(r.fid for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in plan or "PartitionFilters: [(" in plan


def test_class_plane_file(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(b"CLASSES1" + struct.pack("<II", 4, 2) + bytes([1, 1, 2, 2, 3, 3, 3, 3]))
    (tmp_path / "short.bin").write_bytes(b"CLASSES1" + struct.pack("<II", 4, 2) + bytes([1]))
    got = sorted((r.ty, r.x0, r.x1, r.value) for r in readers.scan_class_plane(spark, str(tmp_path / "*.bin")).collect())
    assert got == [(0, 0, 2, 1), (0, 2, 4, 2), (1, 0, 4, 3)]


def test_placements_csv(spark, tmp_path):
    cols = [f.name for f in __import__("mapweft.model", fromlist=["PLACEMENT"]).PLACEMENT]
    rows = [(f"b{i}_01.tbx", "n", i, 2, 3, 4, 0, 0, 0, 0, 1, 0, 1, 1, 0, "house", "brick", 0, 0.0) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in __import__("mapweft.model", fromlist=["PLACEMENT"]).PLACEMENT))
    assert df.columns == cols
    writers.write_placements(df, str(tmp_path / "p"))
    back = readers.scan_placements(spark, str(tmp_path / "p"))
    assert sorted((r.base, r.unit, r.tile_x) for r in back.collect()) == [("b1.tbx", 1, 1), ("b2.tbx", 1, 2), ("b3.tbx", 1, 3)]


def test_fold_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 4, i % 3, None if i % 7 == 0 else i * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, id long, field int, value long")
    src = str(tmp_path / "in")
    for part in (0, 1):
        df.where(F.col("seq") % 2 == part).coalesce(1).write.mode("append").parquet(src)
    patches = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.fold_edits_stream(patches, ["id", "field"], str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    state = streams.folded_edits(spark, str(tmp_path / "state"), ["id", "field"], df)
    want = edits.fold_edits(df, ["id", "field"])
    assert sorted(state.select("id", "field", "value").collect()) == sorted(want.select("id", "field", "value").collect())


def test_keyed_state_after_a_failure(spark, tmp_path):
    """A batch that wrote files but no manifest is done again; untouched buckets keep their version; old versions go."""
    keys, path = ["id"], str(tmp_path / "state")
    state = streams.KeyedState(spark, path, keys, buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "id long, value long, seq long")
    fold = lambda old, new: edits.merge_fold(old, new, keys)
    now = lambda: {r.id: r.value for r in state.read(frame([])).collect()}
    state.apply(frame([(i, i, i) for i in range(20)]), 0, fold)
    first = state.manifest(0)
    assert now() == {i: i for i in range(20)} and set(first.values()) == {0}

    def broken(old, new):
        fold(old, new).withColumn("bucket", state._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/1")
        raise RuntimeError("killed")

    late = frame([(3, 33, 50), (3, 30, 40), (5, None, 60), (7, 70, 1)])
    with pytest.raises(RuntimeError):
        state.apply(late, 1, broken)
    assert state.last() == 0 and now() == {i: i for i in range(20)}
    state.apply(late, 1, fold)
    want = {i: i for i in range(20)} | {3: 33, 5: None}
    assert now() == want and state.last() == 1 and 1 in state.manifest(1).values() and 0 in state.manifest(1).values()
    state.apply(late, 1, fold)  # replayed whole
    assert now() == want
    for n in (2, 3, 4):
        state.apply(frame([(i, 100 * n, 100 * n) for i in range(20)]), n, fold)
    assert now() == {i: 400 for i in range(20)} and sorted(os.listdir(f"{path}/state")) == ["3", "4"] and sorted(os.listdir(f"{path}/manifest")) == ["3", "4"]


def test_late_extracts_do_not_replace_newer_ones(spark, tmp_path):
    src, out, schema = str(tmp_path / "src"), str(tmp_path / "out"), "region string, day string, fid long"
    for rows in ([("a", "2024-01-05", 1), ("b", "2024-01-01", 2)], [("a", "2024-01-03", 8), ("b", "2024-01-02", 3), ("c", "2024-01-01", 4)], [("a", "2024-01-05", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.refresh_extract_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted((r.region, r.fid) for r in spark.read.parquet(out).collect()) == [("a", 5), ("b", 3), ("c", 4)]


def test_stream_to_its_end_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    live = streams.run_to_end(streams.trailing_rate(streams.read_table_stream(spark, sf, "events")))
    want = streams.trailing_rate(spark.read.parquet(f"{sf}/events.parquet"))
    rows = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert rows(live) == rows(want)


def test_rate_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "ev")
    ev.orderBy("ts").coalesce(1).write.parquet(src)
    live = streams.trailing_rate(spark.readStream.schema(ev.schema).parquet(src))
    q = live.writeStream.outputMode("append").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.sql("SELECT * FROM rates").collect()}
    want = {(r.start, r.event_type): r.n for r in streams.trailing_rate(ev).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_refresh_replaces_partition(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "region string, day string, fid long"
    spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-01", 2), ("b", "2024-01-01", 3)], schema).coalesce(1).write.parquet(src)
    for _ in range(2):
        streams.refresh_extract_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck")).awaitTermination(120)
        spark.createDataFrame([("a", "2024-01-02", 9)], schema).coalesce(1).write.mode("append").parquet(src)
    got = sorted((r.region, r.fid) for r in spark.read.parquet(out).collect())
    assert got == [("a", 9), ("b", 3)] or got == [("a", 1), ("a", 2), ("b", 3)]
