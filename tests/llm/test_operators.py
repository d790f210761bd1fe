"""Every operator against brute force, over rows with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweft.llm import bpe, chat, media, toxicity
from mapweft.llm import components as components_module
from mapweft.llm.components import components
from mapweft.llm.jaccard import Sketches, similar_documents, sketch, suffix_able
from mapweft.llm.lines import drop_spread_lines
from mapweft.llm.mixing import mix
from mapweft.llm.near_vectors import link_vectors
from mapweft.llm.shards import shard_by_bytes
from mapweft.llm.suffixes import Run, common_prefixes, front_code, merge, remove_repeats
from mapweft.session import estimated_bytes

SCHEMA = "doc_id long, text string, source string, size long, block long, rank int, score double, kept boolean, n_lines int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "ti", "on", "ed", "ße", "ò"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([1, 3, 5, 40, 120])) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [texts[3], texts[3], texts[3] + " more", passage, "A. " + passage + "\n" + texts[8], texts[9] + passage.upper()]
    texts += ["", None, "   \n\t ", "x", "a b c d", "A B C D", "same line here\n" + texts[5], "same line here\n" + texts[6]]
    texts += ["same line here\n" + prose(rng, 30) for _ in range(16)] + [prose(rng, 9000), "w" * 9000, "é" * 700, "ab" * 400]
    base = prose(rng, 100).split()
    texts += [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in range(0, 100, 9)]
    out = [(i, t, rng.choice(["s1", "s2", "s3", "s4", "s5", "s6", None])) for i, t in enumerate(texts)]
    rng.shuffle(out)
    out += [out[0], out[0], (None, texts[3], "s1"), (None, None, None)]
    return [(*r, 1, 2, 3, 4.0, True, 5) for r in out]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def last_null(x):
    return math.inf if x is None else x


def groups_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similar_by_force(data):
    data = sorted(data, key=lambda r: last_null(r[0]))
    sets = [shingles(r[1]) for r in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = groups_of(len(data), links)
    return Counter((r[0], len(s), data[g][0]) for r, s, g in zip(data, sets, group))


def test_similar_documents(docs, data, nothing):
    got = similar_documents(docs)
    found = got.collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == similar_by_force(data)
    assert sum(r.kept for r in found) == len(set(groups_of_rows(data)))
    assert similar_documents(nothing).count() == 0


def groups_of_rows(data):
    data = sorted(data, key=lambda r: last_null(r[0]))
    sets = [shingles(r[1]) for r in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return groups_of(len(data), links)


def test_suffix_filter_never_loses_a_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(2))
        both = len(np.intersect1d(x, y))
        assert suffix_able(x, y, both)


def repeats_by_force(data, length=50):
    starts = {}
    texts = [(last_null(r[0]), (r[1] or "").encode()) for r in data]
    for d, t in texts:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            starts[w] = min(d, starts.get(w, math.inf))
    out = Counter()
    for (d, t), r in zip(texts, data):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if starts[t[s : s + length]] < d:
                gone[s : s + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out[r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_remove_repeats(docs, data, nothing):
    got = remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats_by_force(data)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert remove_repeats(nothing).count() == 0


def test_loser_tree_merges_runs():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 20):
        runs, every = [], []
        for _ in range(n):
            own = sorted({(bytes(rng.choices(b"ab", k=rng.randint(1, 9))), 1) for _ in range(rng.randint(0, 12))})
            every += [s for s, _ in own]
            runs.append(Run(front_code(own, np.zeros(len(own), np.int64))))
        merged = [(runs[r].strings[p], k) for r, p, k in merge(runs)] if any(r.strings for r in runs) else []
        assert [s for s, _ in merged] == sorted(every)
        assert [k for _, k in merged] == common_prefixes(sorted(every)).tolist()


def test_link_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 12))
    near = base[:15] + rng.normal(size=(15, 12)) * 0.12
    vectors = [v.tolist() for v in np.concatenate([base, near, base[:3], base[3:5] * 4])]
    vectors += [None, [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] * 12, [None] + [1.0] * 11, [], [1.0, 2.0], [2.0, 4.0], [1e300] * 12, [1e300] * 12]
    table = [(i, v, 7) for i, v in enumerate(vectors)]
    table += [table[0], (None, vectors[0], 1)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, rank int").repartition(3)

    def unit(r):
        v = r[1]
        if r[0] is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(r) for r in table]
    links = [(i, j) for i in range(len(table)) for j in range(i) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95]
    order = sorted(range(len(table)), key=lambda i: last_null(table[i][0]))
    place = {i: p for p, i in enumerate(order)}
    group = groups_of(len(table), [(place[i], place[j]) for i, j in links])
    n = Counter(x for pair in links for x in pair)
    want = Counter((r[0], n[i], table[order[group[place[i]]]][0]) for i, r in enumerate(table))
    got = link_vectors(frame).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert link_vectors(frame.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    chain = list(range(400))
    random.Random(4).shuffle(chain)
    edges = spark.createDataFrame([*zip(chain[:-1], chain[1:]), (1000, 1001), (1002, 1001)], "src long, dst long").repartition(7)
    got = {r.id: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(400))
    assert (got[1000], got[1001], got[1002]) == (1000, 1000, 1000)


def test_components_keep_their_size(spark, monkeypatch):
    """However many rounds it takes, the plan's guess of the size stays that of the rows."""
    monkeypatch.setattr(components_module, "TASK_EDGES", 50)
    chain = list(range(400))
    random.Random(4).shuffle(chain)
    edges = spark.createDataFrame([*zip(chain[:-1], chain[1:])], "src long, dst long")
    got = components(edges)
    assert estimated_bytes(got) < 1 << 20
    assert {r.component for r in got.collect()} == {0}


def test_shards(docs, data, nothing):
    got = shard_by_bytes(docs, 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in data)
    total = sum(r.size for r in got)
    for s in range(7):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        if own:
            assert abs(sum(r.size for r in own) - total / 7) <= max(r.size for r in got)
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert ids == sorted(ids)
    assert shard_by_bytes(nothing, 7).count() == 0


def test_mix(docs, data, nothing):
    got = mix(docs).collect()
    count = lambda t: len((t or "").encode().split())
    size = Counter()
    for r in data:
        size[r[2]] += count(r[1])
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, dict(weight), sum(size.values())
    while free:
        level = left / sum(free.values())
        over = [s for s in free if 3 * size[s] <= free[s] * level]
        if not over:
            target |= {s: w * level for s, w in free.items()}
            break
        for s in over:
            target[s], left = 3 * size[s], left - 3 * size[s]
            del free[s]
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
    longest = {s: max((count(r[1]) for r in data if r[2] == s), default=0) for s in size}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], count(r[1])) for r in data)
    again = mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in got) == Counter((r.doc_id, r.source, r.taken) for r in again)
    assert mix(nothing).count() == 0


def test_spread_lines(docs, data, nothing):
    lines = {}
    for r in data:
        for line in set((r[1] or "").split("\n")):
            if line.strip(" "):
                lines.setdefault(line, set()).add((r[2], r[0]))
    bad = {k: min((d for _, d in v if d is not None), default=None) for k, v in lines.items() if len({s for s, _ in v} - {None}) >= 5}
    assert bad
    want = Counter()
    for r in data:
        own = (r[1] or "").split("\n")
        kept = [x for x in own if not (x in bad and bad[x] != r[0])]
        want[r[0], None if r[1] is None else "\n".join(kept), 0 if r[1] is None else len(own), 0 if r[1] is None else len(own) - len(kept)] += 1
    got = drop_spread_lines(docs, 5)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == want
    assert set(got.columns) == set(docs.columns) | {"n_removed"}
    assert drop_spread_lines(nothing, 5).count() == 0


def test_encoding_equals_the_library(docs, data, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.vocabulary_path())
    whole.no_truncation()
    whole.no_padding()
    got = bpe.encode_documents(docs).collect()
    want = Counter()
    for r in data:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], tuple(ids), whole.decode(ids, skip_special_tokens=False) if ids else ""] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(nothing).count() == 0


def test_chunks_anywhere_give_the_same_ids():
    encoder = bpe.Encoder(bpe.vocabulary_path())
    rng = random.Random(9)
    odd = ["<|endoftext|>", "it's", "É", "é", "́", "İ", "Σ", " ", " ", "\x1c", "\x85", "😀👍", "ﬁ", "123", "$$$", "中文字", "\n\n", "\t", " "]
    for n in (0, 1, 30, 400):
        text = "".join(rng.choice([*odd, "word", "the ", "ing "]) for _ in range(n))
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        for mean, least in ((1, 1), (3, 2), (50, 1), (50, 20), (100_000, 1)):
            old = bpe.chunk_ends
            bpe.chunk_ends = lambda d, m=mean, s=least, f=old: f(d, m, s, 40)
            try:
                found = encoder.encode(text.encode())
                assert np.frombuffer(found, "<u4").tolist() == ids
                assert encoder.decode(found).decode() == (encoder.tokenizer.decode(ids, skip_special_tokens=False) if ids else "")
            finally:
                bpe.chunk_ends = old


def test_chunks_and_tables_are_bounded():
    for data in (b"ab" * 50_000, b"\0" * 50_000, bytes(range(256)) * 300, b"x", b""):
        ends = bpe.chunk_ends(data)
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(data) and sizes.max(initial=0) <= bpe.MOST_CHUNK and (sizes[:-1] >= bpe.LEAST_CHUNK).all()
    table = bpe.Table(100 + 10 * bpe.ENTRY)
    for i in range(1000):
        table.keep(b"%d" % i, b"12345")
        table.turn()
        assert table.find(b"0") == b"12345"  # met often: it stays
    assert len(table) < 40 and table.find(b"3") is None


def test_forgetful_tables_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 2000)
    monkeypatch.setattr(bpe, "CHUNK_TABLE_BYTES", 3000)
    encoder = bpe.Encoder(bpe.vocabulary_path())
    text = prose(random.Random(4), 3000)
    for piece in (text, text[:9000], text[5:], text):
        assert np.frombuffer(encoder.encode(piece.encode()), "<u4").tolist() == encoder.tokenizer.encode(piece, add_special_tokens=False).ids


def test_chat_round_trip(spark):
    rng = random.Random(8)
    table = []
    for c in range(30):
        for t in range(rng.choice([1, 2, 5, 40])):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "tool\nx", None])
            table.append((c, t, role, rng.choice([None, "", prose(rng, 30), "\\1 <s>[INST] </s>\\", "[/INST]</s>" * 3, prose(rng, 900)]), 1))
    table += [(None, None, "user", "a", 1), (-7, 0, "user", "</s>[INST] ok [/INST]", 1), (3, 0, "assistant", "tie", 1), (3, 0, "assistant", "tie", 1)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, window int").repartition(4)
    windows = chat.format_conversations(frame)
    got = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    for conv in {r[0] for r in table}:
        own = sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode()))
        turns = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), turns)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = windows.collect()
    for r in shown:
        cost = sum(chat.turn_tokens(t[0]) for t in chat.TURN.finditer(r.formatted))
        assert cost <= 512 or r.new_turns == 1
    first = {r.conv_id: chat.parse_window(r.formatted)[0] for r in shown if r.window == 0}
    assert all(chat.parse_window(r.formatted)[0] == first[r.conv_id] for r in shown if first[r.conv_id][0] == "system")
    assert any(r.repeated for r in shown)
    assert chat.read_windows(chat.format_conversations(frame.limit(0))).count() == 0


def test_chat_history_gives_way_to_a_long_turn(spark):
    rng = random.Random(9)
    table = []
    for c in range(40):
        for t in range(30):
            role = "system" if t == 0 and c % 2 else "user" if t % 2 else "assistant"
            table.append((c, t, role, "x" * rng.choice([40, 200, 460, 1700, 1900, 2500])))
    shown = chat.format_conversations(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).collect()
    for r in shown:
        costs = [chat.turn_tokens(t[0]) for t in chat.TURN.finditer(r.formatted)]
        own = chat.parse_window(r.formatted)
        head = costs[0] if r.repeated and own[0][0] == "system" else 0
        assert sum(costs) <= 512 or (r.new_turns == 1 and head + costs[-1] > 512 and len(costs) == 1 + bool(head))
    assert any(r.repeated > 1 for r in shown)


def test_media_round_trip(spark, docs, data, nothing, tmp_path):
    got = media.media_features(media.store_and_scan(docs, range_bytes=2000)).collect()
    want = Counter()
    for r in data:
        own = (r[1] or "").encode()
        payload = own + b"\xff" * (max(576, -(-len(own) // 576) * 576) - len(own))
        want[r[0], len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.media_features(media.store_and_scan(nothing)).count() == 0


def test_media_member_is_read_again(tmp_path, monkeypatch):
    members = [media.to_png(media.payload_of(t)[0]) for t in ("one", "two", "three")]
    entries, at = [], 0
    for i, m in enumerate(members):
        entries.append((i, False, at, len(m), zlib.crc32(m)))
        at += len(m)
    (tmp_path / "a.arc").write_bytes(b"".join(members) + media.directory_of(entries, at))
    (tmp_path / "archives.json").write_text(f'[["a.arc", {at}]]')
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "range_bytes": "100000"})
    asked, true_read = [], media.read_at

    def flaky(store, path, offset, length):
        asked.append(offset)
        got = true_read(store, path, offset, length)
        return bytes(len(got)) if len(asked) <= 2 else got

    monkeypatch.setattr(media, "read_at", flaky)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert [bytes(x.as_py()) for b in batches for x in b.column(1)] == members
    assert asked == [0, 0, 0, len(members[0]), len(members[0]) + len(members[1])]
    monkeypatch.setattr(media, "read_at", lambda *a: b"")
    with pytest.raises(OSError):
        list(reader.read(part))


def test_toxicity(spark):
    rng = random.Random(6)
    table, labels = [], []
    for i in range(900):
        words = prose(rng, rng.choice([5, 40, 150])).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "clown", "pathetic"]))
        table.append((i, " ".join(words), 0.5, "x"))
        labels.append((i, int(toxic), "clash"))
    table += [(9000, None, 0.0, "x"), (9001, "", 0.0, "x"), (9001, "", 0.0, "x"), (None, "the idiot clown " * 30_000, 0.0, "x")]
    labels += [(None, 1, ""), (5, None, ""), (5, 1, ""), (7777, 1, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string, score double, source string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    held = {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    model = toxicity.train(docs, marks.where(~toxicity.held_out()), per_class=400)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(table) and all(0 <= r.score <= 1 for r in got)
    tested = [(r.score >= 0.3, r.doc_id % 5 == 0) for r in got if r.doc_id in held]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested)
    assert next(r.score for r in got if r.doc_id is None) > 0.9
    assert len({r.score for r in got if r.text in (None, "")}) == 1
    empty = toxicity.train(docs.limit(0), marks.limit(0))
    assert all(r.score == pytest.approx(1e-6) for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_slices_do_not_change_a_score(monkeypatch):
    model = toxicity.Model(np.arange(0, 1 << 20, 7), np.ones(len(range(0, 1 << 20, 7))), 0.0)
    slot = toxicity._slots(model.buckets)
    texts = ["abc" * 50, "", "x", "the idiot " * 40]
    whole = [x.tolist() for x in toxicity._hits(texts, slot)]
    monkeypatch.setattr(toxicity, "SLICE", 64)
    assert [x.tolist() for x in toxicity._hits(texts, slot)] == whole


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 40, 120, 500, 520, 640, 5000, 5100)]
    sets += [np.concatenate([sets[4][:450], sets[5][:80]]), sets[4].copy(), np.concatenate([sets[7], sets[2]])]
    sets.sort(key=len)
    sketches = Sketches([sketch(s) for s in sets])
    for i in range(len(sets) - 1):
        others = np.arange(i + 1, len(sets))
        bound = sketches.differ(i, others)
        apart = [len(np.setxor1d(sets[i], sets[j])) for j in others]
        assert (bound <= apart).all()
        assert all(b == 0 for b, a in zip(bound, apart, strict=True) if a == 0)


def test_large_sets_around_the_limit_are_linked_as_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, texts = [word() for _ in range(230)], []
    for k in range(70):  # one passage with own words around it: similarities from far below to above the limit
        own = [word() for _ in range(rng.choice([6, 14, 22, 26, 30, 60]))]
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    for k in range(12):
        w = texts[k].split()
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    parent = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert 1 < len(set(parent)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(docs).collect()}
    assert got == {d: (len(sets[d]), parent[d]) for d in range(len(texts))}
