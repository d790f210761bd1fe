"""Repeated passages: a distributed merge sort of suffixes that keeps known prefixes."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.llm.blocks import NO_ID, Block, distinct_keys, pack, read_marks, shared_keys, unpack
from mapweft.session import cut

LENGTH = 50  # bytes of a repeated string
GRAM = 16  # bytes by which a suffix is chosen
WINDOW = LENGTH - GRAM + 1
SPLITTERS = 20_000  # sampled suffixes that the driver sees at most, about
ANSWER = np.dtype([("unit", "<u4"), ("start", "u1"), ("count", "u1"), ("low", "<i8")])


class Units:
    """The chosen suffixes of a block and the windows that hang on each.

    Of the 16-byte grams in a 50-byte window the one with the least hash is its anchor.
    The choice looks at nothing outside the window, so equal windows have equal anchors
    at equal offsets. Windows next to each other mostly share one: about every 19th byte
    is an anchor, and sorting the suffixes there is enough to compare all windows.
    """

    def __init__(self, block: Block):
        n = len(block.data)
        self.block = block
        empty = np.zeros(0, np.int64)
        self.anchor = self.low = self.high = self.doc = empty
        self.key = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        words = np.ndarray((n - 7,), "<u8", block.data, strides=(1,))
        grams = n - GRAM + 1
        mixed = words[:grams] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= words[8 : 8 + grams] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        least = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < WINDOW:
            least = np.minimum(least[: len(least) - (WINDOW - span)], least[WINDOW - span :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(len(anchor), bool)
        for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
            inside[a : max(a, b - LENGTH + 1)] = True
        anchor[~inside] = -1
        edge = np.flatnonzero(np.diff(anchor, prepend=-2))
        last = np.append(edge[1:], len(anchor)) - 1
        used = anchor[edge] >= 0
        self.low, self.high = edge[used], last[used]
        self.anchor = anchor[self.low]
        self.doc = np.searchsorted(block.ends, self.anchor, "right")
        self.key = mixed[self.anchor] >> np.uint64(17)

    def repeated(self, grades: np.ndarray) -> np.ndarray:
        """Places of the units whose anchor another document has as well."""
        _, _, place = distinct_keys(self.key, self.block.ids[self.doc])
        return np.flatnonzero(grades[place] > 0) if len(place) else place

    def strings(self, chosen: np.ndarray) -> list[tuple[bytes, int]]:
        """Each unit as its suffix up to the last window's end, then what stands before, reversed.

        The number is the suffix's length. Two units are equal if string and number are.
        """
        data, out = self.block.data, []
        for a, lo, hi in zip(self.anchor[chosen].tolist(), self.low[chosen].tolist(), self.high[chosen].tolist(), strict=True):
            right = hi + LENGTH - a
            out.append((data[a : a + right] + data[lo:a][::-1], right))
        return out

    def distinct(self, chosen: np.ndarray) -> tuple[list[tuple[bytes, int]], np.ndarray, np.ndarray]:
        """Sorted distinct units, each one's smallest document id, and each chosen unit's place."""
        strings = self.strings(chosen)
        ordered = sorted(set(strings))
        place_of = {s: i for i, s in enumerate(ordered)}
        place = np.fromiter((place_of[s] for s in strings), np.int64, len(strings))
        low = np.full(len(ordered), NO_ID)
        np.minimum.at(low, place, self.block.ids[self.doc[chosen]])
        return ordered, low, place


def _keys_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    units = Units(block)
    keys, several, _ = distinct_keys(units.key, block.ids[units.doc])
    return keys, several


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of each string's common prefix with the one before it."""
    if not strings:
        return np.zeros(0, np.int64)
    width = max(map(len, strings)) + 1
    table = np.zeros((len(strings), width), np.int16)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    row = np.repeat(np.arange(len(strings)), sizes)
    table[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat + np.int16(1)
    differs = table[1:] != table[:-1]
    same = np.where(differs.any(axis=1), differs.argmax(axis=1), sizes[1:])
    return np.concatenate([[0], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))])


def front_code(units: list[tuple[bytes, int]], low: np.ndarray) -> bytes:
    """A sorted run: prefix kept from the string before, the rest, suffix length, smallest id."""
    strings = [s for s, _ in units]
    kept = common_prefixes(strings)
    tails = b"".join([s[k:] for s, k in zip(strings, kept.tolist(), strict=True)])
    head = np.array([len(units)], "<u4").tobytes()
    body = [kept.astype(np.uint8), np.array([len(s) for s in strings], np.uint8), np.array([r for _, r in units], np.uint8)]
    return zstandard.compress(head + b"".join(x.tobytes() for x in body) + low.astype("<i8").tobytes() + tails, 3)


class Run:
    """A front-coded run, read back: strings, common prefixes, suffix lengths, ids."""

    def __init__(self, coded: bytes):
        data = zstandard.decompress(coded)
        n = int(np.frombuffer(data, "<u4", 1)[0])
        kept, size, right = (np.frombuffer(data, np.uint8, n, 4 + k * n).tolist() for k in range(3))
        self.low = np.frombuffer(data, "<i8", n, 4 + 3 * n).tolist()
        self.kept, self.right, self.strings = kept, right, []
        at, before = 4 + 11 * n, b""
        for k, s in zip(kept, size, strict=True):
            before = before[:k] + data[at : at + s - k]
            at += s - k
            self.strings.append(before)


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs with a loser tree; yields (run, place, common prefix with the one before).

    Every loser on the path of the last winner knows its common prefix with it. Of two
    candidates the one with the longer known prefix is the smaller, without a look at the
    strings; equal ones are compared from the known prefix on only.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    head: list[bytes] = [r.strings[0] if r.strings else b"" for r in runs] + [b""] * (size - len(runs))
    known = [0 if r.strings else -1 for r in runs] + [-1] * (size - len(runs))  # -1: run is over
    tree = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        hx, hy = known[x], known[y]
        if hx != hy:
            return (x, y) if hx > hy else (y, x)
        if hx < 0:
            return x, y
        a, b = head[x], head[y]
        if a == b:
            k, first = len(a), x <= y
        else:
            k, top = hx, min(len(a), len(b))
            while k < top and a[k] == b[k]:
                k += 1
            first = a < b
        if first:
            known[y] = k
            return x, y
        known[x] = k
        return y, x

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while known[winner] >= 0:
        run = runs[winner]
        place = at[winner]
        yield winner, place, known[winner]
        place += 1
        at[winner] = place
        if place < len(run.strings):
            head[winner], known[winner] = run.strings[place], run.kept[place]
        else:
            known[winner] = -1
        node = (size + winner) >> 1
        while node:
            winner, tree[node] = play(winner, tree[node])
            node >>= 1


def _answers(group: list[tuple[int, int, int, int, bytes, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """For the units of one anchor gram: windows that a smaller document than the unit's own has.

    Entries are (run, unit, suffix length, smallest id, string). Yields (run, unit, start,
    count, low): for the windows that reach start .. start + count - 1 bytes before the
    anchor, the smallest document that has them.
    """
    best: dict[tuple[bytes, int], int] = {}
    for _, _, right, low, string in group:
        if low < best.get((string, right), NO_ID + 1):
            best[string, right] = low
    if len(best) == 1:
        only = next(iter(best.values()))
        for run, unit, right, low, string in group:
            if only < low:
                yield run, unit, LENGTH - right, len(string) - LENGTH + 1, only
        return
    windows: dict[tuple[int, bytes], int] = {}
    for (string, right), low in best.items():
        for i in range(LENGTH - right, len(string) - right + 1):
            key = i, string[: LENGTH - i] + string[right : right + i]
            if low < windows.get(key, NO_ID + 1):
                windows[key] = low
    cached: dict[tuple[bytes, int], list[tuple[int, int, int]]] = {}
    for run, unit, right, low, string in group:
        spans = cached.get((string, right))
        if spans is None:
            spans = []
            for i in range(LENGTH - right, len(string) - right + 1):
                m = windows[i, string[: LENGTH - i] + string[right : right + i]]
                if spans and spans[-1][2] == m:
                    spans[-1] = (spans[-1][0], spans[-1][1] + 1, m)
                else:
                    spans.append((i, 1, m))
            cached[string, right] = spans
        for start, count, m in spans:
            if m < low:
                yield run, unit, start, count, m


def _merge_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of one range and tell each block what it did not know."""
    rows = rows.sort_values("block", kind="stable")
    runs = [Run(p) for p in rows["payload"]]
    first = rows["first"].tolist()
    found: list[list[tuple]] = [[] for _ in runs]
    group: list[tuple] = []

    def settle() -> None:
        if len(group) > 1:
            for run, unit, start, count, low in _answers(group):
                found[run].append((first[run] + unit, start, count, low))
        group.clear()

    for run, place, prefix in merge(runs):
        if prefix < GRAM:
            settle()
        r = runs[run]
        group.append((run, place, r.right[place], r.low[place], r.strings[place]))
    settle()
    some = [i for i, f in enumerate(found) if f]
    return pd.DataFrame({"block": rows["block"].to_numpy()[some], "part": [zstandard.compress(np.array(found[i], ANSWER).tobytes()) for i in some]})


def _covered(units: Units, chosen: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Which bytes a window of a smaller document covers."""
    ordered, low, place = units.distinct(chosen)
    ids = units.block.ids[units.doc[chosen]]
    marks = np.zeros(len(units.block.data) + 1, np.int64)
    local = low[place] < ids
    np.add.at(marks, units.low[chosen][local], 1)
    np.add.at(marks, units.high[chosen][local] + LENGTH, -1)
    if len(answers):
        by_unit = np.argsort(place, kind="stable")
        sorted_place = place[by_unit]
        a, b = np.searchsorted(sorted_place, answers["unit"], "left"), np.searchsorted(sorted_place, answers["unit"], "right")
        which = np.repeat(np.arange(len(answers)), b - a)
        inst = by_unit[np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
        got = answers[which]
        use = got["low"] < ids[inst]
        anchor, start, count = units.anchor[chosen][inst][use], got["start"][use].astype(np.int64), got["count"][use].astype(np.int64)
        np.add.at(marks, anchor - start - count + 1, 1)
        np.add.at(marks, anchor - start + LENGTH, -1)
    return np.cumsum(marks[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a document with a smaller id.

    Suffixes are chosen by their content (`Units`). Hashes of their first 16 bytes tell
    which start in several documents; only those are sorted. A block sorts its own,
    joins equal ones to one with the smallest id, and sends them as front-coded runs, cut
    by sampled splitters. A range merges its runs with a loser tree; stretches of the
    result that share an anchor gram are compared window by window. What a block learns
    comes back to it by the place of the unit in its run.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed stretches inside a
    document), kept_sha256 and, with `outputs`, kept (the remaining bytes). Null texts are
    empty. A null id counts as larger than all others. Rows with equal ids do not cover
    each other. Empty input: no rows. Other columns are not carried.
    """
    spark = docs.sparkSession
    blocks = pack(docs, id_col, text_col)
    marks = cut(shared_keys(blocks, _keys_of))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SPLITTERS / 64 / max(blocks.count(), 1))
    sample = blocks.where(F.pmod(F.xxhash64("block"), F.lit(10_000)) < share * 10_000).select("sample").collect()
    points = sorted(s.sample[i : i + 8] for s in sample for i in range(0, len(s.sample), 8))
    splitters = sorted({points[len(points) * k // ranges] for k in range(1, ranges)}) if points else []

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                units = Units(unpack(row))
                ordered, low, _ = units.distinct(units.repeated(read_marks(row.marks)))
                cuts = [0, *[bisect_left(ordered, (s, 0)) for s in splitters], len(ordered)]
                parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                yield pd.DataFrame({
                    "range": [k for k, _, _ in parts], "block": row.block, "first": [a for _, a, _ in parts],
                    "payload": [front_code(ordered[a:b], low[a:b]) for _, a, b in parts],
                })

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block = unpack(row)
                units = Units(block)
                parts = [np.frombuffer(zstandard.decompress(p), ANSWER) for p in (row.parts if row.parts is not None else [])]
                chosen = units.repeated(read_marks(row.marks))
                gone = _covered(units, chosen, np.concatenate(parts) if parts else np.zeros(0, ANSWER))
                data, out = np.frombuffer(block.data, np.uint8), []
                for d, (a, b) in enumerate(zip(block.starts.tolist(), block.ends.tolist(), strict=True)):
                    own = gone[a:b]
                    kept = data[a:b][~own].tobytes()
                    spans = int(np.count_nonzero(own[1:] & ~own[:-1]) + (own[0] if b > a else 0))
                    out.append((None if block.no_id[d] else str(block.ids[d]), b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if outputs else [])))
                yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if outputs else [])
    sent = blocks.join(marks, "block").mapInPandas(runs, "range int, block long, first int, payload binary")
    told = sent.groupBy("range").applyInPandas(_merge_range, "block long, part binary")
    answers = told.groupBy("block").agg(F.collect_list("part").alias("parts"))
    both = marks.join(answers, "block", "left")
    out = blocks.join(both, "block", "left").mapInPandas(finish, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if outputs else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
