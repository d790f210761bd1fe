"""Periodic runs of words: seeds of guaranteed overlap, extended along diagonals."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6  # words of the shortest run
TIMES = 4  # periods of the shortest run
SEED = 5  # words of the shortest seed: a run of period 1 agrees with itself, one word on, in LEAST - 1 words
BATCH = 200_000  # words of short texts that are searched together
SLICE = 4 << 20  # bytes split at once
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_numbers(data: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers; new words are added to the vocabulary."""
    parts, at = [], 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            found = SPACE.search(data, end)
            end = found.start() if found else len(data)
        add = vocabulary.setdefault
        parts.append(np.array([add(w, len(vocabulary)) for w in data[at:end].split()], np.int32))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _grams(a: np.ndarray, shift: int, b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of longer grams, each made of gram a[i] and gram b[i + shift].

    Grams that do not recur in their document get -1, since nothing longer that starts
    with them does. Also returns, for each recurring gram, the places of its consecutive
    occurrences: (earlier, later).
    """
    numbers = np.full(len(a), -1, np.int64)
    at = np.flatnonzero((a[: len(a) - shift] >= 0) & (b[shift:] >= 0) & (owner[: len(a) - shift] == owner[shift:])) if shift < len(a) else np.zeros(0, np.int64)
    if shift:
        key = a[at] * (int(b.max(initial=0)) + 1) + b[at + shift]
    else:
        key = a[at]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    near = same & (owner[at[1:]] == owner[at[:-1]])
    again = np.zeros(len(at), bool)
    again[1:] |= near
    again[:-1] |= near
    group = np.concatenate([[0], np.cumsum(~same)]) if len(at) else np.zeros(0, np.int64)
    numbers[at[again]] = group[again]
    return numbers, at[:-1][near], at[1:][near]


def _reach(words: np.ndarray, at: int, lag: int, low: int, high: int, width: int) -> tuple[int, int]:
    """The stretch around [at, at + width) whose words equal those `lag` further on."""
    end, step = at + width, 64
    while end + lag < high:
        stop = min(end + step, high - lag)
        bad = np.flatnonzero(words[end:stop] != words[end + lag : stop + lag])
        if bad.size:
            end += int(bad[0])
            break
        end, step = stop, step * 2
    begin, step = at, 64
    while begin > low:
        stop = max(begin - step, low)
        bad = np.flatnonzero(words[stop:begin] != words[stop + lag : begin + lag])
        if bad.size:
            begin = stop + int(bad[-1]) + 1
            break
        begin, step = stop, step * 2
    return begin, end


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs in documents laid end to end.

    A run of period q agrees with itself, q words on, in at least max(5, 3q) places. So
    grams of k = 5, 15, 45, ... words see every run of a period from k/3 to k, and since
    k is no shorter than the period, a gram inside a run recurs there after exactly q
    words, never sooner: consecutive occurrences are pairs enough, and a pair never tells
    a multiple of the smallest period. A table with the furthest word covered along each
    lag suppresses seeds of a stretch that has been extended. Each length of gram costs
    one sort of the places whose shorter grams recur.
    """
    out: list[tuple[int, int, int, int]] = []
    if not len(words):
        return out
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ones, left, _ = _grams(words.astype(np.int64), 0, words.astype(np.int64), owner)
    twos, left, _ = _grams(ones, 1, ones, owner)
    fours, left, _ = _grams(twos, 2, twos, owner)
    grams, left, right = _grams(fours, 4, ones, owner)
    k = SEED
    while left.size:
        lag = right - left
        able = (lag <= k) & ((lag > k // 3) | (k == SEED))
        left, lag = left[able], lag[able]
        order = np.lexsort((left, lag))
        left, lag = left[order], lag[order]
        furthest: dict[int, int] = {}
        i = 0
        while i < len(left):
            at, q = int(left[i]), int(lag[i])
            if at + k <= furthest.get(q, -1):
                stop = int(np.searchsorted(lag, q, "right"))
                i += int(np.searchsorted(left[i:stop], furthest[q] - k, "right"))
                continue
            doc = int(owner[at])
            begin, end = _reach(words, at, q, int(bounds[doc]), int(bounds[doc + 1]), k)
            furthest[q] = end
            if end - begin + q >= max(LEAST, TIMES * q):
                out.append((doc, begin - int(bounds[doc]), end - begin + q, q))
        # Grams three times as long, from three in a row.
        double, left, _ = _grams(grams, k, grams, owner)
        if not left.size:
            break
        grams, left, right = _grams(double, 2 * k, grams, owner)
        k *= 3
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _tightest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """Periodic runs of each text, and the text with each run cut down to its first period.

    A run is a stretch of words with smallest period q, at least 6 words and 4 periods
    long, that no neighbouring word extends. A word goes if some run holds it after that
    run's first q words. Words are runs of characters other than ASCII white space.

    Returns doc_id, n_runs, start, length, period and exponent_milli of the tightest run
    (null without runs), runs_sha256 over the lines `start,length,period`, collapsed_sha256
    and, with `outputs`, runs (array of start, length, period) and collapsed. Null text:
    the empty text. Repeated rows give repeated results. Empty input: no rows. Other
    columns are not carried. Short texts are searched together, a very long one by itself
    in time n log n; it takes about 100 bytes a word in its task beside the text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vocabulary: dict[bytes, int] = {}
            ids, texts, total = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                numbers = word_numbers((text or "").encode("utf-8"), vocabulary)
                if texts and total + len(numbers) > BATCH:
                    yield _results(ids, texts, list(vocabulary), names)
                    ids, texts, total = [], [], 0
                ids.append(doc_id)
                texts.append(numbers)
                total += len(numbers)
                if len(vocabulary) > BATCH:  # words are held for a bounded number of texts only
                    yield _results(ids, texts, list(vocabulary), names)
                    vocabulary, ids, texts, total = {}, [], [], 0
            if texts:
                yield _results(ids, texts, list(vocabulary), names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + (["runs", "collapsed"] if outputs else [])
    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if outputs:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return narrow.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def _results(ids: list, texts: list[np.ndarray], spelled: list[bytes], names: list[str]) -> pd.DataFrame:
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for doc, *one in find_runs(np.concatenate(texts), bounds):
        found.setdefault(doc, []).append(tuple(one))
    rows = []
    for i, (doc_id, numbers) in enumerate(zip(ids, texts, strict=True)):
        runs = found.get(i, [])
        if runs:
            depth = np.zeros(len(numbers) + 1, np.int32)
            for start, length, period in runs:
                depth[start + period] += 1
                depth[start + length] -= 1
            numbers = numbers[np.cumsum(depth)[:-1] == 0]
        collapsed = b" ".join([spelled[w] for w in numbers.tolist()])
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        best = _tightest(runs)
        tight = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        row = (doc_id, len(runs), *tight, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed).hexdigest())
        if len(names) > len(row):
            row += ([{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed.decode("utf-8"))
        rows.append(row)
    out = pd.DataFrame(rows, columns=names)
    return out.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")})
