"""Texts packed into blocks, and keys that several documents share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.session import cut

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 1 << 18
KEY_BYTES = 6
NO_ID = np.iinfo(np.int64).max  # stands for a null id, after all others
SCHEMA = "block long, ids binary, no_id binary, ends binary, body binary, sample binary"


@dataclass
class Block:
    """Texts of some documents, as bytes in a row."""

    block: int
    ids: np.ndarray
    no_id: np.ndarray
    ends: np.ndarray
    data: bytes

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else self.ends


def unpack(row) -> Block:
    ids = np.frombuffer(row.ids, np.int64)
    return Block(row.block, ids, np.frombuffer(row.no_id, bool), np.frombuffer(row.ends, np.int64), zstandard.decompress(row.body))


def pack(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole texts, compressed, in reliable storage.

    Later steps refer to a document as a place in its block, so blocks are written once
    and never made again. Each carries the first 8 bytes at 64 places, a sample from
    which ranges are cut. Null texts are empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 20
        ids, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                data = (text or "").encode("utf-8")
                if ids and (size + len(data) > block_bytes or len(ids) >= BLOCK_ROWS):
                    yield _packed(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(key)
                texts.append(data)
                size += len(data)
        if ids:
            yield _packed(number, ids, texts)

    narrow = docs.select(F.col(id_col).cast("long").cast("string").alias("key"), F.col(text_col).alias("text"))
    return cut(narrow.mapInPandas(run, SCHEMA))


def _packed(number: int, ids: list, texts: list[bytes]) -> pd.DataFrame:
    data = b"".join(texts)
    at = (np.arange(64) * max(len(data) - 8, 1)) // 64
    sample = b"".join(data[a : a + 8].ljust(8, b"\0") for a in at)
    return pd.DataFrame({
        "block": [number],
        "ids": [np.array([NO_ID if i is None else int(i) for i in ids], np.int64).tobytes()],
        "no_id": [np.array([i is None for i in ids], bool).tobytes()],
        "ends": [np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes()],
        "body": [zstandard.compress(data, 3)], "sample": [sample],
    })


def buckets_of(spark) -> int:
    """Key buckets: a few for each shuffle partition, so they spread evenly."""
    return 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_keys(blocks: DataFrame, keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """How common each key of each block is in all blocks.

    `keys_of` gives a block's distinct keys (sorted, below 2^47) and whether several of
    its documents have them. Only 6 bytes a key are sent; the answer is a byte a key:
    0 for a key of one document, else the logarithm of about how many have it. Keys are
    hashes, so an answer can be too high, never too low. Returns (block, marks) with the
    answers in the order of the keys, one row a block.
    """
    n = buckets_of(blocks.sparkSession)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                keys, several = keys_of(unpack(row))
                if not len(keys):
                    continue
                bucket = _bucket(keys, n)
                packed = (keys << np.uint64(1) | several.astype(np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                stops = np.append(edges[1:], len(keys))
                yield pd.DataFrame({"bucket": bucket[edges], "block": row.block, "keys": [packed[a:b].tobytes() for a, b in zip(edges, stops, strict=True)]})

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(k) // KEY_BYTES for k in rows["keys"]])
        wide = np.zeros((sizes.sum(), 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(b"".join(rows["keys"]), np.uint8).reshape(-1, KEY_BYTES)
        both = wide.view("<u8").ravel()
        keys, weight = both >> np.uint64(1), 1 + (both & np.uint64(1)).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] + np.uint64(1)))
        total = np.add.reduceat(weight[order], first)
        grade = np.empty(len(keys), np.uint8)
        grade[order] = np.repeat(np.floor(np.log2(total)).astype(np.uint8), np.diff(np.append(first, len(keys))))
        stops = np.cumsum(sizes)
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "part": [zstandard.compress(grade[b - s : b].tobytes()) for b, s in zip(stops, sizes, strict=True)]})

    told = blocks.mapInPandas(send, "bucket int, block long, keys binary").groupBy("bucket").applyInPandas(tell, "block long, bucket int, part binary")
    return told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "part"))).alias("marks"))


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of keys: sorted keys stay in order across them."""
    return ((keys >> np.uint64(17)) * np.uint64(n) >> np.uint64(30)).astype(np.int64)


def read_marks(marks) -> np.ndarray:
    """The answers for a block's keys."""
    parts = [zstandard.decompress(m["part"]) for m in marks] if marks is not None else []
    return np.frombuffer(b"".join(parts), np.uint8)


def distinct_keys(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether several documents have each, and each entry's place among them."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    first = np.flatnonzero(np.diff(k, prepend=k[:1] + np.uint64(1))) if len(k) else np.zeros(0, np.int64)
    if not len(first):
        return keys, np.zeros(0, bool), np.zeros(0, np.int64)
    several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    place = np.empty(len(k), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
    return k[first], several, place
