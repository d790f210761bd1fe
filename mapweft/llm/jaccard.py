"""Set-similarity join of documents on word shingles, by rare-first prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.llm.blocks import Block, buckets_of, distinct_keys, pack, read_marks, shared_keys, unpack
from mapweft.llm.components import components
from mapweft.session import cut

WORDS = 5
ROW_BITS = 18  # a document's number in its block
SAMPLE = np.uint64(3)  # of large sets, every third shingle is counted over all documents
LARGE = 200  # members from which a set is large
TOGETHER = 4096  # lists of at most so many members go to the task of their least member's hash
SKETCH_BITS = 4096  # of the widest sketch; wider ones would only make the filter sharper
SMALL_TOKENS = np.uint64(0xA5A5F00D12345678)  # parts the tokens of small sets from those of large ones
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(7)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_VALUES = _random.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0xD1342543DE82EF95)
POSTING = np.dtype([("token", "<u8"), ("uid", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (A-Z lower-cased) and the document it stands in."""
    data = np.frombuffer(block.data.lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = block.starts[block.starts < block.ends]
    begins[starts] = ~space[starts]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(rows.max()), BASE, np.uint64))]) if rows.max() else np.ones(1, np.uint64)
    value = BYTE_VALUES[data[at[0] :]] * powers[rows]
    value[space[at[0] :]] = 0
    return _mix(np.add.reduceat(value, at - at[0])), np.searchsorted(block.ends, at, "right")


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, one document after another; sizes."""
    words, owner = word_hashes(block)
    count = np.bincount(owner, minlength=len(block.ids)) if len(owner) else np.zeros(len(block.ids), np.int64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(count) else count
    mixed = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        mixed += words[k : k + len(mixed)] * PLACE_VALUES[k]
    mixed = _mix(mixed)
    sets, sizes = [], np.zeros(len(block.ids), np.int64)
    for d, (a, n) in enumerate(zip(first, count, strict=True)):
        if not n:
            continue
        if n >= WORDS:
            own = np.unique(mixed[a : a + n - WORDS + 1])
        else:  # the whole sequence as one
            parts = np.append(words[a : a + n], np.uint64(n)) * np.append(PLACE_VALUES[:n], PLACE_VALUES[WORDS])
            own = _mix(parts.sum(dtype=np.uint64, keepdims=True))
        sets.append(own)
        sizes[d] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def _views(hashes: np.ndarray, sizes: np.ndarray, percent: int):
    """Tokens of the small and of the large sets: (token, document, counted) of each view.

    In a small set every member is counted, in a large one every third. A set whose
    size is near the limit is in both views, under different tokens; similar sets are
    therefore in one view together, and a view has one order for all its sets.
    """
    docs = np.repeat(np.arange(len(sizes)), sizes)
    of = sizes[docs]
    small, large = of <= LARGE * 100 // percent, of >= LARGE
    yield _mix(hashes[small] ^ SMALL_TOKENS), docs[small], np.ones(int(small.sum()), bool)
    yield hashes[large], docs[large], hashes[large] % SAMPLE == 0


def _counted(views: list):
    """Counted tokens of a block: distinct keys, whether several documents have them, each one's place."""
    keys = np.concatenate([t[c] for t, _, c in views]) >> np.uint64(17)
    return distinct_keys(keys, np.concatenate([d[c] for _, d, c in views]))


def _keys_of(percent: int):
    def run(block: Block) -> tuple[np.ndarray, np.ndarray]:
        keys, several, _ = _counted(list(_views(*shingle_sets(block), percent)))
        return keys, several

    return run


def prefix_size(n: np.ndarray | int, percent: int):
    """How many of the rarest members of a set of n must hold one of any similar set."""
    return n - -(-percent * n // 100) + 1


def sketch(hashes: np.ndarray) -> bytes:
    """One bit for each remainder of the hashes: whether an odd number of members has it.

    The bits in which two sketches differ are at most the members that one set alone has.
    A sketch of half the width is the exclusive or of the two halves.
    """
    bits = min(SKETCH_BITS, max(64, 1 << int(2 * len(hashes) - 1).bit_length()))
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of the sets of a list, by ascending size, folded to a width when one asks for it."""

    def __init__(self, packed: list[bytes]):
        self.words = [np.frombuffer(p, np.uint64) for p in packed]
        self.folded: dict[int, np.ndarray] = {}

    def _at(self, width: int) -> np.ndarray:
        if width not in self.folded:
            out = np.zeros((len(self.words), width), np.uint64)
            for i, w in enumerate(self.words):
                if len(w) >= width:
                    out[i] = np.bitwise_xor.reduce(w.reshape(-1, width), axis=0)
            self.folded[width] = out
        return self.folded[width]

    def differ(self, i: int, others: np.ndarray) -> np.ndarray:
        """At least so many members stand in one set alone, for set i and each of some sets not smaller."""
        own = self._at(len(self.words[i]))
        return np.bitwise_count(own[others] ^ own[i]).sum(axis=1, dtype=np.int64)


def _describe(percent: int, buckets: int):
    """Per block: postings of the prefixes, the sets that have any, and a row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block = unpack(row)
                hashes, sizes = shingle_sets(block)
                views = list(_views(hashes, sizes, percent))
                _, _, place = _counted(views)
                grades = read_marks(row.marks)[place] if len(place) else np.zeros(0, np.uint8)
                out, postings, with_postings, starts = [], [], set(), block.starts
                seen: dict[bytes, int] = {}
                ends = np.cumsum(sizes)
                for d, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
                    uid = row.block << ROW_BITS | d
                    rep = seen.setdefault(hashes[end - n : end].tobytes(), uid) if n else uid
                    text = block.data[int(starts[d]) : int(block.ends[d])]
                    out.append((2, -1, uid, n, rep, int(block.ids[d]), int.from_bytes(xxhash.xxh64_digest(text, 42), "big", signed=True), None, None))
                    with_postings |= {d} if n and rep == uid else set()
                done = 0
                for tokens, docs, counted in views:
                    # The order of a view: counted tokens by how common they are, then the others.
                    rank = np.full(len(tokens), 255, np.uint8)
                    rank[counted] = grades[done : done + int(counted.sum())]
                    done += int(counted.sum())
                    edges = np.append(np.flatnonzero(np.diff(docs, prepend=-1)), len(docs)).tolist()
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        d = int(docs[a])
                        if d not in with_postings:
                            continue
                        own, own_rank = tokens[a:b], rank[a:b]
                        order = np.lexsort((own, own_rank))[: prefix_size(b - a, percent)]
                        pos = np.flatnonzero(own_rank[order] > 0)  # rank 0: no other document has it
                        if pos.size:
                            entry = np.zeros(pos.size, POSTING)
                            entry["token"], entry["uid"], entry["n"], entry["pos"] = own[order[pos]], row.block << ROW_BITS | d, b - a, pos
                            postings.append(entry)
                for d in sorted({int(e["uid"][0]) & ((1 << ROW_BITS) - 1) for e in postings}):
                    own = hashes[ends[d] - sizes[d] : ends[d]]
                    out.append((1, -1, row.block << ROW_BITS | d, len(own), 0, 0, 0, (own >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), sketch(own)))
                if postings:
                    entry = np.concatenate(postings)
                    entry = entry[np.argsort(entry["token"], kind="stable")]
                    bucket = ((entry["token"] >> np.uint64(34)) * np.uint64(buckets) >> np.uint64(30)).astype(np.int64)
                    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                    for a, b in zip(edges, np.append(edges[1:], len(entry)), strict=True):
                        out.append((0, int(bucket[a]), 0, 0, 0, 0, 0, zstandard.compress(entry[a:b].tobytes(), 1), None))
                yield pd.DataFrame(out, columns=["kind", "bucket", "uid", "n", "rep", "doc_id", "text_key", "payload", "sketch"])

    return run


def _lists(payloads) -> np.ndarray:
    """Postings of a bucket whose token several documents have, by token, then size."""
    entry = np.frombuffer(b"".join(zstandard.decompress(p) for p in payloads), POSTING)
    entry = entry[np.lexsort((entry["uid"], entry["n"], entry["token"]))]
    same = entry["token"][1:] == entry["token"][:-1]
    return entry[np.append(same, False) | np.insert(same, 0, False)] if len(entry) else entry


def _able(nx, ny, px, py, percent: int):
    """Length and positional filters on a common token at places px and py."""
    need = -(-percent * (nx + ny) // (100 + percent))
    return (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (1 + np.minimum(nx - px, ny - py) - 1 >= need)


def _neighbours(percent: int):
    """Pairs of documents that follow each other, by size, in the list of a token."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        e = _lists(rows["payload"])
        x, y = e[:-1], e[1:]
        ok = (x["token"] == y["token"]) & (x["uid"] != y["uid"]) & _able(x["n"], y["n"], x["pos"], y["pos"], percent)
        return pd.DataFrame({"u": np.minimum(x["uid"], y["uid"])[ok], "v": np.maximum(x["uid"], y["uid"])[ok]}).drop_duplicates()

    return run


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    """The lists of a bucket, each named by a hash of its members.

    The tokens of a passage mostly have the same documents; under one name they become one list.
    """
    e = _lists(rows["payload"])
    if not len(e):
        return pd.DataFrame({"list": e["uid"], "uid": e["uid"], "n": e["n"], "pos": e["pos"]})
    edges = np.flatnonzero(np.diff(e["token"], prepend=e["token"][:1] + np.uint64(1)))
    sizes = np.diff(np.append(edges, len(e)))
    name = _mix(np.add.reduceat(_mix(e["uid"].view(np.uint64) * BASE), edges) + sizes.astype(np.uint64))
    return pd.DataFrame({"list": np.repeat(name, sizes).view(np.int64), "uid": e["uid"], "n": e["n"], "pos": e["pos"]})


def _borders(percent: int, draw: int):
    """Pairs next to each other in a token's list that are not connected yet.

    Equal sizes stand in an order drawn for each token, so two groups that share many
    tokens are tried at many pairs, and one that is similar connects them.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        token, uid = rows["token"].to_numpy(), rows["uid"].to_numpy()
        drawn = _mix(token.view(np.uint64) ^ (uid.view(np.uint64) + np.uint64(draw)) * BASE)
        rows = rows.iloc[np.lexsort((drawn, rows["n"].to_numpy(), token))]
        x, y = rows.iloc[:-1].reset_index(drop=True), rows.iloc[1:].reset_index(drop=True)
        ok = (x["token"] == y["token"]) & (x["label"] != y["label"]) & _able(x["n"], y["n"], x["pos"], y["pos"], percent)
        return pd.DataFrame({"u": np.minimum(x["uid"], y["uid"])[ok], "v": np.maximum(x["uid"], y["uid"])[ok]}).drop_duplicates()

    return run


def _across(percent: int):
    """Pairs of a token's list whose documents are not connected yet and whose sketches allow it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["token", "n", "uid"], kind="stable")
        token, label = rows["token"].to_numpy(), rows["label"].to_numpy()
        uid, n, pos = rows["uid"].to_numpy(), rows["n"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64)
        packed = rows["sketch"].tolist()
        edges = np.append(np.flatnonzero(np.diff(token, prepend=token[:1] - 1)), len(token))
        found = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if (label[a:b] == label[a]).all():
                continue
            sketches = Sketches(packed[a:b])
            for i in range(a, b - 1):  # sizes ascend, so the partners of i are a stretch
                j = np.arange(i + 1, a + np.searchsorted(n[a:b], n[i] * 100 // percent, "right"))
                j = j[(label[j] != label[i]) & _able(n[i], n[j], pos[i], pos[j], percent)]
                if j.size:  # the members that one of them may have alone
                    most = n[i] + n[j] - 2 * -(-percent * (n[i] + n[j]) // (100 + percent))
                    j = j[sketches.differ(i - a, j - a) <= most]
                if j.size:
                    found.append(np.column_stack([np.full(j.size, uid[i]), uid[j]]))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def suffix_able(x: np.ndarray, y: np.ndarray, need: int, depth: int = 3) -> bool:
    """Whether two sorted sets can share `need` members, from where probes of one fall in the other."""
    if min(len(x), len(y)) < need:
        return False
    if not depth or not len(x) or not len(y):
        return True
    probe = y[len(y) // 2]
    a, b = int(np.searchsorted(x, probe)), len(y) // 2
    left, right = min(a, b), min(len(x) - a, len(y) - b)
    if left + right < need:
        return False
    return suffix_able(x[:a], y[:b], need - right, depth - 1) and suffix_able(x[a:], y[b:], need - left, depth - 1)


def _verify(percent: int):
    def wide(packed: bytes) -> np.ndarray:
        out = np.zeros((len(packed) // 6, 8), np.uint8)
        out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
        return out.view("<u8").ravel()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (a, b) in enumerate(zip(batch["left"], batch["right"], strict=True)):
                x, y = wide(a), wide(b)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if suffix_able(x, y, need):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.loc[keep, ["u", "v"]]

    return run


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar; each pair is looked at once."""
    left, right = sets.select(F.col("uid").alias("u"), F.col("payload").alias("left")), sets.select(F.col("uid").alias("v"), F.col("payload").alias("right"))
    return cut(pairs.distinct().join(left, "u").join(right, "v").select("u", "v", "left", "right").mapInPandas(_verify(percent), "u long, v long"))


def similar_documents(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least `percent` / 100.

    A document's set is its distinct shingles of five words. The members of a set are
    ordered by how many documents have them, the rarest first; two similar sets share a
    member of both prefixes. It is counted over all documents (6 bytes a member to its
    bucket, one byte back), in large sets for every third member; the others come last,
    which keeps the order the same everywhere. A prefix member that one document alone
    has is not sent at all.

    First only documents next to each other in a token's list are compared, which
    connects groups of copies at the cost of their size; two more such rounds try the
    borders between groups. Then the lists are read again: every pair that shares a prefix
    token, passes the length and positional filters, whose parity sketches do not differ in
    more bits than similar sets may have members apart, and that is not connected yet is
    verified. Lists that share most members mostly meet in one task, which names a pair once.
    The sketch, too, drops only pairs that cannot be similar. So no link between different groups is lost, and
    the pairs inside a connected group are never listed.

    Returns doc_id, n_shingles, component_id (smallest id in reach, or its own), kept (the
    first row of the group) and text_key (xxhash64 of the text, to tell rows of one id
    apart). Null or empty texts have the empty set and no links.
    Repeated rows are documents of their own and similar. A null id counts as larger than
    all others. Empty input: no rows. Other columns are not carried. A text is held whole,
    with some 50 to 100 bytes for each of its bytes, in the task of its block. Members are
    compared as the first 48 bits of their hashes: two texts of a million shingles each
    take one false member for common with odds of about 1 in 300.
    """
    spark = docs.sparkSession
    buckets = buckets_of(spark)
    blocks = pack(docs, id_col, text_col)
    marked = blocks.join(shared_keys(blocks, _keys_of(percent)), "block", "left")
    table = cut(marked.mapInPandas(_describe(percent, buckets), "kind int, bucket int, uid long, n int, rep long, doc_id long, text_key long, payload binary, sketch binary"))
    postings, sets = table.where("kind = 0").select("bucket", "payload"), table.where("kind = 1").select("uid", "payload")
    near = _checked(postings.groupBy("bucket").applyInPandas(_neighbours(percent), "u long, v long"), sets, percent)
    labels = components(near, "u", "v")
    entries = postings.groupBy("bucket").applyInPandas(_entries, "list long, uid long, n int, pos int")
    # A document's first place in any of the lists of one name: the filters stay safe.
    entries = entries.groupBy(F.col("list").alias("token"), "uid", "n").agg(F.min("pos").alias("pos"))
    entries = cut(entries)
    links = near
    last = _across(percent)
    for step in (_borders(percent, 1), _borders(percent, 2), last):
        labelled = entries.join(labels.withColumnRenamed("id", "uid"), "uid", "left").withColumn("label", F.coalesce("component", "uid")).drop("component")
        lists = labelled.groupBy("token").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.min(F.xxhash64("uid")).alias("least")
        ).where("low <> high")  # the others have nothing left to connect
        home = F.when(F.col("members") <= TOGETHER, F.col("least")).otherwise(F.col("token"))
        dealt = labelled.join(lists.select("token", F.pmod(home, F.lit(buckets)).cast("int").alias("bucket")), "token")
        dealt = dealt.join(table.where("kind = 1").select("uid", "sketch"), "uid") if step is last else dealt
        more = _checked(dealt.groupBy("bucket").applyInPandas(step, "u long, v long"), sets, percent)
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links, "u", "v")
    rows = table.where("kind = 2").select("uid", "doc_id", "text_key", "n", "rep")
    placed = cut(rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("uid", "doc_id", "text_key", "n", "component"))
    lowest = cut(placed.groupBy("component").agg(F.min(F.struct("doc_id", "uid")).alias("low")))
    no_id = F.lit(int(np.iinfo(np.int64).max))
    return placed.join(lowest, "component").select(
        F.nullif("doc_id", no_id).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.nullif(F.col("low.doc_id"), no_id).alias("component_id"), (F.col("low.uid") == F.col("uid")).alias("kept"), "text_key",
    )
