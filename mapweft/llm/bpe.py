"""BPE encoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
CHUNK_BYTES = 1024  # mean length of a chunk
LEAST_CHUNK, MOST_CHUNK = 256, 8192
# Memory of one generation of each table; a process, which may serve other stages after this one, holds two of both.
WORD_BYTES = 20 << 20
CHUNK_TABLE_BYTES = 4 << 20
ENTRY = 200  # bytes that an entry takes beside its own
SEEN = 1 << 15  # hashes of chunks met once
MARKS = b".,;:!?"
PUT_OFF = 50_000  # words that wait to be looked up together
SPACE = re.compile(rb"[\x20\x09-\x0d]")
SPACES = tuple(bytes([b]) for b in (9, 10, 11, 12, 13, 32))

_encoders: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_ends(data: bytes, mean: int = CHUNK_BYTES, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> list[int]:
    """Where content-defined chunks end: a hash of the 16 bytes before the cut decides it.

    No chunk is shorter than `least`, but for the last, or longer than `most`.
    """
    n = len(data)
    if n <= max(least, 16):
        return [n]
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    rolled = words[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0x94D049BB133111EB)
    ends, at = [], 0
    for end in [*(np.flatnonzero((rolled >> np.uint64(32)) % np.uint64(mean) == 0) + 16).tolist(), n]:
        while end - at > most:
            at += most
            ends.append(at)
        if end - at >= least or end == n > at:
            ends.append(end)
            at = end
    return ends


class Table:
    """What was met before, in two generations of bounded bytes.

    When the younger one is full it becomes the older, and that one is forgotten: what is
    met often is found in the older one in time and moves on, so it stays for good. Turning
    over is left to the caller, so that nothing is lost between two uses.
    """

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def find(self, key: bytes):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.keep(key, value)
        return value

    def keep(self, key: bytes, value) -> None:
        self.size += ENTRY + len(key) + (len(value) if isinstance(value, bytes) else sum(map(len, value)))
        self.young[key] = value

    def turn(self) -> None:
        """Make room if the younger generation is full."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0


class Encoder:
    """Encodes byte strings; words and chunks met before are looked up.

    ASCII white space separates what the vocabulary's rules see, so the ids of a text are
    the ids of its words in a row. A chunk keeps the ids of the words that lie whole
    inside it, and apart from them the broken words at its two ends. Where two chunks
    meet, the broken halves are put together and encoded anew; a chunk without white
    space joins the word that is still open, so the repair goes on to the next chunk
    until a white space is met. From there on both sides agree exactly. A chunk is kept
    once a second document, or place, has it. Both tables are bounded in bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        # Without a decoder the decoded text is the tokens with blanks between.
        self.shown = None if self.tokenizer.decoder is not None else [b" " + (n or "").encode() for n in names]
        self.alike = self._parts_alike()
        self.words = Table(WORD_BYTES)
        self.chunks = Table(CHUNK_TABLE_BYTES)
        self.seen: set[int] = set()

    def _parts_alike(self) -> bool:
        """Whether case and the marks after a word make no difference to the ids of the word itself."""
        ids = lambda *texts: [i for t in texts for i in self.tokenizer.encode(t, add_special_tokens=False).ids]
        bases = ("a", "The", "WORD", "x9", "7Up", "nation")
        return all(ids(b) == ids(b.lower()) and all(ids(b + m) == ids(b, m) for m in (".", ",", ";", ":", "!?", "...")) for b in bases)

    def _learn(self, words: list[bytes]) -> None:
        """Encode words and keep their ids.

        An ASCII word with capitals or marks after it is put together from the ids of the
        plain word and of the marks, if the vocabulary's rules part them.
        """
        made = {}
        plain = dict.fromkeys(words)
        if self.alike:
            for word in words:
                base = word.rstrip(MARKS)
                if base.isalnum() and (len(base) < len(word) or base != base.lower()):
                    made[word] = (base.lower(), word[len(base) :])
                    del plain[word]
            for base, marks in made.values():
                plain.setdefault(base)
                if marks:
                    plain.setdefault(marks)
        new = [w for w in plain if self.words.find(w) is None]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for word, one in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False), strict=True):
                self.words.keep(word, array("I", one.ids).tobytes())
        known = self.words.young
        for word, (base, marks) in made.items():
            self.words.keep(word, known[base] + known[marks] if marks else known[base])

    def _settle(self, waiting: list[tuple]) -> None:
        """Fill in the ids of words that were put off, after learning the unknown ones together."""
        self.words.turn()
        self.chunks.turn()
        unknown: set[bytes] = set()
        for _, _, words, _ in waiting:
            unknown.update(filterfalse(self.words.young.__contains__, words))
        self._learn([w for w in unknown if self.words.find(w) is None])
        get = self.words.young.__getitem__
        for parts, at, words, kept in waiting:
            parts[at] = b"".join(map(get, words))
            if kept:
                chunk, head, tail = kept
                self.chunks.keep(chunk, (head, parts[at], tail))
        waiting.clear()

    def _again(self, chunk: bytes) -> bool:
        """Whether a chunk has been met before; it is remembered by its hash."""
        mark = hash(chunk)
        if mark in self.seen:
            return True
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(mark)
        return False

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, 4 bytes each."""
        waiting: list[tuple] = []
        made, put_off = [], 0
        for data in texts:
            parts: list[bytes] = []
            made.append(parts)
            open_word, start = [], 0
            for end in chunk_ends(data):
                chunk = data[start:end]
                start = end
                known = self.chunks.find(chunk)
                if known is None:
                    found = SPACE.search(chunk)
                    if found is None:
                        open_word.append(chunk)
                        continue
                    first, last = found.start(), max(chunk.rfind(s) for s in SPACES)
                    head, tail, words = chunk[:first], chunk[last + 1 :], chunk[first:last].split()
                else:
                    head, ids, tail = known
                open_word.append(head)
                repaired = b"".join(open_word)
                if repaired:
                    waiting.append((parts, len(parts), [repaired], None))
                    parts.append(b"")
                if known is None:
                    waiting.append((parts, len(parts), words, (chunk, head, tail) if self._again(chunk) else None))
                    put_off += len(words)
                parts.append(b"" if known is None else ids)
                open_word = [tail]
                if put_off > PUT_OFF:
                    self._settle(waiting)
                    put_off = 0
            repaired = b"".join(open_word)
            if repaired:
                waiting.append((parts, len(parts), [repaired], None))
                parts.append(b"")
        self._settle(waiting)
        return [b"".join(parts) for parts in made]

    def encode(self, data: bytes) -> bytes:
        """Ids of a text, 4 bytes each."""
        return self.encode_many([data])[0]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in a row, as the tokenizer decodes them."""
        numbers = array("I", ids).tolist()
        if self.shown is None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False).encode() if numbers else b""
        return b"".join(map(self.shown.__getitem__, numbers))[1:]


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True,
) -> DataFrame:
    """Ids of every text and the text decoded from them.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with `outputs`, ids (array of
    int) and decoded. The two digests are taken over ids as little-endian 32-bit integers
    and over the decoded UTF-8. Nothing is shuffled: a process keeps the words and chunks
    it has met in two bounded tables, for all texts of all its tasks.

    Null text: encoded as the empty text (no ids). Repeated rows give repeated results.
    Very long texts go chunk by chunk; a chunk has 8,192 bytes at most, a word may be as
    long as its text. A task holds a text, its ids and its decoded text. Empty input: no
    rows. Other columns are not carried.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 256):  # words new to the table are learnt together
                part = batch.iloc[at : at + 256]
                rows = []
                for doc_id, ids in zip(part["doc_id"], encoder.encode_many([(text or "").encode("utf-8") for text in part["text"]]), strict=True):
                    shown = encoder.decode(ids)
                    row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown).hexdigest())
                    rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int32), shown.decode()) if outputs else row)
                yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if outputs else [])
    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = narrow.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if outputs else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
