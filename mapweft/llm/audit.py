"""Filter interaction audit: counts of joint failures as a tensor, contracted for every order of the filters."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.session import cut

CAPITALS = bytes(range(65, 91))
SYMBOLS = re.compile(r"[#$%&*|]")
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def few_words(text: str, data: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def repeated_words(text: str, data: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def many_capitals(text: str, data: bytes, words: list[bytes]) -> bool:
    return 100 * (len(data) - len(data.translate(None, CAPITALS))) > 2 * len(text)


def odd_symbols(text: str, data: bytes, words: list[bytes]) -> bool:
    return SYMBOLS.search(text) is not None


# What makes a text fail; the letters are the axes of the tensor, in this order.
FILTERS: dict[str, Callable[[str, bytes, list[bytes]], bool]] = {"A": few_words, "B": repeated_words, "C": many_capitals, "D": odd_symbols}
COPY = "E"  # the axis of texts that a document with a smaller id has


def joint_failures(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Callable] | None = None,
    id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """(part, cell, n, good, toxic): documents of a part by the set of filters they fail.

    Bit i of a cell is set when the document fails filter i; the last bit marks copies.
    Texts are read once and leave their task as a digest and a few bits, so what is
    shuffled does not grow with their length. Equal texts fail the same filters, so a
    group of copies is counted by part and label before its smallest id is looked up:
    a text that a third of all documents share meets as one row for each part and label.

    Null text: the empty text. Null part: the empty string. Words are runs of characters
    other than ASCII white space. Rows with a null id are no copies, have no copies and
    no labels. Repeated rows count one by one; a copy needs a strictly smaller id. With
    several label rows a document is good, or toxic, if one of them says so. Labels of
    unknown documents are ignored. A text is held whole, twice, in its task.
    """
    filters = FILTERS if filters is None else filters

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells, keys = [], []
            for text in batch["text"]:
                data = text.encode("utf-8")
                words = data.split()
                cells.append(sum(fails(text, data, words) << i for i, fails in enumerate(filters.values())))
                keys.append(hashlib.sha256(data).digest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "part": batch["part"], "key": keys, "cell": cells})

    empty = F.lit("")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), empty).alias("part"), F.coalesce(F.col(text_col), empty).alias("text"))
    seen = texts.mapInPandas(look, "doc_id long, part string, key binary, cell int")
    rows = seen.groupBy("doc_id", "part", "key", "cell").agg(F.count(F.lit(1)).alias("n"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    marked = rows.join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    # Rows of one id are unique in a group, so the count beside the smallest id is that of its first document.
    groups = cut(marked.groupBy("key", "cell", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    ))
    first = groups.groupBy("key").agg(F.min("low").alias("first"))
    fresh = F.col("n_null") + F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(F.lit(0))
    split = groups.join(first, "key").withColumn("fresh", fresh).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("cell"), F.col("fresh").alias("n")),
            F.struct((F.col("cell") + F.lit(1 << len(filters))).alias("cell"), (F.col("n") - F.col("fresh")).alias("n")),
        )).alias("c"),
    )
    return split.groupBy("part", F.col("c.cell").alias("cell")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic")
    )


def selectors(letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Every (order, step), and for each measure what it selects along each axis there.

    A selector is an array (steps of all orders, axis, 2): pass, fail or all.
    """
    n = len(letters)
    steps, made = [], {name: [] for name in ("kept", "removed", "fails", "alone")}
    for order in itertools.permutations(range(n)):
        name = "".join(letters[i] for i in order)
        for at, own in enumerate(order):
            steps.append((name, at + 1))
            before = set(order[:at])
            made["kept"].append([PASS if i in before or i == own else ALL for i in range(n)])
            made["removed"].append([FAIL if i == own else PASS if i in before else ALL for i in range(n)])
            made["fails"].append([FAIL if i == own else ALL for i in range(n)])
            made["alone"].append([FAIL if i == own else PASS for i in range(n)])
    return steps, {k: np.array(v, np.int64) for k, v in made.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums of a tensor (parts, 2, 2, ...) under each selector: an array (parts, steps)."""
    n = tensor.ndim - 1
    terms = [tensor, list(range(n + 1))]
    for axis in range(n):
        terms += [chosen[:, axis, :], [n + 1, axis + 1]]
    return np.einsum(*terms, [0, n + 1], optimize="greedy")


def audit_filters(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Callable] | None = None, copy: str = COPY,
    id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """What each filter removes at each step of every order of the filters, by part.

    One pass over the texts gives each part's counts of joint failures; reshaped to a
    tensor with an axis of (pass, fail) for each filter, they answer every order by
    contraction, without reading the documents again. A part has 2^filters counts and
    its rows are made part by part, wherever the parts lie.

    Returns part, filter_order, step (from 1) and the long columns kept, removed,
    redundant (fails here, removed earlier), unique_fails (fails this filter only),
    good_lost, toxic_lost (removed here) and shapley (removed by this step's filter,
    summed over all orders). Empty input: no parts, no rows. Nulls, repeated rows and
    other columns: see `joint_failures`.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join(filters) + copy
    n = len(letters)
    cells = joint_failures(docs, labels, filters, id_col, text_col, part_col)
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def every_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, chosen = selectors(letters)
        orders, numbers = [s[0] for s in steps], np.array([s[1] for s in steps], np.int32)
        own = np.array([[order[step - 1] == c for c in letters] for order, step in steps], np.int64)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                flat = np.zeros((3, len(part), 2**n), np.int64)
                for i, row in enumerate(part["cells"]):
                    for c in row:
                        flat[:, i, c["cell"]] = c["n"], c["good"], c["toxic"]
                # The highest bit of a cell is the first axis of the reshaped array; turn the axes around.
                tensors = flat.reshape(3, len(part), *[2] * n).transpose(0, 1, *range(n + 1, 1, -1))
                removed = contract(tensors[0], chosen["removed"])
                out = {
                    "kept": contract(tensors[0], chosen["kept"]), "removed": removed,
                    "redundant": contract(tensors[0], chosen["fails"]) - removed, "unique_fails": contract(tensors[0], chosen["alone"]),
                    "good_lost": contract(tensors[1], chosen["removed"]), "toxic_lost": contract(tensors[2], chosen["removed"]),
                    "shapley": np.einsum("pk,kf,jf->pj", removed, own, own, optimize="greedy"),
                }
                yield pd.DataFrame({
                    "part": np.repeat(part["part"].to_numpy(object), len(steps)), "filter_order": orders * len(part), "step": np.tile(numbers, len(part)),
                    **{m: out[m].ravel() for m in measures},
                })

    return packed.mapInPandas(every_order, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in measures))
