"""Filling windows of fixed length with texts, hierarchically.

Texts are measured in tokens and routed to tiers of context length. A longer text is divided; its full pieces are windows of their own. The others
are spread at random over groups of bounded size. In a group each tier, from the longest down, fills the gaps that longer contexts left (the
tightest that fits) before it opens contexts of its own length. Contexts are then combined to sequences, whose last gaps the shortest tier fills.
So short texts are attended to within short contexts, and little room stays unused. Sequences are dealt to training steps of equal cost.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

WINDOW = 2048
TIERS = (128, 256, 512, 1024, 2048)  # context lengths; the last is the window
GROUP = 40_000  # pieces that are packed together: some 2000 windows, of which the last may stay half empty
STEP = 64  # windows of a training step
TOKENIZER = os.environ.get("MILLRACE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str = TOKENIZER):
    """The public tokenizer whose ranks lie at path."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of the whole text; null texts have none. The vocabulary at path goes from the driver to the workers."""

    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(SparkFiles.get(name))
        for b in batches:
            n = [len(t.encode_ordinary(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


class Bins:
    """Windows with room, and the tightest of them for a size. Rooms are whole numbers, so a bit for each of them finds it."""

    def __init__(self, largest: int):
        self._by_room: list[list[int]] = [[] for _ in range(largest + 1)]
        self._open = 0
        self.length: list[int] = []
        self.left: list[int] = []

    def _has(self, w: int) -> None:
        self._by_room[self.left[w]].append(w)
        self._open |= 1 << self.left[w]

    def put(self, size: int, length: int) -> tuple[int, int]:
        """(window, offset) for a size: the tightest gap it fits in, else a new window of that length."""
        fits = self._open >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            w = self._by_room[room].pop()
            if not self._by_room[room]:
                self._open &= ~(1 << room)
        else:
            w, room = len(self.left), length
            self.length.append(length)
            self.left.append(length)
        self.left[w] = room - size
        self._has(w)
        return w, self.length[w] - room


def fill(sizes: np.ndarray, tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset in it, context length, offset of the context) of each size, none over the last tier, which is the sequences' length.

    A context's length is that of the tier it was opened for; combined, it takes only the room it uses.
    """
    window, tier = tiers[-1], np.searchsorted(np.array(tiers), sizes)
    n = len(sizes)
    context, within = np.full(n, -1), np.zeros(n, np.int64)
    contexts = Bins(window)
    order = np.lexsort((-sizes, -tier)).tolist()
    for k in order:
        if tier[k] or len(tiers) == 1:
            context[k], within[k] = contexts.put(int(sizes[k]), tiers[tier[k]])
    used = np.array(contexts.length, np.int64) - np.array(contexts.left, np.int64)
    sequences = Bins(window)
    at = np.zeros((len(used), 2), np.int64)
    for c in np.argsort(-used, kind="stable").tolist():
        at[c] = sequences.put(int(used[c]), window)
    own = context >= 0
    place, start, length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, tiers[0])
    place[own], start[own], length[own] = at[context[own], 0], at[context[own], 1], np.array(contexts.length, np.int64)[context[own]] if own.any() else 0
    for k in order:
        if not own[k]:
            place[k], start[k] = sequences.put(int(sizes[k]), window)
    return place, start + within, length, start


def deal(costs: DataFrame, step: int = STEP) -> DataFrame:
    """sequence and step of sequences with a cost: steps of equal numbers (but for one), costs dealt there and back from the dearest down.

    The place of a sequence in the order of cost comes from sorted ranges and the numbers of rows before them; only the latter, one a range, are gathered.
    """
    ranged = durable(costs.repartitionByRange(F.desc("cost"), "sequence").sortWithinPartitions(F.desc("cost"), "sequence"))
    rows = ranged.withColumn("id", F.monotonically_increasing_id()).withColumn("range", F.shiftright("id", 33))
    sizes = {r["range"]: r["n"] for r in rows.groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    steps = F.lit(max(1, -(-total // step)))
    spark = costs.sparkSession
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "range bigint, before bigint"))
    rank = rows.join(starts, "range").withColumn("rank", F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1))
    turn, at = F.floor(F.col("rank") / steps), F.col("rank") % steps
    return rank.select("sequence", F.when(turn % 2 == 0, at).otherwise(steps - 1 - at).cast("bigint").alias("step"))


def pack(sizes: DataFrame, tiers: tuple[int, ...] = TIERS, group: int = GROUP, step: int = STEP) -> DataFrame:
    """Places for texts of n_tokens: doc_id, part, token_from, token_to, tier, sequence, start, context, context_start, step.

    Every text is in exactly one place, whole unless it is longer than the window (the last tier), when its parts are full windows and a rest.
    Empty texts have an empty place. Of repeated or null doc_ids each row is placed. sizes is written once: rows are numbered as they lie in those
    files, so that a lost task numbers them again alike, and no group grows with how often a doc_id stands. Steps are dealt over all groups.
    """
    n, w = F.coalesce(F.greatest(F.col("n_tokens"), F.lit(0)), F.lit(0)), F.lit(tiers[-1])
    rows = durable(sizes.select(F.col("doc_id").cast("bigint"), n.alias("n"))).withColumn("row", F.monotonically_increasing_id())
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / w) - 1).cast("int"))))
    parts = parts.select("row", "doc_id", "part", (F.col("part") * w).cast("bigint").alias("token_from"), F.least("n", (F.col("part") + 1) * w).cast("bigint").alias("token_to"))
    groups = max(1, -(-parts.count() // group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "part"], kind="stable")
        size = (pdf.token_to - pdf.token_from).to_numpy(np.int64)
        no, start, context, begins = fill(size, tiers)
        # What attention costs: the square of each context's use.
        _, which = np.unique(np.stack([no, begins]), axis=1, return_inverse=True)
        use = np.bincount(which, weights=size)
        owner = np.zeros(len(use), np.int64)
        owner[which] = no
        cost = np.bincount(owner, weights=use**2)
        return pd.DataFrame({
            "doc_id": pdf.doc_id.astype("Int64"), "part": pdf.part, "token_from": pdf.token_from, "token_to": pdf.token_to, "tier": np.array(tiers, np.int64)[np.searchsorted(np.array(tiers), size)],
            "sequence": (np.int64(pdf.group.iloc[0]) << 32) + no, "start": start, "context": context, "context_start": begins, "cost": cost[no],
        })

    schema = "doc_id bigint, part int, token_from bigint, token_to bigint, tier bigint, sequence bigint, start bigint, context bigint, context_start bigint, cost double"
    places = durable(parts.withColumn("group", F.pmod(F.xxhash64("row", "part"), F.lit(groups)).cast("bigint")).groupBy("group").applyInPandas(place, schema))
    steps = deal(places.groupBy("sequence").agg(F.max("cost").alias("cost")), step)
    return places.drop("cost").join(steps, "sequence").select("doc_id", "part", "token_from", "token_to", "tier", "sequence", "start", "context", "context_start", "step")


def packed(documents: DataFrame, path: str = TOKENIZER, **how) -> DataFrame:
    """pack() of the whole texts of documents."""
    return pack(token_counts(documents, path), **how)
