"""Evaluation texts that turn up, wholly or in part, in a corpus.

Spaced seeds: six words are hashed, either neighbours or with one position between them ignored. Passages and documents are hashed under
every mask and meet on the words kept, not on the mask, so that a replaced word (a gap on both sides), a dropped one (a gap in the passage
only) and an added one (a gap in the document only) are all bridged. With at most one edit in eight words some two neighbouring runs of
unedited words have six words or more between them, so no leak is missed. Hits are verified exactly.

A set of test items of bounded size goes to all tasks, which read the corpus once. A larger set meets the corpus in a join on seeds, also in one reading:
a bitmap of bounded size drops most seeds of the corpus before they are shuffled, and the pairs that share a seed are verified.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import durable
from .text import words

RUN = 12  # consecutive words that make a leak
EDITS = 8  # one edit in so many words is tolerated in a whole passage
KEPT = 6
BLOCK_WORDS = 200_000  # words of test items up to which they go to all tasks: about 15 MB in a worker
BITS = 30  # the bitmap of a larger set has 2**BITS bits: 128 MB
CHUNK = 19  # it is made in parts of 2**CHUNK bits

# Positions kept, by mask.
MASKS = tuple(tuple(i + (i >= gap) for i in range(KEPT)) for gap in (KEPT, 1, 2, 3, 4, 5))
_P = np.uint64(0x9E3779B97F4A7C15)
_MARKS = np.uint64((1 << 20) - 1)


def _seeds(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of windows all of whose kept words are known (not 0)."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    known = ids != 0
    ok = known[:n].copy()
    for off in mask[1:]:
        ok &= known[off : off + n]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for off in mask:
        h = (h ^ ids[at + off].astype(np.uint64)) * _P
        h ^= h >> np.uint64(29)
    return h, at


@dataclass
class SeedIndex:
    """Seeds of passages: vocabulary, word numbers of each passage, sorted hashes with the passage and place they come from."""

    vocabulary: dict[str, int]
    passages: list[tuple[int, np.ndarray]]
    masks: tuple[tuple[int, ...], ...]
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    marks: np.ndarray  # by the lowest bits of a hash, whether there may be such a seed: most windows of a corpus end here


def build_index(items: list[tuple[int, str]]) -> SeedIndex:
    """Passages without a word have no seed and leak nowhere. Those shorter than a seed are hashed whole."""
    vocabulary: dict[str, int] = {}
    passages = []
    for key, text in items:
        w = words(text or "")
        if w:
            passages.append((key, np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int64)))
    short = sorted({len(p) for _, p in passages if len(p) < KEPT})
    masks = MASKS + tuple(tuple(range(n)) for n in short)
    hashes, owner, place = [], [], []
    for k, (_, ids) in enumerate(passages):
        for m in masks:
            if (len(m) < KEPT) == (len(ids) < KEPT) and (len(m) == KEPT or len(m) == len(ids)):
                h, at = _seeds(ids, m)
                hashes.append(h)
                owner.append(np.full(len(h), k))
                place.append(at)
    if not hashes:
        e = np.empty(0, np.int64)
        return SeedIndex(vocabulary, passages, masks, np.empty(0, np.uint64), e, e, np.zeros(1 << 20, bool))
    h, o, p = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
    order = np.argsort(h, kind="stable")
    marks = np.zeros(1 << 20, bool)
    marks[h & _MARKS] = True
    return SeedIndex(vocabulary, passages, masks, h[order], o[order], p[order], marks)


def _has_run(doc: np.ndarray, passage: np.ndarray, shift: int, need: int) -> bool:
    """Whether doc and passage, laid at a shift, agree in need consecutive words."""
    lo, hi = max(0, -shift), min(len(passage), len(doc) - shift)
    if hi - lo < need:
        return False
    same = np.concatenate(([False], doc[lo + shift : hi + shift] == passage[lo:hi], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    return bool(len(edges)) and int((edges[1::2] - edges[::2]).max()) >= need


def least_edits(doc: np.ndarray, passage: np.ndarray, most: int | None = None) -> int:
    """Fewest replaced, dropped and added words that turn the passage into some stretch of doc; where that is more than most, some number over most."""
    steps = np.arange(len(doc) + 1)
    row = np.zeros(len(doc) + 1, np.int64)
    for i, w in enumerate(passage):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (doc != w))
        row = np.minimum.accumulate(new - steps) + steps
        if most is not None and i % 8 == 7 and row.min() > most:  # it never falls
            break
    return int(row.min())


def _within(doc: np.ndarray, passage: np.ndarray, most: int) -> bool:
    """Whether some stretch of doc is the passage with at most so many edits. A word of the passage that doc lacks is an edit, which settles most cases."""
    return int(np.isin(passage, doc, invert=True).sum()) <= most and least_edits(doc, passage, most) <= most


def _leaks(doc: np.ndarray, passage: np.ndarray, shifts: list[int]) -> bool:
    n = len(passage)
    if any(_has_run(doc, passage, s, min(RUN, n)) for s in shifts):
        return True
    k = n // EDITS
    if not k:
        return False
    end = -1
    for s in shifts:  # in order; overlapping windows are taken together
        lo, hi = max(0, s - k), min(len(doc), s + n + k)
        if end >= 0 and lo <= end:
            end = max(end, hi)
            continue
        if end >= 0 and _within(doc[start:end], passage, k):
            return True
        start, end = lo, hi
    return end >= 0 and _within(doc[start:end], passage, k)


def scan(index: SeedIndex, keys: list, texts: list[str]) -> list[tuple]:
    """(key, passage's key) of every text that holds a passage."""
    flat, starts, gap = array("q"), [], [0] * (KEPT + 1)
    get = index.vocabulary.get
    for t in texts:
        starts.append(len(flat))
        if t:
            flat.extend([get(w, 0) for w in words(t)])
        flat.extend(gap)
    ids, begin = np.frombuffer(flat, np.int64), np.array(starts + [len(flat)])
    hits: dict[tuple[int, int], set[int]] = defaultdict(set)
    for m in index.masks:
        h, at = _seeds(ids, m)
        some = index.marks[h & _MARKS]
        h, at = h[some], at[some]
        left, right = np.searchsorted(index.hashes, h, "left"), np.searchsorted(index.hashes, h, "right")
        some = right > left
        left, count, at = left[some], (right - left)[some], at[some]
        if not len(at):
            continue
        each = np.repeat(np.arange(len(at)), count)
        entry = left[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        doc = np.searchsorted(begin, at[each], "right") - 1
        for d, o, s in set(zip(doc.tolist(), index.owner[entry].tolist(), (at[each] - begin[doc] - index.place[entry]).tolist())):
            hits[d, o].add(s)
    found = []
    for (d, o), shifts in hits.items():
        key, passage = index.passages[o]
        if _leaks(ids[begin[d] : begin[d + 1]], passage, sorted(shifts)):
            found.append((keys[d], key))
    return found


def _ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, with a gap of zeros after each text; where each text begins)."""
    known: dict[str, int] = {}
    flat, starts, gap = array("q"), [], [0] * (KEPT + 1)
    for t in texts:
        starts.append(len(flat))
        for w in words(t) if t else ():
            h = known.get(w)
            if h is None:
                h = known[w] = (xxh64_intdigest(w) & (2**63 - 1)) or 1
            flat.append(h)
        flat.extend(gap)
    return np.frombuffer(flat, np.int64), np.array(starts, np.int64)


def _seed_rows(texts: list[str | None], masks: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, seed) of all seeds of texts, each once a text."""
    ids, begin = _ids(texts)
    rows = []
    for m in masks:
        h, at = _seeds(ids, m)
        rows.append(np.stack([np.searchsorted(begin, at, "right") - 1, h.astype(np.int64)]))
    both = np.unique(np.concatenate(rows, axis=1), axis=1) if rows else np.empty((2, 0), np.int64)
    return both[0], both[1]


def _short_lengths(items: DataFrame, text: str) -> list[int]:
    """Lengths, under a seed's, that passages have: at most KEPT - 1 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = sorted({k for t in b.column(0).to_pylist() if 0 < (k := len(words(t))) < KEPT})
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    return sorted(r[0] for r in items.select(text).mapInArrow(count, "n bigint").distinct().collect())


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of the lowest bits of a seed: a bounded size, made in parts where the seeds are."""
    chunk = min(CHUNK, bits)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << chunk, bool)
        on[pdf.bit.to_numpy() & ((1 << chunk) - 1)] = True
        return pd.DataFrame({"part": [int(pdf.part.iloc[0])], "bits": [np.packbits(on).tobytes()]})

    bit = F.col("seed").bitwiseAND((1 << bits) - 1)
    parts = seeds.select(bit.alias("bit")).distinct().withColumn("part", F.shiftright("bit", chunk)).groupBy("part").applyInPandas(part, "part bigint, bits binary")
    out = np.zeros((1 << (bits - chunk), (1 << chunk) // 8), np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _joined(documents: DataFrame, items: DataFrame, bits: int) -> DataFrame:
    """leaked() for any number of test items, by a join on seeds. documents (doc_id, text) and items (eval_id, passage) are distinct rows."""
    spark = documents.sparkSession
    lengths = _short_lengths(items, "passage")
    whole = tuple(tuple(range(n)) for n in lengths)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for short in (False, True):
                own = [i for i, t in enumerate(texts) if (len(words(t)) < KEPT) == short]
                for n in lengths if short else [0]:
                    some = [i for i in own if not short or len(words(texts[i])) == n]
                    at, h = _seed_rows([texts[i] for i in some], (tuple(range(n)),) if short else MASKS)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[some[k]] for k in at], pa.int64()), pa.array(h, pa.int64())], names=["eval_id", "seed"])

    tests = durable(items.mapInArrow(of_items, "eval_id bigint, seed bigint"))
    shared = spark.sparkContext.broadcast(_bitmap(tests, bits))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                at, h = _seed_rows(part.column(1).to_pylist(), MASKS + whole)
                bit = h & ((1 << bits) - 1)
                hit = (shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at[hit])), pa.array(h[hit], pa.int64())], names=["doc_id", "seed"])

    met = documents.mapInArrow(of_documents, "doc_id bigint, seed bigint").join(tests, "seed").select("doc_id", "eval_id").distinct()
    pairs = met.withColumnRenamed("doc_id", "d").join(documents, F.col("d").eqNullSafe(F.col("doc_id"))).join(items, "eval_id").select("doc_id", "text", "eval_id", "passage")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, text, item, passage = (b.column(i).to_pylist() for i in range(4))
            by: dict[tuple, list[int]] = defaultdict(list)
            for i, p in enumerate(passage):
                by[item[i], p].append(i)
            found = [x for (k, p), rows in by.items() for x in scan(build_index([(k, p)]), [doc[i] for i in rows], [text[i] for i in rows])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["doc_id", "eval_id"])

    return pairs.mapInArrow(verify, "doc_id bigint, eval_id bigint")


def leaked(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, eval_id of every document whose text contains a test passage.

    Contains: at least RUN consecutive words of it (all of its words if it has fewer), or all of it with at most one word in EDITS replaced,
    dropped or added. Up to block_words words of test items go to all tasks; more are joined by seeds. Either way the corpus is read once.
    Null and empty texts contain nothing; a document that stands twice is reported once. Whole texts are read.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint"), "text").where("text <> ''")
    tests = items.select(F.col("eval_id").cast("bigint"), "passage").where("passage <> '' and eval_id is not null").distinct()
    block, size = [], 0
    for r in tests.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(words(r[1]))
        if size > block_words:
            return _joined(texts.distinct(), tests, bits).distinct()
    shared = spark.sparkContext.broadcast(build_index(block))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                found = scan(shared.value, part.column(0).to_pylist(), part.column(1).to_pylist())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["doc_id", "eval_id"])

    return texts.mapInArrow(find, "doc_id bigint, eval_id bigint").distinct()
