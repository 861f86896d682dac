"""Scoring texts for abusive, hateful and sexual language.

Words are bags of subwords (character n-grams) and pairs of neighbouring words; their embeddings are averaged over a sentence, or a stretch of
it, into a linear softmax. Embeddings and softmax are trained jointly, in numpy, on judgements of whole reviews: which sentence of a
judged review made the case isn't said, so training and choosing the sentences alternate, and judgements the model can't support are dropped.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("none", "abusive", "hateful", "sexual")
BUCKETS, DIM = 1 << 15, 16
GRAMS = (3, 4, 5)
MAX_LABELLED = 8_000  # judged reviews a model is fitted on, drawn by hash
THRESHOLD = 0.5
WINDOW, STRIDE = 9, 4  # words of a stretch, for sentences that aren't divided by a mark
KNOWN = 200_000  # sentences whose scores a task keeps: templates and copies are read once

_BREAK = regex.compile(r"</?(?:br|p|div|li|tr|td|h[1-6])\b[^<>]*>", regex.I)
_TAG = regex.compile(r"</?[A-Za-z!?][^<>]*>")
_UNSEEN = regex.compile(r"[\p{M}\p{Cf}\p{Default_Ignorable_Code_Point}--\s]|[\p{Cc}--\s]", regex.V1)
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:([-._*·])[^\W_])(?:\1[^\W_])+(?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?: [^\W_]){3,}(?![^\W_])")
_END = re.compile(r"[.!?…！？。]+(?=\s|$|[\"'»)])|¡|¿")
# Ranges of controls and of characters that don't show.
_HIDDEN = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]")
_TOKEN = regex.compile(r"[\p{L}\p{N}@$#*!_%&+]*[\p{L}\p{N}][\p{L}\p{N}@$#*_%&+]*(?:!(?=[\p{L}\p{N}])[\p{L}\p{N}@$#*_%&+]*)*")
_SIGNS, _ASCII, _DOUBLE, _OTHER = re.compile(r"[@$#*!_%&+]"), re.compile(r"[a-z0-9]+"), re.compile(r"([a-z])\1+"), re.compile(r"[^\w]|_")
_RUN = re.compile(r"(.)\1+")

# Letters of other scripts, digits and signs that are written for Latin letters.
_LOOK = str.maketrans("авсеніјкморѕтухѵгԁԛԝαβεικνορτυχ", "abcehijkmopstyxvrdqwabeiknoptux")
_LEET = str.maketrans("0134578@$!|+", "oieastbasiit")


def fold(text: str) -> str:
    """text in lower case without accents, invisible characters and tags, with letters that look alike as one."""
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(_LOOK)
    return text.lower()


def tokens(sentence: str) -> list[str]:
    """Words of a folded sentence; disguises within a word are undone as far as they can be: f-o-o, f00, fooo. Numbers are all one word."""
    if sentence.isascii() and not _SIGNS.search(sentence):
        return [t if t.isalpha() else "0" if t.isdigit() else _bare(t) for t in _ASCII.findall(_DOUBLE.sub(r"\1", sentence))]
    out = []
    for t in _TOKEN.findall(sentence):
        if t.isascii() and t.isalpha():
            out.append(_RUN.sub(r"\1", t))
        elif t.isdigit():
            out.append("0")
        elif t := _bare(t):
            out.append(t)
    return out


def _bare(t: str) -> str:
    """A word that isn't just letters, with the letters its digits and signs are written for."""
    letters = sum(c.isalpha() for c in t)
    if letters == 1 and t[1:].isdigit():  # part of a product's name
        t = "0"
    if letters >= 2 or (letters and (t[0].isdigit() and len(t) > 4 or any(c in "@$!#*" for c in t))):
        t = t.translate(_LEET)
    return _RUN.sub(r"\1", _OTHER.sub("*", t.strip("_*#&%+")))


def pieces(text: str | None) -> list[str]:
    """A text divided at the ends of its sentences, each piece as it is written; tags and hidden characters, which may hide an end, are taken out first."""
    if not text:
        return []
    if "<" in text or _HIDDEN.search(text):
        text = fold(text)
    return [s for s in _END.split(text) if s]


def read(piece: str) -> tuple[str, ...]:
    """The words of a piece."""
    t = _SPELLED.sub(lambda m: m[0].replace(m[1], ""), fold(piece))
    return tuple(tokens(_SPACED.sub(lambda m: m[0].replace(" ", ""), t)))


def sentences(text: str | None) -> list[tuple[str, ...]]:
    """The sentences of a text, as words. Null and empty texts have none."""
    return [w for s in pieces(text) if (w := read(s))]


def grams(word: str) -> list[int]:
    """Buckets of a word's character n-grams and of the whole word."""
    w = f"<{word}>"
    return [crc32(w.encode()) % BUCKETS] + [crc32(w[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Embeddings of subwords, and a linear softmax over their mean."""

    embedding: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    _at: dict[str, int] = field(default_factory=dict)
    _words: tuple[np.ndarray, ...] = ()

    def _known(self, words: list[str]) -> np.ndarray:
        """Numbers of words; of each the sum of its subwords' embeddings, how many they are, and its hash are kept in _words."""
        if len(self._at) > 200_000:
            self._at.clear()
        if not self._at:
            self._words = np.zeros((0, DIM)), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at, had = self._at, len(self._at)
        ids = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words))
        new = list(at)[had:] if len(at) > had else []
        if new:
            g = [grams(w) for w in new]
            n = np.array([len(x) for x in g])
            sums = np.add.reduceat(self.embedding[np.concatenate(g)].astype(np.float64), _starts(n), axis=0)
            self._words = np.vstack([self._words[0], sums]), np.append(self._words[1], n), np.append(self._words[2], np.array([crc32(w.encode()) for w in new], np.uint64))
        return ids

    def scores(self, texts: list[list[tuple[str, ...]]]) -> np.ndarray:
        """For each text (its sentences), the greatest probability of each kind over stretches of its sentences; shape (texts, kinds), of 'none' the least."""
        flat = [w for t in texts for s in t for w in s]
        out = np.zeros((len(texts), len(KINDS)))
        out[:, 0] = 1
        if not flat:
            return out
        ids = self._known(flat)
        vec, n, h = (x[ids] for x in self._words)
        sizes = np.array([len(s) for t in texts for s in t])
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        pair = self.embedding[(_pairs(h[:-1], h[1:]))]  # between word k and k + 1
        vsum, nsum = np.vstack([np.zeros((1, DIM)), np.cumsum(vec, 0)]), np.concatenate([[0], np.cumsum(n)])
        psum = np.vstack([np.zeros((1, DIM)), np.cumsum(pair, 0, dtype=np.float64)])
        a, b, o = spans(sizes, owner)
        mean = (vsum[b] - vsum[a] + psum[b - 1] - psum[a]) / (nsum[b] - nsum[a] + b - a - 1)[:, None]
        p = _softmax(mean @ self.weight + self.bias)
        by = np.argsort(o, kind="stable")
        p, at = p[by], np.flatnonzero(np.r_[True, np.diff(o[by]) > 0])
        out[o[by][at], 1:] = np.maximum.reduceat(p[:, 1:], at, axis=0)
        out[o[by][at], 0] = np.minimum.reduceat(p[:, 0], at)
        return out


def spans(sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, text) of every sentence, and of the stretches of those that are long."""
    first = _starts(sizes)
    long = np.flatnonzero(sizes > WINDOW + 2)
    n = -(-(sizes[long] - WINDOW + STRIDE) // STRIDE)
    each = np.repeat(long, n)
    a = first[each] + STRIDE * (np.arange(n.sum()) - np.repeat(_starts(n), n))
    b = np.minimum(a + WINDOW, first[each] + sizes[each])
    return np.concatenate([first, a]), np.concatenate([first + sizes, b]), np.concatenate([owner, owner[each]])


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA77)) >> np.uint64(15)) % np.uint64(BUCKETS)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Bags:
    """Sentences as numbers: words once each with the buckets of their subwords, pairs of words as buckets."""

    def __init__(self, texts: list[tuple[str, ...]]):
        vocabulary: dict[str, int] = {}
        self.words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t]) for t in texts]
        each = [np.array(grams(w)) for w in vocabulary]
        self.size = np.array([len(g) for g in each])
        self.begin = np.cumsum(self.size) - self.size
        self.grams = np.concatenate(each)
        h = np.array([crc32(w.encode()) for w in vocabulary], np.uint64)
        # Bucket BUCKETS stands for no pair, and stays 0.
        self.pairs = [np.append(_pairs(h[w[:-1]], h[w[1:]]).astype(np.int64), BUCKETS) for w in self.words]
        self.total = np.array([self.size[w].sum() + len(w) - 1 for w in self.words])


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def fit(texts: list[tuple[str, ...]], y: np.ndarray, weight: np.ndarray, epochs: int = 6, seed: int = 0, rate: float = 0.25, batch: int = 256) -> Model:
    """Subword embeddings and softmax, jointly, by AdaGrad on the weighted cross entropy. y: kinds, as probabilities (n, kinds)."""
    rng = np.random.default_rng(seed)
    bags = Bags(texts)
    e = rng.uniform(-1, 1, (BUCKETS + 1, DIM)).astype(np.float32) / DIM
    e[BUCKETS] = 0
    w, b = rng.normal(0, 0.1, (DIM, len(KINDS))), np.zeros(len(KINDS))
    ge, gw, gb = np.full(BUCKETS + 1, 1e-6), np.full(w.shape, 1e-6), np.full(b.shape, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            k = order[lo : lo + batch]
            long, paired = [bags.words[i] for i in k], [bags.pairs[i] for i in k]
            n_words, n_pairs, total = np.array([len(x) for x in long]), np.array([len(x) for x in paired]), bags.total[k][:, None]
            used, back = np.unique(np.concatenate(long), return_inverse=True)
            size = bags.size[used]
            ids = bags.grams[np.repeat(bags.begin[used] - _starts(size), size) + np.arange(size.sum())]
            pid = np.concatenate(paired)
            vec = np.add.reduceat(e[ids], _starts(size), axis=0)
            mean = (np.add.reduceat(vec[back], _starts(n_words), axis=0) + np.add.reduceat(e[pid], _starts(n_pairs), axis=0)) / total
            d = (_softmax(mean @ w + b) - y[k]) * weight[k, None]
            dm = ((d @ w.T) / total).astype(np.float32)
            dw, db = mean.T @ d, d.sum(0)
            gw += dw**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
            dv = np.zeros((len(used), DIM), np.float32)
            np.add.at(dv, back, np.repeat(dm, n_words, axis=0))
            both = np.concatenate([ids, pid])
            grad = np.concatenate([np.repeat(dv, size, axis=0), np.repeat(dm, n_pairs, axis=0)])
            by = np.argsort(both, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(both[by]) > 0])
            de, u = np.add.reduceat(grad[by], at, axis=0), both[by][at]
            ge[u] += (de**2).mean(1)
            e[u] -= rate * de / np.sqrt(ge[u])[:, None].astype(np.float32)
            e[BUCKETS] = 0
    return Model(e[:BUCKETS], w, b)


def disguised(words: tuple[str, ...], rng: random.Random) -> tuple[str, ...]:
    """The words with one of them misspelled: a letter masked, dropped, doubled away or swapped."""
    k = rng.choice([i for i, w in enumerate(words) for _ in range(1 + len(w))])
    w = words[k]
    if len(w) < 4:
        return words
    i = rng.randrange(1, len(w) - 1)
    w = rng.choice([w[:i] + "*" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rng.choice("aeiou") + w[i + 1 :]])
    return (*words[:k], w, *words[k + 1 :])


def _targets(docs: list[tuple[list, set[int]]], p: dict | None) -> dict:
    """How often each sentence stands for each kind. p: probabilities of a model that hasn't seen these texts; None in the first round."""
    target: dict = defaultdict(lambda: np.zeros(len(KINDS)))
    for s, kinds in docs:
        if p is None:
            for x in s:
                for k in kinds:
                    target[x][k] += 1 / len(s)
                target[x][0] += 0.3 if kinds else 1
            continue
        best = {k: max(s, key=lambda x: p[x][k], default=None) for k in kinds}
        for x in s:
            said = [k for k in kinds if p[x][k] > 0.5 or (x is best[k] and p[x][k] > 0.2)]
            for k in said:
                target[x][k] += 1
            # A sentence nobody named may be of a kind all the same: judgements name one kind, and some are wrong.
            if not said and p[x][0] > (0.7 if kinds else 0.5):
                target[x][0] += 1
            elif not said and kinds and p[x][0] < 0.3:
                target[x] += p[x] * 0.5
    return target


def _fit(target: dict, examples: list[tuple[tuple[str, ...], int]], epochs: int, seed: int) -> Model:
    """A model of such targets; epochs are for many sentences, few are gone through more often."""
    rng = random.Random(seed)
    total: dict = defaultdict(lambda: np.zeros(len(KINDS)))
    for x, t in target.items():
        total[x] += t
    for x, k in examples:
        total[x][k] += 2
    texts, y, weight = [], [], []
    for x, t in total.items():
        n = t.sum()
        texts.append(x)
        y.append(t / n)
        weight.append(min(n, 4.0) ** 0.5)
        if t[0] > 0.9 * n and rng.random() < 0.4:  # scraps of harmless sentences are harmless
            i = rng.randrange(len(x))
            texts.append(x[i : i + rng.randrange(1, 5)])
            y.append(t / n)
            weight.append(0.7)
        for _ in range(4 if t[0] < 0.5 * n else int(rng.random() < 0.2)):
            texts.append(disguised(x, rng))
            y.append(t / n)
            weight.append(0.5)
    return fit(texts, np.array(y), np.array(weight), max(epochs, min(30, 40_000 // len(texts))), seed)


def train(judged: list[tuple[str, list[str | None]]], rounds: int = 2, folds: int = 2, seed: int = 0, examples: list[tuple[str, str]] | None = None) -> Model:
    """A model from (text, its judgements) and from example sentences (sentence, kind).

    Null judgements say nothing. A text has the kinds that at least as many judgements name as say none. In the first round each of its
    sentences is taken, thinly, for all of its kinds, and sentences that also stand in clean texts lose out. Then models of one fold choose
    the sentences of the other, so that a wrong judgement can't confirm itself: what no other text supports is dropped.
    """
    if examples is None:
        from .examples import EXAMPLES as examples
    fixed = [(s, KINDS.index(k)) for text, k in examples for s in sentences(text)]
    docs: list[tuple[list[tuple[str, ...]], set[int]]] = []
    for text, said in judged:
        votes = [KINDS.index(x) for v in said if v is not None and (x := v.strip().lower()) in KINDS]
        if votes:
            docs.append((list(dict.fromkeys(sentences(text))), {k for k in set(votes) - {0} if votes.count(k) >= votes.count(0)}))
    random.Random(seed).shuffle(docs)
    parts = [docs[f::folds] for f in range(folds)]
    targets = [_targets(d, None) for d in parts]
    for _ in range(rounds):
        new = []
        for f, d in enumerate(parts):
            rest: dict = defaultdict(lambda: np.zeros(len(KINDS)))
            for g, t in enumerate(targets):
                if g != f:
                    for x, n in t.items():
                        rest[x] += n
            every = list({x for s, _ in d for x in s})
            p = dict(zip(every, _fit(rest, fixed, 4, seed).scores([[x] for x in every]))) if every else {}
            new.append(_targets(d, p))
        targets = new
    total: dict = defaultdict(lambda: np.zeros(len(KINDS)))
    for t in targets:
        for x, n in t.items():
            total[x] += n
    return _fit(total, fixed, 6, seed)


def judged_texts(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, list[str | None]]]:
    """Texts with their judgements, of at most so many reviews, drawn by a hash of doc_id (all of them if there are fewer)."""
    by = labels.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("annotator", "label"))).alias("j"))
    few = by.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("j.label").alias("said"))
    rows = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "said").toLocalIterator()
    return [(r["text"], r["said"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


class Reader:
    """Scores texts piece by piece; a piece that was met before isn't read again."""

    def __init__(self, model: Model, most: int = KNOWN):
        self.model, self.most = model, most
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._p = np.zeros((1, len(KINDS) - 1))  # row 0: of no piece

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """For each text the greatest probability of each kind but 'none'; shape (texts, kinds)."""
        if len(self._at) > self.most:
            self._forget()
        flat: list[int] = []
        begin, new, at = [], [], self._at
        for t in texts:
            begin.append(len(flat))
            flat.append(0)
            for s in pieces(t):
                k = at.get(s)
                if k is None:
                    k = at[s] = len(at) + 1
                    new.append(s)
                flat.append(k)
        if new:
            self._p = np.vstack([self._p, self.model.scores([[w] if (w := read(s)) else [] for s in new])[:, 1:]])
        return np.maximum.reduceat(self._p[flat], begin, axis=0) if texts else self._p[:0]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, abusive, hateful, sexual: the greatest probability of each kind over the text's sentences, 0 for texts without words."""
    shared = documents.sparkSession.sparkContext.broadcast((model.embedding, model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Model(*shared.value))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                p = reader.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, i]) for i in range(3))], names=["doc_id", *KINDS[1:]])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, abusive double, hateful double, sexual double")


def flagged(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, category of every score over the threshold."""
    kinds = F.array(*[F.when(F.col(k) > threshold, F.lit(k)) for k in KINDS[1:]])
    return scores.select("doc_id", F.explode(F.array_compact(kinds)).alias("category")).distinct()
