"""Full-text search: tokenizers, postings, a query language, ranking; and exact and approximate vector search."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType

from ..functions.stem import stem
from ..functions.vectors import METRICS

K1, B = 1.2, 0.75
PATTERNS = {"simple": r"(\w+)", "unicode61": r"([\p{L}\p{N}]+)"}


def tokens(text: Column, tokenizer: str = "unicode61") -> Column:
    """An array of a text's words in lower case (porter: their stems); of trigram, its overlapping threes of characters. Null texts have none."""
    if tokenizer == "porter":
        return _stems(tokens(text))
    x = F.coalesce(F.lower(text), F.lit(""))
    if tokenizer == "trigram":
        n = F.char_length(x)
        return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: x.substr(i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.regexp_extract_all(x, F.lit(PATTERNS[tokenizer]), 1)


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return pd.Series([[known.get(w) or known.setdefault(w, stem(w)) for w in ws] for ws in words])


def stemmed(n: "Node") -> "Node":
    """A query with its words (but not prefixes) as stems."""
    return Node(n.kind, n.words if n.kind == "prefix" else tuple(map(stem, n.words)), tuple(map(stemmed, n.parts)), n.distance, n.column)


def postings(docs: DataFrame, key: str, columns: list[str], tokenizer: str = "unicode61") -> DataFrame:
    """key, column, pos, term for every word."""
    out = None
    for i, c in enumerate(columns):
        one = docs.select(F.col(key), F.lit(c).alias("column"), F.posexplode(tokens(F.col(c), tokenizer)).alias("pos", "term"))
        out = one if i == 0 else out.unionByName(one)
    return out


@dataclass
class Node:
    """Of a query: term, phrase, prefix, near, and, or, not; a column it is bound to."""

    kind: str
    words: tuple[str, ...] = ()
    parts: tuple["Node", ...] = ()
    distance: int = 10
    column: str | None = None


_TOKEN = re.compile(r'"(?P<phrase>[^"]*)"|(?P<near>NEAR\s*\(([^)]*)\))|(?P<paren>[()])|(?P<column>[\w]+)\s*:|(?P<prefix>[^\s()":*]+)\*|(?P<word>[^\s()":]+)')


def parse_query(text: str) -> Node:
    """term, "phrase", prefix*, a AND b (also a b), a OR b, a NOT b, NEAR(a b, n), column:term. NOT binds tightest, then AND, then OR."""
    items, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} in {text!r}")
        items.append(m)
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return None if pos >= len(items) else items[pos]["paren"] or items[pos]["word"] or ""

    def words(s: str) -> tuple[str, ...]:
        return tuple(re.findall(r"[^\W_]+", s.lower()))

    def primary(column: str | None = None) -> Node:
        nonlocal pos
        if pos >= len(items):
            raise ValueError(f"{text!r} ends too early")
        m = items[pos]
        pos += 1
        if m["column"]:
            return primary(m["column"])
        if m["paren"] == "(":
            n = either()
            if peek() != ")":
                raise ValueError("a bracket isn't closed")
            pos += 1
            return n
        if m["near"]:
            body, _, d = m[3].partition(",")
            return Node("near", words(body), distance=int(d) if d.strip() else 10, column=column)
        if m["phrase"] is not None:
            return Node("phrase", words(m["phrase"]), column=column)
        if m["prefix"]:
            return Node("prefix", (m["prefix"].lower(),), column=column)
        if m["word"] is None:
            raise ValueError(f"unexpected {m[0]!r}")
        w = words(m["word"])
        return Node("term" if len(w) == 1 else "phrase", w, column=column)

    def without() -> Node:
        nonlocal pos
        n = primary()
        while peek() == "NOT":
            pos += 1
            n = Node("not", parts=(n, primary()))
        return n

    def every() -> Node:
        nonlocal pos
        parts = [without()]
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                pos += 1
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def either() -> Node:
        nonlocal pos
        parts = [every()]
        while peek() == "OR":
            pos += 1
            parts.append(every())
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    n = either()
    if pos < len(items):
        raise ValueError(f"unexpected {items[pos][0]!r} in {text!r}")
    return n


def _near(words: tuple[str, ...], t: Column, distance: int) -> Column:
    """Whether some stretch holds all words with at most distance words between first and last."""
    at = F.transform(F.filter(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*words)), lambda x: x)
    ends = lambda s: F.filter(at, lambda y: (y["i"] >= s["i"]) & (y["i"] <= s["i"] + distance))
    return F.exists(at, lambda s: F.size(F.array_distinct(F.transform(ends(s), lambda y: y["w"]))) == len(set(words)))


def _holds(n: Node, t: dict[str, Column]) -> Column:
    """A query as a condition on arrays of words by column: one pass over the documents, no shuffle."""
    some = lambda f: _any([f(c) for k, c in t.items() if n.column in (None, k)])
    if n.kind == "term":
        return some(lambda c: F.array_contains(c, n.words[0]))
    if n.kind == "prefix":
        return some(lambda c: F.exists(c, lambda w: w.startswith(n.words[0])))
    if n.kind == "phrase":
        if not n.words:
            return F.lit(False)
        k = len(n.words)
        return some(lambda c: F.exists(F.when(F.size(c) >= k, F.sequence(F.lit(1), F.size(c) - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(c, i, k) == F.array(*map(F.lit, n.words))))
    if n.kind == "near":
        return some(lambda c: _near(n.words, c, n.distance))
    a = _holds(n.parts[0], t)
    for p in n.parts[1:]:
        b = _holds(p, t)
        a = a & b if n.kind == "and" else a | b if n.kind == "or" else a & ~b
    return a


def _any(xs: list[Column]) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x
    return out


def match(docs: DataFrame, query: str, columns: list[str], tokenizer: str = "unicode61") -> DataFrame:
    """Documents a query holds for."""
    t = {c: F.col(f"__t_{c}") for c in columns}
    d = docs
    for c in columns:
        d = d.withColumn(f"__t_{c}", tokens(F.col(c), tokenizer))
    n = parse_query(query)
    return d.where(_holds(stemmed(n) if tokenizer == "porter" else n, t)).select(*docs.columns)


def terms_of(query: str, tokenizer: str = "unicode61") -> list[str]:
    """Words of a query that count for ranking (not those it excludes)."""

    def walk(n: Node):
        if n.kind in ("and", "or"):
            for p in n.parts:
                yield from walk(p)
        elif n.kind == "not":
            yield from walk(n.parts[0])
        elif n.kind != "prefix":
            yield from n.words

    found = walk(parse_query(query))
    return list(dict.fromkeys(map(stem, found) if tokenizer == "porter" else found))


def _frequencies(docs: DataFrame, key: str, columns: list[str], terms: list[str], tokenizer: str) -> DataFrame:
    """Of each document: its length in words over all columns, and by column and term how often the term stands there. No word is shuffled."""
    d = docs.select(key, *[tokens(F.col(c), tokenizer).alias(f"__t_{i}") for i, c in enumerate(columns)])
    is_ = lambda t: lambda w: w == t
    tf = [F.size(F.filter(f"__t_{i}", is_(t))).alias(f"tf_{i}_{k}") for i in range(len(columns)) for k, t in enumerate(terms)]
    return d.select(key, sum((F.size(f"__t_{i}") for i in range(len(columns))), F.lit(0)).alias("len"), *tf)


def bm25(docs: DataFrame, key: str, columns: list[str], query: str, weights: dict[str, float] | None = None, tokenizer: str = "unicode61", k1: float = K1, b: float = B) -> DataFrame:
    """key and score of documents the query holds for.

    idf is ln((N - df + 0.5) / (df + 0.5) + 1), where df counts (document, column) pairs; a document's length is that of all columns together.
    """
    terms = terms_of(query, tokenizer)
    f = _frequencies(docs, key, columns, terms, tokenizer)
    hits = match(docs, query, columns, tokenizer).select(key)
    df = [sum((F.count(F.when(F.col(f"tf_{i}_{k}") > 0, 1)) for i in range(len(columns))), F.lit(0)).alias(f"df_{k}") for k in range(len(terms))]
    stats = f.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *df)
    s = f.join(hits, key, "left_semi").crossJoin(F.broadcast(stats))  # one row of totals
    score = F.lit(0.0)
    for k in range(len(terms)):
        d = F.col(f"df_{k}")
        idf = F.log((F.col("n_docs") - d + 0.5) / (d + 0.5) + 1)
        for i, c in enumerate(columns):
            tf = F.col(f"tf_{i}_{k}")
            score = score + F.lit((weights or {}).get(c, 1.0)) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return s.select(key, score.alias("score"))


def tfidf(docs: DataFrame, key: str, columns: list[str], query: str, tokenizer: str = "unicode61") -> DataFrame:
    """key and the sum of tf / length * ln(N / df) over the query's terms, of documents it holds for."""
    terms = terms_of(query, tokenizer)
    f = _frequencies(docs, key, columns, terms, tokenizer)
    hits = match(docs, query, columns, tokenizer).select(key)
    tf = [sum((F.col(f"tf_{i}_{k}") for i in range(len(columns))), F.lit(0)) for k in range(len(terms))]
    stats = f.agg(F.count("*").alias("n_docs"), *[F.count(F.when(x > 0, 1)).alias(f"df_{k}") for k, x in enumerate(tf)])
    s = f.join(hits, key, "left_semi").crossJoin(F.broadcast(stats))
    score = sum((F.coalesce(F.try_divide(x, F.col("len")) * F.log(F.col("n_docs") / F.when(F.col(f"df_{k}") > 0, F.col(f"df_{k}"))), F.lit(0.0)) for k, x in enumerate(tf)), F.lit(0.0))
    return s.select(key, score.alias("score"))


def highlight(text: Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """text with the query's words marked: whole words, letter case aside."""
    ws = terms_of(query)
    if not ws:
        return text
    return F.regexp_replace(text, r"(?iU)\b(" + "|".join(re.escape(w) for w in ws) + r")\b", before.replace("$", r"\$") + "$1" + after.replace("$", r"\$"))


def highlight_phrases(text: Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """text with the query's phrases marked as wholes, whatever stands between their words but letters and digits, and its other words one by one."""

    def walk(n: Node):
        for p in n.parts[:1] if n.kind == "not" else n.parts:
            yield from walk(p)
        if n.kind in ("phrase", "term") and n.words:
            yield n.words
        elif n.kind == "near":
            yield from ((w,) for w in n.words)

    found = sorted(set(walk(parse_query(query))), key=lambda w: (-len(w), w))
    if not found:
        return text
    each = "|".join(r"[^\p{L}\p{N}]+".join(map(re.escape, w)) for w in found)
    return F.regexp_replace(text, rf"(?iU)\b({each})\b", before.replace("$", r"\$") + "$1" + after.replace("$", r"\$"))


def _once(x: Column, f) -> Column:
    """f(x), where x is computed once for each row. A lambda function computes all that it holds each time it is called, but for its arguments."""
    return F.transform(F.array(x), f)[0]


def snippet(text: Column, query: str, size: int = 12, ellipsis: str = "...") -> Column:
    """The stretch of size words with most of the query's words, the first such one; an ellipsis where something is left out.

    Its time grows in proportion to the text, however many of the query's words that holds and whatever size is.
    """
    ws = terms_of(query)
    hit = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "").isin(*ws) if ws else F.lit(False)
    places = lambda w: F.filter(F.transform(w, lambda x, i: F.when(hit(x), i + 1)), lambda p: p.isNotNull())

    def best(at: Column) -> Column:
        """The first start: a stretch with more hits than all before it begins the text or ends in a hit, and has one more than the best so far."""

        def longer(a: Column, p: Column) -> Column:
            more = F.get(at, a["k"] - a["n"]) > p - size
            return F.struct((a["k"] + 1).alias("k"), F.when(more, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(more, F.greatest(F.lit(1), p - size + 1)).otherwise(a["start"]).alias("start"))

        return F.aggregate(at, F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(1).alias("start")), longer, lambda a: a["start"])

    def cut(w: Column, start: Column) -> Column:
        return F.concat(F.when(start > 1, ellipsis).otherwise(""), F.array_join(F.slice(w, start, size), " "), F.when(start + size <= F.size(w), ellipsis).otherwise(""))

    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return _once(words, lambda w: _once(places(w), lambda at: _once(best(at), lambda start: cut(w, start))))


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "cos", vector: str = "embedding", key: str = "vec_id", where: str | None = None) -> DataFrame:
    """The k nearest rows of one vector, exactly, with distance; ties by key. where is applied before. Rows of another length, and nulls, are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vectors.where(where) if where else vectors
    return v.withColumn("distance", METRICS[metric](F.col(vector), q)).where("distance is not null").orderBy("distance", key).limit(k)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cos", vector: str = "embedding", key: str = "vec_id", block_bytes: int = 32 * 1024 * 1024) -> DataFrame:
    """The k nearest rows of each query row: query_id, key, distance, rank. A stated query set, in blocks of bounded bytes, against all rows.

    Each block is one pass over the rows (32 MB are some 60,000 queries of 64 numbers); a task keeps k rows a query. Null vectors, and rows of
    another length than a query's, match nothing.
    """
    spark, out = vectors.sparkSession, None

    def blocks():
        ids, rows, size, dim = [], [], 0, None
        for i, v in queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator():
            if rows and (size > block_bytes or len(v) != dim):
                yield ids, rows
                ids, rows, size = [], [], 0
            dim = len(v)
            ids.append(i)
            rows.append(list(v))
            size += 8 * dim
        if rows:
            yield ids, rows

    for ids, rows in blocks():
        shared = spark.sparkContext.broadcast((np.array(ids), np.array(rows, np.float64)))

        def near(batches, shared=shared):
            ids, every = shared.value
            parts = [(ids[lo : lo + 256], every[lo : lo + 256]) for lo in range(0, len(ids), 256)]
            best: list = [None] * len(parts)
            for b in batches:
                ok = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None and len(v) == every.shape[1] and i is not None]
                if not ok:
                    continue
                keys, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok], np.float64)
                for p, (_, q) in enumerate(parts):
                    best[p] = _nearer(best[p], q, keys, x, k, metric)
            for (mine, _), got in zip(parts, best):
                if got is not None:
                    n = got[0].shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, n)), pa.array(got[1].ravel()), pa.array(got[0].ravel())], names=["query_id", key, "distance"])

        one = vectors.select(key, vector).mapInArrow(near, f"query_id bigint, {key} bigint, distance double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, distance double, rank int")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", key))).where(F.col("rank") <= k)


def _nearer(best, q: np.ndarray, keys: np.ndarray, x: np.ndarray, k: int, metric: str):
    """(distances, keys) of the k nearest rows of each query, among the best so far and rows x."""
    if metric == "cos":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        d = 1 - np.clip(np.divide(q @ x.T, n, out=np.zeros_like(n), where=n > 0), -1, 1)
    elif metric == "dot":
        d = -(q @ x.T)
    else:
        d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T, 0))
    ids = np.broadcast_to(keys, d.shape)
    if best is not None:
        d, ids = np.hstack([best[0], d]), np.hstack([best[1], ids])
    top = np.lexsort((ids, d))[:, :k]
    return np.take_along_axis(d, top, 1), np.take_along_axis(ids, top, 1)


class IvfIndex:
    """An approximate index: rows by nearest of so many centres (fitted on a bounded sample, drawn by hash); searches look into the nearest few cells.

    Every row is indexed. Cells, by default the root of the number of rows, are a column, to be written as partitions; a search reads probes / cells of
    them. How many probes find least of the true neighbours is measured while fitting: the vectors of the sample but for the first HELD_OUT are
    searched, exactly and by cells, for those, and the default of search() is the fewest probes that suffice.
    """

    SAMPLE, HELD_OUT, NEAR = 20_000, 200, 10

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, rounds: int = 10, seed: int = 0, least: float = 0.97):
        self.key, self.vector = key, vector
        ok = vectors.where(F.col(vector).isNotNull())
        cells = cells or max(1, min(4096, int(ok.count() ** 0.5)))
        rows = ok.orderBy(F.xxhash64(F.col(key), F.lit(seed))).limit(self.SAMPLE).select(vector).collect()
        x = np.array([r[0] for r in rows], np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            at = (x @ c.T).argmax(1)
            c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.centres = c
        q, rest = x[: self.HELD_OUT], x[self.HELD_OUT :] if len(x) > 2 * self.HELD_OUT else x
        true = np.argsort(-(q @ rest.T), axis=1)[:, : self.NEAR]
        cell = (rest @ c.T).argmax(1)
        place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)  # of each cell in a query's order
        needed = np.sort(np.take_along_axis(place, cell[true], 1).ravel())
        self.curve = [float((needed < p).mean()) for p in range(1, len(c) + 1)]
        self.probes = next((p for p, r in enumerate(self.curve, 1) if r >= least), len(c))
        self.rows = vectors.withColumn("cell", self._cell(F.col(vector)))

    def _cell(self, v: Column) -> Column:
        shared = self.centres

        @F.pandas_udf("int")
        def cell(xs: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or len(x) != shared.shape[1] else int(np.argmax(shared @ np.asarray(x))) for x in xs], dtype="Int32")

        return cell(v)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, key, distance, rank of about the k nearest rows by cosine."""
        shared, probes = self.centres, probes or self.probes

        @F.pandas_udf("array<int>")
        def nearest(xs: pd.Series) -> pd.Series:
            return pd.Series([np.argsort(-(shared @ np.asarray(x)))[:probes].tolist() for x in xs])

        q = queries.select(F.col(self.key).alias("query_id"), F.col(self.vector).alias("__q"), F.explode(nearest(F.col(self.vector))).alias("cell"))
        d = self.rows.select(self.key, self.vector, "cell").join(q, "cell").withColumn("distance", METRICS["cos"](F.col(self.vector), F.col("__q")))
        return d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", self.key))).where(F.col("rank") <= k).select("query_id", self.key, "distance", "rank")
