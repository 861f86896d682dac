"""A stored full-text index: postings in files sorted by term, so that a query reads only the row groups its words lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import files
from .search import B, K1, Node, parse_query, stemmed, terms_of, tokens


class TextIndex:
    """Postings under a path: term, column, key, positions, and the document's length in words over all columns.

    Postings are range-partitioned by term and key, so a word that stands in a third of all documents is spread over many files. Null texts have no
    words; documents without words count among all documents. Keys are unique.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.about = files.get(spark, f"{self.path}/meta/index.json")

    @classmethod
    def build(cls, docs: DataFrame, key: str, columns: list[str], path: str, tokenizer: str = "unicode61") -> "TextIndex":
        words = docs.select(F.col(key), *[tokens(F.col(c), tokenizer).alias(f"__w{i}") for i, c in enumerate(columns)])
        words = words.withColumn("len", sum((F.size(f"__w{i}") for i in range(len(columns))), F.lit(0)))
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__w{i}").alias("words")) for i, c in enumerate(columns)])).alias("c")
        flat = words.select(key, "len", each).select(key, "len", "c.column", F.posexplode("c.words").alias("pos", "term"))
        rows = flat.groupBy("term", "column", key, "len").agg(F.sort_array(F.collect_list("pos")).alias("at"))
        rows.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").option("parquet.block.size", 16 * 1024 * 1024).parquet(f"{path}/postings")
        n, length = words.agg(F.count("*"), F.avg("len")).first()
        files.remove(docs.sparkSession, f"{path}/meta")
        files.put(docs.sparkSession, f"{path}/meta/index.json", {"key": key, "columns": columns, "tokenizer": tokenizer, "documents": n, "avg_len": length or 0.0})
        return cls(docs.sparkSession, path)

    def _postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def _rows(self, n: Node) -> DataFrame:
        rows = self._postings().where(F.col("term").startswith(n.words[0]) if n.kind == "prefix" else F.col("term").isin(*n.words))
        return rows.where(F.col("column") == n.column) if n.column else rows

    def _keys(self, n: Node) -> DataFrame:
        key = self.about["key"]
        if n.kind in ("and", "or", "not"):
            out = self._keys(n.parts[0])
            for p in n.parts[1:]:
                other = self._keys(p)
                out = out.unionByName(other).distinct() if n.kind == "or" else out.join(other, key, "left_semi" if n.kind == "and" else "left_anti")
            return out
        if n.kind != "prefix" and not n.words:
            return self._postings().select(key).limit(0)
        if n.kind in ("term", "prefix"):
            return self._rows(n).select(key).distinct()
        # Of each document and column the places of the query's words: as many arrays as the query has words.
        of = self._rows(n).groupBy(key, "column").agg(F.collect_list(F.struct("term", "at")).alias("w"))
        at = lambda t: F.flatten(F.transform(F.filter("w", lambda x: x["term"] == t), lambda x: x["at"]))
        if n.kind == "phrase":
            holds = F.exists(at(n.words[0]), lambda p: _all([F.array_contains(at(t), p + i) for i, t in enumerate(n.words) if i]))
        else:
            holds = F.exists(F.flatten(F.transform("w", lambda x: x["at"])), lambda p: _all([F.exists(at(t), lambda q: (q >= p) & (q <= p + n.distance)) for t in dict.fromkeys(n.words)]))
        return of.where(holds).select(key).distinct()

    def _parsed(self, query: str) -> Node:
        n = parse_query(query)
        return stemmed(n) if self.about["tokenizer"] == "porter" else n

    def match(self, query: str) -> DataFrame:
        """Keys of the documents a query holds for."""
        return self._keys(self._parsed(query))

    def bm25(self, query: str, weights: dict[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """key and score of documents the query holds for, as operators.search.bm25() scores them."""
        terms, key, n, avg = terms_of(query, self.about["tokenizer"]), self.about["key"], self.about["documents"], self.about["avg_len"]
        rows = self._postings().where(F.col("term").isin(*terms)) if terms else self._postings().limit(0)
        df = F.broadcast(rows.groupBy("term").agg(F.count("*").alias("df")))  # a row a word of the query
        weight = F.lit(1.0)
        for c, w in (weights or {}).items():
            weight = F.when(F.col("column") == c, F.lit(float(w))).otherwise(weight)
        idf, tf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), F.size("at")
        part = weight * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(avg)))
        scores = rows.join(df, "term").groupBy(key).agg(F.sum(part).alias("score"))
        return self.match(query).join(scores, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def _all(xs):
    out = F.lit(True)
    for x in xs:
        out = out & x
    return out
