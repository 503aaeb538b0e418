"""Lexical index and search: postings, BM25 over prefix terms, fused rankings, neighbours, task relevance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import MAX_TERMS, plain_words, query_terms, stem, stems
from ..model import lookup

#: Weight of each field in the score.
FIELD_WEIGHTS = {"text": 1.0, "why": 0.5, "entities": 2.0, "refs": 1.5}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
FUSION = 60
#: Task relevance: hits that are kept, hits that neighbours are taken of, ranks at which it halves, and its floor.
RETRIEVED, SEEDS, HALVES, FLOOR = 200, 12, 8, 0.02


FIELDS = tuple(FIELD_WEIGHTS)


def token_table(claims: DataFrame, stemmed: bool = True) -> DataFrame:
    """(id, one array of tokens a field, length): what a search reads. Built row by row, without a shuffle."""
    split = stems if stemmed else plain_words
    content = {"text": F.col("text"), "why": F.col("why"), "entities": F.array_join("entities", " "), "refs": F.array_join("refs", " ")}
    rows = claims.select("id", *[split(F.coalesce(content[f], F.lit(""))).alias(f) for f in FIELDS])
    length = sum((F.size(f) for f in FIELDS[1:]), F.size(FIELDS[0]))
    return rows.withColumn("length", length.cast("long"))


def postings(table: DataFrame) -> DataFrame:
    """(token, field, id, tf, length): the inverted index of a token table, to be written sorted by token."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in FIELDS])
    rows = table.select("id", "length", F.explode(parts).alias("p")).select("id", "length", "p.field", F.explode("p.words").alias("token"))
    return rows.groupBy("token", "field", "id", "length").agg(F.count("*").alias("tf"))


#: Folders of the postings: a token's folder is told by its first letter, so a prefix has one too.
SHARDS = 64
#: The folder of what is counted of the documents themselves.
COUNTED = -1
#: A list of postings: of one token and field, by documents that one task has read one after another; ``n`` are in it. Rows of
#: COUNTED have no token: ``n`` are the documents with tokens, ``total`` their lengths.
LISTS = "token string, field string, first string, n long, total long, list array<struct<id: string, tf: long, length: long>>"
_LISTS = pa.schema({"token": pa.string(), "field": pa.string(), "first": pa.string(), "n": pa.int64(), "total": pa.int64(), "list": pa.list_(pa.struct({"id": pa.string(), "tf": pa.int64(), "length": pa.int64()}))})
#: Tokens that a task makes lists of at once; a longer document is by itself.
TOGETHER = 1 << 21


def shard_of(token: Column) -> Column:
    return F.coalesce(F.pmod(F.ascii(token), F.lit(SHARDS)), F.lit(COUNTED)).cast("int")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LISTS of the rows of a token table, so many rows at a time as have TOGETHER tokens."""
    for batch in batches:
        reached, at = np.cumsum(batch.column("length").to_numpy()), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(reached, TOGETHER + (reached[at - 1] if at else 0), "right")))
            part = batch.slice(at, end - at)
            length = part.column("length").to_numpy()
            yield pa.RecordBatch.from_pylist([{"n": int((length > 0).sum()), "total": int(length.sum())}], _LISTS)
            for field in FIELDS:
                if (found := _lists_of(part, field)) is not None:
                    yield found
            at = end


def _lists_of(rows: pa.RecordBatch, field: str) -> pa.RecordBatch | None:
    """LISTS of one field: its tokens as numbers, each with its row, are sorted and counted."""
    words = rows.column(field)
    tokens = words.flatten()
    if not len(tokens):
        return None
    coded, n_rows = tokens.dictionary_encode(), len(words)
    owner = np.repeat(np.arange(n_rows), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n_rows + owner, return_counts=True)
    code, owner = pairs // n_rows, pa.array(pairs % n_rows)
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.append(begins[1:], len(code))
    ids = rows.column("id").take(owner)
    postings = pa.StructArray.from_arrays([ids, pa.array(tf), rows.column("length").take(owner)], ["id", "tf", "length"])
    columns = {
        "token": coded.dictionary.take(pa.array(code[begins])),
        "field": pa.array([field] * len(begins)),
        "first": ids.take(pa.array(begins)),
        "n": pa.array(ends - begins),
        "total": pa.array(np.add.reduceat(tf, begins)),
        "list": pa.ListArray.from_arrays(pa.array(np.append(begins, len(code)).astype(np.int32)), postings),
    }
    return pa.RecordBatch.from_pydict(columns, _LISTS)


@dataclass(frozen=True)
class StoredIndex:
    """A written index: lists of postings by folder, in ranges of tokens, and one row of statistics (n, average)."""

    spark: SparkSession
    folder: str

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(f"{LISTS}, shard int").parquet(f"{self.folder}/postings")

    @property
    def postings(self) -> DataFrame:
        """(token, field, id, tf, length, shard), a row for each posting."""
        return self.lists.where(F.col("shard") != COUNTED).select("token", "field", F.inline("list"), "shard")

    @property
    def size(self) -> int:
        """Postings in all, told by the lengths of the lists."""
        return self.lists.where(F.col("shard") != COUNTED).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    @property
    def statistics(self) -> DataFrame:
        return self.spark.read.schema("n double, average double").parquet(f"{self.folder}/statistics")


def write_index(table: DataFrame, folder: str) -> StoredIndex:
    """Write the postings of a token table (unique ids) in order of token, and its statistics; what was there before is replaced.

    Each task makes lists of the postings of its rows, so nothing is shuffled but lists, and the rows are read for the ranges
    and for the lists only. Ranges are by token and then id, so a token that most claims have is spread over several files.
    The statistics are summed of counts beside the lists. Without claims there are no postings, and the statistics count none.
    """
    index, order = StoredIndex(table.sparkSession, folder), ("shard", "token", "first")
    found = table.select("id", *FIELDS, "length").mapInArrow(_lists, LISTS).withColumn("shard", shard_of(F.col("token")))
    found.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/postings")
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("double")
    counted = index.lists.where(F.col("shard") == COUNTED).agg(n.alias("n"), F.when(n > 0, F.sum("total") / n).alias("average"))
    counted.write.mode("overwrite").parquet(f"{folder}/statistics")
    return index


def _terms_of(terms: list[str], stemmed: bool) -> list[str]:
    return list(dict.fromkeys(stem(t) for t in terms) if stemmed else dict.fromkeys(terms))


def _scored(rows: DataFrame, totals: DataFrame, n_terms: int) -> DataFrame:
    """(id, matched, score) of rows (id, length, wtf array) with a hit, under one row of statistics (n, average, df array)."""
    found = rows.where(F.exists("wtf", lambda x: x > 0)).crossJoin(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for k in range(n_terms):
        wtf, df = F.col("wtf")[k], F.col("df")[k]
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + F.when(wtf > 0, idf * wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * F.col("length") / F.col("average")))).otherwise(0.0)
    return found.select("id", F.size(F.filter("wtf", lambda x: x > 0)).cast("long").alias("matched"), score.alias("score"))


def bm25(table: DataFrame | StoredIndex, terms: list[str], stemmed: bool = True, fields: tuple[str, ...] = FIELDS, exact: bool = False) -> DataFrame:
    """(id, matched, score) of the claims with any of the terms; terms are prefixes unless ``exact``.

    ``table`` is a token table, read whole, or a stored index, of which only the ranges of the terms are read. The statistics are
    over all of it, one row. Term frequencies of a token table are expressions on a row, so nothing is shuffled; of an
    index the matching postings are summed by claim. Without terms, or in an empty table, nothing is found.
    """
    terms = _terms_of(terms, stemmed)
    if isinstance(table, StoredIndex):
        return _bm25_stored(table, terms, fields, exact)
    if not terms:
        return table.select("id", F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("score")).limit(0)
    hit = lambda t: (lambda w: w == t) if exact else (lambda w: w.startswith(t))
    weighted = [sum((F.lit(FIELD_WEIGHTS[f]) * F.size(F.filter(f, hit(t))) for f in fields), F.lit(0.0)) for t in terms]
    rows = table.select("id", "length", F.array(*weighted).alias("wtf"))
    frequencies = [F.count_if(F.col("wtf")[k] > 0).cast("double") for k in range(len(terms))]
    totals = rows.where("length > 0").agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("average"), F.array(*frequencies).alias("df"))
    return _scored(rows, totals, len(terms))


def _bm25_stored(index: StoredIndex, terms: list[str], fields: tuple[str, ...], exact: bool) -> DataFrame:
    token, weight = F.col("token"), lookup(FIELD_WEIGHTS, "field", 0.0)
    if not terms:
        return index.postings.select("id", F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("score")).limit(0)
    hits = [token == t if exact else token.startswith(t) for t in terms]
    wanted = F.lit(False)
    for t, hit in zip(terms, hits, strict=True):
        wanted = wanted | ((F.col("shard") == ord(t[0]) % SHARDS) & hit)
    read = index.postings.where(wanted)
    read = read if set(fields) == set(FIELDS) else read.where(F.col("field").isin(*fields))
    sums = [F.sum(F.when(hit, weight * F.col("tf")).otherwise(0.0)) for hit in hits]
    rows = read.groupBy("id").agg(F.first("length").alias("length"), F.array(*sums).alias("wtf"))
    # lengths are never null: the condition keeps the two uses of ``rows`` alike, so that its shuffle is used again
    frequencies = rows.where("length IS NOT NULL").agg(F.array(*[F.coalesce(F.count_if(F.col("wtf")[k] > 0), F.lit(0)).cast("double") for k in range(len(terms))]).alias("df"))
    return _scored(rows, index.statistics.crossJoin(F.broadcast(frequencies)), len(terms))  # one row each


def ranked(rows: DataFrame, order: list[Column], depth: int, name: str = "rank") -> DataFrame:
    """The first ``depth`` rows with their place from 1: the limit comes first, so the window sees few rows."""
    return rows.orderBy(*order).limit(depth).withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def fuse(lists: list[DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists: (id, score, rank), ties to the newer id."""
    out = lists[0].select("id", "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select("id", "rank"))
    scores = out.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(FUSION) + F.col("rank"))).alias("score"))
    return ranked(scores, [F.desc(F.round("score", 12)), F.desc("id")], limit)


def search(index: DataFrame | StoredIndex, claims: DataFrame, query: str, limit: int = 50, stemmed: bool = True) -> DataFrame:
    """Claims for a free-text query, best first (column ``rank``).

    Two passes, claims with every term and claims with any, are fused by rank. ``claims`` holds those that
    pass the caller's filter; statistics are of the whole token table or stored index.
    """
    terms = query_terms(query)
    depth = max(4 * limit, 50)
    found = bm25(index, terms, stemmed).join(claims.select("id"), "id", "left_semi")
    order = [F.desc(F.round("score", 9)), F.desc("id")]
    lists = [ranked(found, order, depth)]
    wanted = len(dict.fromkeys(stem(t) for t in terms)) if stemmed else len(terms)
    if wanted > 1:
        lists.insert(0, ranked(found.where(F.col("matched") == wanted), order, depth))
    return fuse(lists, limit).join(claims, "id").orderBy("rank")


def keyword_search(claims: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The simple search of remote surfaces: most distinct query words first, then the newest."""
    wanted = list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", query.lower())))
    have = F.array_union(plain_words("text"), F.array_union(plain_words(F.coalesce("why", F.lit(""))), F.array_union(plain_words(F.array_join("entities", " ")), plain_words(F.array_join("refs", " ")))))
    rows = claims.withColumn("matched", F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in wanted]))) if wanted else F.lit(0))
    return rows.where("matched > 0").orderBy(F.desc("matched"), F.desc("id")).limit(limit)


def neighbors(claims: DataFrame, seeds: DataFrame, limit: int, passing: Column | None = None) -> DataFrame:
    """Claims one hop from ``seeds`` (ids): along supersession first, then by shared tags and files.

    ``passing`` filters the second pass only. (id, hop, shared), in order. Seeds may be any number of rows, repeated or
    null: their joins are by size, and only the MAX_TERMS tags are broadcast. Null lists have no tags; an empty
    table on either side gives no rows.
    """
    at = seeds.select("id").distinct()
    edges = claims.where("supersedes IS NOT NULL").select(F.col("id").alias("src"), F.col("supersedes").alias("dst"))
    forward = edges.join(at, edges.src == at.id).select(F.col("dst").alias("id"))
    back = edges.join(at, edges.dst == at.id).select(F.col("src").alias("id"))
    history = forward.union(back).distinct().withColumns({"hop": F.lit(0), "shared": F.lit(0).cast("long")})
    marks = F.array_distinct(F.transform(F.array_union(F.coalesce("entities", F.array().cast("array<string>")), F.coalesce("refs", F.array().cast("array<string>"))), F.lower))
    tags = claims.join(at, "id", "left_semi").select("id", F.explode(marks).alias("tag")).where(F.length("tag") > 1)
    tags = tags.groupBy("tag").agg(F.min("id").alias("first")).orderBy("first", "tag").limit(MAX_TERMS).select("tag")
    pool = claims if passing is None else claims.where(passing)
    tagged = pool.select("id", F.explode(marks).alias("tag")).join(F.broadcast(tags), "tag").groupBy("id").agg(F.count("*").alias("shared")).withColumn("hop", F.lit(1)).select("id", "hop", "shared")
    both = history.unionByName(tagged).join(at, "id", "left_anti")
    best = both.groupBy("id").agg(F.min(F.struct("hop", F.negative("shared").alias("s"))).alias("b"), F.max("shared").alias("shared"))
    return best.select("id", F.col("b.hop").alias("hop"), "shared").orderBy("hop", F.desc("shared"), F.desc("id")).limit(limit)


def task_relevance(index: DataFrame | StoredIndex, claims: DataFrame, pool: DataFrame, task: str, stemmed: bool = True) -> DataFrame:
    """(id, relevance) of each claim in the pool for a task: hits halve every HALVES ranks, neighbours of the best
    hits come after the hits, all others have the floor."""
    ids = pool.select("id").distinct()
    hits = search(index, claims, task, RETRIEVED * 4, stemmed).select("id", "rank").join(ids, "id", "left_semi")
    hits = ranked(hits.select("id", F.col("rank").alias("_r")), [F.col("_r")], RETRIEVED).persist()  # RETRIEVED rows, used four times
    around = neighbors(claims, hits.where(F.col("rank") <= SEEDS), RETRIEVED).join(ids, "id", "left_semi").join(hits.select("id"), "id", "left_anti")
    count = hits.agg(F.count("*").alias("n_hits"))
    after = ranked(around, [F.col("hop"), F.desc("shared"), F.desc("id")], RETRIEVED, "at").crossJoin(F.broadcast(count)).select("id", (F.col("at") + F.col("n_hits")).alias("rank"))
    order = hits.select("id", "rank").unionByName(after.select("id", F.col("rank").cast("int").alias("rank")))
    curve = F.pow(F.lit(0.5), (F.col("rank") - 1) / F.lit(float(HALVES)))
    return ids.join(F.broadcast(order), "id", "left").select("id", F.coalesce(curve, F.lit(FLOOR)).alias("relevance"))
