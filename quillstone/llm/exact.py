"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition sorts the digests of its rows into runs, cut by digest range into buckets. In binomial
rounds, run i + 2**k goes to where run i is, and the runs that meet are merged as streams: their blocks arrive in
order of their first digest, so only blocks that overlap are held. A digest that several runs hold keeps the
verified smallest identifier and the sum of the counts, so after each round a run has one record a digest,
however often it was copied. After the last round each bucket has one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import join_groups, map_batches, materialize, partitions, sized_join

#: Words of a record: four of SHA-256, text length and second hash (the verification), then the order
#: of the identifier, the row it is on, and the number of rows.
DIGEST, SAME, ORDER, ROW, COUNT = slice(0, 4), 6, 6, 7, 8
WORDS = 9
RUN = "bucket int, run int, head binary, records binary"
#: Order of a null identifier: it stays only if its group has no other.
LAST = (1 << 63) - 1
#: Records of one block of a run, and bytes of one bucket (a bucket's share of all records, on average).
BLOCK = 1 << 13
BUCKET_BYTES = 32 << 20


def keys(rows: np.ndarray, words: int) -> np.ndarray:
    """The first ``words`` words of each record as bytes that sort as the words do."""
    return np.ascontiguousarray(rows[:, :words].astype(">u8")).view(f"S{8 * words}").ravel()


def _one_of_each(rows: np.ndarray) -> np.ndarray:
    """Of sorted records with equal digest, length and second hash the first, with their number."""
    if not len(rows):
        return rows
    first = np.flatnonzero(np.r_[True, (rows[1:, :SAME] != rows[:-1, :SAME]).any(axis=1)])
    out = rows[first]
    out[:, COUNT] = np.add.reduceat(rows[:, COUNT], first)
    return out


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of sorted runs, two at a time as in a tournament: a digest that several hold becomes one record."""
    runs = list(runs) or [np.empty((0, WORDS), np.uint64)]
    while len(runs) > 1:
        met = []
        for a, b in zip(runs[::2], runs[1::2], strict=False):
            at = np.searchsorted(keys(a, COUNT), keys(b, COUNT), "right")
            met.append(_one_of_each(np.insert(a, at, b, axis=0)))
        runs = met + (runs[-1:] if len(runs) % 2 else [])
    return runs[0]


def merge_stream(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The merge of runs whose blocks arrive in order of their first record: what no later block can hold goes on."""
    held: list[np.ndarray] = []
    for block in blocks:
        head = keys(block[:1], SAME)
        done, rest = [], [block]
        for rows in held:
            cut = int(np.searchsorted(keys(rows, SAME), head, "left")[0])
            done += [rows[:cut]] * (cut > 0)
            rest += [rows[cut:]] * (cut < len(rows))
        if done:
            yield merge(done)
        held = rest
    if held:
        yield merge(held)


def _sorted_run(rows: np.ndarray) -> np.ndarray:
    return _one_of_each(rows[np.argsort(keys(rows, COUNT), kind="stable")])


def _row(bucket: int, run: int, rows: np.ndarray) -> tuple:
    return bucket, run, rows[0, :SAME].astype(">u8").tobytes(), rows.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["bucket", "run", "head", "records"])


def _leaf_runs(buckets: int, leaves: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = (TaskContext.get().partitionId() if TaskContext.get() else 0) % leaves
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = _sorted_run(np.concatenate(held))
            held.clear()
            bucket = (rows[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            yield _batch([_row(b, leaf, rows[low : min(low + BLOCK, cuts[b + 1])]) for b in range(buckets) for low in range(cuts[b], cuts[b + 1], BLOCK)])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = np.empty((n, WORDS), np.uint64)
            rows[:, DIGEST] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(n, 4)
            for k, name in ((4, "length"), (5, "second"), (ORDER, "place"), (ROW, "row_id")):
                # the sign bit is turned over, so that unsigned order is signed order
                rows[:, k] = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
            rows[:, COUNT] = 1
            held.append(rows)
            if sum(map(len, held)) >= flush:
                yield from out()
        if held:
            yield from out()

    return run


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each (bucket, run); rows are sorted by these and by head."""
    from itertools import groupby

    rows = (r for batch in batches for r in zip(*(batch.column(n).to_pylist() for n in ("bucket", "run", "records")), strict=True))
    for (bucket, run), group in groupby(rows, key=lambda r: r[:2]):
        for merged in merge_stream(np.frombuffer(r[2], np.uint64).reshape(-1, WORDS) for r in group):
            yield _batch([_row(bucket, run, merged[low : low + BLOCK]) for low in range(0, len(merged), BLOCK)])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("records").to_pylist():
            rows = np.frombuffer(blob, np.uint64).reshape(-1, WORDS)
            rows = rows[rows[:, COUNT] > 1]
            digests = [x.tobytes() for x in rows[:, DIGEST].astype(">u8")]
            signed = lambda k, rows=rows: pa.array((rows[:, k] ^ np.uint64(1 << 63)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), signed(4), signed(5), signed(ORDER), signed(ROW), pa.array(rows[:, COUNT].astype(np.int64))], ["digest", "length", "second", "best", "best_row", "group_size"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", leaves: int = 256, fan_in: int = 2, flush: int = 1 << 18) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal if their SHA-256, byte length and xxHash64 are; null counts as the empty text. Of
    equal texts the row with the ``keep`` ("smallest" or "largest") identifier stays; a null identifier
    stays only in a group without others, and of rows that repeat the same identifier one stays. An
    empty table gives no rows; other columns are neither read nor returned.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.col(id_col).cast("long")
    place = ident if keep == "smallest" else F.bitwise_not(ident)
    keys = materialize(
        docs.select(
            ident.alias("ident"),
            F.coalesce(place, F.lit(LAST)).alias("place"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("length"),
            F.xxhash64(text).alias("second"),
            F.monotonically_increasing_id().alias("row_id"),
        )
    )
    return _resolve(keys, keep, leaves, fan_in, flush).select(F.col("ident").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _resolve(keys: DataFrame, keep: str, leaves: int, fan_in: int, flush: int) -> DataFrame:
    rows, last = keys.select(F.spark_partition_id().alias("part")).agg(F.count("*"), F.max("part")).first()
    spark = keys.sparkSession
    buckets = max(partitions(spark), -(-rows * 8 * WORDS // BUCKET_BYTES))
    leaves = min(leaves, (last or 0) + 1)
    runs, distance = map_batches(keys, _leaf_runs(buckets, leaves, flush), RUN), 1
    while distance == 1 or distance < leaves:
        # run i + distance * j meets run i; the first round also merges the runs of one leaf, so it is never left out
        distance *= fan_in
        met = runs.withColumn("run", F.col("run") - F.col("run") % distance)
        runs = map_batches(met.repartition(partitions(spark), "bucket", "run").sortWithinPartitions("bucket", "run", "head"), _merge_runs, RUN)
    groups = materialize(map_batches(runs, _records, "digest binary, length long, second long, best long, best_row long, group_size long"))
    joined = join_groups(keys, groups, ["digest", "length", "second"], "group_size", rows)
    best = F.when(F.col("best") != LAST, F.col("best") if keep == "smallest" else F.bitwise_not(F.col("best")))
    single = F.col("group_size").isNull()
    return joined.select(
        "ident",
        "digest",
        "row_id",
        F.when(single, F.col("ident")).otherwise(best).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row_id") == F.col("best_row"))).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by ``id_col``: of rows with the same identifier and the same text one stays, a
    row with the same identifier and another text is another document. Null and empty texts are one text; a null
    identifier stays only where its text has no other; ties can't occur, since rows with equal identifiers and texts
    are repeated rows. An empty table gives no rows, and texts may have any length.
    """
    found = exact_duplicates(docs, id_col, text_col, keep)
    gone = materialize(found.where(~F.col("kept")).select(F.col(id_col).alias("ident"), F.col("text_sha256").alias("digest"), (F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("again")))
    filled = F.coalesce("ident", F.lit(LAST)).alias("ident")
    lost, twice = (materialize(gone.where(which).select(filled, "digest").distinct()) for which in (~F.col("again"), F.col("again")))
    n_lost, n_twice = lost.count(), twice.count()
    # the input's columns by number, so that no name can clash with these two
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    ident, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    marked = numbered.select("*", F.coalesce(ident.cast("long"), F.lit(LAST)).alias("ident"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))
    out = sized_join(marked, lost, ["ident", "digest"], "left_anti", n_lost)
    if n_twice:  # rows repeated whole: one of each stays
        one = sized_join(out, twice, ["ident", "digest"], "left_semi", n_twice).dropDuplicates(["ident", "digest"])
        out = sized_join(out, twice, ["ident", "digest"], "left_anti", n_twice).unionByName(one)
    return out.select(*numbered.columns).toDF(*docs.columns)
