"""Near-duplicate groups by Order MinHash, verified by banded alignment.

The k-mers of a text are its windows of five lower-case words, each labelled with the number of its
occurrence. Each of SKETCHES hash functions picks the PICKED k-mers with the smallest values and keeps them
in text order; the hash of that sequence is one sketch. Texts with an equal sketch are a candidate pair;
a pair is a link if the banded alignment of its k-mer sequences has at least ``similarity`` of their
union in common. A text of at most SHORT k-mers has keys beside its sketches, of all its k-mers and of all but
each one, so that none of its similar texts as short is missed.

Texts with the same words are one node. In a bucket (the nodes with an equal sketch) no pairs are made:
each node is compared with a hub, the member that sits in the largest buckets, and linked nodes become
components. Members outside their bucket's main component are then compared with all its members, in
blocks, by products of 0/1 matrices, and only links come out; so each candidate pair was compared or is in
one component anyway.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import word_hashes
from .graph import components
from .runtime import join_groups, map_batches, materialize, mix64, sized_join, texts, word_windows

WORDS = 5
SKETCHES, PICKED = 16, 4
#: Up to so many k-mers, texts at least 0.8 similar differ by at most one k-mer, at one end of the pair.
SHORT = 8
#: Members compared with one hub in one task.
CHUNK = 256
_SEEDS = mix64(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64))
_XOR, _ODD = _SEEDS[:SKETCHES, None], _SEEDS[SKETCHES:, None] | np.uint64(1)
SKETCHED = "row_id long, doc_id long, text_key long, digest binary, kmers long, sketches array<long>"


def label(kmers: np.ndarray) -> np.ndarray:
    """K-mer hashes in which every occurrence after the first has a value of its own."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    same = np.r_[False, ranked[1:] == ranked[:-1]] if len(ranked) else np.empty(0, bool)
    if not same.any():
        return kmers
    at = np.arange(len(ranked))
    occurrence = at - np.maximum.accumulate(np.where(same, 0, at))
    out = kmers.copy()
    out[order] ^= np.where(occurrence > 0, mix64(occurrence.astype(np.uint64)), np.uint64(0))
    return out


def sketch(kmers: np.ndarray) -> np.ndarray:
    """One hash per hash function: its PICKED smallest labelled k-mers, in text order."""
    held_v = held_at = None
    for low in range(0, len(kmers), 1 << 16):
        v = (kmers[None, low : low + (1 << 16)] ^ _XOR) * _ODD
        at = np.broadcast_to(np.arange(low, low + v.shape[1]), v.shape)
        if v.shape[1] > PICKED:
            some = np.argpartition(v, PICKED - 1, axis=1)[:, :PICKED]
            v, at = np.take_along_axis(v, some, 1), some + low
        held_v, held_at = (v, at) if held_v is None else (np.concatenate([held_v, v], 1), np.concatenate([held_at, at], 1))
        if held_v.shape[1] > PICKED:
            some = np.argpartition(held_v, PICKED - 1, axis=1)[:, :PICKED]
            held_v, held_at = np.take_along_axis(held_v, some, 1), np.take_along_axis(held_at, some, 1)
    picked = kmers[np.sort(held_at, axis=1)]
    out = _XOR[:, 0].copy()
    for k in range(picked.shape[1]):
        out = mix64(out + picked[:, k])
    return out


def short_keys(kmers: np.ndarray) -> np.ndarray:
    """Hashes of a short text's k-mers in order, of all and of all but each one."""
    n = len(kmers)
    if not 0 < n <= SHORT:
        return np.empty(0, np.uint64)
    out = np.full(n + 1, 0x2545F4914F6CDD1D, np.uint64)
    for k in range(n):
        out = np.where(np.arange(n + 1) == k, out, mix64(out + kmers[k]))
    return np.unique(out)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Share of the union of two labelled k-mer sequences that their alignment has in common.

    Labelled k-mers occur once, so the alignment is the longest chain of matches that ascends in both. An
    alignment good enough leaves out at most (1 - s) / (1 + s) of both lengths together, so no match farther
    off the diagonal can be in it: that is the band. 0 if the sequences can't be similar enough.
    """
    total = len(a) + len(b)
    least = similarity * total / (1 + similarity)
    if min(len(a), len(b)) < least - 1e-9:
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    place = order[at]
    i = np.flatnonzero(b[place] == a)
    j = place[i]
    near = np.abs(i - j) <= (1 - similarity) / (1 + similarity) * total + 1
    j = j[near]
    if len(j) < least - 1e-9:
        return 0.0
    if (np.diff(j) > 0).all():
        common = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        common = len(tails)
    return common / (total - common)


def _kmers(words: np.ndarray) -> np.ndarray:
    return label(word_windows(words, WORDS))


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from . import textvec

    for b in batches:
        values = texts(b.column("text"))
        digests, counts, rows = [], [], []
        for low, high in textvec.batches(values):
            hashes, at = word_hashes(values[low:high])
            for k in range(high - low):
                words = hashes[at[k] : at[k + 1]]
                if len(words):
                    n = np.arange(1, len(words) + 1, dtype=np.uint64)
                    digest = np.array([np.bitwise_xor.reduce(mix64(words ^ mix64(n))), mix64(words + n).sum() + n[-1]], np.uint64).tobytes()
                else:  # no word: only an equal text is the same
                    import hashlib

                    digest = hashlib.sha256(values[low + k].encode("utf-8", "surrogatepass")).digest()
                kmers = _kmers(words)
                digests.append(digest)
                counts.append(len(kmers))
                rows.append(np.concatenate([sketch(kmers), short_keys(kmers)]).view(np.int64) if len(kmers) else np.empty(0, np.int64))
        ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), b.column("text_key"), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), lists], ["row_id", "doc_id", "text_key", "digest", "kmers", "sketches"])


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_kmers = None, np.empty(0, np.uint64)
        for b in batches:
            rows = []
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                hashes, at = word_hashes(texts(part.column("text")))
                for k, (h, node, member) in enumerate(zip(part.column("hub").to_pylist(), part.column("node").to_pylist(), part.column("member").to_pylist(), strict=True)):
                    kmers = _kmers(hashes[at[k] : at[k + 1]])
                    if not member:
                        hub, hub_kmers = h, kmers
                    elif hub == h:
                        found = aligned(hub_kmers, kmers, similarity)
                        if found >= similarity - 1e-9:
                            rows.append((h, node, found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return run


def _compare(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The links among ``pairs`` (hub, node); ``found`` has the node and text of each."""
    cut = pairs.withColumn("chunk", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK)).cast("long")))
    heads = cut.select("hub", "chunk").distinct().join(found, F.col("hub") == F.col("node")).select("hub", "chunk", F.col("hub").alias("node"), F.lit(False).alias("member"), "text")
    members = cut.join(found, "node").select("hub", "chunk", "node", F.lit(True).alias("member"), "text")
    # a member may be dealt on its own; the head of each (hub, chunk) comes first
    rows = heads.unionByName(members).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "member")
    return materialize(map_batches(rows.select("hub", "node", "member", "text"), _verify(similarity), "a long, b long, similarity double"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, class_id, class_size, n_links, kept.

    A class is a component of links and of equal word sequences; class_id is its smallest identifier and
    that row is the one kept (of rows that repeat it the first read). n_links counts the verified links
    of the row's distinct text that were needed to connect its class. Texts of fewer than five words are
    near only to texts with the same words, texts without a word only to equal texts; null counts as empty. A null identifier
    is in a class like any other and names it only if the class has no other. No rows give no rows.
    """
    ident = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(ident.alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = materialize(map_batches(keyed.withColumn("row_id", F.monotonically_increasing_id()), _sketch_rows, SKETCHED))
    # the identifiers alone are aggregated; the chosen rows' sketches are joined to them
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    chosen = rows.groupBy("digest").agg(F.min(first).alias("f"), F.count("*").alias("copies")).select(F.col("f.row_id").alias("row_id"), "copies")
    nodes = materialize(rows.join(chosen, "row_id").withColumnRenamed("row_id", "node"))
    links = _link(keyed, nodes, similarity)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    graph = components(links.select("a", "b")).join(degree, "node", "left")
    rooted = nodes.select("digest", "copies", "node", "doc_id").join(graph, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted)
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("m"), F.sum("copies").alias("class_size"))
    classes = materialize(join_classes(rooted, best))
    out = join_groups(rows.select("row_id", "doc_id", "digest"), classes, ["digest"], "copies", rows.count())
    return out.select(F.col("doc_id").alias(id_col), "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("row_id") == F.col("keeper")).alias("kept"))


def join_classes(rooted: DataFrame, best: DataFrame) -> DataFrame:
    """For each distinct text: its class, by way of the number of texts in it (one class may hold most)."""
    sizes = rooted.groupBy("root").agg(F.count("*").alias("texts"))
    groups = materialize(best.join(sizes, "root").select("root", "texts", "class_size", F.col("m.doc_id").alias("class_id"), F.col("m.node").alias("keeper")))
    return join_groups(rooted.select("digest", "copies", "root", "n_links"), groups, ["root"], "texts", max(1, rooted.count())).drop("texts", "root")


def _comparable(a: str, b: str, similarity: float):
    """Whether two texts with so many k-mers can be similar enough at all."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _link(keyed: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b, similarity) between nodes that connect all candidate pairs that are similar."""
    total = nodes.count()
    member = nodes.select("node", "kmers", F.explode("sketches").alias("sketch")).distinct()
    sizes = materialize(member.groupBy("sketch").agg(F.count("*").alias("size")).where("size > 1"))
    inside = materialize(join_groups(member, sizes, ["sketch"], "size", (SKETCHES + SHORT + 1) * max(1, total)).where("size IS NOT NULL"))
    n_inside = inside.count()
    if not n_inside:
        return keyed.sparkSession.createDataFrame([], "a long, b long, similarity double")
    no_id = F.lit(-(1 << 63))
    wanted = materialize(inside.select("node").distinct().join(nodes.select("node", "doc_id", "text_key"), "node").select("node", F.coalesce("doc_id", no_id).alias("doc_id"), "text_key"))
    keyed = keyed.withColumn("doc_id", F.coalesce("doc_id", no_id))
    found = materialize(sized_join(keyed, wanted, ["doc_id", "text_key"], "inner", wanted.count()).dropDuplicates(["node"]).select("node", "text"))
    # the hub of a bucket: its member with the most company in all its buckets, which near copies of one text gather around
    weighed = inside.join(inside.groupBy("node").agg(F.sum("size").alias("weight")), "node")
    best = F.struct("weight", F.negative("node"))
    hubs = materialize(weighed.groupBy("sketch").agg(F.max_by("node", best).alias("hub"), F.max_by("kmers", best).alias("hub_kmers"), F.max("size").alias("members")))
    tested = materialize(join_groups(inside, hubs, ["sketch"], "members", n_inside))
    pairs = tested.where((F.col("node") != F.col("hub")) & _comparable("kmers", "hub_kmers", similarity)).groupBy("hub", "node").agg(F.max("size").alias("size"))
    links = _compare(pairs, found, similarity)
    rooted = _rooted(tested, components(links.select("a", "b")), total)
    kinds = rooted.groupBy("sketch", "root").agg(F.count("*").alias("n"), F.sum("kmers").alias("k")).groupBy("sketch").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("own"), F.sum("k").alias("words"))
    split = materialize(kinds.where(F.col("main.n") < F.col("own")).select("sketch", F.col("main.root").alias("main"), "own", "words"))
    if not split.count():
        return links
    # members outside a bucket's main component, against all its members, in blocks
    active = join_groups(rooted.select("sketch", "node", "kmers", "root"), split, ["sketch"], "own", n_inside).where("own IS NOT NULL")
    return materialize(links.unionByName(_compare_blocks(materialize(active), found, similarity)))


def _rooted(members: DataFrame, graph: DataFrame, total: int) -> DataFrame:
    """Members of buckets with the component that each node is in."""
    return materialize(members.join(graph, "node", "left").withColumn("root", F.coalesce("root", "node")))


#: Members of a bucket, and words of theirs, in one block (on average); a task compares two blocks.
BLOCK, BLOCK_WORDS = 512, 500_000


def _compare_blocks(active: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Links between different components of a bucket: each block of members that are outside its main
    component meets each block of all members. What is emitted are links, not pairs."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("own") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    dealt = active.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("blocks", blocks)
    outside = F.col("root") != F.col("main")
    left = dealt.where(outside).select("sketch", "node", "root", F.lit(True).alias("query"), F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r"))
    # only blocks that hold a member outside the main component ask
    asking = materialize(dealt.where(outside).groupBy("sketch").agg(F.max("own").alias("own"), F.collect_set("block").alias("asking")))
    right = join_groups(dealt.drop("own"), asking, ["sketch"], "own", max(1, dealt.count())).where("asking IS NOT NULL").select("sketch", "node", "root", F.lit(False).alias("query"), F.explode("asking").alias("q"), F.col("block").alias("r"))
    rows = left.unionByName(right).join(found, "node")
    return materialize(rows.groupBy("sketch", "q", "r").applyInArrow(_block_links(similarity), "a long, b long, similarity double"))


def _block_links(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        root = group.column("root").to_numpy()
        query = group.column("query").to_numpy().astype(bool)
        hashes, at = word_hashes(texts(group.column("text").combine_chunks()))
        kmers = [_kmers(hashes[at[k] : at[k + 1]]) for k in range(len(node))]
        ask, all_ = np.flatnonzero(query), np.flatnonzero(~query)
        size = np.array([len(k) for k in kmers], float)
        common = _common([kmers[i] for i in ask], [kmers[i] for i in all_])
        # as sets, no order yet: an upper bound of the alignment
        near = common >= (similarity * (size[ask][:, None] + size[all_][None, :]) / (1 + similarity) - 1e-6)
        near &= (root[ask][:, None] != root[all_][None, :]) & (node[ask][:, None] != node[all_][None, :])
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        rows = []
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = ask[i], all_[j]
            p, q = top(int(root[x])), top(int(root[y]))
            if p != q and (found := aligned(kmers[x], kmers[y], similarity)) >= similarity - 1e-9:
                parent[max(p, q)] = min(p, q)
                rows.append((int(node[x]), int(node[y]), found))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())))})

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of k-mers that each of ``a`` has in common with each of ``b``, by products of 0/1 matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    all_a, all_b = np.concatenate([np.empty(0, np.uint64), *a]), np.concatenate([np.empty(0, np.uint64), *b])
    shared = np.intersect1d(all_a, all_b)

    def cells(values: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        return row[hit], at[hit]

    row_a, col_a = cells(all_a, a)
    row_b, col_b = cells(all_b, b)
    for low in range(0, len(shared), 4096):
        width = min(4096, len(shared) - low)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        some = (col_a >= low) & (col_a < low + width)
        x[row_a[some], col_a[some] - low] = 1
        some = (col_b >= low) & (col_b < low + width)
        y[row_b[some], col_b[some] - low] = 1
        out += x @ y.T
    return out


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the kept identifiers, with all their columns.

    Rows are told apart by ``id_col``: rows that share an identifier stay or go together, and go only if
    none of them is kept; a null identifier stays.
    """
    found = materialize(near_duplicates(docs, similarity, id_col, text_col).select(F.col(id_col).alias("_id"), "kept"))
    gone = materialize(found.groupBy("_id").agg(F.max("kept").alias("kept")).where("NOT kept AND _id IS NOT NULL").select(F.col("_id").alias(id_col)))
    return sized_join(docs, gone, [id_col], "left_anti", gone.count())
