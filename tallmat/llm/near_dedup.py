"""MinHash near-dedup: set similarity join by chosen paths.

A document is the set of its distinct shingles, of two words in the query and of five in the pipeline. Documents with equal sets form a class, and one of each class
(the smallest doc_id) goes through `TREES` independent trees. A tree branches its documents by one minwise token after
the other: documents stay together as long as the token with the smallest hash agrees. A node of at most `LEAF`
documents is compared exhaustively; larger ones branch on. A pair of similarity 0.8 survives a branching with
probability 0.8, so with ten trees it meets in at least one leaf with probability 1 - 4e-8 at depth one, 0.99999 at
depth two and 0.9988 at depth three; closer pairs and groups meet more often.

Nodes that are still large after `DEPTH` branchings hold documents much alike. They are cut into random blocks, other
ones in each tree, and each block also gets the node's first document. Documents of such a node that end up in another
component than that first document, or in none, are then compared exactly with all others of the node, block against
block: a task holds two blocks of at most about `BLOCK` documents, whose sizes allow a similarity of 0.8, and gives
edges between components alone. So no pair of a large node goes without comparison unless both are already in the
component of its first document. What this costs grows with the square of the unresolved documents of a node, in tasks
of bounded size.

Leaves compare 60 one-byte minwise sketches and give a spanning forest of the candidates, never all pairs. Components of
these candidates that are small are settled exactly in one task with the full sets of their members. In large ones,
edges are confirmed by joins on the full sets: for each document its strongest edge and the one to the component's
first document; then, between the components so found, all candidates that leaves have.

Defined cases: a text of fewer words than a shingle has one, all its words; NULL, empty and blank texts have none and are
linked with nothing; rows with equal doc_id are versions of one document: links of any of them count; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.llm.common import cut_lineage, query, stored, table, texts_of
from tallmat.llm.graph import components
from tallmat.llm.words import Words, as_long, lists, mix, slices, window_starts, windows

TREES = 10
DEPTH = 4
LEAF = 40
PERCENT = 80
# Minwise tokens of 60 that have to agree for a candidate: at similarity 0.8 fewer do with probability 5e-5.
MIN_AGREE = 36
# Candidate components up to this size are settled in one task.
SMALL = 64
# Documents of a block of a large node; two blocks meet in one task.
BLOCK = 512
# Shingles (columns) of the products that give the intersections of two blocks.
_WIDTH = 1 << 13

_COORDS = 60
_RANDOM = np.random.default_rng(11).integers(0, 1 << 63, (2, _COORDS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and their number per text."""
    words = Words(texts, lower=True)
    x = words.hashes()
    shingles = windows(x, width)
    found, sizes = [], np.zeros(len(texts), np.int64)
    for i, n in enumerate(words.counts.tolist()):
        if n:
            a = words.first[i]
            if n >= width:
                own = np.unique(shingles[a : a + n - width + 1])
            else:
                own = np.full(1, 0x5851F42D4C957F2D, np.uint64)
                for k in range(n):
                    own = mix(own ^ x[a + k : a + k + 1])
            found.append(own)
            sizes[i] = len(own)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), sizes


def _sketch_batches(batches: Iterator, width: int) -> Iterator:
    for batch in batches:
        for piece in slices(batch):
            values, sizes = shingle_sets(piece.column("text"), width)
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            sig = np.zeros((piece.num_rows, _COORDS), np.int32)
            key = np.zeros((2, piece.num_rows), np.uint64)
            if len(full):
                for c in range(_COORDS):
                    least = np.minimum.reduceat((values ^ _RANDOM[0, c]) * _RANDOM[1, c], starts)
                    sig[full, c] = (mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                key[0, full] = np.add.reduceat(mix(values), starts)
                key[1, full] = np.add.reduceat(mix(values ^ np.uint64(0xABCDEF)), starts)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(sizes),
                    pa.array(as_long(key[0])),
                    pa.array(as_long(key[1])),
                    lists(sig.reshape(-1), np.full(len(sig), _COORDS), pa.int32()),
                ],
                names=["doc_id", "n", "k1", "k2", "sig"],
            )


def _groups(batches: Iterator, key: str) -> Iterator[pa.Table]:
    """Rows of sorted batches by equal key."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, t]) if rest is not None else t
        values = rest.column(key).to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        begin = 0
        for end in cuts.tolist():
            yield rest.slice(begin, end - begin)
            begin = end
        rest = rest.slice(begin)
    if rest is not None:
        yield rest


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _leaf_edges(ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, known: np.ndarray | None) -> list[tuple[int, int, int]]:
    """Candidates of one leaf: a spanning forest, strongest edges first, or all between known components."""
    agree = (sketch[:, None, :] == sketch[None, :, :]).sum(2)
    i, j = np.nonzero(np.triu(agree >= MIN_AGREE, 1))
    fits = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
    i, j = i[fits], j[fits]
    order = np.argsort(-agree[i, j], kind="stable")
    union = _Union(len(ids))
    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if ids[a] == ids[b] or known is not None and known[a] == known[b]:
            continue
        if known is not None or union.join(a, b):
            low, high = sorted((int(ids[a]), int(ids[b])))
            out.append((low, high, int(agree[a, b])))
    return out


def _leaf_batches(batches: Iterator, labelled: bool) -> Iterator:
    for group in _groups(batches, "node"):
        if group.num_rows < 2:
            continue
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, _COORDS)
        known = group.column("root").to_numpy() if labelled else None
        edges = _leaf_edges(group.column("id").to_numpy(), group.column("n").to_numpy(), sketch, known)
        if edges:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b", "agree"]
            )


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(x) + len(y)
    shared = both - len(np.unique(np.concatenate([x, y])))
    return 100 * shared >= PERCENT * (both - shared)


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    values, sizes = shingle_sets(texts, width)
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _settle_batches(batches: Iterator, width: int) -> Iterator:
    """Exact components of small groups of candidates: every pair not yet connected is compared."""
    for group in _groups(batches, "root"):
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        sets = _sets(group.column("text").combine_chunks(), width)
        union = _Union(len(ids))
        for p in range(len(order)):
            for q in range(p + 1, len(order)):
                if union.find(p) != union.find(q) and _similar(sets[order[p]], sets[order[q]]):
                    union.join(p, q)
        roots = [ids[order[union.find(p)]] for p in range(len(order))]
        yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(roots, pa.int64())], names=["id", "root"])


def _confirm_batches(batches: Iterator, width: int) -> Iterator:
    for batch in batches:
        for piece in slices(batch, "ta", 1 << 20):
            x, y = _sets(piece.column("ta"), width), _sets(piece.column("tb"), width)
            yield piece.select(["a", "b"]).filter(pa.array([_similar(p, q) for p, q in zip(x, y)], pa.bool_()))


def _confirmed(edges: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The edges whose full sets are similar enough."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    joined = edges.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return cut_lineage(joined.mapInArrow(lambda x: _confirm_batches(x, width), "a LONG, b LONG"))


def _leaves(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id) rows of all leaves, and (node, id, parent, pivot) of the nodes that had to be cut into blocks.

    The whole path of a document through a tree follows from its sketch. Nodes of the first branching are counted for
    all documents, those of the others only below nodes that are still large.
    """
    names = [f"n{k}" for k in range(1, DEPTH + 1)]

    def path(tree: Column) -> Column:
        node, nodes = tree, []
        for k, name in enumerate(names):
            node = F.xxhash64(node, F.get("sig", tree * DEPTH + k))
            nodes.append(node.alias(name))
        return F.struct(*nodes)

    paths = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), path)
    active = sketches.select("id", F.explode(paths).alias("path")).select("id", "path.*")
    size = [F.count("*").alias("size"), F.min("id").alias("pivot")]
    placed = stored(active.join(active.groupBy("n1").agg(*size).where("size > 1"), "n1"), "nodes")
    large = placed.where(F.col("size") > LEAF)
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.col(name).alias("node")) for k, name in enumerate(names, 1)])
    below = large.select("id", F.col(names[-1]).alias("last"), F.explode(levels).alias("at")).select("id", "last", "at.*")
    found = F.struct("level", "node", "size", "pivot")
    ends = stored(
        below.join(below.groupBy("node").agg(*size), "node")
        .groupBy("id", "last")
        .agg(F.min(F.when(F.col("size") <= LEAF, found)).alias("leaf"), F.max(found).alias("deepest")),
        "nodes",
    )
    still = ends.where("leaf IS NULL").select("id", "deepest.*")
    blocks = F.ceil(F.col("size") / LEAF)
    cut = still.select(
        "id", "pivot", F.col("node").alias("parent"), F.xxhash64("node", F.pmod(F.xxhash64("id", "node"), blocks)).alias("node")
    )
    first = (
        still.select("node", "size", "pivot")
        .distinct()
        .select(F.col("pivot").alias("id"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.xxhash64("node", k))).alias("node"))
    )
    out = placed.where(F.col("size") <= LEAF).select(F.col("n1").alias("node"), "id")
    for more in (ends.where("leaf.size > 1").select("leaf.node", "id"), cut.select("node", "id"), first.select("node", "id")):
        out = out.unionByName(more)
    return stored(out.distinct(), "leaves"), cut


def _compare(leaves: DataFrame, sketches: DataFrame, labelled: bool) -> DataFrame:
    rows = leaves.join(sketches.select("id", "n", "sketch"), "id")
    columns = ["node", "id", "n", "sketch"] + ["root"] * labelled
    return (
        rows.select(*columns)
        .repartition("node")
        .sortWithinPartitions("node", "id")
        .mapInArrow(lambda b: _leaf_batches(b, labelled), "a LONG, b LONG, agree LONG")
    )


def _relabelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the component of the id in `column`; ids without a link are their own."""
    labels = labels.select(F.col("id").alias(column), F.col("root").alias("_root"))
    return rows.join(labels, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def _settle_large(edges: DataFrame, leaves: DataFrame, sketches: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Confirmed components of the candidate components that are too large for one task."""
    ends = edges.select("a", "b", "agree").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    strongest = ends.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("minus"))).alias("s"))
    first = strongest.select("a", (-F.col("s.minus")).alias("b"))
    first = first.unionByName(members.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = _confirmed(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), members, width)
    labels = cut_lineage(components(links))
    inside = members.select("id")
    known = cut_lineage(_relabelled(leaves.join(inside, "id", "left_semi"), labels, "id", "root"))
    mixed = known.groupBy("node").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("node")
    known = known.join(mixed, "node", "left_semi").select("node", "id", "root")
    pairs = _compare(known, sketches, True).select("a", "b").distinct()
    return components(links.unionByName(_confirmed(pairs, members, width)))


def _rest_batches(batches: Iterator, width: int = 2) -> Iterator:
    """Edges between the components of the documents of two blocks, from the exact intersections of all pairs."""
    for group in _groups(batches, "task"):
        ids, roots = group.column("id").to_numpy(), group.column("root").to_numpy()
        values, sizes = shingle_sets(group.column("text").combine_chunks(), width)
        row = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(values, kind="stable")
        values, row = values[order], row[order]
        begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        times = np.diff(np.append(begins, len(values)))
        # shingles of a single document are in no intersection
        common = np.repeat(times >= 2, times)
        row, column = row[common], np.repeat(np.arange((times >= 2).sum()), times[times >= 2])
        shared = np.zeros((len(ids), len(ids)), np.float32)
        edges = np.searchsorted(column, np.arange(0, (times >= 2).sum() + _WIDTH, _WIDTH))
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if a < b:
                part = np.zeros((len(ids), _WIDTH), np.float32)
                part[row[a:b], column[a:b] - k * _WIDTH] = 1
                shared += part @ part.T
        both = sizes[:, None] + sizes[None, :]
        i, j = np.nonzero(np.triu((shared > 0) & (100 * shared >= PERCENT * (both - shared)), 1))
        apart = roots[i] != roots[j]
        i, j = i[apart], j[apart]
        _, label = np.unique(roots, return_inverse=True)
        union = _Union(int(label.max()) + 1)
        found = [(int(ids[p]), int(ids[q])) for p, q in zip(i.tolist(), j.tolist()) if union.join(int(label[p]), int(label[q]))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _tasks(cut: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """(task, id, root): pairs of blocks of large nodes, where not both are in the component of the first document.

    A cell is the documents of a node whose sizes lie within a quarter, inside that component or outside; each is cut
    into blocks. Blocks of the same or the next size meet unless both are inside.
    """
    rows = _relabelled(_relabelled(cut.select("parent", "id", "pivot"), labels, "id", "root"), labels, "pivot", "top")
    rows = rows.select("parent", "id", "root", (F.col("root") != F.col("top")).alias("out"))
    rows = rows.join(sketches.groupBy("id").agg(F.collect_set("n").alias("ns")), "id")
    # versions under one number may lie in several cells
    band = F.floor(F.log("n") / float(np.log(100 / PERCENT)) + F.lit(1e-9))
    rows = rows.withColumn("n", F.explode("ns")).select("parent", "id", "root", "out", band.alias("band")).distinct()
    rows = stored(rows, "rest")
    counted = rows.groupBy("parent", "band", "out").agg(F.count("*").alias("size"))
    cells = cut_lineage(counted.select("parent", "band", "out", F.ceil(F.col("size") / BLOCK).alias("blocks")))
    other = cells.select("parent", F.col("band").alias("band2"), F.col("out").alias("out2"), F.col("blocks").alias("blocks2"))
    meets = cells.join(other, "parent").where("(out OR out2) AND abs(band - band2) <= 1")
    dealt = rows.join(meets, ["parent", "band", "out"]).withColumn("block", F.pmod(F.xxhash64("id", "parent"), "blocks"))
    dealt = dealt.withColumn("block2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks2") - 1)))
    mine = F.struct("band", "out", "block")
    yours = F.struct(F.col("band2").alias("band"), F.col("out2").alias("out"), F.col("block2").alias("block"))
    task = F.xxhash64("parent", F.least(mine, yours), F.greatest(mine, yours))
    return dealt.select(task.alias("task"), "id", "root").distinct()


def _rest(cut: DataFrame, labels: DataFrame, sketches: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Confirmed edges (a, b) between documents of large nodes, the component of the first document apart."""
    return cut_lineage(
        _tasks(cut, labels, sketches).join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
        .repartition("task")
        .sortWithinPartitions("task", "id")
        .mapInArrow(lambda b: _rest_batches(b, width), "a LONG, b LONG")
    )


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept), one row per document row; shingles of `width` words."""
    texts = texts_of(docs)
    sketched = stored(
        texts.mapInArrow(lambda b: _sketch_batches(b, width), "doc_id LONG, n LONG, k1 LONG, k2 LONG, sig ARRAY<INT>"), "sketches"
    )
    full = sketched.where("n > 0")
    classes = stored(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id")), "classes")
    one = full.join(classes.select("k1", "k2", F.col("class_id").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
    sketches = stored(
        one.dropDuplicates(["doc_id", "k1", "k2"]).select(
            F.col("doc_id").alias("id"),
            "n",
            "sig",
            F.unhex(F.concat_ws("", F.transform("sig", lambda s: F.lpad(F.hex(s.bitwiseAND(255)), 2, "0")))).alias("sketch"),
        ),
        "classes",
    )
    leaves, cut = _leaves(sketches)
    edges = stored(
        _compare(leaves, sketches, False).groupBy("a", "b").agg(F.max("agree").alias("agree")), "edges"
    )
    groups = components(edges)
    sizes = cut_lineage(groups.groupBy("root").agg(F.count("*").alias("size")))
    members = stored(
        texts.select(F.col("doc_id").alias("id"), "text").join(groups.join(sizes, "root"), "id").select("id", "text", "root", "size"),
        "members",
    )
    small = (
        members.where(F.col("size") <= SMALL)
        .select("root", "id", "text")
        .repartition("root")
        .sortWithinPartitions("root", "id")
        .mapInArrow(lambda b: _settle_batches(b, width), "id LONG, root LONG")
    )
    large = members.where(F.col("size") > SMALL).select("id", "text", "root")
    linked = small
    if not large.isEmpty():
        big_edges = edges.join(large.select(F.col("id").alias("a")), "a", "left_semi")
        linked = small.unionByName(_settle_large(big_edges, leaves, sketches, large, width))
    linked = stored(linked.groupBy("id").agg(F.min("root").alias("root")), "components")
    if not cut.isEmpty():
        more = _rest(cut, linked, sketches, texts, width)
        if not more.isEmpty():
            linked = components(linked.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    by_class = cut_lineage(_relabelled(classes, linked, "class_id", "component_id"))
    return (
        sketched.select("doc_id", "n", "k1", "k2")
        .join(by_class, ["k1", "k2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each group of near duplicates, with all its columns; rows without an id stay.

    Rows that agree in id and text are one row; different texts under the id that stays all stay.
    """
    found = near_duplicates(docs, width)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    key = docs["doc_id"].cast("long")
    kept = docs.join(gone, key == F.col("_id"), "left_anti")
    # only ids with several rows are looked at again
    several = stored(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "several")
    if several.isEmpty():
        return kept
    once = kept.join(several, key == F.col("_id"), "left_anti")
    return once.unionByName(kept.join(several, key == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "text"]))


@query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 2).select("doc_id", "n_shingles", "component_id", "kept")
