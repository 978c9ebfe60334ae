"""Jaccard self-join of word shingles with a count-vector R-tree.

Texts with equal shingle sets are one node. Two linked nodes share at least a known number of the first shingles of
their sets in any common order, so a node is a candidate only if that many of its first shingles occur in other nodes,
and of those it needs to be looked up only by the rarest. That makes short candidate lists; a list is never paired out:

1. every node is compared with the best-connected node of its lists, which joins groups of near copies at one pair a node;
2. what still lies in different components of one list goes into an R-tree: shingles are hashed into groups, the counts
   per group are a point, and the sum of coordinate minima bounds the overlap. Only surviving pairs are compared exactly.

Shingles are 64-bit hashes, and a comparison intersects the whole sets.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .components import components
from .hashing import Powers, Prefix, U64, mix, parts_of, ragged

WORDS = 5
#: Two sets link when PERCENT of the union's size is shared.
PERCENT = 75
#: Coordinates of a count vector.
GROUPS = 128
#: Shingles in more than one of this many texts come last in the common order, at most ORDERED of them: an order that all
#: rows share is all the search needs, so what is left out changes no result.
FREQUENT, ORDERED = 1000, 1 << 17
#: Counters of a task's summary of frequent shingles, and shingles counted before they are merged into it.
COUNTERS, PENDING = 1 << 16, 1 << 19
#: Rows of a candidate list that meet in one task; a longer list is dealt out in pairs of blocks.
CELL = 4096
#: Rows of the candidate lists of one family of components that meet in one task.
SLICE = 1 << 19
LEAF, FAN = 32, 8
LOAD = 1 << 20
_FOLD = 0xD6E8FEB86659FD93
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _loads(texts: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
    """Joined texts of about `LOAD` bytes and the row of each byte range: [(row, end)], cut at white space."""
    parts, rows, filled = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > LOAD:
                end = at + LOAD
                while end < len(text) and not SPACES[text[end]]:
                    end += 1
            parts.append(text[at:end])
            rows.append((row, end - at + 1))
            filled += end - at + 1
            at = end
            if filled >= LOAD:
                yield b" ".join(parts) + b" ", rows
                parts, rows, filled = [], [], 0
    if parts:
        yield b" ".join(parts) + b" ", rows


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the row each belongs to. White space separates words."""
    hashes, owner = [], []
    for joined, rows in _loads(texts):
        buf = np.frombuffer(joined, np.uint8)
        space = SPACES[buf]
        begin = np.flatnonzero(~space & np.append(True, space[:-1]))
        end = np.flatnonzero(~space & np.append(space[1:], True)) + 1
        hashes.append(mix(Prefix(buf, np.arange(len(buf)), powers).of(begin, end) + (end - begin).astype(U64)))
        ends = np.cumsum([n for _, n in rows])
        owner.append(np.array([r for r, _ in rows])[np.searchsorted(ends, begin, side="right")])
    none = np.zeros(0, np.int64)
    return np.concatenate([none.astype(U64), *hashes]), np.concatenate([none, *owner])


def shingle_sets(texts: list[str | None], powers: Powers) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, owner = word_hashes([(t or "").encode().lower() for t in texts], powers)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    first = np.cumsum(counts) - counts
    at, row = ragged(first, np.maximum(0, counts - WORDS + 1))
    fold = np.zeros(len(at), U64)
    for i in range(WORDS):
        fold = fold * U64(_FOLD) + h[at + i]
    fold = mix(fold)
    ends = np.cumsum(np.maximum(0, counts - WORDS + 1))
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= WORDS:
            out.append(np.unique(fold[ends[i] - (n - WORDS + 1):ends[i]]))
        elif n:
            value = np.array([n], U64)
            for k in range(n):
                value = mix(value * U64(_FOLD) + h[first[i] + k:first[i] + k + 1])
            out.append(value)
        else:
            out.append(np.zeros(0, U64))
    return out


def node_of(shingles: np.ndarray) -> int:
    """One 64-bit name for equal sets."""
    return int(mix(np.array([mix(shingles ^ U64(_FOLD)).sum(dtype=U64) + U64(len(shingles))], U64)).view(np.int64)[0])


class Summary:
    """Frequent values of a stream in a fixed number of counters: merge, then lower all by the largest that must go."""

    def __init__(self) -> None:
        self.values, self.counts, self.lowered = np.zeros(0, U64), np.zeros(0, np.int64), 0
        self.pending, self.held = [], 0

    def add(self, values: np.ndarray) -> None:
        for low in range(0, len(values), PENDING):
            self.pending.append(values[low:low + PENDING])
            self.held += len(self.pending[-1])
            if self.held >= PENDING:
                self.merge()

    def merge(self) -> None:
        self.values, self.counts = _tally(self.values, self.counts, self.pending)
        self.pending, self.held = [], 0
        if len(self.values) > COUNTERS:
            less = int(np.partition(self.counts, len(self.counts) - COUNTERS - 1)[len(self.counts) - COUNTERS - 1])
            stays = self.counts > less
            self.values, self.counts = self.values[stays], self.counts[stays] - less
            self.lowered += less


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, node) per row, and the shingles that are frequent in this task with their counts."""
    powers, docs, summary = Powers(), 0, Summary()
    for batch in batches:
        for part in parts_of(batch, 1):
            sets = shingle_sets(part.column(1).to_pylist(), powers)
            docs += part.num_rows
            summary.add(np.concatenate(sets))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([node_of(s) for s in sets], pa.int64()),
                                              pa.nulls(part.num_rows, pa.int64())], ["doc_id", "n", "node", "seen"])
    summary.merge()
    values, counts = summary.values, summary.counts + summary.lowered
    # A shingle in one of FREQUENT texts overall is in as many of some task's texts.
    often = counts >= max(2, docs // FREQUENT)
    for low in range(0, int(often.sum()), 10_000):
        v, c = values[often][low:low + 10_000], counts[often][low:low + 10_000]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.int32()), pa.array(v.view(np.int64)), pa.array(c)],
                                         ["doc_id", "n", "node", "seen"])


def _tally(values: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate([values, *more])
    weight = np.concatenate([counts, np.ones(len(both) - len(values), np.int64)])
    by = np.argsort(both, kind="stable")
    both, weight = both[by], weight[by]
    new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    return both[new], np.add.reduceat(weight, new) if len(new) else weight


def at_least(n: np.ndarray | int):
    """Shingles that a set of n must share with a linked one."""
    return (PERCENT * n + 99) // 100


def looked_up(n):
    """Of the first `prefix` shingles of a set of n, those a linked set of no smaller size shares."""
    return (n + 7) // 8


def prefix(n):
    return n - at_least(n) + looked_up(n)


def _first_shingles(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, done = Powers(), set()
        for batch in batches:
            for part in parts_of(batch, 0):
                tokens, nodes, sizes = [], [], []
                for s in shingle_sets(part.column(0).to_pylist(), powers):
                    node = node_of(s)
                    if not len(s) or node in done:
                        continue
                    if len(done) >= 1_000_000:      # a node named again is named twice, which changes nothing
                        done.clear()
                    done.add(node)
                    if len(frequent):
                        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                        s = np.concatenate([s[~late], s[late]])
                    s = s[:prefix(len(s))] if len(s) else s
                    tokens.append(s)
                    nodes.append(node)
                    sizes.append(len(s))
                if tokens:
                    many = np.repeat(np.arange(len(nodes)), sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.array(nodes)[many])], ["token", "node"])
    return run


def packed(counts: np.ndarray) -> bytes:
    """A count vector in one byte per coordinate where that holds it, else in four."""
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def unpacked(vector: bytes) -> np.ndarray:
    return np.frombuffer(vector, "u1" if len(vector) == GROUPS else "<u4").astype(np.int32)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        for part in parts_of(batch, 0):
            sets = shingle_sets(part.column(0).to_pylist(), powers)
            vectors = [packed(np.bincount((s >> U64(40)) % U64(GROUPS), minlength=GROUPS)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()),
                                              pa.array(vectors, pa.binary())], ["node", "n", "shingles", "vector"])


class RTree:
    """Count vectors in leaves of `LEAF` and nodes of `FAN`; a node keeps the largest count per coordinate and its sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        spread = int(vectors.var(axis=0).argmax()) if len(vectors) else 0
        slab = np.argsort(np.argsort(sizes, kind="stable")) // (LEAF * FAN)
        self.order = np.lexsort((vectors[:, spread], slab))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.levels = []
        top, least, most = self.vectors, self.sizes, self.sizes
        width = LEAF
        while len(top) > 1 or not self.levels:
            cut = np.arange(0, len(top), width)
            top, least, most = np.maximum.reduceat(top, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((top, least, most))
            width = FAN

    @staticmethod
    def possible(a, a_least, a_most, b, b_least, b_most) -> np.ndarray:
        """Whether overlap bounds and sizes of a (rows) and b (columns) allow a link."""
        bound = np.stack([np.minimum(x, b).sum(axis=1) for x in a]) if len(b) else np.zeros((len(a), 0))
        fit = (100 * b_most[None] >= PERCENT * a_least[:, None]) & (100 * a_most[:, None] >= PERCENT * b_least[None])
        return fit & ((100 + PERCENT) * bound >= PERCENT * (a_least[:, None] + b_least[None]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of row numbers that may link, each once, leaf by leaf."""
        top, least, most = self.levels[0]
        for leaf in range(len(top)):
            nodes = np.arange(len(self.levels[-1][0]))
            for level in range(len(self.levels) - 1, -1, -1):
                t, lo, hi = self.levels[level]
                nodes = nodes[self.possible(top[leaf:leaf + 1], least[leaf:leaf + 1], most[leaf:leaf + 1], t[nodes], lo[nodes], hi[nodes])[0]]
                if level:
                    nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                    nodes = nodes[nodes < len(self.levels[level - 1][0])]
            nodes = nodes[nodes >= leaf]
            if not len(nodes):
                continue
            mine = np.arange(leaf * LEAF, min(len(self.sizes), (leaf + 1) * LEAF))
            rows = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            rows = rows[rows < len(self.sizes)]
            a, b = np.nonzero(self.possible(self.vectors[mine], self.sizes[mine], self.sizes[mine], self.vectors[rows], self.sizes[rows], self.sizes[rows]))
            a, b = mine[a], rows[b]
            yield self.order[a[a < b]], self.order[b[a < b]]


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in one cell that the R-tree leaves; rows stand ordered by (token, cell).

    A pair may stand in several lists; a task names it once as long as it remembers it.
    """
    done: set[tuple[int, int]] = set()
    held: list[pa.RecordBatch] = []

    def work(cell: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, part, n, block = (cell.column(c).to_numpy() for c in ("node", "component", "n", "block"))
        low, high = (cell.column(c)[0].as_py() for c in ("one", "two"))
        vectors = np.stack([unpacked(v) for v in cell.column("vector").to_pylist()])
        for x, y in RTree(vectors, n.astype(np.int64)).pairs():
            apart = (part[x] != part[y]) & (np.minimum(block[x], block[y]) == low) & (np.maximum(block[x], block[y]) == high)
            x, y = node[x[apart]], node[y[apart]]
            fresh = [p for p in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()) if p not in done]
            if len(done) > 1_000_000:
                done.clear()
            done.update(fresh)
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in fresh], pa.int64()), pa.array([b for _, b in fresh], pa.int64())], ["x", "y"])

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "one", "two")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield from work(joined())
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield from work(joined())


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(c)[i].as_py(), U64) for c in ("a", "b"))
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if 100 * same >= PERCENT * (len(a) + len(b) - same):
                keep.append(i)
        yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose whole sets link."""
    one = sets.select(F.col("node").alias("x"), F.col("shingles").alias("a"))
    two = sets.select(F.col("node").alias("y"), F.col("shingles").alias("b"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "a", "b").mapInArrow(_linked, "x bigint, y bigint")


def join(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    Words are separated by white space, A-Z in lower case; the set of a text is its distinct 5-word shingles, of a shorter
    text its words as one, of a null, empty or blank text nothing: it is linked with none and its component is its own id.
    Two texts link at a Jaccard similarity of 0.75 or more. component_id is the least doc_id reachable. Rows with the same
    id and text are alike; no rows give no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    passed = cut_lineage(rows.mapInArrow(_signatures, "doc_id bigint, n int, node bigint, seen bigint"))
    signed = passed.where("seen IS NULL").select("doc_id", "n", "node")
    total = signed.count()
    often = (passed.where("seen IS NOT NULL").groupBy("node").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(8, total // (2 * FREQUENT)))
             .orderBy(F.desc("seen"), "node").limit(ORDERED).select("node").collect())
    frequent = np.sort(np.array([r["node"] for r in often], np.int64).view(U64))
    nodes = signed.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"))
    first = rows.select("text").mapInArrow(_first_shingles(frequent), "token bigint, node bigint")
    by_token = W.partitionBy("token")
    shared = (first.select("token", "node", F.count(F.lit(1)).over(by_token).alias("df"), F.min("node").over(by_token).alias("lo"), F.max("node").over(by_token).alias("hi"))
              .where("lo != hi").groupBy("token", "node").agg(F.max("df").alias("df")))
    by_node = W.partitionBy("node")
    counted = shared.join(nodes.select("node", "n"), "node").select(
        "token", "node", "n", F.count(F.lit(1)).over(by_node).alias("s"), F.row_number().over(by_node.orderBy("df", "token")).alias("r"))
    # A linked set has at least 3/4 of n shingles, so it looks up this many of the node's first ones.
    wanted = F.expr(f"(({PERCENT} * n + 99) div 100 + 7) div 8")
    keys = cut_lineage(counted.where(F.col("s") >= wanted).where(F.col("r") <= F.col("s") - wanted + 1).select("token", "node", "n", "s"))
    # The node's set, from the text of one of its documents.
    need = keys.select("node", "n").distinct().join(nodes, ["node", "n"]).select("node", F.col("doc_id").alias("_d"))
    texts = rows.join(need, F.col("doc_id").eqNullSafe(F.col("_d"))).select("text", "node")
    sets = (texts.select("text").mapInArrow(_whole_sets, "node bigint, n int, shingles binary, vector binary").join(need.select("node"), "node", "left_semi")
            .groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("vector").alias("vector")))
    sets = cut_lineage(sets)
    fit = f"100 * least(n, cn) >= {PERCENT} * greatest(n, cn)"
    centre = keys.groupBy("token").agg(F.max(F.struct("s", "node", "n")).alias("c")).select("token", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"))
    spokes = (keys.join(centre, "token").where("node != centre").where(fit).groupBy("node", "centre").agg(F.count(F.lit(1)).alias("m"))
              .groupBy("node").agg(F.max_by("centre", F.struct("m", "centre")).alias("centre")))
    near = cut_lineage(verified(spokes.select(F.col("node").alias("x"), F.col("centre").alias("y")), sets))
    part = components(near)
    placed = keys.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_part = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    open_ = (by_part.groupBy("token").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "component")).alias("most")).where("parts > 1")
             .select("token", "m", F.col("most.component").alias("family")))
    # Lists in which one component prevails name the same pairs: they go to one task, or to several if they are very many.
    slices = open_.groupBy("family").agg(F.sum("m").alias("rows")).select("family", F.expr(f"CAST((rows + {SLICE - 1}) div {SLICE} AS INT)").alias("slices"))
    cells = (placed.join(open_.join(slices, "family"), "token").withColumn("blocks", F.expr(f"(m + {CELL - 1}) div {CELL}").cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("family", "slices", "token", "node", "component", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
             .withColumn("slice", F.pmod(F.xxhash64("token", "one", "two"), F.col("slices")).cast("int")).drop("slices")
             .join(sets.select("node", "n", "vector"), "node"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    survivors = (cells.repartition(parts, "family", "slice").sortWithinPartitions("token", "one", "two").mapInArrow(_surviving, "x bigint, y bigint").distinct())
    far = verified(survivors, sets)
    whole = components(near.unionByName(far))
    named = nodes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = named.join(ids, "component").select("node", F.col("n").alias("_n"), "component_id")
    out = signed.join(final, (signed["node"] == final["node"]) & (signed["n"] == final["_n"]), "left")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").cast(kind).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is their component's id (rules: `join`): one text of each near-duplicate group stays.

    Rows without words stay. Of rows that share id and text one stays; all columns as they were. Rows that go are taken out
    by their ids and only rows whose id is repeated are shuffled with their texts.
    """
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = cut_lineage(join(docs).groupBy("doc_id").agg(stays.alias("stays")).where("NOT stays").select(F.col("doc_id").alias("_gone")))
    again = cut_lineage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")))
    kept = docs.select(F.struct("*").alias("_row")).join(gone, F.col("_row.doc_id").eqNullSafe(F.col("_gone")), "left_anti")
    same = F.col("_row.doc_id").eqNullSafe(F.col("_again"))
    numbered = kept.join(again, same, "left_semi").withColumn("_n", F.row_number().over(W.partitionBy("_row.doc_id", F.xxhash64("_row.text")).orderBy(F.xxhash64(F.to_json("_row"))))).where("_n = 1")
    return kept.join(again, same, "left_anti").unionByName(numbered.drop("_n")).select("_row.*")
