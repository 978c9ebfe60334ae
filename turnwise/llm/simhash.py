"""SimHash near-duplicates by meeting in the middle.

Two fingerprints that differ in at most RADIUS bits have a common word within HALF bits of both. So every distinct
fingerprint emits all its variants within HALF bits, the variants are shuffled, and fingerprints that emit the same
variant are compared.

A variant belongs to the cell that a linear hash (an XOR of one label per set bit) gives it. The cell of `x ^ e` is
cell(x) ^ cell(e), so a fingerprint travels to each cell once, not once per variant, and the task that owns the cell
spells out the variants that fall there. A variant has at most 2,081 fingerprints around it, all distinct and all within
RADIUS bits of one another, so a star on the least of them keeps them together and no pair list is needed.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .components import components
from .hashing import U64, mix, parts_of, ragged

WORDS = 4
SEED = 42
BITS = 64
RADIUS, HALF = 4, 2
#: Cells that a corpus of up to FILLED fingerprints is dealt to; their number doubles with the fingerprints beyond it.
CELLS, FILLED = 64, 1 << 24
#: Variants spelled out at once in a task.
SPELLED = 1 << 22
#: Bytes of a text and shingles that are worked on at once.
PIECE, LOAD = 1 << 22, 1 << 18
_LANES = U64(0x0101010101010101)


def _piece_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the shingles of one text, piece by piece."""
    carry, at, seen = [], 0, False
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = carry + text[at:end].split()
        at = end
        carry = words[-(WORDS - 1):]
        if len(words) < WORDS:
            continue
        seen = True
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        joined = b" ".join(words)
        first, last = (stop - size)[:len(words) - WORDS + 1].tolist(), stop[WORDS - 1:].tolist()
        digest = xxhash.xxh64_digest
        yield np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(first, last)]), ">u8").astype(U64)
    if carry and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], U64)


def add_bits(total: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> None:
    """Add to total[row] (64 counts) the set bits of its hashes; sizes[i] > 0 hashes in order belong to rows[i].

    Eight counters of a byte each share a word, so at most 255 hashes are summed before the bytes are spread.
    """
    parts = -(-sizes // 255)
    within, owner = ragged(np.zeros(len(sizes), np.int64), parts)
    begin = (np.cumsum(sizes) - sizes)[owner] + 255 * within
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> U64(bit)) & _LANES, begin)
        np.add.at(total[:, bit::8], rows[owner], lanes.astype("<u8").view(np.uint8).reshape(-1, 8))


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """The fingerprint of each text."""
    total, n = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held, rows, filled = [], [], 0

    def flush() -> None:
        sizes = np.array([len(h) for h in held], np.int64)
        np.add.at(n, np.array(rows), sizes)
        add_bits(total, np.concatenate(held), sizes, np.array(rows))

    for row, text in enumerate(texts):
        for hashes in _piece_hashes((text or "").encode().lower()):
            held.append(hashes)
            rows.append(row)
            filled += len(hashes)
            if filled >= LOAD:
                flush()
                held, rows, filled = [], [], 0
    if held:
        flush()
    return ((2 * total > n[:, None]).astype(U64) << np.arange(BITS, dtype=U64)).sum(axis=1, dtype=U64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1).to_pylist()).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row: the 64-bit fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def errors() -> np.ndarray:
    """All words of at most HALF set bits."""
    one = U64(1) << np.arange(BITS, dtype=U64)
    a, b = np.triu_indices(BITS, 1)
    return np.concatenate([np.zeros(1, U64), one, one[a] | one[b]])


class LinearHash:
    """XOR of one label of `bits` bits per set bit of a word."""

    def __init__(self, bits: int):
        labels = mix(np.arange(1, BITS + 1, dtype=U64)) >> U64(BITS - bits) if bits else np.zeros(BITS, U64)
        self.tables = []
        for byte in range(8):
            table = np.zeros(256, U64)
            for value in range(1, 256):
                low = value & -value
                table[value] = table[value ^ low] ^ labels[8 * byte + low.bit_length() - 1]
            self.tables.append(table)

    def of(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), U64)
        for byte, table in enumerate(self.tables):
            out ^= table[((words >> U64(8 * byte)) & U64(255)).astype(np.int64)]
        return out


def cell_bits(distinct: int) -> int:
    """Bits of a cell number for that many distinct fingerprints."""
    return (CELLS * max(1, -(-distinct // FILLED)) - 1).bit_length()


def _to_cells(bits: int):
    """Each fingerprint with every cell that one of its variants falls into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = LinearHash(bits)
        steps = np.unique(hashed.of(errors()))
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 13):
                x = batch.column(0).slice(low, 1 << 13).to_numpy()
                cells = hashed.of(x.view(U64))[:, None] ^ steps[None]
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), pa.array(np.repeat(x, len(steps)))], ["cell", "fp"])
    return run


def collisions(x: np.ndarray, cell: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant number, index into x) of the members of every variant of the cell that two or more of x emit."""
    fine = max(0, (len(x) * 2081 // (SPELLED << bits))).bit_length()
    coarse, whole = LinearHash(bits), LinearHash(bits + fine)
    # The labels of `whole` start with those of `coarse`, so a cell is a run of finer ones.
    assert (whole.of(x[:1]) >> U64(fine) == coarse.of(x[:1])).all()
    hx = whole.of(x)
    by = np.argsort(hx, kind="stable")
    x_by, h_by = x[by], hx[by]
    e = errors()
    he = whole.of(e)
    order = np.argsort(he, kind="stable")
    steps, first = np.unique(he[order], return_index=True)
    groups = np.split(e[order], first[1:])
    for sub in range(1 << fine):
        target = U64((cell << fine) | sub)
        low, high = np.searchsorted(h_by, steps ^ target, "left"), np.searchsorted(h_by, steps ^ target, "right")
        some = np.flatnonzero(high > low)
        if not len(some):
            continue
        variants = np.concatenate([(x_by[low[i]:high[i], None] ^ groups[i][None]).ravel() for i in some])
        owner = np.concatenate([np.repeat(by[low[i]:high[i]], len(groups[i])) for i in some])
        met = np.sort(variants)
        met = met[1:][met[1:] == met[:-1]]
        if not len(met):
            continue
        seen = np.zeros(1 << 20, bool)
        slot = lambda v: (v * U64(0x9E3779B97F4A7C15) >> U64(44)).astype(np.int64)
        seen[slot(met)] = True
        maybe = np.flatnonzero(seen[slot(variants)])
        met = np.unique(met)
        at = np.searchsorted(met, variants[maybe])
        same = met[np.minimum(at, len(met) - 1)] == variants[maybe]
        yield at[same], owner[maybe[same]]


def star_links(x: np.ndarray, cell: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside the cell, reduced to one link per fingerprint: to the least it reaches by them."""
    label = np.arange(len(x))
    for variant, owner in collisions(x, cell, bits):
        by = np.lexsort((owner, variant))
        variant, owner = variant[by], owner[by]
        head = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
        centre = np.repeat(owner[head], np.diff(np.append(head, len(owner))))
        near = np.bitwise_count(x[owner] ^ x[centre]) <= RADIUS
        a, b = owner[near], centre[near]
        while True:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while not np.array_equal(down := label[label], label):
                label = down
            if (label[a] == label[b]).all():
                break
    moved = np.flatnonzero(label != np.arange(len(x)))
    return x[moved], x[label[moved]]


def _links(bits: int):
    """Links (x, y) of the cells in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        del parts
        cell, fp = table.column(0).to_numpy(), table.column(1).to_numpy().view(U64)
        by = np.argsort(cell, kind="stable")
        cell, fp = cell[by], fp[by]
        head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        for a, b in zip(head, [*head[1:], len(cell)]):
            x, y = star_links(np.unique(fp[a:b]), int(cell[a]), bits)
            for low in range(0, len(x), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(v[low:low + (1 << 16)].view(np.int64)) for v in (x, y)], ["x", "y"])
    return run


def links(distinct: DataFrame, count: int) -> DataFrame:
    """Links (x, y) that connect every two of the distinct fingerprints (fp) within RADIUS bits, directly or by others."""
    bits = cell_bits(count)
    dealt = distinct.mapInArrow(_to_cells(bits), "cell int, fp bigint").repartitionById(1 << bits, "cell")
    return dealt.mapInArrow(_links(bits), "x bigint, y bigint").distinct()


def join(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    A-Z count as lower case, words are separated by white space. A bit is 1 if it is set in over half of the XXH64 values of
    all 4-word shingles, repeats included; a shorter text is one shingle, and a null, empty or blank text has the fingerprint
    zero and is linked like any other. Rows link at RADIUS or fewer differing bits; component_id is the least doc_id
    reachable. A null doc_id is no least id: its row takes part, and is named null only where no other row is reached.
    Repeated rows are alike; no rows give no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = cut_lineage(fingerprints(docs))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    part = components(links(nodes.select("fp"), nodes.count()))
    named = nodes.join(part, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    # The fingerprint of the empty texts may be very common: the rows are spread and the short side follows its size.
    out = marked.join(ids, F.col("fp") == F.col("_fp"))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component_id").cast(kind).alias("component_id"))
