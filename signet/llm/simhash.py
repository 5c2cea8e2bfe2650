"""SimHash near-duplicate detection by a binary-trie self-join (operator 7).

1. Fingerprints: one Arrow pass over whole texts; no shuffle.
2. Exact copies collapse: one row per distinct fingerprint (map-side minima).
3. Trie self-join.  Two fingerprints within BUDGET bits agree on at least one of
   BUDGET + 1 bit blocks, so each fingerprint stands in BUDGET + 1 tries, each with
   another block as its top levels; below a shared top node the trie is traversed
   in node pairs that accumulate differing bits and are pruned beyond the budget.
   Nodes are ranges of a sorted array, and a whole level of node pairs is one numpy
   step.  A top node with many fingerprints is dealt out further, to one task for
   each pair of lower nodes within the budget.
4. Components of the links, in checkpointed passes; then back to the documents.

Null and empty texts have fingerprint zero and link like any other.  Repeated
rows and equal ids each get a row.  A null id never names a component unless all
ids of the component are null.  Columns other than id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

BUDGET, SHINGLE, SEED = 2, 3, 42
#: Fingerprints below one trie node that one task takes before they are dealt out further.
NODE_ROWS = 20_000
BLOCK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; long texts are counted in blocks of shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[low:high], ends[low + shingle - 1 : high + shingle - 1], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text`` and with ``fp``, the fingerprint's 64 bits as a signed long."""
    docs = docs.drop("fp")
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([simhash(t.as_py(), shingle) for t in batch.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(marks)], names=[*rest, "fp"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(run, f"{kept}, fp long" if rest else "fp long")


def _children(low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Where the ones begin in each sorted range; ``ones`` has running counts of the level's bit."""
    return high - (ones[high] - ones[low])


def trie_links(keys: np.ndarray, pairs: np.ndarray, selfs: np.ndarray, depth: int, budget: int, link, width: int = 64) -> None:
    """Traverses the trie over ``keys`` (uint64, each range sorted) and calls ``link(i, j)`` with arrays of linked places.

    ``pairs``: rows (low, high, low, high, differing bits so far) of node pairs;
    ``selfs``: rows (low, high) of nodes to join with themselves; all have read
    ``depth`` bits from the top, of which ``width`` count.  Leaves of several equal
    keys go to ``link.leaves(low, high, low, high)``.  Nodes whose rows are connected
    already are passed over.
    """
    for bit in range(63 - depth, 63 - width, -1):
        pairs, selfs = link.apart(pairs, selfs)
        lone = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if lone.any():  # two leaves: the rest of the bits at once
            i, j = pairs[lone, 0], pairs[lone, 2]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            link(i[near], j[near])
            pairs = pairs[~lone]
        if not len(pairs) and not len(selfs):
            return
        if len(pairs) > 1 << 20:  # one half after the other, so that memory stays bounded
            half = len(pairs) // 2
            trie_links(keys, pairs[:half], selfs[:0], 63 - bit, budget, link, width)
            pairs = pairs[half:]
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        al, ah, bl, bh, d = pairs.T
        am, bm = _children(al, ah, ones), _children(bl, bh, ones)
        sl, sh = selfs.T
        sm = _children(sl, sh, ones)
        zero = np.zeros(len(sl), np.int64)
        pairs = np.concatenate([np.stack(x, 1) for x in ((al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1), (am, ah, bl, bm, d + 1), (sl, sm, sm, sh, zero + 1))])
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]
        selfs = np.concatenate([np.stack((sl, sm), 1), np.stack((sm, sh), 1)])
        selfs = selfs[selfs[:, 1] - selfs[:, 0] > 1]
    for al, ah, bl, bh, _ in pairs:  # all bits read: equal keys on either side
        link.leaves(al, ah, bl, bh)
    for low, high in selfs:
        link.leaves(low, high, low, high)


class Forest:
    """Links fold into roots at once, so that only a forest, never all links, is kept."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.fp, self.root = rows["fp"], np.arange(len(rows["fp"]))
        if "root" in rows:  # what is connected from the start
            _, first, which = np.unique(rows["root"], return_index=True, return_inverse=True)
            self.root = first[which]

    def apart(self, pairs: np.ndarray, selfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of both whose rows aren't all of one component."""
        root = self.find(np.arange(len(self.root)))
        turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        al, ah, bl, bh, _ = pairs.T
        one = (turns[al] == turns[ah - 1]) & (turns[bl] == turns[bh - 1]) & (root[al] == root[bl])
        return pairs[~one], selfs[turns[selfs[:, 0]] != turns[selfs[:, 1] - 1]]

    def leaves(self, al: int, ah: int, bl: int, bh: int) -> None:
        """All of both leaves are linked: each with the first of the other."""
        self(np.arange(al, ah), np.full(ah - al, bl))
        self(np.arange(bl, bh), np.full(bh - bl, al))

    def edges(self) -> list[np.ndarray]:
        at = np.arange(len(self.root))
        root = self.find(at)
        return [self.fp[root != at], self.fp[root[root != at]]]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def find(self, i: np.ndarray) -> np.ndarray:
        at = self.root[i]
        while (up := self.root[at]).tobytes() != at.tobytes():
            at = up
        self.root[i] = at
        return at


def _edges(rows: dict[str, np.ndarray], depth: int, budget: int) -> list[np.ndarray]:
    """Links of whole groups, folded into a forest; rows are sorted by group and key."""
    keys, groups = rows["key"].view(np.uint64), np.stack([rows[c] for c in ("trie", "block", "low", "high")])
    starts = np.flatnonzero(np.concatenate([[True], (groups[:, 1:] != groups[:, :-1]).any(0)]))
    ends = np.append(starts[1:], len(keys))
    low, high = rows["low"][starts], rows["high"][starts]
    many = ends - starts > 1
    selfs = np.stack((starts, ends), 1)[many & (low == high)]
    two = many & (low != high)
    sides = np.concatenate([[0], np.cumsum(rows["side"])])
    middle = ends - (sides[ends] - sides[starts])
    pairs = np.stack((starts, middle, middle, ends, np.bitwise_count(low ^ high).astype(np.int64)), 1)[two]
    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
    forest = Forest(rows)
    trie_links(keys, pairs, selfs, depth, budget, forest)
    return forest.edges()


def _join(batches: Iterator[pa.RecordBatch], names: list[str], depths: list[int], budget: int) -> Iterator[pa.RecordBatch]:
    """Joins a sorted partition group by group, many whole groups at a time."""
    held: dict[str, np.ndarray] = {c: np.empty(0, np.int64) for c in names}

    def flush(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for trie in np.unique(rows["trie"]):  # the trie's number, and in hundreds the bits it was dealt out by
            own = rows["trie"] == trie
            found = _edges({c: x[own] for c, x in rows.items()}, depths[trie % 100] + trie // 100, budget)
            yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["a", "b"])

    for batch in batches:
        now = {c: np.concatenate([held[c], batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for c in names}
        n = len(now["key"])
        if n < 50_000:
            held = now
            continue
        last = np.flatnonzero(np.stack([now[c][1:] != now[c][:-1] for c in names[:4]]).any(0))
        whole = last[-1] + 1 if len(last) else 0
        held = {c: x[whole:] for c, x in now.items()}
        if whole:
            yield from flush({c: x[:whole] for c, x in now.items()})
    if len(held["key"]):
        yield from flush(held)


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << b for b in chosen) for k in range(budget + 1) for chosen in combinations(range(bits), k)]


def links(marks: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` of ``marks`` that connect all that differ in ``budget`` bits or fewer.

    The edges are a forest for each trie node, not all pairs: the components are
    those of all links.
    """
    n = budget + 1
    sizes = [64 // n + (i < 64 % n) for i in range(n)]
    offsets = [sum(sizes[:i]) for i in range(n)]

    def turned(offset: int) -> Column:
        return F.shiftleft("fp", offset).bitwiseOR(F.shiftrightunsigned("fp", 64 - offset)) if offset else F.col("fp")

    tries = F.array(*(F.struct(F.lit(i).cast("long").alias("trie"), turned(o).alias("key"), F.shiftrightunsigned(turned(o), 64 - s).alias("block")) for i, (o, s) in enumerate(zip(offsets, sizes, strict=True))))
    rows = marks.select("fp", F.inline(tries))
    large = rows.groupBy("trie", "block").agg(F.count("*").alias("n")).filter(F.col("n") > node_rows)
    rows = rows.join(large, ["trie", "block"], "left")
    deep = F.when(F.col("n").isNull(), 0).when(F.col("n") <= node_rows * 500, 10).otherwise(20)
    masks = F.when(F.col("deep") == 0, F.array(F.lit(0))).when(F.col("deep") == 10, F.array(*map(F.lit, _masks(10, budget)))).otherwise(F.array(*map(F.lit, _masks(20, budget))))
    rows = rows.withColumn("deep", deep).withColumn("mask", F.explode(masks))
    size = F.array(*map(F.lit, sizes))[F.col("trie").cast("int")]
    own = F.when(F.col("deep") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("key"), 64 - size - F.col("deep")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("deep")) - 1))
    rows = rows.withColumn("own", own).withColumn("other", F.col("own").bitwiseXOR(F.col("mask").cast("long")))
    rows = rows.select((F.col("trie") + F.col("deep") * 100).alias("trie"), "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("long").alias("side"), "key", "fp")
    group = ["trie", "block", "low", "high"]
    # keys are compared as unsigned numbers: flipping the sign bit makes Spark's signed order that order
    rows = rows.withColumn("order", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    rows = rows.repartition(*group).sortWithinPartitions(*group, "side", "order").drop("order")
    return rows.mapInArrow(lambda batches: _join(batches, [*group, "side", "key", "fp"], sizes, budget), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id, root): one row per row of ``docs``; root is the component's own name."""
    ids = cut(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle))
    marks = cut(ids.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(marks, budget)).withColumnsRenamed({"node": "fp"})
    named = marks.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "root").select("fp", "component_id", "root"))
    return ids.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
