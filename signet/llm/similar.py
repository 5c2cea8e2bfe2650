"""Groups of documents that share most of their five-word shingles, by the trie self-join of operator 7.

A SimHash of 64 bits can't tell a similarity of 0.8 at a budget that a join can
afford: some 15 % of its bits differ there.  So the fingerprints here are of
sampled signs: each bit is one bit of the shingle that one of 512 orders puts
first, and two texts differ in it with half of one less their Jaccard index
(10 % at 0.8, half if unrelated).

1. Sketches: 512 bits as eight longs, and eight marks of two least shingles each, in
   one Arrow pass over whole texts; equal texts collapse by their hash.
2. Texts that share a mark (at 0.8: one or more of eight with 0.9997) meet below one
   trie node.  There the trie over WIDTH bits of that mark's long is traversed in node
   pairs with BUDGET differing bits, and a pair is near if its sketches differ in NEAR
   bits or fewer (at 0.8: four standard deviations).  Near pairs aren't links: what
   they connect only says which texts must be seen side by side.
3. The texts of each connected set meet in a cell, where all pairs are compared by
   their shingles, exactly, but for those that other links already connect.  So no
   unproved pair stands for another, and each text travels once.
4. Components of the links; of each, the row with the least id stays.

Large nodes and cells are dealt out in blocks of NODE_ROWS rows or CELL_BYTES bytes.
Each block also sees a few rows of the whole, so copies of one text become one
component in one round; then only the rows outside of the largest component meet all
blocks.  Work is thus linear in groups of copies of any size; it is quadratic only for
a large family whose members are near each other and not similar.

Null texts count as empty, and texts without words are alike.  Fewer than five words
are one shingle.  A null id leads only where all ids of its group are null.  Of
repeated rows (same id and text) one stays.  Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .simhash import Forest, trie_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Differing bits allowed: of the WIDTH bits that a trie has, and of the 512 of whole sketches.
BUDGET, WIDTH, NEAR = 9, 32, 78
BANDS = 8
SKETCH, MARKS = tuple(f"s{i}" for i in range(8)), tuple(f"m{i}" for i in range(BANDS))
NODE_ROWS, CELL_BYTES, SEEN = 20_000, 16 << 20, 16
#: Hashes that texts share are broadcast up to so many.
FEW = 10_000
#: Odd multipliers, one for each order of the shingles.
ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, 512, np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1024


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    digest, space = xxhash.xxh64_intdigest, b" "
    return np.array([digest(space.join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)], np.uint64)


def sketch(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """512 sampled sign bits as eight longs and BANDS marks; zero for a text without words."""
    found = np.unique(shingles(text, size))
    if not len(found):
        return np.zeros(8 + BANDS, np.int64)
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max)
    for low in range(0, len(found), BLOCK):
        for at in range(0, len(ORDERS), 64):
            part = slice(at, at + 64)
            np.minimum(least[part], np.multiply.outer(ORDERS[part], found[low : low + BLOCK]).min(1), out=least[part])
    bits = np.packbits(((least >> np.uint64(20)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    marks = least[0 : 2 * BANDS : 2] * ORDERS[0] ^ least[1 : 2 * BANDS : 2]
    return np.concatenate([bits, marks.view(np.int64)])


def jaccard(a: str | None, b: str | None, size: int = SHINGLE) -> float:
    a, b = np.unique(shingles(a, size)), np.unique(shingles(b, size))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


class Near(Forest):
    """Pairs whose sketches are near, folded into a forest; rows with a ``root`` begin as what that connects."""

    def __init__(self, rows: dict[str, np.ndarray]):
        super().__init__(rows)
        self.sketch = np.stack([rows[c] for c in SKETCH], 1).view(np.uint64)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> None:
        for low in range(0, len(i), 1 << 17):
            p, q = i[low : low + (1 << 17)], j[low : low + (1 << 17)]
            apart = self.find(p) != self.find(q)
            p, q = p[apart], q[apart]
            near = np.bitwise_count(self.sketch[p] ^ self.sketch[q]).sum(1, dtype=np.int64) <= NEAR
            super().__call__(p[near], q[near])

    def leaves(self, al: int, ah: int, bl: int, bh: int) -> None:
        """Leaves of equal bits: all with the first of the other side, then those outside of its component with all."""
        left, right = np.arange(al, ah), np.arange(bl, bh)
        self(left, np.full(len(left), bl))
        self(np.full(len(right), al), right)
        for own, others in ((left, right), (right, left)):
            apart = own[self.find(own) != self.find(np.array([al]))]
            wide = max(1, (1 << 17) // len(others))
            for low in range(0, len(apart), wide):
                some = apart[low : low + wide]
                self(np.repeat(some, len(others)), np.tile(others, len(some)))


def near_pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is near in each of many cells (cell, part, side, fp, SKETCH); the cell's lowest bits name its band."""
    band = rows["cell"] & (BANDS - 1)
    key = np.stack([rows[c] for c in SKETCH])[band, np.arange(len(band))].view(np.uint64) & np.uint64((1 << 64) - (1 << 64 - WIDTH))
    order = np.lexsort((key, rows["side"], rows["part"], rows["cell"]))
    rows, key = {c: x[order] for c, x in rows.items()}, key[order]
    starts = np.flatnonzero(np.concatenate([[True], (rows["cell"][1:] != rows["cell"][:-1]) | (rows["part"][1:] != rows["part"][:-1])]))
    ends = np.append(starts[1:], len(key))
    ones = np.concatenate([[0], np.cumsum(rows["side"])])
    middle = ends - (ones[ends] - ones[starts])
    two = middle < ends  # rows of side 1 meet those of side 0, which meet each other only where there are none
    selfs = np.stack((starts, ends), 1)[~two & (ends - starts > 1)]
    pairs = np.stack((starts, middle, middle, ends, np.zeros(len(starts), np.int64)), 1)[two & (starts < middle)]
    forest = Near(rows)
    for budget in (0, BUDGET // 3, BUDGET):  # what is nearest first: what that connects is passed over
        trie_links(key, pairs, selfs, 0, budget, forest, WIDTH)
    return tuple(forest.edges())


def similar_pairs(rows: dict[str, np.ndarray], texts: list[str], size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the similar texts of one cell: all pairs, or those of both sides if there are two.

    Of an inverted index, each row in turn gets the shingles that it shares with all
    others at once.  A row in the largest component needn't ask: whoever is outside asks.
    """
    n, sets = len(texts), [np.unique(shingles(t, size)) for t in texts]
    sizes = np.array([len(s) for s in sets])
    forest = Forest(rows)
    empty = np.flatnonzero(sizes == 0)
    forest(empty[1:], np.full(max(len(empty) - 1, 0), empty[0] if len(empty) else 0))
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if sizes.sum() and both / (sizes.sum() - both) >= similarity:
            forest(np.array([0]), np.array([1]))
        return tuple(forest.edges())
    owner = np.repeat(np.arange(n), sizes)
    _, mark, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(mark, kind="stable")
    holders, first = owner[order], np.concatenate([[0], np.cumsum(times)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    two = rows["side"].any()
    waiting = (rows["side"] == 0) & (sizes > 0) if two else sizes > 0
    at = np.arange(n)
    while True:
        root = forest.find(at)
        counts = np.bincount(root, minlength=n)
        open_ = np.flatnonzero(waiting & (root != counts.argmax() if counts.max() < n else False))
        if not len(open_):
            return tuple(forest.edges())
        for i in open_[:64]:
            waiting[i] = False
            own = mark[bounds[i] : bounds[i + 1]]
            own = own[times[own] > 1]
            long = times[own]
            place = np.arange(long.sum()) + np.repeat(first[own] - np.cumsum(long) + long, long)
            both = np.bincount(holders[place], minlength=n)
            alike = (both > 0) & (both >= similarity * (sizes[i] + sizes - both)) & (at != i)
            if two:
                alike &= rows["side"] == 1
            found = np.flatnonzero(alike)
            forest(found, np.full(len(found), i))


def _cells(batches: Iterator[pa.RecordBatch], most: int, join: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Hands a partition's whole cells to ``join``, as many as make ``most`` rows; rows are sorted by cell and part."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for a, b in join(rows):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            rows = pa.Table.from_batches(held)
            cell, part = rows.column("cell").to_numpy(), rows.column("part").to_numpy()
            last = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))
            whole = last[-1] + 1 if len(last) else 0
            held = rows.slice(whole).to_batches()
            if whole:
                yield from out(rows.slice(0, whole))
    if held:
        yield from out(pa.Table.from_batches(held))


def _numbers(rows: pa.Table) -> dict[str, np.ndarray]:
    return {c: rows.column(c).to_numpy().astype(np.int64) for c in rows.column_names if c != "text"}


def joined(names: DataFrame, payload: DataFrame, most: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], seen: int = SEEN) -> DataFrame:
    """Edges (a, b) that ``run`` finds within the cells of ``names`` (cell, fp, weight), with the columns that ``payload`` has for each fp.

    A cell heavier than ``most`` is dealt out in blocks, which ``seen`` of its rows join
    all; whoever this leaves outside of the cell's largest component then meets each block.
    """
    sizes = cut(names.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.sum("weight") / most).cast("int").alias("blocks")).filter("n > 1").drop("n"))
    names = cut(names.join(sizes, "cell"))
    block = F.pmod(F.xxhash64("fp", "cell"), F.col("blocks")).cast("int")
    plain = names.select("cell", block.alias("part"), "fp", F.lit(0).alias("side"), F.col("fp").alias("root"))

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.join(payload, "fp").repartition("cell", "part").sortWithinPartitions("cell", "part")
        return cut(rows.mapInArrow(run, "a long, b long"))

    hot = names.filter("blocks > 1")
    if hot.isEmpty():
        return compared(plain)
    least = W.partitionBy("cell").orderBy(F.xxhash64(F.lit(SEED), "fp"), "fp")
    shown = hot.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= seen)
    shown = shown.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "fp", F.lit(0).alias("side"), F.col("fp").alias("root"))
    found = compared(plain.union(shown).distinct())
    roots = components(found).toDF("fp", "root")
    hot = cut(hot.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    major = hot.groupBy("cell", "root").agg(F.sum("weight").alias("w")).groupBy("cell").agg(F.max_by("root", F.struct("w", "root")).alias("major"))
    minor = cut(hot.join(major, "cell").filter("root != major").drop("major"))
    if minor.isEmpty():
        return found
    parts = minor.groupBy("cell").agg(F.ceil(F.sum("weight") / most).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("cell", "fp"), F.col("parts")).cast("int")
    asking = minor.join(parts, "cell").select("cell", "fp", "root", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), F.lit(0).alias("side"))
    every = hot.join(parts, "cell").select("cell", "fp", "root", "blocks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"), block.alias("other"), F.lit(1).alias("side"))
    again = asking.union(every).select("cell", (F.col("own") * F.col("blocks") + F.col("other")).alias("part"), "fp", "side", "root")
    return found.union(compared(again))


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([sketch(t.as_py(), size) for t in batch.column("text")], np.int64).reshape(-1, 8 + BANDS)
        yield pa.RecordBatch.from_arrays([batch.column("fp"), *(pa.array(found[:, i]) for i in range(8 + BANDS))], names=["fp", *SKETCH, *MARKS])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cells(batches, 50_000, lambda rows: [near_pairs(_numbers(rows))])


def _similar(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    def join(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        numbers = _numbers(rows)
        starts = np.flatnonzero(np.concatenate([[True], (numbers["cell"][1:] != numbers["cell"][:-1]) | (numbers["part"][1:] != numbers["part"][:-1])]))
        found = [similar_pairs({c: x[low:high] for c, x in numbers.items()}, rows.column("text").slice(low, high - low).to_pylist(), size, similarity) for low, high in zip(starts, np.append(starts[1:], rows.num_rows), strict=True)]
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return _cells(batches, 2000, join)


def colliding(docs: DataFrame, bits: int = 64) -> DataFrame | None:
    """``fp`` of hashes that different texts of ``docs`` share, by a second hash; None if there are none, as is usual below 10^9 texts."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select(_hash(text, bits).alias("fp"), F.xxhash64(F.lit(SEED), text).alias("second"))
    both = cut(seen.groupBy("fp").agg(F.min("second").alias("low"), F.max("second").alias("high")).filter("low <> high").select("fp"))
    n = len(both.take(FEW + 1))
    return None if n == 0 else F.broadcast(both) if n <= FEW else both


def _hash(text: Column, bits: int) -> Column:
    return F.xxhash64(text) if bits == 64 else F.shiftright(F.xxhash64(text), 64 - bits)


def fingerprinted(docs: DataFrame, shared: DataFrame | None, name: str, bits: int = 64) -> DataFrame:
    """``docs`` with a number of its text as ``name``: a hash, or where texts share one (``shared``) one of both hashes."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn(name, _hash(text, bits))
    if shared is None:
        return rows
    both = rows.join(shared.select(F.col("fp").alias("__shared")), F.col(name) == F.col("__shared"), "left")
    return both.withColumn(name, F.when(F.col("__shared").isNotNull(), F.xxhash64(F.col(name), F.xxhash64(F.lit(SEED), text))).otherwise(F.col(name))).drop("__shared")


def groups(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, node_rows: int = NODE_ROWS, cell_bytes: int = CELL_BYTES, shared: DataFrame | None = None, bits: int = 64) -> DataFrame:
    """(doc_id, fp, n, lead_id, lead_fp): rows of ``docs`` (doc_id, text) by id and text's number, n of them, and their group's lead.

    A ``similarity`` below the default needs wider BUDGET and NEAR.
    """
    texts = fingerprinted(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), shared, "fp", bits)
    ids = cut(texts.groupBy("doc_id", "fp").agg(F.count("*").alias("n")))
    least = cut(ids.groupBy("fp").agg(F.min("doc_id").alias("least")))
    kinds = ", ".join(f"{c} long" for c in ("fp", *SKETCH, *MARKS))
    marks = texts.select("fp", "text").mapInArrow(lambda batches: _sketched(batches, size), kinds)
    marks = cut(marks.groupBy("fp").agg(*(F.min(c).alias(c) for c in (*SKETCH, *MARKS))))
    cells = F.array(*(F.shiftleft(F.col(c), 3).bitwiseOR(F.lit(i)) for i, c in enumerate(MARKS)))
    near = joined(marks.select(F.explode(cells).alias("cell"), "fp", F.lit(1).alias("weight")), marks.select("fp", *SKETCH), node_rows, _near)
    sets = components(near).toDF("fp", "cell")
    asked = least.join(sets, "fp").select("fp", "least")
    same = (F.col("t.fp") == F.col("x.fp")) & F.col("t.doc_id").eqNullSafe(F.col("x.least"))
    asked = cut(texts.alias("t").join(asked.alias("x"), same, "left_semi").dropDuplicates(["fp", "doc_id"]).select("fp", "text"))
    names = sets.join(asked.select("fp", (F.octet_length("text") + 64).alias("weight")), "fp").select("cell", "fp", "weight")
    found = joined(names, asked, cell_bytes, lambda batches: _similar(batches, size, similarity))
    roots = components(found).toDF("fp", "root")
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    leads = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("lead"))
    named = named.join(leads, "root").select("fp", F.col("lead.least").alias("lead_id"), F.col("lead.fp").alias("lead_fp"))
    return ids.join(named, "fp")


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, bits: int = 64) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text) that lead their group."""
    shared = colliding(docs, bits)
    found = cut(groups(docs, size, similarity, shared=shared, bits=bits))
    leads = F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("fp") == F.col("lead_fp"))
    some = cut(found.filter(leads & (F.col("n") > 1)).select("doc_id", "fp"))
    drop = found.filter(~leads).select("doc_id", "fp").union(some)
    marked = fingerprinted(docs, shared, "__fp", bits)
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.__fp") == F.col("x.fp"))
    kept = marked.alias("d").join(drop.alias("x"), same, "left_anti").select(docs.columns)
    repeated = marked.alias("d").join(some.alias("x"), same, "left_semi").dropDuplicates(["doc_id", "__fp"]).select(docs.columns)
    return kept.union(repeated)
