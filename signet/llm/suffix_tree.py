"""Language-model scores from a probabilistic suffix tree (operator 2).

Symbols are the UTF-8 bytes of a text's words (A-Z in lower case), one space between
words, and an end.  States are contexts of up to DEPTH symbols:

1. Texts are shuffled into blocks once; a block gives its distinct grams (DEPTH
   symbols and the next one) with their counts over its training texts, packed in
   pieces by shard: all grams whose nearest NEAR symbols are alike are in one shard.
2. A shard sums its pieces; shorter contexts are sums of longer ones.  A context is a
   candidate if LEAST symbols follow it, whatever the size of the corpus.
3. A candidate is retained if its next-symbol distribution diverges from that of the
   context one symbol shorter: twice the summed log ratio exceeds DIVERGENCE for each
   distinct next symbol.
4. Distributions are smoothed by the longest retained shorter context, in the share
   that distinct next symbols have (Witten and Bell), down to uniform bytes.
5. The shard sends log10 P(symbol | longest retained suffix) of its grams back to the
   blocks that asked; a text's score is the sum over its symbols.

States longer than NEAR - 1 symbols never leave their shard.  The shorter ones, which
the alphabet bounds and the corpus doesn't, are broadcast.

Words for the base score are counted exactly over all training texts in the same way:
a block asks for each of its distinct words once and gets its count back, so neither
a vocabulary nor all tokens are gathered anywhere.

Null and empty texts are one end.  The symbol 0 within a text counts as 1.  Rows
without an id are held out by the checksum of ''.  Without training texts all bytes
are alike.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, stored, table

DEPTH, LEAST, DIVERGENCE = 6, 2, 3.0
NEAR = 3
BLOCK_BYTES, CHUNK, SCORED = 32 << 20, 4 << 20, 1 << 20
END = b"\x00"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def symbols(found: list[bytes]) -> bytes:
    return b" ".join(found).replace(END, b"\x01") + END


def codes(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of all ``texts`` (each ends in END) its gram, and where each text starts.

    A gram is one number: the symbols before, the nearest in the highest byte, and in
    the lowest byte the symbol itself.  Sorted grams have their suffixes sorted too.
    """
    pad = END * depth
    line = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8)
    ends = np.cumsum([len(t) + depth for t in texts])
    n = len(line) - depth
    found = np.zeros(n, np.uint64)
    for k in [*range(depth - 1, -1, -1), depth]:
        found <<= np.uint64(8)
        found |= line[k : n + k]
    within = np.ones(n, bool)
    for k in range(1, depth + 1):  # windows that reach into the next text
        within[(ends - k)[ends - k < n]] = False
    lengths = np.array([len(t) for t in texts])
    return found[within], np.cumsum(lengths) - lengths


def summed(found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order with the sums of their counts."""
    if not len(found):
        return found, n
    order = np.argsort(found, kind="stable")
    found, n = found[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[starts], np.add.reduceat(n, starts)


class Sums:
    """Counts of grams added part by part; what is held stays near the number of distinct grams."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.known = 0, 0

    def add(self, found: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((found, n))
        self.held += len(found)
        if self.held > max(CHUNK, 2 * self.known):
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        none = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        found, n = (np.concatenate(x) for x in zip(*(self.parts or none), strict=True))
        self.parts = [summed(found, n)]
        self.held = self.known = len(self.parts[0][0])
        return self.parts[0]


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes, compressed by byte planes."""
    return pa.Codec("zstd", compression_level=1).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def _unpacked(data: bytes, kinds: int, dtype: type) -> np.ndarray:
    flat = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * kinds, asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, kinds).T).view(dtype).ravel()


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, word, c) as pieces by block: their words joined by a space, and the counts."""
    names, held = ["block", "kinds", "size", "words", "counts"], []

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        order = np.argsort(rows.column("block").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        block, c = rows.column("block").to_numpy(), rows.column("c").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        made = []
        for low, high in zip(starts, np.append(starts[1:], len(block)), strict=True):
            line = b" ".join(rows.column("word").slice(low, high - low).to_pylist())
            made.append((block[low], high - low, len(line), pa.Codec("zstd", compression_level=1).compress(line, asbytes=True), _packed(np.ascontiguousarray(c[low:high]))))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 1 << 18:
            yield from out()
            held.clear()
    if sum(b.num_rows for b in held):
        yield from out()


def _packed_logs(logs: np.ndarray) -> bytes:
    """Logarithms in steps of 2 ** -40, which take fewer bytes than doubles do: each is off by less than 1e-12."""
    return _packed(np.round(logs * 2.0**40).astype(np.int64))


def _unpacked_logs(data: bytes, kinds: int) -> np.ndarray:
    return _unpacked(data, kinds, np.int64) * 2.0**-40


def _packed_grams(found: np.ndarray) -> bytes:
    return _packed(np.diff(found, prepend=np.uint64(0)))


def _unpacked_grams(data: bytes, kinds: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, kinds, np.uint64), dtype=np.uint64)


def _to_depth(found: np.ndarray, depth: int, to: int) -> np.ndarray:
    """Grams of ``depth`` symbols and the next one without the symbols that stand farther than ``to``."""
    return found >> np.uint64(8 * (depth - to) + 8) << np.uint64(8) | found & np.uint64(255)


def _shard(found: np.ndarray, depth: int, shards: int) -> np.ndarray:
    near = found >> np.uint64(8 * (depth - min(NEAR, depth)) + 8)
    return (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)


def retained(own: tuple[np.ndarray, np.ndarray], shorter: tuple[np.ndarray, np.ndarray], least: float, divergence: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one depth's summed grams and counts those of retained contexts; ``shorter``: all of one symbol less."""
    found, n = own
    if not len(found):
        return own
    eight = np.uint64(8)
    _, at, kinds = np.unique(found >> eight, return_inverse=True, return_counts=True)
    total = np.bincount(at, n)
    place = np.searchsorted(shorter[0], found >> np.uint64(16) << eight | found & np.uint64(255))
    _, short_at = np.unique(shorter[0] >> eight, return_inverse=True)
    short_all = np.bincount(short_at, shorter[1])[short_at[place]]
    ratio = np.log(n / total[at]) - np.log(shorter[1][place] / short_all)
    kept = ((total >= least) & (2 * np.bincount(at, n * ratio) / kinds > divergence))[at]
    return found[kept], n[kept]


@dataclass
class Tree:
    """Retained states by depth: sorted contexts with the log10 share left to shorter ones, sorted grams with log10 P."""

    depth: int
    root: np.ndarray = field(default_factory=lambda: np.full(256, -np.log10(256)))
    contexts: list[np.ndarray] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, depth: int, found: np.ndarray, n: np.ndarray) -> Tree:
        """The empty context's state, from all symbols and their counts."""
        tree = cls(depth)
        counts = np.zeros(256)
        counts[found.astype(np.int64)] = n
        kinds, total = len(found), counts.sum()
        tree.root = np.log10((counts + max(kinds, 1) / 256) / (total + max(kinds, 1)))
        return tree

    def deeper(self, found: np.ndarray, n: np.ndarray) -> Tree:
        """This tree and the retained states of the next depth, from their sorted grams and counts."""
        d = len(self.grams) + 1
        context, at, kinds = np.unique(found >> np.uint64(8), return_inverse=True, return_counts=True)
        total = np.bincount(at, n, len(context))
        shift = np.uint64(8 * (self.depth - d))
        shorter = 10 ** self.log10(found >> np.uint64(8) << shift + np.uint64(8) | found & np.uint64(255), d - 1)
        rest = np.log10(kinds / (total + kinds))
        logs = np.log10((n + kinds[at] * shorter) / (total + kinds)[at])
        return Tree(self.depth, self.root, [*self.contexts, context], [*self.rest, rest], [*self.grams, found], [*self.logs, logs])

    def log10(self, found: np.ndarray, depth: int | None = None) -> np.ndarray:
        """log10 P of each gram's last symbol after the longest retained suffix of what stands before it."""
        depth = self.depth if depth is None else depth
        eight, symbol = np.uint64(8), np.uint64(255)
        out, open_, full = np.zeros(len(found)), np.arange(len(found)), int(self.depth)
        for d in range(depth, 0, -1):
            contexts, known = self.contexts[d - 1], self.grams[d - 1]
            if not len(contexts):
                continue
            gram = found[open_]
            context = gram >> np.uint64(8 * (full - d) + 8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            state = contexts[at] == context
            here, gram = open_[state], context[state] << eight | gram[state] & symbol
            place = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            seen = known[place] == gram
            out[here[seen]] += self.logs[d - 1][place[seen]]
            out[here[~seen]] += self.rest[d - 1][at[state][~seen]]
            state[state] = seen
            open_ = open_[~state]
        out[open_] += self.root[(found[open_] & np.uint64(255)).astype(np.int64)]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return scores(texts, self.depth, self.log10)


def scores(texts: list[bytes], depth: int, log10: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """log10 P of each text (symbols with END) by that of grams; a long text is cut into parts that remember what stands before."""
    out, held = np.zeros(len(texts)), []
    for i, text in enumerate(texts):
        held += [(i, text[max(0, low - depth) : low], text[low : low + SCORED]) for low in range(0, len(text), SCORED)]
    at = 0
    while at < len(held):
        end, n = at, 0
        while end < len(held) and n < SCORED:
            n += len(held[end][2])
            end += 1
        own = held[at:end]
        found, starts = codes([before + part for _, before, part in own], depth)
        distinct, inverse = np.unique(found, return_inverse=True)
        logs = np.concatenate([[0.0], np.cumsum(log10(distinct)[inverse])])
        stops = np.append(starts[1:], len(found))
        np.add.at(out, [i for i, *_ in own], logs[stops] - logs[starts + [len(before) for _, before, _ in own]])
        at = end
    return out


@dataclass
class Model:
    """Counts of grams as a table of pieces by shard in the shared folder, and what decides which contexts are retained."""

    pieces: DataFrame
    shards: int
    depth: int
    p_min: float
    divergence: float

    @cached_property
    def short(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """All counts by depth of contexts under NEAR symbols: what the alphabet bounds."""
        near = min(NEAR, self.depth)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums()
            for batch in batches:
                for kinds, found, n in zip(*(batch.column(c).to_pylist() for c in ("kinds", "grams", "counts")), strict=True):
                    sums.add(_unpacked_grams(found, kinds), _unpacked(n, kinds, np.int64))
            found, n = sums.all()
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n)], names=["gram", "n"])

        rows = self.pieces.filter("shard = -1").select("kinds", "grams", "counts").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        levels = [summed(rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy())]
        for d in range(near - 1, 0, -1):
            found, n = levels[0]
            levels.insert(0, summed(_to_depth(found, d, d - 1), n))
        return levels

    def states(self) -> tuple[Tree, tuple[np.ndarray, np.ndarray], float]:
        """The tree of short contexts, all counts of the longest of these, and the least count of a candidate."""
        least = max(LEAST, self.p_min * float(self.short[0][1].sum()))
        tree = Tree.of(self.depth, *self.short[0])
        for above, own in zip(self.short, self.short[1:], strict=False):
            tree = tree.deeper(*retained(own, above, least, self.divergence))
        return tree, self.short[-1], least

    @cached_property
    def local(self) -> Tree:
        """The whole tree in one place, to look into a small model; ``score`` never asks for it."""
        sums = Sums()
        for r in self.pieces.filter("shard >= 0").toLocalIterator():
            sums.add(_unpacked_grams(r.grams, r.kinds), _unpacked(r.counts, r.kinds, np.int64))
        return grown(*sums.all(), *self.states(), self.divergence)

    @property
    def contexts(self) -> list[np.ndarray]:
        return self.local.contexts

    def log10(self, found: np.ndarray) -> np.ndarray:
        return self.local.log10(found)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.local.scores(texts)


def grown(found: np.ndarray, n: np.ndarray, tree: Tree, above: tuple[np.ndarray, np.ndarray], least: float, divergence: float) -> Tree:
    """``tree`` with the retained states of all depths from NEAR on, from grams and counts; each context's are all there."""
    found, n = found[n > 0], n[n > 0]
    levels = [(found, n)]
    for d in range(tree.depth, min(NEAR, tree.depth), -1):
        levels.insert(0, summed(_to_depth(levels[0][0], d, d - 1), levels[0][1]))
    for own in levels:
        tree = tree.deeper(*retained(own, above, least, divergence))
        above = own
    return tree


def blocked(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text, held_out) shuffled by ``block``, and the number of blocks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(parts, size // BLOCK_BYTES)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block"), blocks


def used(texts: DataFrame, depth: int, shards: int) -> DataFrame:
    """What each block of ``texts`` has: word, n (over training texts) of its distinct words; pieces of its distinct grams by shard.

    The piece of shard -1 has the counts of contexts under NEAR symbols.
    """

    def emitted(block: int, train: Counter, others: set, sums: Sums) -> Iterator[pa.RecordBatch]:
        own = list(train) + list(others - train.keys())
        for low in range(0, len(own), 1 << 16):
            some = own[low : low + (1 << 16)]
            yield batch_of([block] * len(some), word=some, n=[train.get(w, 0) for w in some])
        found, n = sums.all()
        short = summed(_to_depth(found, depth, min(NEAR, depth) - 1), n)
        pieces = [(-1, short[0][short[1] > 0], short[1][short[1] > 0])]
        shard = _shard(found, depth, shards)
        order = np.argsort(shard, kind="stable")
        which, starts = np.unique(shard[order], return_index=True)
        pieces += [(int(k), found[at], n[at]) for k, at in zip(which, np.split(order, starts[1:]), strict=True)]
        for low in range(0, len(pieces), 64):
            some = pieces[low : low + 64]
            yield batch_of([block] * len(some), shard=[k for k, *_ in some], kinds=[len(g) for _, g, _ in some], grams=[_packed_grams(g) for _, g, _ in some], counts=[_packed(c) for *_, c in some])

    types = {"word": pa.binary(), "n": pa.int64(), "shard": pa.int32(), "kinds": pa.int32(), "grams": pa.binary(), "counts": pa.binary()}

    def batch_of(blocks: list[int], **columns: list) -> pa.RecordBatch:
        made = [pa.array(columns.get(c, [None] * len(blocks)), t) for c, t in types.items()]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *made], names=["block", *types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, train, others, sums = None, Counter(), set(), Sums()
        lines: dict[bool, list[bytes]] = {False: [], True: []}
        waiting = {False: 0, True: 0}

        def counted(out: bool) -> None:
            if lines[out]:
                found, n = np.unique(codes(lines[out], depth)[0], return_counts=True)
                sums.add(found, np.zeros(len(found), np.int64) if out else n)
                lines[out], waiting[out] = [], 0

        for batch in batches:
            for block, text, out in zip(batch.column("block").to_pylist(), batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                if block != now:
                    counted(False), counted(True)
                    if now is not None:
                        yield from emitted(now, train, others, sums)
                    now, train, others, sums = block, Counter(), set(), Sums()
                found = [*words(text.as_py()), b""]
                others.update(found) if out else train.update(found)
                lines[out].append(symbols(found[:-1]))
                waiting[out] += len(lines[out][-1])
                if waiting[out] >= CHUNK:
                    counted(out)
        counted(False), counted(True)
        if now is not None:
            yield from emitted(now, train, others, sums)

    schema = "block int, word binary, n long, shard int, kinds int, grams binary, counts binary"
    return texts.select("block", "text", "held_out").sortWithinPartitions("block").mapInArrow(run, schema)


def _pieces(found: DataFrame) -> DataFrame:
    return found.filter("shard is not null").select("block", "shard", "kinds", "grams", "counts")


def fit(docs: DataFrame, depth: int = DEPTH, p_min: float = 0.0, divergence: float = DIVERGENCE) -> Model:
    """The model of all texts of ``docs``; candidates have LEAST symbols, or ``p_min`` of all if that is more."""
    texts, blocks = blocked(docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out")))
    return Model(_pieces(stored(used(texts, depth, blocks))), blocks, depth, p_min, divergence)


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Without ``model`` it is that of the rows that aren't held out, and their grams are counted once for both.
    """
    spark = docs.sparkSession
    texts, blocks = blocked(docs.select("doc_id", "text", F.coalesce(held_out("doc_id", 7), F.lit(False)).alias("held_out")))
    found = stored(used(texts, model.depth if model else DEPTH, model.shards if model else blocks))
    pieces = _pieces(found)
    if model is None:
        model = Model(pieces, blocks, DEPTH, 0.0, DIVERGENCE)
    else:
        pieces = pieces.withColumn("counts", F.lit(None).cast("binary")).unionByName(model.pieces.withColumn("block", F.lit(-1)))
    depth, divergence = model.depth, model.divergence
    shared = spark.sparkContext.broadcast(model.states())

    def answered(own: pa.Table) -> pa.Table:
        asked = list(zip(*(own.column(c).to_pylist() for c in ("block", "kinds", "grams", "counts")), strict=True))
        sums = Sums()
        for _, kinds, grams, counts in asked:
            sums.add(_unpacked_grams(grams, kinds), np.zeros(kinds, np.int64) if counts is None else _unpacked(counts, kinds, np.int64))
        every, n = sums.all()
        logs = grown(every, n, *shared.value, divergence).log10(every)
        asked = [(block, kinds, grams, _packed_logs(logs[np.searchsorted(every, _unpacked_grams(grams, kinds))])) for block, kinds, grams, _ in asked if block >= 0]
        made = [list(x) for x in zip(*asked, strict=True)] or [[]] * 4
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "kinds", "grams", "logs"])

    answers = pieces.filter("shard >= 0").groupBy("shard").applyInArrow(answered, "block int, kinds int, grams binary, logs binary")
    of_word = W.partitionBy("word")
    counted = found.filter("word is not null").select("block", "word", "n", F.sum("n").over(of_word).alias("c"), (F.row_number().over(of_word.orderBy("block")) == 1).alias("first"))
    tokens, kinds = F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("kinds")
    totals = counted.agg(F.struct(tokens, kinds).alias("totals"))

    def scored(own: pa.Table, known: pa.Table) -> pa.Table:
        of_words, of_grams = known.filter(pc.is_valid(known.column("words"))), known.filter(pc.is_valid(known.column("grams")))
        log = {}
        for kinds, size, line, c in zip(*(of_words.column(c).to_pylist() for c in ("kinds", "size", "words", "counts")), strict=True):
            log.update(zip(pa.Codec("zstd").decompress(line, size, asbytes=True).split(b" "), np.log10(_unpacked(c, kinds, np.int64) + 1.0).tolist(), strict=True))
        sent = list(zip(*(of_grams.column(c).to_pylist() for c in ("kinds", "grams", "logs")), strict=True))
        grams = np.concatenate([np.zeros(0, np.uint64), *(_unpacked_grams(g, k) for k, g, _ in sent)])
        logs_of = np.concatenate([np.zeros(0), *(_unpacked_logs(v, k) for k, _, v in sent)])
        order = np.argsort(grams, kind="stable")
        grams, logs_of = grams[order], logs_of[order]
        n_tokens, n_known, base, lines = [], [], [], []
        for text in own.column("text"):
            words_of = [*words(text.as_py()), b""]
            n_tokens.append(len(words_of))
            logs = list(map(log.__getitem__, words_of))
            n_known.append(len(words_of) - logs.count(0.0))
            base.append(sum(logs))
            lines.append(symbols(words_of[:-1]))
        by_tree = scores(lines, depth, lambda distinct: logs_of[np.searchsorted(grams, distinct)])
        made = [own.column("doc_id"), own.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(by_tree, pa.float64())]
        return pa.Table.from_arrays(made, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    of_words = counted.select("block", "word", "c").mapInArrow(_packed_words, "block int, kinds int, size int, words binary, counts binary")
    back = of_words.unionByName(answers, allowMissingColumns=True)
    rows = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rows = rows.withColumn("totals", totals.scalar())
    base = F.col("base") - F.col("n_tokens") * F.log10(F.col("totals.tokens") + F.col("totals.kinds") + 1)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.col("totals.tokens").alias("train_tokens"), base.alias("base_score"), "score")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
