"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

1. Every text becomes its set of 64-bit hashes of five-word shingles; equal sets are one item.
2. Document frequencies of all shingles are counted in blocks of hash ranges; the frequent ones give a common order,
   rare first.
3. A pair at or above the threshold t must share a column among the first n - ceil(t*n) + 1 of each row in that order.
   These columns are multiplied in blocks.  Overlaps of pairs that meet only in columns of few items are accumulated,
   and pairs below the size-derived bound on them are discarded.  In a column of many items, the smallest stands for
   all whose sizes are within the bound: they go to its group, so no pair is lost and no column becomes its square.
4. Groups are multiplied in tiles of bounded size: overlaps of whole rows are accumulated over shared columns, pairs
   with 100*overlap < 75*union are discarded, and the rest are links.  A group of more than one tile is first compared
   with its smallest item alone; only what doesn't link with that one is compared with the whole group.
5. Links connect items; a document's component is the smallest id among its items' documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import ship
from .common import few_at_a_time, fresh, row_key, small, tasks, written

WORDS, PERCENT = 5, 75
#: At most so many frequent shingles are broadcast for the order (about 2 MB); any choice gives the same result.
FREQUENT = 1 << 18
LEAST_FREQUENCY = 8
#: Columns of at most so many items are multiplied pair by pair, others by their smallest item.
FEW = 3
#: Items in a tile of a group, and shingles in it, about: a tile of long texts has fewer items.
TILE, TILE_SHINGLES = 1024, 4_000_000
#: Bits of the filter that keeps texts outside all groups from being shuffled (4 MB, whatever the input).
FILTER_BITS = 1 << 25
_FLUSH = 2_000_000
#: Bytes of text whose shingles one task counts, shingles whose columns one task multiplies, and tasks over which a large
#: component is spread.
TASK_BYTES, TASK_SHINGLES, SALTS = 64 << 20, 4_000_000, 32

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, to at least ``n``."""
    global _powers
    if len(_powers[0]) < n:
        size = max(4096, 2 * n)
        tables = []
        for base in (_P, _PINV):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tables[0], tables[1]
    return _powers


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words the whole sequence is one; none without words."""
    return shingle_bytes((text or "").encode("utf-8", "surrogatepass"), size)


def shingle_bytes(text: bytes, size: int = WORDS) -> np.ndarray:
    found = text.lower().split()  # of bytes: only A-Z change, only ASCII space splits
    if not found:
        return np.zeros(0, np.uint64)
    k = min(size, len(found))
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - [len(w) + 1 for w in found])[: len(found) - k + 1]
    data = np.frombuffer(b" ".join(found), np.uint8).astype(np.uint64) + np.uint64(1)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[: len(data)], dtype=np.uint64)])
    h = (sums[ends[k - 1 :] - 1] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def item_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _texts(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], step: int = 256) -> Iterator[list[tuple]]:
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield list(zip(*(part.column(n).to_pylist() for n in names)))


_SETS = pa.schema([("rk", pa.int64()), ("rk2", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("item", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])


def names(spark: SparkSession, n: int) -> np.ndarray:
    """A name of each of ``n`` blocks that a repartition into ``n`` deals to a task of its own (but for a few, if any)."""
    dealt = spark.range(24 * n).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("i").alias("i")).collect()  # n rows
    out = np.full(n, -1, np.int64)
    out[[r["p"] for r in dealt]] = [r["i"] for r in dealt]
    lost = np.flatnonzero(out < 0)
    out[lost] = 24 * n + lost
    return out


def _sets(named: np.ndarray):
    """Rows of documents (rk, rk2, doc_id, n, item) and rows of counts (block, hashes of 32 bits, a document each)."""

    blocks = len(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            all32 = np.sort(np.concatenate(held))
            cuts = np.searchsorted(all32, np.arange(blocks + 1, dtype=np.uint64) * (1 << 32) // blocks)
            out = [(int(named[b]), all32[cuts[b] : cuts[b + 1]].tobytes()) for b in range(blocks) if cuts[b + 1] > cuts[b]]
            none = [None] * len(out)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([none, none, none, none, none, [b for b, _ in out], [x for _, x in out]], _SETS)], schema=_SETS)

        for rows in _texts(batches, ("rk", "rk2", "doc_id", "text")):
            sets = [shingles(r[3]) for r in rows]
            items = [item_of(s) for s in sets]
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [len(s) for s in sets], items, none, none], _SETS)], schema=_SETS)
            for s, item in zip(sets, items):
                if item not in seen:
                    seen.add(item)
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    size += len(s)
            if size > _FLUSH:
                yield flush()
                held.clear()
                seen.clear()
                size = 0
        if size:
            yield flush()

    return run


def _frequent(table: pa.Table) -> pa.Table:
    """(h, c) of a block's hashes that at least LEAST_FREQUENCY items have."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")]
    h, c = np.unique(np.concatenate(parts), return_counts=True)
    often = c >= LEAST_FREQUENCY
    return pa.table({"h": h[often].astype(np.int64), "c": c[often].astype(np.int64)})


def frequent_order(counts: DataFrame, parts: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit hashes of frequent shingles and their binary logarithm of frequency, ``most`` of them at most."""
    found = written(counts.repartition(parts, "block").groupBy("block").applyInArrow(_frequent, "h long, c long"))
    level = F.floor(F.log2("c")).cast("int")
    left, least = most, 64
    for lev, n in sorted(((r[0], r[1]) for r in found.groupBy(level.alias("l")).count().collect()), reverse=True):  # 64 rows at most
        if n > left:
            break
        left, least = left - n, lev
    rows = found.where(level >= least).select("h", level.cast("long").alias("l")).toArrow()
    h, lev = rows.column("h").to_numpy().astype(np.uint32), rows.column("l").to_numpy().astype(np.uint8)
    order = np.argsort(h)
    return h[order], lev[order]


def prefix(hashes: np.ndarray, order: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The columns of a row that take part in the first product: its rarest n - ceil(t*n) + 1."""
    n = len(hashes)
    keep = n - -(-percent * n // 100) + 1 if n else 0
    often, level = order
    if len(often):
        h32 = (hashes >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(often, h32), len(often) - 1)
        weight = np.where(often[at] == h32, level[at], 0)
        return hashes[np.argsort(weight, kind="stable")[:keep]]
    return hashes[:keep]


def _columns(order, named: np.ndarray):
    """A row for each block and flush: items, sizes, columns an item, and the columns' hashes."""
    schema, blocks = pa.schema([("block", pa.int32()), ("cells", pa.binary())]), len(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = order.value
        hs: list[np.ndarray] = []
        items: list[bytes] = []
        sizes: list[int] = []
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            h, owner = np.concatenate(hs), np.repeat(np.arange(len(hs)), [len(x) for x in hs])
            block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            by = np.lexsort((owner, block))
            h, owner, block = h[by], owner[by], block[by]
            ids, many = np.frombuffer(b"".join(i[:8] for i in items), np.int64), np.array(sizes, np.uint32)
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            out = []
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                own, n = np.unique(owner[part], return_counts=True)
                out.append((int(named[b]), len(own).to_bytes(4, "little") + ids[own].tobytes() + many[own].tobytes() + n.astype(np.uint32).tobytes() + h[part].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=schema)

        size = 0
        for rows in _texts(batches, ("text",)):
            for (text,) in rows:
                s = shingles(text)
                item = item_of(s)
                if len(s) and item not in seen:
                    seen.add(item)
                    hs.append(prefix(s, often))
                    items.append(item)
                    sizes.append(len(s))
                    size += len(hs[-1])
            if size > _FLUSH:
                yield flush()
                size = 0
                for x in (hs, items, sizes, seen):
                    x.clear()
        if size:
            yield flush()

    return run


_EDGES = "u long, v long, nu long, nv long, c long, many boolean"


def _product(table: pa.Table) -> pa.Table:
    """Pairs (u, v) of one block, u the smaller: c shared columns of FEW items at most, or ``many``: u stands for a column."""
    ids, sizes, hashes = [], [], []
    for x in table.column("cells"):
        raw = x.as_py()
        n = int.from_bytes(raw[:4], "little")
        item, size, cols = np.frombuffer(raw, np.int64, n, 4), np.frombuffer(raw, np.uint32, n, 4 + 8 * n), np.frombuffer(raw, np.uint32, n, 4 + 12 * n)
        ids.append(np.repeat(item, cols))
        sizes.append(np.repeat(size, cols))
        hashes.append(np.frombuffer(raw, np.uint64, offset=4 + 16 * n))
    item, size, h = np.concatenate(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(hashes)
    by = np.argsort(h, kind="stable")
    item, size, h = item[by], size[by], h[by]
    same = h[1:] == h[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    item, size, h = item[shared], size[shared], h[shared]
    by = np.lexsort((item, size, h))
    item, size, h = item[by], size[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (size[1:] != size[:-1])
    item, size, h = item[new], size[new], h[new]
    first = np.ones(len(h), bool)  # a column ends where the next size is out of bounds
    first[1:] = (h[1:] != h[:-1]) | (100 * size[:-1] < PERCENT * size[1:])
    at = np.flatnonzero(first)
    width = np.diff(np.append(at, len(h)))
    lead, wide = np.repeat(at, width), np.repeat(width, width)
    every = np.arange(len(h))
    star = (wide > FEW) & (every != lead)
    left, right, many = [lead[star]], [every[star]], [np.ones(star.sum(), bool)]
    for gap in range(1, FEW):
        ok = every[: max(0, len(h) - gap)]
        ok = ok[(lead[ok] == lead[ok + gap]) & (wide[ok] <= FEW)]
        left, right, many = [*left, ok], [*right, ok + gap], [*many, np.zeros(len(ok), bool)]
    a, b, big = np.concatenate(left), np.concatenate(right), np.concatenate(many)
    pairs, c = np.unique(np.stack([item[a], item[b], size[a], size[b], big], axis=1), axis=0, return_counts=True)
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1], "nu": pairs[:, 2], "nv": pairs[:, 3], "c": c.astype(np.int64), "many": pairs[:, 4].astype(bool)})


def candidates(products: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v, nu, nv) of pairs that may link: those of wide columns, and those whose overlap within the prefixes is large enough.

    Of a linked pair's overlap o >= t/(1+t) * (nu + nv), the first o - ceil(t * max) + 1 columns lie in both prefixes.
    """
    pairs = products.groupBy("u", "v", "nu", "nv").agg(F.sum(F.when(~F.col("many"), F.col("c")).otherwise(0)).alias("c"), F.max("many").alias("many"))
    overlap = F.ceil(F.lit(percent) * (F.col("nu") + F.col("nv")) / (100 + percent))
    least = overlap - F.ceil(F.lit(percent) * F.greatest("nu", "nv") / 100) + 1
    return pairs.where(F.col("many") | (F.col("c") >= least)).select("u", "v", "nu", "nv")


def tiles() -> Column:
    """The tiles of a group of items with ``n`` shingles each, by items and by shingles."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")


def links_within(sets: list[np.ndarray], left: int | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning set of the linked pairs among ``sets``: with ``left``, only pairs of one below it and one not.

    Overlaps of a row with all others are accumulated over its shared columns; once all are connected it stops.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    owner = np.repeat(np.arange(m), sizes)
    h = np.concatenate(sets)
    by = np.argsort(h, kind="stable")
    h, owner = h[by], owner[by]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    width = np.diff(edge)
    column = np.repeat(np.arange(len(width)), width)
    shared = width[column] > 1
    by_row = np.lexsort((column[shared], owner[shared]))
    row_cols = column[shared][by_row]
    row_at = np.searchsorted(owner[shared][by_row], np.arange(m + 1))
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, apart = [], m - 1
    for x in range(m if left is None else left):
        cols = row_cols[row_at[x] : row_at[x + 1]]
        if not len(cols) or not apart:
            continue
        n = width[cols]
        at = np.repeat(edge[cols] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        overlap = np.bincount(owner[at], minlength=m)
        linked = 100 * overlap >= percent * (sizes[x] + sizes - overlap)
        for y in np.flatnonzero(linked).tolist():
            if y > x and (left is None or y >= left):
                a, b = find(x), find(y)
                if a != b:
                    parent[a] = b
                    apart -= 1
                    out.append((x, y))
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (root, u, v: items) of tiles that arrive sorted by (root, i, j, side).

    A tile of i = j is compared within itself, another by pairs of side 0 and side 1.
    """
    key, items, sets, left = None, [], [], 0
    unpack = zstandard.ZstdDecompressor().decompress

    def close() -> pa.RecordBatch | None:
        pairs = links_within(sets, None if key[1] == key[2] else left) if len(sets) > 1 and (key[1] == key[2] or 0 < left < len(sets)) else []
        if pairs:
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(pairs), pa.int64()), pa.array([items[a] for a, _ in pairs], pa.binary()), pa.array([items[b] for _, b in pairs], pa.binary())], names=["root", "u", "v"])
        return None

    for rows in _texts(batches, ("root", "i", "j", "side", "item", "text"), 64):
        for root, i, j, side, item, text in rows:
            if key != (root, i, j):
                if key is not None and (out := close()) is not None:
                    yield out
                key, items, sets, left, last = (root, i, j), [], [], 0, None
            s = shingle_bytes(unpack(text))
            if item_of(s) == item and last != (side, item):
                last = side, item
                items.append(item)
                sets.append(s)
                left += side == 0
    if key is not None and (out := close()) is not None:
        yield out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"))
    rk, rk2 = row_key(base, "i", "t")
    return base.select(rk.alias("rk"), rk2.alias("rk2"), F.col("i").alias("doc_id"), F.col("t").alias("text"))


def _linked(tiles: DataFrame, blocks: int) -> DataFrame:
    """Links of tiles (root, i, j, side, item, text), written."""
    tiles = tiles.repartition(blocks, "root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "item")
    return written(tiles.mapInArrow(_tiles, "root long, u binary, v binary"))


def group_links(members: DataFrame, texts: DataFrame, blocks: int) -> DataFrame:
    """Links (u, v) that connect all items that link within a group; ``members``: item, rk, short, root, t (tiles), n (shingles)."""
    one, zero = F.lit(1), F.lit(0)
    fit = members.where("t = 1").join(texts, "rk").select("root", zero.alias("i"), zero.alias("j"), zero.alias("side"), "item", "text")
    links = _linked(fit, blocks).select("u", "v")
    if members.where("t > 1").isEmpty():
        return links
    wide = written(members.where("t > 1").join(texts, "rk").withColumn("k", F.pmod(F.xxhash64("item"), F.col("t")).cast("int")).select("root", "t", "k", (F.col("short") == F.col("root")).alias("lead"), "item", "n", "text"))
    # the smallest item with each tile
    lead = wide.where("lead").select("root", F.explode(F.sequence(zero, F.col("t") - 1)).alias("i"), F.lit(-1).alias("j"), zero.alias("side"), "item", "text")
    first = _linked(lead.union(wide.where("not lead").select("root", "k", F.lit(-1), one, "item", "text")), blocks)
    rest = wide.where("not lead").join(first.select("root", F.col("v").alias("item")), ["root", "item"], "left_anti")
    parts = rest.groupBy("root").agg(tiles().alias("p"))
    # what is left with the whole group
    rest = rest.join(parts, "root").select("root", F.pmod(F.xxhash64("item", one), F.col("p")).cast("int").alias("i"), F.explode(F.sequence(zero, F.col("t") - 1)).alias("j"), zero.alias("side"), "item", "text")
    every = wide.join(parts, "root").select("root", F.explode(F.sequence(zero, F.col("p") - 1)).alias("i"), F.col("k").alias("j"), one.alias("side"), "item", "text")
    again = _linked(rest.union(every).withColumn("j", -2 - F.col("j")), blocks)
    return links.union(first.select("u", "v")).union(again.select("u", "v"))


def _solve(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rk, rk2, doc_id, n, item) of every row, and (item, component_id, keep) of every item; keep is the row that stays."""
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = max(1, size // TASK_BYTES)  # the number of blocks grows with the text, so no block does
    table = written(rows.mapInArrow(_sets(names(spark, counted)), "rk long, rk2 int, doc_id long, n long, item binary, block int, counts binary"))
    own = table.where("block is null").select("rk", "rk2", "doc_id", "n", "item")
    order = frequent_order(table.where("block is not null").select("block", "counts"), counted)
    total = own.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, total // TASK_SHINGLES)
    sent = spark.sparkContext.broadcast(order)
    cells = rows.select("text").mapInArrow(_columns(sent, names(spark, blocks)), "block int, cells binary")
    pairs = candidates(written(cells.repartition(blocks, "block").groupBy("block").applyInArrow(_product, _EDGES)))
    group = pairs.select("u", "v", F.col("nv").alias("n")).union(pairs.select("u", F.col("u").alias("v"), "nu")).distinct()
    group = group.join(group.groupBy("u").agg(tiles().alias("t")), "u").select(F.col("v").alias("short"), F.col("u").alias("root"), "t", "n")
    # an item's first 8 bytes name it in groups; where two items share them, both are in the group and are compared
    items = own.where("n > 0").groupBy("item").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "rk2")).alias("first"))
    named = items.select("item", "first.rk").mapInArrow(_short_names, "item binary, rk long, short long")
    members = written(named.join(group, "short").select("item", "rk", "short", "root", "t", "n"))
    texts = rows.select("rk", "text").mapInArrow(_members_only(spark.sparkContext.broadcast(member_filter(members))), "rk long, text binary")
    joined = components(group_links(members, texts, max(blocks, tasks(spark))))
    # only linked items take part, and a large component is spread over salts
    salt = F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int").alias("salt")
    linked = joined.select(F.col("u").alias("item"), "root").union(joined.select("root", "root").distinct())
    linked = written(items.join(linked, "item").select("item", "root", "first", "low", salt))
    least = linked.groupBy("root", "salt").agg(F.min("first").alias("first"), F.min("low").alias("low")).groupBy("root").agg(F.min("first").alias("keep"), F.min("low").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    best = linked.select("item", "root", "salt").join(least, ["root", "salt"]).select("item", "component_id", "keep")
    found = items.join(best, "item", "left").select("item", F.when(F.col("keep").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("keep", "first").alias("keep"))
    return own, written(found)  # a join on a very frequent item is then split by its own side's rows


def member_filter(members: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the members' keys; its size is fixed, so with very many members it lets more texts through."""
    words = members.groupBy(F.expr(f"shiftright(pmod(rk, {bits}), 6)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(rk, {bits}) & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def _members_only(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rk = batch.column("rk").to_numpy()
            bit = np.mod(rk, FILTER_BITS)
            at = np.flatnonzero(sent.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
            for k in range(0, len(at), 256):
                part = at[k : k + 256]
                texts = [pack((x or "").encode("utf-8", "surrogatepass")) for x in batch.column("text").take(pa.array(part)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rk[part]), pa.array(texts, pa.binary())], names=["rk", "text"])

    return run


def _short_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item = batch.column(0)
        names = np.frombuffer(b"".join(x[:8] for x in item.to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([item, batch.column(1), pa.array(names)], names=["item", "rk", "short"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    Null and wordless texts have no shingles and are linked with nothing; a null id never is a component's smallest
    unless all are null; repeated rows stay repeated; texts of any length are read whole; an empty table gives no rows;
    other columns are ignored.
    """
    with few_at_a_time(docs.sparkSession):
        own, found = _solve(docs, id_col, text_col)
    out = own.join(found, "item", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one of smallest id; rows without words all stay. Same columns.

    Of several rows of that id and text, the one whose columns as JSON come first stays. An empty table stays empty.
    """
    with few_at_a_time(docs.sparkSession):
        own, found = _solve(docs, id_col, text_col)
    a, b = fresh(docs, "rk", "rk2")
    each = own.where("n > 0").groupBy("rk", "rk2").agg(F.count(F.lit(1)).alias("c"))
    stays = found.select("keep.rk", "keep.rk2", F.lit(True).alias("again")).distinct()
    mark = each.join(stays, ["rk", "rk2"], "left").where("again is null or c > 1")  # by rows, so a frequent text is no hot key
    mark = written(mark.select(F.col("rk").alias(a), F.col("rk2").alias(b), F.coalesce("again", F.lit(False)).alias("again")))
    i, t = docs[id_col].cast("long"), docs[text_col]
    keyed = docs.select("*", F.xxhash64(i, t, t.isNull()).alias(a), F.hash(F.lit(7), i, t).alias(b))
    left, again = mark.select(a, b), mark.where("again").select(a, b)
    once = keyed.join(small(left) or left, [a, b], "left_anti").select(*docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = keyed.join(small(again) or again, [a, b], "left_semi").groupBy(a, b).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return once.union(repeated)
