"""Token-id output as directly addressable codes.

A segment holds the ids of consecutive documents.  Each id is split into chunks
of the segment's level widths, lowest first.  Level k stores, as bit planes, the
chunks of the ids that reach it, and (all but the last level) a bitmap that says
which of them continue, with a rank directory: the set bits before every 512.
Random access to id i reads one chunk and one bit a level; the rank of that bit
is the position on the next level, so no block is decoded.

Segment layout, little-endian: magic ``LDAC``, u32 version, u64 ids, u32
documents, u32 levels, then a level table (u32 width, u64 entries, u64 offset of
planes, u64 offset of bitmap, u64 offset of directory), then i64 doc ids, u64
document starts, then the levels' bytes.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import tasks, written

MAGIC, VERSION, RANK = b"LDAC", 1, 512
END_ID = 0
#: A segment is closed at this many ids (a longer document is a segment of its own).
SEGMENT_IDS = 1 << 20
#: Entries of a worker's table of encoded pieces (about 40 bytes each); the table starts anew when full.
PIECES = 500_000
#: Pieces encoded in one string, and bytes of text that are cut at a time (a longer text is a part of its own).
JOINED, SLICE = 512, 2 << 20
_SHIFTS = struct.Struct("<IQQQQ")


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process: its table of pieces serves all tasks of the process."""
    return Encoder(path)


def _bytes(*chars: str | int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[c if isinstance(c, int) else ord(c) for c in chars]] = True
    return out


_SEEN = _bytes(*range(0x21, 0x7F))  # ASCII that can be seen
_ALPHA = _bytes(*range(65, 91), *range(97, 123))
_MARK = _SEEN & ~_ALPHA & ~_bytes(*range(48, 58), "'")  # an apostrophe may begin a contraction
#: First bytes of characters of which none is white space (others may be; they are never cut at).
_BEGINS = _SEEN | _bytes(*range(0xC3, 0xE0), *range(0xE4, 0xF5))


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``, for columns at a time.

    A byte-level tokenizer's pre-tokens never reach over three kinds of places: before a space that something to see
    follows, between a letter and a mark, and around a line end between two characters that can be seen. Texts are cut
    there, equal pieces are found by a dictionary of the column, and each distinct piece is encoded once; a table keeps
    the ids of earlier columns' pieces. Texts that hold a special token's string, and all texts of a tokenizer of another
    kind, are encoded as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre, line = spec["pre_tokenizer"] or {}, self._whole(["\n"])[0]
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cuttable = bool(byte_level and spec["normalizer"] is None and len(line) == 1)
        self.line = line[0] if len(line) else 0
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; few at a time, since what the tokenizer returns is a hundred bytes an id."""
        parts = (texts[k : k + 32] for k in range(0, len(texts), 32))
        return [np.array(x.ids, np.uint32) for part in parts for x in self.tok.encode_batch_fast(part, add_special_tokens=False)]

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and count of ids of distinct pieces: those without white space inside in joined lines, others alone."""
        joins = pc.match_substring_regex(pieces, r"^ ?[^\s\p{Z}\p{C}]+$").to_numpy(zero_copy_only=False)
        names, sizes = pieces.to_pylist(), np.zeros(len(pieces), np.int64)
        lines, rest = np.flatnonzero(joins), np.flatnonzero(~joins).tolist()
        parts: dict[int, np.ndarray] = {}  # by the first piece's place
        groups = [lines[k : k + JOINED] for k in range(0, len(lines), JOINED)]
        for group, ids in zip(groups, self._whole(["\n".join([names[i] for i in g]) + "\n" for g in groups])):
            ends = np.flatnonzero(ids == self.line)
            if len(ends) != len(group):
                rest += group.tolist()
                continue
            sizes[group] = np.diff(ends, prepend=-1) - 1
            parts[int(group[0])] = ids[ids != self.line]
        order = list(parts)
        for i, ids in zip(rest, self._whole([names[i] for i in rest])):
            sizes[i], parts[i] = len(ids), ids
        ids = np.concatenate([*parts.values(), np.zeros(0, np.uint32)])
        placed = np.concatenate([*[lines[k : k + JOINED] for k in np.searchsorted(lines, order).tolist()], np.array(rest, np.int64)]).astype(np.int64)
        starts = np.zeros(len(pieces), np.int64)
        starts[placed] = np.cumsum(sizes[placed]) - sizes[placed]
        return ids[_ranges(starts, sizes)], sizes

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Places of these pieces in the table, which learns the new ones; it starts anew when it is full."""
        if len(self.known) > PIECES:
            self._reset()
        at = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(pc.is_null(at))
        if len(new):
            ids, sizes = self._encoded(new)
            fresh = pc.is_null(at).to_numpy(zero_copy_only=False)
            at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).copy()
            at[fresh] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, (self.at[-1] + np.cumsum(sizes)).astype(np.int32)])
            return at
        return at.to_numpy()

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' places in the table, text after text, and the count of pieces before each text and after all."""
        size = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], size, len(texts) + 1, texts.offset * np.dtype(size).itemsize)
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[ends[0] : ends[-1]] if whole is not None else np.zeros(0, np.uint8)
        ends = (ends - ends[0]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        letter = _ALPHA[data]  # ASCII, and what follows the byte C3 but for two marks
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begins, seen = _BEGINS[data], letter | _SEEN[data]
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 32) & begins[1:]
        cut[ends[1:][np.diff(ends) > 0] - 1] = False  # what follows is the next text's
        cut[1:] |= letter[:-1] & _MARK[data[1:]]
        line = np.flatnonzero(data == 10)
        line = line[(line > 0) & (line < len(data) - 1)]
        line = line[seen[line - 1] & begins[line + 1]]
        cut[line] = cut[line + 1] = True
        first = ends[:-1][np.diff(ends) > 0]
        cut[first] = True
        at = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        return self._places(coded.dictionary)[coded.indices.to_numpy()], np.append(np.searchsorted(at, ends[:-1]), len(at))

    def _sliced(self, texts: pa.Array) -> Iterator[tuple[pa.Array, bool]]:
        """The column in parts of about SLICE bytes, and whether a part's texts may be cut."""
        texts = pc.fill_null(texts, "")
        odd = np.full(len(texts), not self.cuttable)
        for name in self.added:
            odd |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            pa.default_memory_pool().release_unused()
            if odd[a]:
                yield texts.slice(a, 1), False
                a += 1
                continue
            far = int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE, "right"))
            later = np.flatnonzero(odd[a : max(far, a + 1)])
            b = a + int(later[0]) if len(later) else max(far, a + 1)
            yield texts.slice(a, b - a), True
            a = b

    def encode(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Flat ids and each text's count of ids, of consecutive parts of the column; ``end`` is added to each text."""
        for part, whole in self._sliced(texts):
            tail = [] if end is None else [end]
            if not whole:
                ids = np.append(self._whole(part.to_pylist())[0], np.array(tail, np.uint32)).astype(np.uint32)
                yield ids, np.array([len(ids)])
                continue
            at, first = self._cut(part)
            start, size = self.at[at], self.at[at + 1] - self.at[at]
            flat = self.flat
            if tail:  # one more piece at each text's end
                flat = np.append(flat, np.uint32(end))
                start, size = np.insert(start, first[1:], len(flat) - 1), np.insert(size, first[1:], 1)
                first = first + np.arange(len(first))
            before = np.concatenate([[0], np.cumsum(size)])
            yield flat[_ranges(start, size)], np.diff(before[first])

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Each text's count of ids."""
        out = [np.zeros(0, np.int64)]
        for part, whole in self._sliced(texts):
            if whole:
                at, first = self._cut(part)
                before = np.concatenate([[0], np.cumsum(self.at[at + 1] - self.at[at])])
                out.append(np.diff(before[first]))
            else:
                out.append(np.array([len(self._whole(part.to_pylist())[0])]))
        return np.concatenate(out)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every start, as many as its size, one after another."""
    total = np.cumsum(sizes)
    n = int(total[-1]) if len(total) else 0
    return np.repeat((starts - (total - sizes)).astype(np.int32), sizes) + np.arange(n, dtype=np.int32)  # within a table or a part


def level_widths(ids: np.ndarray, most: int = 4) -> list[int]:
    """The level widths that take the fewest bits for these ids, by dynamic programming over bit lengths."""
    bits = np.frexp(ids.astype(np.float64))[1]
    top = max(1, int(bits.max()) if len(bits) else 1)
    over = (len(ids) - np.cumsum(np.bincount(bits, minlength=top + 1))).tolist()  # ids of more than b bits
    over[0] = len(ids)
    best: dict[tuple[int, int], tuple[float, list[int]]] = {}

    def cost(start: int, left: int) -> tuple[float, list[int]]:
        if start >= top:
            return 0.0, []
        if (start, left) not in best:
            options = [(float(over[start] * (top - start)), [top - start])]
            if left > 1:
                for end in range(start + 1, top):
                    rest, widths = cost(end, left - 1)
                    options.append((over[start] * (end - start + 1.07) + rest, [end - start, *widths]))
            best[start, left] = min(options)
        return best[start, left]

    return cost(0, most)[1]


def _rank_directory(bitmap: np.ndarray) -> np.ndarray:
    """Set bits before every RANK bits."""
    ones = np.unpackbits(bitmap, bitorder="little")
    ones = np.concatenate([ones, np.zeros(-len(ones) % RANK, np.uint8)]).reshape(-1, RANK).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if len(ones) else np.zeros(0, "<u8")


def pack(doc_ids: list[int], ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """One segment of these documents' ids, one document's after another's."""
    starts = (np.cumsum(sizes) - sizes).astype("<u8")
    widths = level_widths(ids)
    fixed = 24 + _SHIFTS.size * len(widths)
    body, at, table, rest = [], fixed + 16 * len(doc_ids), [], ids
    for k, width in enumerate(widths):
        kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32
        chunk = (rest & np.uint32((1 << width) - 1)).astype(kind)
        planes = b"".join(np.packbits(chunk & kind(1 << j) != 0, bitorder="little").tobytes() for j in range(width))
        bitmap = directory = b""
        n = len(rest)
        if k < len(widths) - 1:
            above = rest >> np.uint32(width)
            more = above > 0
            packed = np.packbits(more, bitorder="little")
            bitmap, directory = packed.tobytes(), _rank_directory(packed).tobytes()
            rest = above[more]
        table.append(_SHIFTS.pack(width, n, at, at + len(planes), at + len(planes) + len(bitmap)))
        body += [planes, bitmap, directory]
        at += len(planes) + len(bitmap) + len(directory)
    head = MAGIC + struct.pack("<IQII", VERSION, len(ids), len(doc_ids), len(widths))
    return b"".join([head, *table, np.array(doc_ids, "<i8").tobytes(), starts.tobytes(), *body])


class Segment:
    """Reads a segment: any id by position, any document, or all ids."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment")
        version, self.n_ids, self.n_docs, n_levels = struct.unpack_from("<IQII", raw, 4)
        if version != VERSION:
            raise ValueError(f"version {version} is not known")
        self.raw, at = raw, 24
        self.levels = [_SHIFTS.unpack_from(raw, at + k * _SHIFTS.size) for k in range(n_levels)]
        at += n_levels * _SHIFTS.size
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.starts = np.frombuffer(raw, "<u8", self.n_docs, at + 8 * self.n_docs).astype(np.int64)

    def __getitem__(self, i: int) -> int:
        """Id i, without decoding others."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for k, (width, n, planes, bitmap, directory) in enumerate(self.levels):
            step = (n + 7) // 8
            for j in range(width):
                value |= (self.raw[planes + j * step + i // 8] >> (i % 8) & 1) << (shift + j)
            if k == len(self.levels) - 1 or not self.raw[bitmap + i // 8] >> (i % 8) & 1:
                return value
            block = i // RANK
            first = block * RANK // 8
            rank = struct.unpack_from("<Q", self.raw, directory + 8 * block)[0]
            rank += int.from_bytes(self.raw[bitmap + first : bitmap + i // 8], "little").bit_count()
            rank += (self.raw[bitmap + i // 8] & ((1 << i % 8) - 1)).bit_count()
            i, shift = rank, shift + width
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(self.n_ids, "<u4")
        where, shift = None, 0
        for k, (width, n, planes, bitmap, _) in enumerate(self.levels):
            step = (n + 7) // 8
            kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32
            chunk = np.zeros(n, kind)
            for j in range(width):
                chunk |= np.unpackbits(np.frombuffer(self.raw, np.uint8, step, planes + j * step), count=n, bitorder="little").astype(kind) << kind(j)
            if where is None:
                out = chunk.astype("<u4")
            else:
                out[where] |= chunk.astype("<u4") << np.uint32(shift)
            if k < len(self.levels) - 1:
                where = (np.arange(n) if where is None else where)[np.unpackbits(np.frombuffer(self.raw, np.uint8, step, bitmap), count=n, bitorder="little").astype(bool)]
            shift += width
        return out

    def document(self, k: int) -> range:
        """Positions of document k's ids."""
        return range(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < self.n_docs else self.n_ids)


_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("null_ids", pa.binary()), ("segment", pa.binary())])


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        docs: list[int | None] = []
        kept: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = start = seq = 0

        def close() -> pa.RecordBatch:
            nulls = np.packbits([d is None for d in docs], bitorder="little").tobytes()
            raw = pack([d or 0 for d in docs], np.concatenate(kept), np.concatenate(sizes))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "start": start, "n_ids": held, "n_docs": len(docs), "null_ids": nulls, "segment": raw}], schema=_SEGMENT)

        for batch in batches:
            names, row = batch.column(0).to_pylist(), 0
            for ids, n in enc.encode(batch.column(1), END_ID):
                ends, a, at = np.cumsum(n), 0, 0
                while a < len(n):  # as many documents as the open segment takes
                    b = int(np.searchsorted(ends, at + SEGMENT_IDS - held, "right"))
                    if b <= a and docs:
                        yield close()
                        start, seq, held = start + held, seq + 1, 0
                        docs, kept, sizes = [], [], []
                        continue
                    b = max(b, a + 1)
                    docs += names[row + a : row + b]
                    kept.append(ids[at : ends[b - 1]])
                    sizes.append(n[a:b])
                    held += int(ends[b - 1]) - at
                    a, at = b, int(ends[b - 1])
                row += len(n)
        if docs:
            yield close()

    return run


def write_codes(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids, then END_ID, as segments in ascending id order; returns the written table.

    ``part``, ``seq`` order the segments; ``start`` counts ids from the part's first.  A null text counts as empty, a
    null id comes first and is kept as null, equal ids stand in order of their texts' hashes; an empty table writes no
    segment; other columns are ignored.
    """
    ship(docs.sparkSession)
    order = [F.col("i").asc_nulls_first(), F.xxhash64("t"), F.hash("t")]
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(_writer(tokenizer), "part int, seq int, start long, n_ids long, n_docs long, null_ids binary, segment binary"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            base, start, nulls, raw = (batch.column(n)[row].as_py() for n in ("base", "start", "null_ids", "segment"))
            seg = Segment(raw)
            ids, spans = seg.ids(), [seg.document(k) for k in range(seg.n_docs)]
            null = np.unpackbits(np.frombuffer(nulls, np.uint8), count=seg.n_docs, bitorder="little").astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg.doc_ids, pa.int64(), mask=null), pa.array(seg.starts + base + start), pa.array([len(s) for s in spans], pa.int64()), pa.array([zlib.crc32(ids[s.start : s.stop].tobytes()) for s in spans], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_codes(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored segments.

    Only each part's sum of ids goes to the driver: a row for each partition of the writer.
    """
    ship(segments.sparkSession)
    spark = segments.sparkSession
    sums, base = [], 0
    for part, n in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        sums.append((part, base))
        base += n
    bases = F.broadcast(spark.createDataFrame(sums, "part int, base long"))
    return segments.join(bases, "part").select("base", "start", "null_ids", "segment").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
