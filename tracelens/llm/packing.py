"""Best-fit packing of tokenised documents into sequences.

Best-fit decreasing, exactly and for all documents at once: lengths are whole numbers up to the capacity, so open
bins with equal room left are interchangeable, and the whole corpus is its histogram of lengths. The plan is made on
that histogram (at most `capacity` numbers, whatever the corpus): for each length, longest first, a segment tree over
the capacities finds the least room that still fits in logarithmic time, and all bins with that room are filled at
once, each with as many pieces of the length as fit: best fit goes on with the bin it has just used.
The plan's rows say: the pieces of length L ranked a to b go to the bins s, s + 1, ... at offset o.

Pieces get their rank within a length without a global sort: they are dealt by (length, salt), ranked there, and
shifted by the counts of the salts before; a length has a salt for about every RANKED pieces. Pieces of the full
capacity need no rank, as each is a sequence of its own (with a negative number).
The plan is broadcast. Its rows don't grow with the corpus: a span of bins that are filled alike has a row a piece,
and there are at most two spans for each length (about 32,000 rows for any corpus of capacity 4096; PLAN_ROWS is
checked).

A null or empty text is one piece: the end token alone. Pieces longer than the capacity don't occur; documents
longer are cut, and full pieces fill a sequence each. Repeated rows are packed as often as they occur; ranks among
equal pieces follow doc_id and piece. A null doc_id is packed like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.llm.bpe import LibraryBpe, caches, tokenizer
from tracelens.llm.common import saved

CAPACITY, END_ID = 4096, 1
#: Pieces of one length that one task ranks, about.
RANKED = 100_000
#: Most rows of a plan that is broadcast: some 100 MB.
PLAN_ROWS = 4_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    end = pack_ids("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (known, _) = tokenizer(path, LibraryBpe), caches("bytes", path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, units in zip(ids, t.blocks(batch.column("text").to_pylist(), [known], [lambda x: pack_ids(f"<{len(x)}I", *x)]), strict=True):
                packed = b"".join(map(known.__getitem__, units)) + end
                step = 4 * capacity
                for k, at in enumerate(range(0, len(packed), step)):
                    part = packed[at : at + step]
                    for column, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and the end id, cut at the capacity."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(path, capacity, end_id), PIECES)


class RoomTree:
    """Segment tree over the room left in open bins: which rooms have bins, and the least of them from some room up."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def mark(self, room: int, has: bool) -> None:
        i = room + self.leaves
        self.any[i] = has
        while i > 1:
            i >>= 1
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def least(self, room: int) -> int | None:
        """The least room with bins that is at least this."""
        i = room + self.leaves
        if self.any[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on a histogram length -> pieces. Rows (length, first rank, rank after the last, first bin,
    offset): ranks go to consecutive bins."""
    tree, bins, made, plan = RoomTree(capacity), {}, 0, []
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.least(length)
            if room is None:
                # as many new bins as the rest needs when each takes as many of this length as fit
                n = -(-left // (capacity // length))
                room, bins[capacity] = capacity, [(made, made + n)]
                made += n
            spans = bins[room]
            while spans and left:
                lo, hi = spans.pop()
                # a bin just used is the tightest that fits, so it takes all it can before the next one
                each = min(left, room // length)
                n = min(left // each, hi - lo)
                for k in range(each):
                    plan.append((length, rank, rank + n, lo, capacity - room + k * length))
                    rank += n
                left -= n * each
                if lo + n < hi:
                    spans.append((lo + n, hi))
                rest = room - each * length
                into = bins.setdefault(rest, [])
                if into and into[-1][1] == lo:
                    into[-1] = (into[-1][0], lo + n)
                else:
                    into.append((lo, lo + n))
                tree.mark(rest, True)
            tree.mark(room, bool(spans))
    return plan


def _placed(plan_of):
    """Sequence and offset for rows ordered by length, from the plan's rows of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for x in np.unique(length):
                at = length == x
                first, bin_, off = plan[x]
                i = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = bin_[i] + rank[at] - first[i], off[i]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ...) with sequence_id and offset. pieces is read several times: give a
    saved table."""
    spark = pieces.sparkSession
    total = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` numbers
    plan: dict[int, list[tuple]] = {}
    for i, row in enumerate(plan_packing({k: v for k, v in total.items() if k < capacity}, capacity)):
        if i == PLAN_ROWS:
            raise ValueError(f"the plan has more than {PLAN_ROWS} rows at a capacity of {capacity}")
        plan.setdefault(row[0], []).append(row)
    ship = spark.sparkContext.broadcast({k: tuple(np.array([r[i] for r in v], np.int64) for i in (1, 3, 4)) for k, v in plan.items()})

    whole = F.col("length") >= capacity
    alone = pieces.where(whole).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    several = {k: -(-n // RANKED) for k, n in total.items() if k < capacity and n > RANKED}
    salts = F.lit(1)
    if several:  # at most `capacity` of them
        salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in several.items() for x in kv]), F.col("length").cast("int")), salts)
    dealt = pieces.where(~whole).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("length", "salt").count().withColumn("shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = dealt.withColumn("own", F.row_number().over(order) - 1).join(shifts, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("own") + F.col("shift")).alias("rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_placed(ship), schema).union(alone)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All documents' pieces with the sequence and offset they are packed at."""
    return pack(saved(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)
