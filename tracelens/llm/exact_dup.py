"""Exact dedup with an extendible-hash index on shared files.

Two texts are equal when identical after lower-casing A-Z. A task puts the equal texts of its rows together as one
entry (key: 64-bit hash, text bytes, doc_ids), so copies are counted before the shuffle; entries are written to the
shared folder. The key's first bits name an owner, and an owner has about OWNER_BYTES of text, however large the
corpus. An owner task reads its key range and inserts each entry into its part of the index: the directory over the
next bits of the key names a bucket, the bucket is walked along the records of that key, and their texts are compared
byte by byte; an equal one takes the entry in, else a record is chained to them. An overfull bucket is split by its
next bit, and the directory doubles when it has no bit to spare; a bucket that holds one key only, or is as deep as may
be, grows by its chain instead.

The index is written to the shared folder as three kinds of rows: directory slots (owner, slot -> bucket), records
(owner, bucket, key, chain -> keep_id, group_size), and the place in its chain that each entry was given. Entries then
look their group up through it: owner and slot from their key, the bucket from the directory, the record from the
bucket.

Null counts as empty. Of equal texts the row with the largest doc_id stays; rows with the same text and doc_id are one
document and both kept. A null doc_id stays only if no copy has one. Memory per task: entries of ENTRY_BYTES, an owner's
distinct texts. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import saved

#: Records of a bucket before it is split; bytes of text that an owner and a map task hold, about.
BUCKET, OWNER_BYTES, ENTRY_BYTES = 64, 1 << 24, 1 << 24

#: Doublings of an owner's directory; a bucket of this depth overflows into its chain instead.
MOST_DEPTH = 16
KEY_BITS, MOST_OWNER_BITS = 64, 30
MASK = (1 << KEY_BITS) - 1


def key_of(text: bytes) -> int:
    """Signed 64-bit key of a normalised text."""
    return int.from_bytes(blake2b(text, digest_size=8).digest(), "big", signed=True)


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return (text or "").encode().lower()


class Directory:
    """Extendible hash directory of one owner, over the key bits behind the owner's own."""

    def __init__(self, skip: int, capacity: int):
        self.skip, self.capacity, self.depth = skip, capacity, 0
        self.slots: list[dict] = [{"depth": 0, "prefix": 0, "records": []}]

    def _slot(self, key: int) -> int:
        return ((key & MASK) << self.skip & MASK) >> (KEY_BITS - self.depth) if self.depth else 0

    def find(self, key: int, text: bytes) -> tuple[list | None, int]:
        """The record [key, chain, text, ...] of a text, and how many others of its key were passed on the way."""
        passed = 0
        for r in self.slots[self._slot(key)]["records"]:
            if r[0] == key:
                if r[2] == text:
                    return r, passed
                passed += 1
        return None, passed

    def insert(self, record) -> None:
        """record: (key, ...)"""
        while True:
            bucket = self.slots[self._slot(record[0])]
            records = bucket["records"]
            if len(records) < self.capacity or bucket["depth"] >= MOST_DEPTH or all(r[0] == record[0] for r in records):
                records.append(record)
                return
            self._split(bucket)

    def _split(self, bucket: dict) -> None:
        if bucket["depth"] == self.depth:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        halves = [{"depth": bucket["depth"] + 1, "prefix": bucket["prefix"] * 2 + bit, "records": []} for bit in (0, 1)]
        at = self.skip + bucket["depth"]
        for r in bucket["records"]:
            halves[(r[0] & MASK) >> (KEY_BITS - 1 - at) & 1]["records"].append(r)
        span = 1 << (self.depth - halves[0]["depth"])
        for half in halves:
            self.slots[half["prefix"] * span : (half["prefix"] + 1) * span] = [half] * span

    def buckets(self) -> Iterator[dict]:
        last = None
        for b in self.slots:
            if b is not last:
                last = b
                yield b


def _entries(key: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        size, task, at = 0, uuid.uuid4().hex, 0

        def flushed() -> pa.RecordBatch:
            texts = list(found)
            kinds = {
                "entry": pa.array([f"{task}{at + i}" for i in range(len(texts))], pa.string()), "key": pa.array(map(key, texts), pa.int64()), "text": pa.array(texts, pa.binary()),
                "bytes": pa.array(map(len, texts), pa.int64()), "ids": pa.array(list(found.values()), pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_arrays(list(kinds.values()), list(kinds))

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = normalised(text)
                ids = found.get(text)
                if ids is None:
                    ids = found[text] = []
                    size += len(text)
                ids.append(doc)
                size += 16
            if size > ENTRY_BYTES:
                yield flushed()
                at += len(found)
                found, size = {}, 0
        if found:
            yield flushed()

    return run


ENTRY = "entry string, key long, text binary, bytes long, ids array<long>"
#: kind "record": chain, text_sha256, keep_id, group_size; "slot": slot, bucket, depth (of the directory); "entry": chain
INDEX = "kind string, owner long, slot long, bucket long, depth int, key long, chain int, entry string, text_sha256 string, keep_id long, group_size long"
_INDEX_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _own(skip: int, capacity: int):
    """Entries in the order of their owner to the rows of the owners' indexes."""
    names, kinds = zip(*[x.split() for x in INDEX.split(", ")], strict=True)

    def rows(owner: int, directory: Directory, placed: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for b in directory.buckets():
            out += [{"kind": "record", "bucket": b["prefix"] << 8 | b["depth"], "key": r[0], "chain": r[1], "text_sha256": sha256(r[2]).hexdigest(), "keep_id": r[3], "group_size": r[4]} for r in b["records"]]
            if len(out) >= 4096:
                yield made(owner, out)
                out = []
        out += [{"kind": "slot", "slot": i, "bucket": b["prefix"] << 8 | b["depth"], "depth": directory.depth} for i, b in enumerate(directory.slots)]
        for lo in range(0, len(placed), 4096):
            out += [{"kind": "entry", "entry": e, "key": k, "chain": c} for e, k, c in placed[lo : lo + 4096]]
            yield made(owner, out)
            out = []

    def made(owner: int, out: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([owner] * len(out) if n == "owner" else [r.get(n) for r in out], _INDEX_KINDS[k]) for n, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, directory, placed = None, Directory(skip, capacity), []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("owner", "entry", "key", "top", "n"))
            for i, (o, entry, key, top, n) in enumerate(zip(*columns, strict=True)):
                if o != owner:
                    if owner is not None:
                        yield from rows(owner, directory, placed)
                    owner, directory, placed = o, Directory(skip, capacity), []
                text = batch.column("text")[i].as_py()
                record, passed = directory.find(key, text)
                if record is None:
                    record = [key, passed, text, top, n]
                    directory.insert(record)
                else:
                    record[4] += n
                    if top is not None and (record[3] is None or top > record[3]):
                        record[3] = top
                placed.append((entry, key, record[1]))
        if owner is not None:
            yield from rows(owner, directory, placed)

    return run


def build_index(entries: DataFrame, capacity: int = BUCKET, owner_bytes: int = OWNER_BYTES) -> tuple[DataFrame, int]:
    """The index of a table of entries, as a table in the shared folder, and the number of key bits that name an owner."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = entries.agg(F.sum("bytes")).first()[0] or 0
    skip = min(MOST_OWNER_BITS, max(0, (size // owner_bytes).bit_length(), (n - 1).bit_length()))
    rows = entries.select(_owner(skip).alias("owner"), "entry", "key", "text", F.array_max("ids").alias("top"), F.size("ids").cast("long").alias("n"))
    dealt = rows.repartition(n, "owner").sortWithinPartitions("owner")
    return saved(dealt.mapInArrow(_own(skip, capacity), INDEX), "extendible-hash"), skip


def _owner(skip: int):
    return F.shiftrightunsigned("key", KEY_BITS - skip) if skip else F.lit(0).cast("long")


def look_up(entries: DataFrame, index: DataFrame, skip: int) -> DataFrame:
    """(ids, text_sha256, keep_id, group_size) of each entry by its record in the index."""
    slots = index.where("kind = 'slot'").select("owner", "slot", "bucket", "depth")
    records = index.where("kind = 'record'").select("owner", "bucket", "key", "chain", "text_sha256", "keep_id", "group_size")
    placed = index.where("kind = 'entry'").select("entry", "owner", "key", "chain")
    depths = slots.select("owner", "depth").distinct()
    # the first `depth` bits of the key behind the owner's are the slot
    slot = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.shiftleft("key", skip), KEY_BITS - F.col("depth")))
    at = placed.join(depths, "owner").withColumn("slot", slot).join(slots.drop("depth"), ["owner", "slot"])
    found = at.join(records, ["owner", "bucket", "key", "chain"]).select("entry", "text_sha256", "keep_id", "group_size")
    return entries.select("entry", "ids").join(found, "entry")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[bytes], int] = key_of, capacity: int = BUCKET) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    entries = saved(texts.mapInArrow(_entries(key), ENTRY), "entries")
    index, skip = build_index(entries, capacity)
    out = look_up(entries, index, skip).select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
