"""Passage dedup with a sparse suffix array: of passages of LENGTH words or more that occur more than once, the
first occurrence, by (doc_id, hash of the text, position), stays.

Sparse suffixes. In every window of LENGTH words the k-gram with the least hash (the leftmost, at ties) is the
window's minimiser; only suffixes that begin at minimisers are retained, about one in 18 words. Equal windows choose
equal minimisers, so every repeated passage has a retained suffix at the same place in each occurrence.

Sort and compare. Suffixes are sorted by (k-gram, surroundings, doc_id, text, position); the surroundings are the words
to both sides as far as any window of this minimiser can reach. A suffix behind a neighbour with the same k-gram and
surroundings is settled: all windows here are copies. The first of each such class is extended if its k-gram has
another class, that is other surroundings.

Extend. A suffix is extended to the left and right by each split of LENGTH words into words before and after its begin
for which it is the minimiser: the window there is hashed (128 bits), and windows whose words are all the same meet in
a partial aggregate that keeps the first place. The neighbour with the longest match to the right needn't have the
longest to the left, so the comparison is over all suffixes with the k-gram and not with the next one only. Covered
windows are merged per text, so matches of any length are found whole, and a word goes exactly if some window of LENGTH
words over it has an earlier occurrence.

Skew. Copies within a task's batch are settled before the shuffle; suffixes are dealt by k-gram and surroundings, so a
frequent k-gram spreads with its surroundings, and whether a k-gram has several classes is a partial aggregate. No
group is collected or paired. Texts are cut in a join by document.

Words are runs of bytes other than 0x20 and 0x09-0x0D, compared after lower-casing A-Z. Null texts count as empty
and stay null; shorter texts stay as they are; rows with a null doc_id take no part and stay. Rows with equal doc_id
and text are one document; different texts of one doc_id stand in the order of their hashes (64 bits). Cutting removes everything from a passage's first word to the next word that stays, and
white space before a passage that ends the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import lean, saved
from tracelens.llm.words import _BASE, _upto, U, chunks, mix, runs

LENGTH, GRAM = 50, 16
#: k-grams of a window: a suffix lies at most REACH words behind the begin of its windows.
REACH = LENGTH - GRAM

COVERED, FIRST = 0, 1
SUFFIX = "gram long, around long, doc_id long, text_hash long, pos int, kind int"
FOUND = "gram long, doc_id long, text_hash long, pos int, kind int"
WINDOW = "h1 long, h2 long, doc_id long, text_hash long, lo int"


class Text:
    """One text's word hashes and the minimiser of each of its windows."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.n = hashes, len(hashes)
        grams = runs(hashes, GRAM)
        self.grams = grams
        view = np.lib.stride_tricks.sliding_window_view(grams, REACH + 1)
        self.minimiser = np.concatenate([view[lo : lo + 4096].argmin(axis=1) for lo in range(0, len(view), 4096)]) + np.arange(len(view))
        self.suffixes = self.minimiser[np.append(True, self.minimiser[1:] != self.minimiser[:-1])]

    def _sums(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n + 1, U)
        np.cumsum(hashes * _upto(self.n)[0], out=out[1:])
        return out

    def between(self, lo: np.ndarray, hi: np.ndarray, second: bool = False) -> np.ndarray:
        """Hash of the words lo to hi."""
        sums = self._sums(mix(self.hashes ^ U(0x2545F4914F6CDD1D)) if second else self.hashes)
        return mix((sums[hi] - sums[lo]) * _upto(self.n + 1)[1][lo] + (hi - lo).astype(U))

    def around(self) -> np.ndarray:
        """Hash of each suffix's surroundings, and of how far they go."""
        p = self.suffixes
        lo, hi = np.maximum(p - REACH, 0), np.minimum(p + LENGTH, self.n)
        return mix(self.between(lo, hi) ^ ((p - lo) * 128 + hi - p).astype(U))

    def windows(self, suffixes: np.ndarray) -> np.ndarray:
        """Begins of the windows that have one of these minimisers."""
        return np.flatnonzero(np.isin(self.minimiser, suffixes))


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x, U).view(np.int64) if len(x) else np.zeros(0, np.int64))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of a batch; of equal ones (k-gram and surroundings) all but the first are settled here."""
    lean("passages")
    for batch in batches:
        docs, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
        parts = []
        for row, w in chunks(batch.column("text")):
            for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                if b - a >= LENGTH:
                    t = Text(w.hash[a:b])
                    m = len(t.suffixes)
                    parts.append((t.grams[t.suffixes], t.around(), np.full(m, docs[row + k]), np.full(m, marks[row + k]), t.suffixes))
        if not parts:
            continue
        gram, around, doc, mark, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((pos, mark, doc, around, gram))
        gram, around, doc, mark, pos = (c[order] for c in (gram, around, doc, mark, pos))
        head = np.append(True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1]))
        first = np.maximum.accumulate(np.where(head, np.arange(len(gram)), 0))
        # a repeated row is the same place
        later = (doc != doc[first]) | (mark != mark[first]) | (pos != pos[first])
        ints = lambda x: pa.array(x.astype(np.int32))
        columns = [_longs(gram), _longs(around), pa.array(doc), pa.array(mark), ints(pos), ints(np.where(later, COVERED, FIRST))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SUFFIX.split(", ")])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the order of (kind, gram, around, doc_id, text_hash, pos): COVERED for what is settled already or comes after
    an equal suffix, FIRST for the first of a class."""
    lean("passages")
    last = None  # the place (gram, around, doc_id, text_hash, pos) that opened the current class
    for batch in batches:
        gram, around, doc, mark, pos, kind = (batch.column(c).to_numpy() for c in ("gram", "around", "doc_id", "text_hash", "pos", "kind"))
        n = len(gram)
        if not n:
            continue
        settled = kind == COVERED
        head = np.append(True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1]) | (kind[1:] != kind[:-1]))
        opens = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        later = (doc != doc[opens]) | (mark != mark[opens]) | (pos != pos[opens])
        goes_on = 0
        if last is not None and not settled[0] and (gram[0], around[0]) == last[:2]:
            goes_on = int(np.append(np.flatnonzero(head[1:]) + 1, n)[0])  # rows of the class that the batch before opened
            later[:goes_on] = (doc[:goes_on] != last[2]) | (mark[:goes_on] != last[3]) | (pos[:goes_on] != last[4])
        if not settled[-1]:
            o = opens[-1]
            if not (o == 0 and goes_on):
                last = (gram[o], around[o], doc[o], mark[o], pos[o])
        # repeated rows of a place go on once
        again = np.append(False, ~head[1:] & (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (pos[1:] == pos[:-1]))
        again[:1] = bool(goes_on) and not later[0]
        keep = np.flatnonzero(~again)
        out = np.where(settled | later, COVERED, FIRST).astype(np.int32)[keep]
        columns = [pa.array(gram[keep]), pa.array(doc[keep]), pa.array(mark[keep]), pa.array(pos[keep]), pa.array(out)]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows over the suffixes to extend; of equal ones of a text the later are marked by a negative lo."""
    lean("passages")
    for batch in batches:
        docs, marks, at = batch.column("doc_id"), batch.column("text_hash"), batch.column("at")
        parts = []
        for row, w in chunks(batch.column("text")):
            for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                t = Text(w.hash[a:b])
                lo = t.windows(np.array(at[row + k].as_py()))
                h1, h2 = t.between(lo, lo + LENGTH), t.between(lo, lo + LENGTH, second=True)
                _, first = np.unique(h1, return_index=True)
                own = np.full(len(lo), True)
                own[first] = False
                parts.append((h1, h2, np.full(len(lo), docs[row + k].as_py()), np.full(len(lo), marks[row + k].as_py()), np.where(own, -1 - lo, lo)))
        if parts:
            h1, h2, doc, mark, lo = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([_longs(h1), _longs(h2), pa.array(doc), pa.array(mark), pa.array(lo.astype(np.int32))], [x.split()[0] for x in WINDOW.split(", ")])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): the covered word ranges of texts (doc_id, text_hash, text), not merged yet."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffixes = texts.mapInArrow(_suffixes, SUFFIX)
    # what a batch has settled goes anywhere, so that copies don't meet in the task of their class
    deal = F.when(F.col("kind") == COVERED, F.xxhash64("doc_id", "pos")).otherwise(F.xxhash64("gram", "around"))
    dealt = suffixes.withColumn("deal", deal).repartition(n, "deal").drop("deal").sortWithinPartitions("kind", "gram", "around", "doc_id", "text_hash", "pos")
    found = saved(dealt.mapInArrow(_neighbours, FOUND), "neighbours")
    # the surroundings of a suffix are a window at least, since its k-gram lies within the text
    settled = found.where(f"kind = {COVERED}").select("doc_id", "text_hash", F.greatest(F.col("pos") - REACH, F.lit(0)).alias("lo"), (F.col("pos") + LENGTH).alias("hi"))

    firsts = found.where(f"kind = {FIRST}")
    # tables of their own, so that a join with them can deal a frequent key to several tasks
    several = saved(firsts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    extend = firsts.join(several, "gram").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("at"))
    windows = saved(texts.join(extend, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "at").mapInArrow(_windows, WINDOW), "windows")
    own = windows.where("lo < 0").select("doc_id", "text_hash", (-1 - F.col("lo")).alias("lo"))
    once = windows.where("lo >= 0")
    first = once.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = saved(first, "first-windows")
    later = once.join(first, ["h1", "h2"]).where(F.struct("doc_id", "text_hash") > F.col("first")).select("doc_id", "text_hash", "lo")
    spans = settled.union(own.union(later).withColumn("hi", F.col("lo") + LENGTH))
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _merged(spans: list[dict], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, min(hi, n)) for lo, hi in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean("passages")
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans")
        clean, before, removed = [], [], []
        for row, w in chunks(texts):
            for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                given = spans[row + k].as_py()
                before.append(b - a)
                if not given:
                    clean.append(texts[row + k].as_py())
                    removed.append(0)
                    continue
                raw, base = texts[row + k].as_py().encode(), w.offsets[k]
                parts, at, gone = [], 0, 0
                for lo, hi in _merged(given, b - a):
                    parts.append(raw[at : w.start[a + lo] - base])
                    at = w.start[a + hi] - base if a + hi < b else len(raw)
                    gone += hi - lo
                text = b"".join([*parts, raw[at:]])
                clean.append((text.rstrip(b" \t\n\r\x0b\x0c") if at == len(raw) else text).decode())
                removed.append(gone)
        columns = [pa.array(clean, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names if c != "spans"]
        names = [c for c in batch.schema.names if c != "spans"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(removed, pa.int64())], [*names, "words_before", "words_removed"])


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cleaned, and words_before and words_removed (long) added. All other columns stay."""
    text = F.col(f"`{text_col}`")
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    spans = repeated_spans(rows.where("doc_id is not null").select("doc_id", "text_hash", "text"))
    joined = rows.join(spans, ["doc_id", "text_hash"], "left").select("rest", "text", "spans")
    schema = joined.drop("spans").schema.add("words_before", "long").add("words_removed", "long")
    out = joined.mapInArrow(_cut, schema)
    return out.select(*[(F.col("text") if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns], "words_before", "words_removed")
