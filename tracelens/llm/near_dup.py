"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Method. A text's set holds the hashes (64 bits) of its distinct five-word shingles. A first permutation (a bijective
mixer, then the top bits) sends a shingle to a place x in a ring of D places; a second one, a table over the ring, is
shifted circularly: coordinate k of the signature is the minimum over the set of table[(x + k) mod D]. So two
permutations give all 128 coordinates, and the coordinates of one shingle are a slice of the table. 32 bands of 4
coordinates give the candidates; a pair at Jaccard 0.75 misses all bands with probability 5e-6. Other thresholds get
bands of their own. Every link is confirmed on the full sets.

Scale. Texts with equal sets are one class from the start, so large groups of copies are counted by a partial
aggregate, not paired. In a bucket, candidates are not paired with each other: in each of STAR_ROUNDS rounds the
bucket's smallest class is compared with the others (a star, dealt to several tasks where the bucket is large), classes
already connected are passed over, and the bucket is done when what is left of it is connected. Buckets still open
after that are compared whole: texts of open buckets that share texts form clusters, and of a cluster the texts outside
its largest component are compared with all texts of a size that a link allows, block by block. A task of two blocks
indexes the first one's rarest shingles, as many as a text at the threshold can't all lack (prefix filter: exact), so
only texts that share one of them are compared on the full sets, and it returns links, never candidates. No links,
components or signatures reach the driver; components come from large-star/small-star rounds over tables in the shared
folder.

Nulls and texts without words have an empty set and no links. Rows with one doc_id are one node. Rows with a null
doc_id take part in nothing and are kept, their component_id is null. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import discard, lean, saved
from tracelens.llm.words import U, chunks, mix, shingle_set

WORDS, COORDINATES = 5, 128
#: Most probability that a pair at the threshold shares no band.
MISS = 1e-5
RING_BITS = 22
STAR_ROUNDS = 2
#: Texts and shingles of a block, at most and about; texts of a block differ in size by a factor of STEP at most.
BLOCK, BLOCK_SHINGLES, STEP = 4096, 1 << 20, 1.1
#: Most blocks of one size in a cluster.
MOST_BLOCKS = 1 << 32
#: Links of a star that one task verifies, about.
STAR_TASK = 2000

_ring: list[np.ndarray] = []


def ring() -> np.ndarray:
    """Windows on the second permutation, continued past its end: row x is its values at x, x + 1, ..."""
    if not _ring:
        table = np.random.Generator(np.random.PCG64(20240229)).permutation(1 << RING_BITS).astype(np.uint32)
        _ring.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: COORDINATES - 1]]), COORDINATES))
    return _ring[0]


def forget() -> None:
    """Drop this worker's ring."""
    _ring.clear()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The circulant MinHash signature of a non-empty set."""
    places = (mix(shingles) >> U(64 - RING_BITS)).astype(np.int64)
    out = None
    for lo in range(0, len(places), 2048):
        low = ring()[places[lo : lo + 2048]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, words in chunks(column):
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            yield shingle_set(words.hash[a:b], WORDS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean("near_dup")
    empty = np.zeros(0, np.int32)
    for batch in batches:
        n, h1, h2, sigs = [], [], [], []
        for s in _sets(batch.column("text")):
            n.append(len(s))
            h1.append(int(np.bitwise_xor.reduce(mix(s + U(1)))) if len(s) else 0)
            h2.append(int(np.add.reduce(mix(s ^ U(0x5DEECE66D)))) if len(s) else 0)
            sigs.append(signature(s).view(np.int32) if len(s) else empty)
        longs = lambda x: pa.array(np.array(x, U).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), longs(h1), longs(h2), _lists(sigs, pa.int32())], ["doc_id", "n_shingles", "h1", "h2", "sig"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean("near_dup")
    for batch in batches:
        sets = [s.view(np.int64) for s in _sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(sets, pa.int64())], ["doc_id", "shingles"])


def banding(num: int, den: int) -> tuple[int, int]:
    """(bands, rows a band): the most rows with which a pair at a similarity of num / den has a band in common."""
    rows = COORDINATES
    while rows and (1 - min(1.0, num / den) ** rows) ** (COORDINATES // rows) > MISS:
        rows //= 2
    if not rows:
        raise ValueError(f"{COORDINATES} coordinates are too few for a similarity of {num} / {den}")
    return COORDINATES // rows, rows


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets (sorted, not empty) have a Jaccard similarity of at least num / den."""
    if len(x) > len(y):
        x, y = y, x
    if den * len(x) < num * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int(np.count_nonzero(y[at] == x))
    return den * same >= num * (len(x) + len(y) - same)


def _verify(num: int, den: int):
    """Rows of one star stand together, its centre's set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("near_dup")
        star, centre = None, []
        for batch in batches:
            a, salt, role, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "salt", "role", "b"))
            sets = batch.column("shingles")
            offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(U)  # sorted as unsigned
            left, right = [], []
            for i in range(len(a)):
                s = flat[offsets[i] : offsets[i + 1]]
                if star != (a[i], salt[i]):
                    star, centre = (a[i], salt[i]), []
                if role[i] == 0:
                    centre.append(s)
                    continue
                if any(similar(c, s, num, den) for c in centre):
                    left.append(a[i])
                    right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b, parts) whose sets have a Jaccard similarity of at least num / den. A centre a is dealt
    to `parts` tasks, with its texts b."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    kind = "a long, salt int, role int, b long, shingles array<long>"
    members = salted.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "shingles")
    centres = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "shingles")
    rows = centres.unionByName(members).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role")
    assert rows.columns == [x.split()[0] for x in kind.split(", ")]
    return rows.mapInArrow(_verify(num, den), "a long, b long")


def near_labels(links: DataFrame) -> DataFrame:
    """(node, component) of the linked nodes: the least node within two links. Equal labels are connected, but connected
    nodes may have different ones."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    one = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return both.join(one, "v").groupBy("u").agg(F.min("m").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node reachable."""
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        discard(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = large.join(low.where("n > 1").drop("n"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(low.select("u", "m")).distinct(), "small-star")
        discard(large)
        # done when each node has one edge, to a node that has none itself
        if e.groupBy("u").count().where("count > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


class RareShingles:
    """The texts of a block by their rarest shingles, in the order of (how many texts of the block have one, hash)."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        self.shingles, which, self.n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        order = np.lexsort((which, self.n[which], own))
        rank = np.arange(len(own)) - first[own]  # own is sorted already
        kept = rank < np.array([self.prefix(len(x)) for x in sets])[own]
        which, own = which[order][kept], own[kept]
        by = np.argsort(which, kind="stable")
        self.texts, self.first = own[by], np.searchsorted(which[by], np.arange(len(self.shingles) + 1))

    def prefix(self, n: int) -> int:
        """Of n shingles a similar set lacks fewer than this many."""
        return n - -(-self.num * n // self.den) + 1

    def candidates(self, s: np.ndarray) -> np.ndarray:
        """Texts that share one of the rarest shingles with a set: all similar ones are among them."""
        at = np.searchsorted(self.shingles, s)
        at[at == len(self.shingles)] = 0
        at = at[self.shingles[at] == s]
        most = self.prefix(len(s)) - (len(s) - len(at))  # those that no text of the block has are the rarest
        if most <= 0:
            return at[:0]
        at = at[np.lexsort((at, self.n[at]))[:most]]
        found = [self.texts[self.first[k] : self.first[k + 1]] for k in at]
        return np.unique(np.concatenate(found)) if found else at[:0]


class Linked:
    """Union-find over the texts of a block."""

    def __init__(self, components: list[int]):
        self.head = list(range(len(components)))
        self.of: dict[int, int] = {}
        for i, c in enumerate(components):
            self.head[i] = self.of.setdefault(c, i)

    def find(self, i: int) -> int:
        while self.head[i] != i:
            self.head[i] = i = self.head[self.head[i]]
        return i

    def join(self, roots: set[int]) -> None:
        low = min(roots, default=0)
        for r in roots:
            self.head[r] = low


def _block_links(num: int, den: int):
    """Rows of one pair of blocks stand together, the left block (side 0) first: links between different components.
    Within a task a text isn't compared with a text that is known to be connected with one it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("near_dup")
        task, left, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cluster", "i", "j", "side", "doc_id", "component")], axis=1)
            sets = batch.column("shingles")
            at, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(U)
            found: tuple[list, list] = ([], [])
            for r in range(len(batch)):
                here, doc, comp = tuple(keys[r][:3]), keys[r][4], keys[r][5]
                if here != task:
                    task, left, index = here, [], None
                own = flat[at[r] : at[r + 1]]
                if keys[r][3] == 0:
                    left.append((doc, comp, own.copy()))  # batches go when they are read
                    continue
                if not left:
                    continue
                if index is None:
                    index = RareShingles([x[2] for x in left], num, den)
                    linked = Linked([x[1] for x in left])
                    places = {x[0]: i for i, x in enumerate(left)}
                roots = {linked.find(i) for i in (linked.of.get(comp), places.get(doc)) if i is not None}
                for x in index.candidates(own):
                    root = linked.find(x)
                    if root not in roots and similar(left[x][2], own, num, den):
                        roots.add(root)
                        found[0].append(min(doc, left[x][0]))
                        found[1].append(max(doc, left[x][0]))
                linked.join(roots)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b"])

    return run


def _in_blocks(open_rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components among the rows (band, doc_id, component) of open buckets. Buckets that share texts are
    one cluster; of a cluster, the texts outside its largest component are compared with all of a fitting size."""
    centre = open_rows.groupBy("band").agg(F.min("doc_id").alias("a"))
    clusters = components(open_rows.join(centre, "band").select("a", F.col("doc_id").alias("b")))
    docs = open_rows.select("doc_id", "component").distinct().join(sets.select("doc_id", F.size("shingles").alias("n")), "doc_id")
    docs = docs.join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    docs = saved(docs.withColumn("step", F.floor(F.log(STEP, "n")).cast("int")), "clusters")
    sizes = docs.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("main")).select("cluster", F.col("main.component").alias("main"))
    docs = saved(docs.join(main, "cluster").withColumn("odd", F.col("component") != F.col("main")).drop("main"), "members")

    # blocks of each size of a cluster; a link allows sizes as far apart as den / num
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.ceil(BLOCK_SHINGLES / F.pow(F.lit(STEP), F.col("step")))))
    blocks = docs.groupBy("cluster", "step").agg(F.count("*").alias("all"), F.count_if("odd").alias("odd"))
    blocks = blocks.select("cluster", "step", F.ceil(F.col("all") / rows).cast("int").alias("all"), F.ceil(F.col("odd") / rows).cast("int").alias("odd"))
    reach = math.ceil(math.log(den / num) / math.log(STEP)) + 1
    one = blocks.where("odd > 0").select("cluster", F.col("step").alias("step_i"), F.col("odd").alias("n_i"), F.explode(F.sequence(F.col("step") - reach, F.col("step") + reach)).alias("step_j"))
    fits = one.join(blocks.select("cluster", F.col("step").alias("step_j"), F.col("all").alias("n_j")), ["cluster", "step_j"])
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda step, part: F.col(step).cast("long") * MOST_BLOCKS + part
    part = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    ids = ("cluster", "i", "j", "side", "doc_id", "component")
    left = docs.where("odd").withColumnRenamed("step", "step_i").join(fits, ["cluster", "step_i"]).withColumns({"i": block("step_i", part("n_i")), "side": F.lit(0)})
    right = docs.withColumnRenamed("step", "step_j").join(fits, ["cluster", "step_j"]).withColumns({"j": block("step_j", part("n_j")), "side": F.lit(1)})
    left = left.select("*", span("n_j").alias("k")).withColumn("j", block("step_j", F.col("k"))).select(*ids)
    right = right.select("*", span("n_i").alias("k")).withColumn("i", block("step_i", F.col("k"))).select(*ids)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.union(right).join(sets, "doc_id").select(*ids, "shingles").repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side")
    return dealt.mapInArrow(_block_links(num, den), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept; linked at a Jaccard similarity >= num / den."""
    n_bands, width = banding(num, den)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sketch = saved(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, h1 long, h2 long, sig array<int>"), "sketch")
    nodes = sketch.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one class; its smallest doc_id stands for it
    classes = nodes.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    copies = saved(classes.where("copies > 1").drop("copies"), "copies")
    rest = nodes.join(copies, ["n_shingles", "h1", "h2"], "left").where("head is null or head = doc_id").select("doc_id", "sig")
    bands = [F.xxhash64(F.lit(b), *[F.get("sig", F.lit(b * width + r)) for r in range(width)]) for b in range(n_bands)]
    keys = rest.select("doc_id", F.explode(F.array(*bands)).alias("band"))
    # tables of their own, so that a join with them can deal a large bucket to several tasks
    full = saved(keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "bands")
    buckets = saved(keys.join(full, "band").distinct(), "buckets")
    ids = buckets.select("doc_id").distinct()
    sets = saved(texts.join(ids, "doc_id", "left_semi").mapInArrow(_shingles, "doc_id long, shingles array<long>"), "sets")

    links = labels = None
    rows = buckets.withColumn("component", F.col("doc_id"))
    for _ in range(STAR_ROUNDS):
        centre = saved(rows.groupBy("band").agg(F.min(F.struct("doc_id", "component")).alias("c"), F.ceil(F.count("*") / STAR_TASK).alias("parts")), "centres")
        others = rows.join(centre, "band").where("doc_id <> c.doc_id")
        pairs = others.where("component <> c.component").groupBy(F.col("c.doc_id").alias("a"), F.col("doc_id").alias("b")).agg(F.max("parts").alias("parts"))
        found = saved(verify(pairs, sets, num, den), "links")
        links = found if links is None else links.union(found)
        # centres are done with; buckets with one component left too
        rows = _open(others.select("band", "doc_id"), near_labels(links))
        if rows.isEmpty():
            break
    labels = components(links)
    if not rows.isEmpty():
        found = saved(_in_blocks(_open(rows.select("band", "doc_id"), labels), sets, num, den), "links")
        if not found.isEmpty():
            labels = components(links.union(found))
    out = sketch.select("doc_id", "n_shingles", "h1", "h2").join(copies, ["n_shingles", "h1", "h2"], "left")
    out = out.withColumn("head", F.when(F.col("n_shingles") > 0, F.coalesce("head", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(labels, F.col("head") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "head"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (band, doc_id, component) of buckets that have more than one component."""
    at = rows.join(labels, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    at = saved(at, "labelled")
    several = saved(at.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band"), "several")
    out = saved(at.join(several, "band", "left_semi"), "open")
    discard(at, several)
    return out
