"""Toxicity scores by weak supervision.

Voters. Fixed lexicons of insults in four languages; lexicons mined from a bounded sample of labelled rows without its
near copies: words and word beginnings that toxic texts have far more often than others (binomial tail, corrected for the number of
candidates), families of which are dealt to LEXICONS voters; and fixed patterns (shouting, symbols for letters, insults
addressed to a reader, dense hits). A voter says whether a text has one of its units. The labels choose which voters
take part: those that hit toxic rows more often than others, beyond chance.

Label model. The true label is a hidden variable that no annotator's label is shown to. Expectation maximisation over
all voters' votes estimates each one's hit rates given either label (its accuracies), and from the residual
correlations of the voters given the label a discount, so that voters that repeat each other count once. The labels set
the prior: the posteriors' mean is the share of toxic labels in the sample. A voter that hits nothing abstains: lexicons of one language say nothing about
another's texts. Whether all of them are silent is one more voter, which never abstains. It starts from the rows that
aren't silent.

Classifier. A logistic regression on votes, hit counts and densities is fitted to the posterior labels by Newton steps
with ridge, and scores every whole text. Only the sample's votes (numbers) and the units chosen reach the driver.

Null texts count as empty and get a score like any. Rows of a doc_id that occur more than once are scored each on
their own text. Without labelled rows of both kinds the score is the sample's share of toxic rows (0 if none), without
a voter that takes part too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.llm.common import discard, lean, saved
from tracelens.llm.words import U, chunks, mix, shingle_set

#: Bounds: labelled rows used for fitting, voters that the mined units are dealt to, and how many of these have several
#: families of units.
TRAIN_ROWS, LEXICONS, SHARED = 12_000, 32, 8
BEGINNINGS = (4, 5, 6, 7, 8)
#: Least share of toxic rows among the rows with a mined unit, and least toxic rows with it.
PRECISION, SUPPORT = 0.9, 3
#: Hashes by which the sample's near copies are found.
COPY_HASHES = 4
#: Toxic from this score on.
THRESHOLD = 0.3

# Common insults, a voter each line; * ends a word's beginning.
INSULTS = """
idiot* moron* imbecile* cretin* dimwit* halfwit* numbskull* nitwit* stupid* dumb dumbass* fool fools brainless* clueless*
loser* worthless* pathetic* useless* failure* nobody* coward* weakling* spineless* pitiful*
scum scumbag* trash garbage filth filthy vermin parasite* disgusting* repulsive* vile rotten sewage
clown* joke freak* weirdo* creep creeps pig pigs swine rat rats snake* leech*
bastard* bitch* asshole* arsehole* jerk* dickhead* prick twat* wanker* whore* slut*
idiot idioten dumm* doof* blöd* trottel* depp deppen vollidiot* schwachkopf* hohlkopf* versager* wertlos* nutzlos* erbärmlich*
abschaum* dreck drecks* schwein schweine* mistkerl* arschloch* wichser* hurensohn* schlampe* ekelhaft* widerlich* clowns
idiot idiote idiots crétin* imbécile* stupide* débile* abruti* nul nulle minable* raté ratés incapable* clown clowns
connard* connasse* salaud* salope* ordure* pourriture* déchet* racaille* dégueulasse* répugnant* porc porcs
idiota* imbécil* estúpid* tonto tonta tontos tarado* inútil* fracasad* patétic* payaso* bobo boba
basura escoria asqueros* cabrón* gilipollas* pendejo* puta puto maldit* cerdo cerda miserable*
"""

_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = (
    re.compile(r"(?:\b[^\W\d_a-zß-ÿ]{3,}\b[\s,.!]*){3,}"),
    re.compile(r"[!?]{3,}"),
    re.compile(r"\b[^\W\d_]+[@#$%&*]+[^\W\d_]+\b"),
    re.compile(r"\b(?:you|your|du|ihr|tu|vous|tú|usted)\b", re.I),
    re.compile(r"([^\W\d_])\1{3,}"),
)


#: unit -> fixed voter
FIXED = {unit: i for i, line in enumerate(INSULTS.strip().splitlines()) for unit in line.split()}
FIXED_LEXICONS = len(INSULTS.strip().splitlines())


def units_of(words: set[str]) -> set[str]:
    out = set(words)
    for k in BEGINNINGS:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """units: unit -> mined voter; dropped: fixed units that don't count; the rest is the classifier's."""

    units: dict[str, int] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    bias: float = -30.0
    dropped: frozenset[str] = frozenset()

    def __post_init__(self):
        self.all: dict[str, list[int]] = {}
        for u, v in FIXED.items():
            if u not in self.dropped:
                self.all.setdefault(u, []).append(v)
        for u, v in self.units.items():
            self.all.setdefault(u, []).append(FIXED_LEXICONS + v)
        self.words = {u for u in self.all if u[-1] != "*"}
        self.lengths = tuple(sorted({len(u) - 1 for u in self.all if u[-1] == "*"}))

    def votes(self, text: str | None) -> list[float]:
        """Lexicon voters, pattern voters, dense hits, families hit, hits (log), hits a hundred words."""
        words = words_of(text)
        hit = [0.0] * (FIXED_LEXICONS + LEXICONS)
        count = Counter(words)
        hits = 0
        for w in self._hit(count):
            hits += count[w]
            for u in (w, *[w[:k] + "*" for k in self.lengths if len(w) >= k]):
                for v in self.all.get(u, ()):
                    hit[v] = 1.0
        rate = hits / max(len(words), 10)
        patterns = [float(bool(p.search(text))) if text else 0.0 for p in PATTERNS]
        return [*hit, *patterns, float(rate > 0.01), float(rate > 0.04), sum(hit) / 4, math.log1p(hits), min(100 * rate, 20.0) / 5]

    def _hit(self, count: Counter) -> set[str]:
        found = self.words & count.keys()
        for k in self.lengths:
            begin = {w[:k] + "*" for w in count if len(w) >= k} & self.all.keys()
            if begin:
                found |= {w for w in count if len(w) >= k and w[:k] + "*" in begin}
        return found

    def score(self, text: str | None) -> float:
        x = self.bias + (sum(a * b for a, b in zip(self.weights, self.votes(text), strict=True)) if self.weights else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


#: Places of a model's votes: voters, then counts.
VOTERS = FIXED_LEXICONS + LEXICONS + len(PATTERNS) + 2


@dataclass
class LabelModel:
    """What expectation maximisation has estimated: each voter's hit rates given either label, and its weight."""

    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    shift: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of 0/1 votes; a 0 is an abstention, a row of zeros is silent."""
        return 1 / (1 + np.exp(-np.clip(self.evidence(votes) + self.shift, -30, 30)))

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        a, b = self.toxic, self.clean
        return _with_silence(votes) @ (self.weight * (np.log(a) - np.log(b))) + votes.any(axis=1) * math.log((1 - a[-1]) / (1 - b[-1]))


def _with_silence(votes: np.ndarray) -> np.ndarray:
    return np.hstack([votes, ~votes.any(axis=1, keepdims=True)]).astype(float)


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """The label model of 0/1 votes (rows x voters), without any label. Its last voter is silence."""
    said = _with_silence(votes)
    p = np.where(votes.any(axis=1), 0.9, prior / 10)
    weight = np.ones(said.shape[1])
    for step in range(rounds):
        one, zero = p.sum() + 1e-9, (1 - p).sum() + 1e-9
        a = (said.T @ p + 0.5) / (one + 1)
        b = (said.T @ (1 - p) + 0.5) / (zero + 1)
        if step % 10 == 0:
            weight[:-1] = 1 / (1 + _excess(votes, p, a[:-1], b[:-1]).sum(axis=1))
        model = LabelModel(a, b, weight, 0.0)
        evidence = model.evidence(votes)
        lo, hi = -60.0, 60.0
        for _ in range(60):
            model.shift = (lo + hi) / 2
            p = 1 / (1 + np.exp(-np.clip(evidence + model.shift, -30, 30)))
            lo, hi = (lo, model.shift) if p.mean() > prior else (model.shift, hi)
    return model


def _excess(votes: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What each two voters share beyond the label: mean absolute correlation within either label, if over 0.1."""
    excess = np.zeros((votes.shape[1],) * 2)
    for q, mean in ((p, a), (1 - p, b)):
        r = (votes - mean) * np.sqrt(q / (q.sum() + 1e-9))[:, None]
        cov = r.T @ r
        sd = np.sqrt(np.diag(cov)) + 1e-6
        excess += np.abs(cov / np.outer(sd, sd)) / 2
    np.fill_diagonal(excess, 0.0)
    return np.where(excess > 0.1, excess, 0)


def chosen_voters(votes: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Voters that labelled toxic rows have more often than the others: by twice at least, and beyond chance."""
    n1, n0 = said.sum(), (1 - said).sum()
    x, y = votes.T @ said, votes.T @ (1 - said)
    p1, p0, p = x / n1, y / n0, (x + y) / (n1 + n0)
    sd = np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) + 1e-12
    return np.flatnonzero((p1 > 2 * p0) & ((p1 - p0) / sd > 3.0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 0.05, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    keep = np.append(np.broadcast_to(ridge, x.shape[1]), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = x1.T @ (x1 * (p * (1 - p))[:, None]) + np.diag(keep)
        step = np.linalg.solve(h, x1.T @ (y - p) - keep * w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean("toxicity")
    for batch in batches:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (toxic if y else clean).update(units_of(set(words_of(text))))
        units = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([toxic[u] for u in units], pa.int64()), pa.array([clean[u] for u in units], pa.int64())], ["unit", "x", "y"])


def mined_units(texts: DataFrame, toxic: int, clean: int) -> tuple[list[str], frozenset[str]]:
    """Units that toxic rows of texts (text, toxic) have too often for chance, the clearest first; and fixed units that
    the rows with them don't bear out: most of them are clean."""
    counts = texts.mapInArrow(_counted, "unit string, x long, y long").groupBy("unit").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    found = saved(counts.where((F.col("x") >= SUPPORT) | F.col("unit").isin(*FIXED)), "units")
    dropped = frozenset(r["unit"] for r in found.where(F.col("unit").isin(*FIXED) & (F.col("y") >= 2) & (F.col("y") > F.col("x"))).collect())
    share, candidates = toxic / (toxic + clean), max(1, found.where(f"x >= {SUPPORT}").count())
    rate = F.col("x") / (F.col("x") + F.col("y"))
    # Chernoff bound of the binomial tail
    other = F.greatest(1 - rate, F.lit(1e-12))
    tail = (F.col("x") + F.col("y")) * (rate * F.log(rate / share) + (1 - rate) * F.log(other / (1 - share)))
    good = found.where(f"x >= {SUPPORT}").withColumns({"rate": rate, "tail": tail}).where((F.col("rate") >= PRECISION) & (F.col("tail") > math.log(candidates) + 1))
    out = [r["unit"] for r in good.orderBy(F.desc("tail"), "unit").select("unit").collect()]
    discard(found)
    return out, dropped


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with COPY_HASHES least shingle hashes of each text: near copies share one of them almost surely."""
    lean("toxicity")
    for batch in batches:
        out = []
        for _, w in chunks(batch.column("text")):
            for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                s = shingle_set(w.hash[a:b], 5)
                out.append([int(mix(s ^ U(k)).min().view(np.int64)) for k in range(COPY_HASHES)] if len(s) else [0] * COPY_HASHES)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "kinds"])


def without_copies(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text, toxic) without rows that share a least shingle hash with a row of smaller doc_id and the
    same label: copies of one text would make its words look frequent."""
    rows = texts.mapInArrow(_kinds, "doc_id long, text string, toxic int, kinds array<long>").withColumn("toxic", F.least("toxic", F.lit(1)))
    places = rows.select("doc_id", "toxic", F.posexplode("kinds").alias("k", "kind"))
    first = places.groupBy("toxic", "k", "kind").agg(F.min("doc_id").alias("first"))
    later = places.join(first, ["toxic", "k", "kind"]).where("doc_id > first").select("doc_id").distinct()
    return rows.join(later, "doc_id", "left_anti").select("text", "toxic")


def _families(units: list[str]) -> dict[str, int]:
    """Units, the clearest first, to mined voters: families of one beginning together, the clearest families alone."""
    found: dict[str, int] = {}
    for u in units:
        found.setdefault(u[: BEGINNINGS[0]], len(found))
    alone = LEXICONS - SHARED
    rest = max(1, -(-(len(found) - alone) // SHARED))
    return {u: v if (v := found[u[: BEGINNINGS[0]]]) < alone else alone + (v - alone) // rest for u in units}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. The sample: the rows of least hash, at most `rows`, none held out."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    toxic = sum(r["toxic"] > 0 for r in chosen)
    clean = len(chosen) - toxic
    share = toxic / len(chosen) if chosen else 0.0
    none = Model(bias=math.log((share + 1e-12) / (1 - share + 1e-12)))
    if not toxic or not clean:
        return none
    sample = spark.createDataFrame(chosen, "doc_id long, toxic int")
    rows = saved(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "sample")
    texts = saved(without_copies(rows), "texts")
    discard(rows)
    counts = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        discard(texts)
        return none
    share = toxic / (toxic + clean)
    units, dropped = mined_units(texts, toxic, clean)
    model = Model(_families(units), dropped=dropped)
    found = _voted(texts, model).collect()
    discard(texts)
    votes, said = np.array([r["votes"] for r in found], float), np.array([float(r["toxic"] > 0) for r in found])
    taking = chosen_voters(votes[:, :VOTERS], said)
    if not len(taking):
        return none
    posterior = label_model(votes[:, taking], share).posterior(votes[:, taking])
    # the classifier sees the voters that take part, and the counts
    seen = [*taking, *range(VOTERS, votes.shape[1])]
    weights = np.zeros(votes.shape[1])
    weights[seen], bias = logistic(votes[:, seen], posterior)
    return Model(model.units, [float(w) for w in weights], bias, dropped)


def _voted(texts: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("toxicity")
        for batch in batches:
            votes = pa.array([model.votes(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), votes], ["toxic", "votes"])

    return texts.select("toxic", "text").mapInArrow(run, "toxic int, votes array<double>")


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col. No shuffle."""
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(given.alias("rest"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("toxicity")
        for batch in batches:
            scores = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("text"), pa.array(scores, pa.float64())], ["rest", "text", "score"])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.select(*[(F.col("text") if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns if c != out_col], F.col("score").alias(out_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(rows, fit(rows, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
