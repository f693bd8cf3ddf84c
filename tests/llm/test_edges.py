"""Cases at the edges of the operators' contracts."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import ODD, frame, lower, prose
from tracelens.llm import bpe, chat, exact_dup, line_dedup, passages, toxicity
from tracelens.llm.common import discard, saved, ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_saved_tables_go(spark):
    one, two = saved(spark.range(3), "one"), saved(spark.range(4), "two")
    discard(one, spark.range(1))
    assert two.count() == 4
    with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND|FILE_NOT_EXIST|found"):
        spark.read.parquet(one.inputFiles()[0]).count()


# 2


def test_index_is_searched_through_its_directory(spark):
    r = random.Random(21)
    texts = [*ODD, *[prose(r, 2) for _ in range(400)]]
    rows = frame(spark, texts)
    entries = saved(rows.mapInArrow(exact_dup._entries(exact_dup.key_of), exact_dup.ENTRY), "entries")
    index, skip = exact_dup.build_index(entries, capacity=2, owner_bytes=1 << 16)
    assert index.where("kind = 'slot'").groupBy("owner").count().agg(F.max("count")).first()[0] > 1
    found = exact_dup.look_up(entries, index, skip)  # an entry is the equal texts of a task
    assert found.count() == entries.count() and found.select("text_sha256").distinct().count() == len({lower(t) for t in texts})
    assert exact_dup.look_up(entries, index.where("kind <> 'slot'"), skip).isEmpty()
    moved = index.withColumn("bucket", F.when(F.col("kind") == "slot", F.col("bucket") + 256).otherwise(F.col("bucket")))
    assert exact_dup.look_up(entries, moved, skip).count() < entries.count()


def test_exact_dedup_keeps_clashing_columns_out(spark):
    d = frame(spark, ["a", "A", "b"]).withColumns({c: F.lit("x") for c in ("entry", "key", "owner", "keep_id", "kind")})
    got = sorted((x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in exact_dup.exact_duplicates(d).collect())
    assert got == [(0, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True)]


# 3


def test_passages_of_two_texts_with_one_id(spark):
    r = random.Random(33)
    shared = prose(r, 120)
    texts = [(1, shared), (1, prose(r, 30) + " " + shared), (1, shared), (2, prose(r, 10) + "\n" + shared + " " + prose(r, 5)), (0, prose(r, 60))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((x["doc_id"], x["words_before"], x["words_removed"]) for x in passages.dedup_passages(d).collect())
    mark = {x["text"]: x["h"] for x in d.withColumn("h", F.xxhash64("text")).collect()}
    first = min((shared, texts[1][1]), key=mark.get)
    keep = {shared: 0 if first == shared else 120, texts[1][1]: 0 if first == texts[1][1] else 120}
    assert got == sorted([(1, 120, keep[shared]), (1, 120, keep[shared]), (1, 150, keep[texts[1][1]]), (2, 135, 120), (0, 60, 0)])


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
def test_neighbours_do_not_depend_on_batches(batch):
    r = random.Random(batch)
    rows = sorted((r.randint(0, 1), r.randint(0, 3), r.randint(0, 2), r.randint(0, 3), r.randint(0, 1), r.randint(0, 2)) for _ in range(200))
    names, kinds = ("kind", "gram", "around", "doc_id", "text_hash", "pos"), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    parts = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + batch]), kinds)], names) for lo in range(0, len(rows), batch)]
    got = {(x["gram"], x["doc_id"], x["text_hash"], x["pos"], x["kind"]) for b in passages._neighbours(iter(parts)) for x in b.to_pylist()}
    opens = {}
    for k, g, a, *place in rows:
        if k == passages.FIRST:
            opens.setdefault((g, a), tuple(place))
    want = {(g, *place, passages.FIRST if k == passages.FIRST and opens[g, a] == tuple(place) else passages.COVERED) for k, g, a, *place in rows}
    assert got == want
    firsts = [(x["gram"], x["doc_id"], x["text_hash"], x["pos"]) for b in passages._neighbours(iter(parts)) for x in b.to_pylist() if x["kind"] == passages.FIRST]
    assert len(firsts) == len(opens)


# 4


def test_label_model_against_loops():
    """One step of the estimate and the posteriors, worked out row by row."""
    rng = np.random.default_rng(4)
    y = rng.random(400) < 0.25
    votes = np.stack([np.where(y, rng.random(400) < 0.6, rng.random(400) < 0.02) for _ in range(5)], axis=1).astype(float)
    m = toxicity.label_model(votes, 0.25, rounds=1)
    start = [0.9 if any(v) else 0.025 for v in votes]
    for j in range(6):
        hit = [float(v[j]) if j < 5 else float(not any(v)) for v in votes]
        for got, p in ((m.toxic[j], start), (m.clean[j], [1 - x for x in start])):
            assert got == pytest.approx((sum(h * q for h, q in zip(hit, p)) + 0.5) / (sum(p) + 1))
    got = m.posterior(votes)
    for v, p in zip(votes, got):
        log = m.shift
        for j in range(5):
            log += m.weight[j] * math.log(m.toxic[j] / m.clean[j]) if v[j] else 0.0
        a, b = (m.toxic[5], m.clean[5]) if not any(v) else (1 - m.toxic[5], 1 - m.clean[5])
        assert p == pytest.approx(1 / (1 + math.exp(-(log + math.log(a / b)))))
    assert got.mean() == pytest.approx(0.25, abs=1e-6)
    full = toxicity.label_model(votes, 0.25)
    assert np.abs(full.toxic[:5] - votes[y].mean(axis=0)).max() < 0.1 and np.abs(full.clean[:5] - votes[~y].mean(axis=0)).max() < 0.03


def test_toxicity_scores_against_loops(spark):
    """The query's scores are those of the model, worked out text by text; labels reach it by the sample only."""
    from tests.llm.test_llm import toxic_corpus

    docs, labels = toxic_corpus(random.Random(5), 500)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "rest": F.lit(1), "toxic": F.lit(0)})
    ls = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d.select("doc_id", "text"), ls)
    got = {x["doc_id"]: x for x in toxicity.toxicity(d, ls).collect()}
    for i, t in docs:
        x = model.bias + sum(w * v for w, v in zip(model.weights, model.votes(t)))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, x)))))
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = {i for i in got if got[i]["held_out"]}
    other = [(i, 1 - y if i in held else y) for i, y in labels]
    again = {x["doc_id"]: x["score"] for x in toxicity.toxicity(d, spark.createDataFrame(other, "doc_id long, toxic int")).collect()}
    assert again == {i: x["score"] for i, x in got.items()}


def test_sample_without_copies(spark):
    r = random.Random(6)
    a, b = prose(r, 80), prose(r, 80)
    near = " ".join(["other", *a.split()[1:]])
    d = spark.createDataFrame([(1, a, 1), (2, near, 1), (3, b, 1), (4, a, 0), (5, "", 0), (6, None, 0)], "doc_id long, text string, toxic int")
    assert sorted((x["text"] or "", x["toxic"]) for x in toxicity.without_copies(d).collect()) == sorted([(a, 1), (b, 1), (a, 0), ("", 0)])


# 5


def test_most_specific_layout(spark):
    d = spark.createDataFrame([("p", "c", "t", 1)], "prompt string, completion string, text string, id int")
    assert [tuple(t) for t in chat.canonical_turns(d).first()["turns"]] == [("user", "p"), ("assistant", "c")]
    s = spark.createDataFrame([("s", "p", "r")], "system string, prompt string, response string")
    assert [t["role"] for t in chat.canonical_turns(s).first()["turns"]] == ["system", "user", "assistant"]
    two = spark.createDataFrame([("p", "c", "r")], "prompt string, completion string, response string")
    with pytest.raises(ValueError):
        chat.canonical_turns(two)
    rows = spark.createDataFrame([(1, 1, "human", "hi", "x"), (1, 2, "gpt", "yo", "y")], "conv_id long, turn long, from string, value string, prompt string")
    got = chat.format_rows(rows).select(chat.parse(F.col("formatted")).alias("t")).first()["t"]
    assert [tuple(t) for t in got] == [("user", "hi"), ("assistant", "yo")]
    clash = spark.createDataFrame([(1, 1, "user", "hi", "x")], "conv_id long, turn long, role string, text string, content string")
    assert chat.chat_digests(clash).first()["n_turns"] == 1


def test_json_picks_the_most_specific_layout(spark):
    want = {
        '{"system": "s", "prompt": "p", "response": "r", "text": "t"}': ["system", "user", "assistant"],
        '{"prompt": "p", "completion": "c", "text": "t", "ts": 1}': ["user", "assistant"],
        '{"messages": [], "source": "web"}': [],
        '{"messages": [], "dialog": []}': None,
    }
    d = spark.createDataFrame([(x,) for x in want], "j string")
    got = {x["j"]: None if x["turns"] is None else [t["role"] for t in x["turns"]] for x in chat.json_turns(d, "j").collect()}
    assert got == want


# 8


def test_lines_of_white_space_are_blank(spark):
    texts = ["\r\n\r\n\r\n\r\n", "x\r\n\r\n\r\n\r\n\r\ny", "\t\n \n\x0b\n\x0c\n", "a\n\n\na\n\n\n", "a\r\n\r\n\r\na\r\n\r\n\r\n"]
    got = {x["doc_id"]: (x["text"], x["lines_removed"]) for x in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i][1] for i in range(3)] == [0, 0, 0] and [got[i][0] for i in range(3)] == texts[:3]
    assert got[3][1] == 3 and got[4][1] == 3  # the run with a word in it does repeat


# 10


def test_other_tokenizer_file(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, r = Tokenizer.from_file(path), random.Random(10)
    texts = [*[t for t in ODD if t is None or len(t) < 40_000], "Hello  world\n it's", *["".join(chr(r.randint(32, 0x24F)) for _ in range(30)) for _ in range(50)]]
    got = {x["doc_id"]: x["ids"] for x in bpe.encode(frame(spark, texts), path).collect()}
    by = collections.Counter(got[i] == lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts))
    assert by == {True: len(texts)}
    import hashlib

    for x in bpe.encode_digests(frame(spark, texts), path).collect():
        back = lib.decode(got[x["doc_id"]], skip_special_tokens=False)
        assert x["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
