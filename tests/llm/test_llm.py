"""Each operator against a brute-force version, and the odd cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import duck, rows
from tracelens.llm import bpe, chat, exact_dup, html_text, line_dedup, near_dup, packing, passages, queries, top_k, toxicity
from tracelens.llm.common import ship

LONG = "word " * 30_000
VOCAB = [a + b for a in "ba du ki lo ne".split() for b in "m n r s t".split()]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def prose(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], "doc_id long, text string")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


ODD = [None, "", " ", "a", "A", "one two", "\n\n\n", "ñandú <|x|> \\", "日本 語 テキスト", LONG, LONG, "a\x00b", "x" * 50_000]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).sql(queries.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


# 1

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><div id="cookie-notice">We use cookies for many purposes
that are described at length here.</div><header><ul class="menu"><li><a href=1>Home</a><li><a href=2>News</a></ul></header><div id="content"><h2>Title</h2>
<p>A first   paragraph &amp; more, long enough to be an <i>arti</i>cle paragraph, we hope.<p>Yes.<div class="ad">Buy this now, it is the best there is, and cheap.</div>
<p>The last &#233;&lt;b&gt; paragraph of the article, with a number of words.</div><aside><p>Related: another story that is told at some length as well.</p></aside>
<form><label>Name</label><button>Send</button></form><section class="comments"><p>I liked this article very much, thank you for writing all of it.</p></section><footer>© all rights</footer></body>"""


def test_html_main_text():
    want = "Title A first paragraph & more, long enough to be an article paragraph, we hope. Yes. The last é<b> paragraph of the article, with a number of words."
    assert html_text.main_text(PAGE) == want


def test_html_odd_pages(spark):
    bad = [None, "", "<", "<p", "<!-- x", "<script>x", "</p></div>", "<div>" * 3000 + "x", "a<table><tr><td>b<td>c", "<p>" + "long text here. " * 5000]
    d = spark.createDataFrame([(i, "u", h, "keep", "mine") for i, h in enumerate([*bad, PAGE, PAGE])], "page_id long, url string, html string, extra string, text string")
    got = html_text.extract_text(d).orderBy("page_id").collect()
    assert len(got) == 12 and got[0]["text"] == "" and got[-1]["text"] == got[-2]["text"] and got[-1]["extra"] == "keep"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_text(d.limit(0)).count() == 0


def test_min_cut_against_all_labellings():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 7)
        cost = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        price = lambda s: sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(cost, s)) + sum(w for i, j, w in edges if s[i] != s[j])  # noqa: E731, B023
        best = min(price([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert price(html_text.min_cut(cost, edges)) == pytest.approx(best)


# 2

@pytest.mark.parametrize("key", [exact_dup.key_of, lambda t: len(t) % 3, lambda t: 7])
def test_exact_dedup(spark, key):
    r = random.Random(2)
    texts = [*ODD, *[prose(r, 3).title() if r.random() < 0.5 else prose(r, 1) for _ in range(300)]]
    got = exact_dup.exact_duplicates(frame(spark, texts), key=key, capacity=4).collect()
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) for x in got} == want
    assert exact_dup.exact_duplicates(frame(spark, []), key=key).count() == 0


def test_exact_dedup_null_ids_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "A"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), str(x["keep_id"]), x["kept"]) for x in exact_dup.exact_duplicates(d).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("None", "3", False), ("None", "None", True)]


def test_directory_doubles():
    d = exact_dup.Directory(0, 2)
    keys = [random.Random(i).getrandbits(64) - 2**63 for i in range(200)]
    for k in keys:
        d.insert((k, "x"))
    assert sorted(r[0] for b in d.buckets() for r in b["records"]) == sorted(keys)
    assert len(d.slots) == 2**d.depth and all(len(b["records"]) <= 2 for b in d.buckets())
    assert all(any(r[0] == k for r in d.slots[d._slot(k)]["records"]) for k in keys)


# 3

def passage_oracle(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        ms = list(SPACE.finditer(t or ""))
        ws = [lower(m[0]) for m in ms]
        gone = [False] * len(ws)
        for k in range(len(ws) - 49):
            w = tuple(ws[k : k + 50])
            if w in seen:
                gone[k : k + 50] = [True] * 50
            seen.add(w)
        text, at, k = "", 0, 0
        while k < len(ws):
            if gone[k]:
                text += t[at : ms[k].start()]
                while k < len(ws) and gone[k]:
                    k += 1
                at = ms[k].start() if k < len(ws) else len(t)
            else:
                k += 1
        text = None if t is None else text + t[at:]
        if gone and gone[-1]:
            text = text.rstrip(" \t\n\r\x0b\x0c")
        out[i] = (text, len(ws), sum(gone))
    return out


def test_passages(spark):
    r = random.Random(3)
    shared = [prose(r, n) for n in (49, 50, 51, 120, 300)]
    texts = [*ODD, *[f"{prose(r, r.randint(0, 60))}\n{r.choice(shared).upper() if r.random() < 0.3 else r.choice(shared)}\t{prose(r, r.randint(0, 60))}" for _ in range(60)], shared[3] + " " + shared[3]]
    d = frame(spark, texts).withColumn("spans", F.lit("mine")).withColumn("text_hash", F.lit(1))
    got = {x["doc_id"]: (x["text"], x["words_before"], x["words_removed"]) for x in passages.dedup_passages(d).collect()}
    want = passage_oracle(list(enumerate(texts)))
    assert got == want and sum(x[2] for x in want.values()) > 2000
    assert passages.dedup_passages(frame(spark, [])).count() == 0


def test_passages_repeated_rows_and_null_ids(spark):
    t = prose(random.Random(9), 80)
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), x["words_removed"]) for x in passages.dedup_passages(d).collect())
    assert got == [("1", 0), ("1", 0), ("2", 80), ("None", 0)]


# 4

def toxic_corpus(r, n):
    bad = ["zorgol", "vexcrud", "snarfip", "grublat"]
    docs, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.2)
        ws = prose(r, r.randint(5, 60)).split()
        if y:
            for _ in range(3):
                ws.insert(r.randint(0, len(ws)), r.choice(bad).upper() if r.random() < 0.2 else r.choice(bad))
        docs.append((i, " ".join(ws)))
        labels.append((i, y))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus(random.Random(4), 600)
    d = spark.createDataFrame([*docs, *[(1000 + i, t) for i, t in enumerate(ODD)], (None, "x"), (5, "again")], "doc_id long, text string")
    got = toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 600 + len(ODD) + 2 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    held = {x["doc_id"]: x for x in got if x["doc_id"] is not None and x["doc_id"] < 600 and x["held_out"]}
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    y = dict(labels)
    assert np.mean([x["predicted"] == y[i] for i, x in held.items() if i != 5]) > 0.97
    assert not any(x["predicted"] for x in got if x["doc_id"] and x["doc_id"] >= 1000)


def test_toxicity_without_labels(spark):
    d = frame(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x["predicted"] for x in toxicity.toxicity(d, none).collect()] == [0, 0]
    assert toxicity.toxicity(d.limit(0), spark.createDataFrame([(0, None), (1, 1), (3, 0)], "doc_id long, toxic int")).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.3).astype(float)
    votes = np.stack([np.where(y > 0, rng.random(3000) < 0.8, rng.random(3000) < 0.1) for _ in range(4)], axis=1).astype(float)
    votes = np.hstack([votes, np.repeat(votes[:, :1], 3, axis=1)])
    m = toxicity.label_model(votes, 0.3)
    assert ((m.posterior(votes) > 0.5) == (y > 0)).mean() > 0.93
    assert m.weight[[0, 4, 5, 6]].max() < 0.26 and 1.5 * m.weight[0] < m.weight[1:4].min()  # four voters say the same
    assert np.abs(m.toxic[:7] - 0.8).max() < 0.2 and np.abs(m.clean[:7] - 0.1).max() < 0.1


# 5

def test_chat_round_trip(spark):
    texts = ["a", "", None, "<|end|>\n", "<|turn:assistant|>\nx<|end|>\n", "\\<|", "<\\|", "|\\>", "<|>", "\\\\", "ends <", "日本 " * 3000, *[t for t in ODD if t != "a\x00b"]]
    rows_ = [(i // 3, i % 3, ["user", "assistant", "<|end|>\nassistant"][i % 3] if i % 7 else None, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame([*rows_, rows_[0], (None, 0, "assistant", "x")], "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1))
    f = chat.format_rows(d)
    got = {x["conv_id"]: ([(t["role"], t["text"]) for t in x["turns"]], x["learned"]) for x in f.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()}
    want = collections.defaultdict(list)
    for c, n, role, t in [*rows_, rows_[0], (None, 0, "assistant", "x")]:
        want[c].append((n, role or "", t or ""))
    for c, ts in want.items():
        ts.sort()
        assert got[c] == ([(r, t) for _, r, t in ts], "".join(t for _, r, t in ts if r == "assistant"))
    assert chat.chat_digests(d.limit(0)).count() == 0


def test_chat_layouts(spark):
    m = spark.createDataFrame([([("human", "q"), ("gpt", None)], 1)], "conversations array<struct<from:string,value:string>>, extra int")
    assert [tuple(t) for t in chat.canonical_turns(m).first()["turns"]] == [("user", "q"), ("assistant", "")]
    i = spark.createDataFrame([("do", "", "done"), ("do", "this", None)], "instruction string, input string, output string")
    assert [[tuple(t) for t in x["turns"]] for x in chat.canonical_turns(i).collect()] == [[("user", "do"), ("assistant", "done")], [("user", "do\n\nthis"), ("assistant", "")]]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))
    j = spark.createDataFrame([('{"prompt": "p", "response": "r"}',), ('{"messages": [{"role": "user", "content": "x"}, {"content": "y", "role": "assistant"}]}',), ("{bad",), (None,), ('{"z": 1}',), ('{"question": "q", "answer": null}',)], "j string")
    got = [None if x["turns"] is None else [tuple(t) for t in x["turns"]] for x in chat.json_turns(j, "j").collect()]
    assert got == [[("user", "p"), ("assistant", "r")], [("user", "x"), ("assistant", "y")], None, None, None, [("user", "q"), ("assistant", "")]]


# 6

def test_top_k(spark):
    r = np.random.default_rng(6)
    vs = [(i, [float(x) for x in r.normal(0, 0.1, 8)]) for i in range(700)] + [(700 + i, [0.5] * 8) for i in range(150)]
    vs += [(900, None), (901, [1.0, None, *[0.0] * 6]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [1.0, 2.0]), (950, [3.0, 1.0]), (905, [1e15] * 8), (1000, [-0.001] * 8)]
    d = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    old, top_k.SHARD = top_k.SHARD, 200
    try:
        got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in top_k.top_k(d, F.col("vec_id") % 50 == 0).collect()}
    finally:
        top_k.SHARD = old
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v in vs if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q, a in ok.items():
        if q % 50 == 0:
            s = sorted((-min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), i) for i, b in ok.items() if i != q and len(b) == len(a))
            want |= {(q, k + 1): (i, -x) for k, (x, i) in enumerate(s[:5])}
    assert got == want
    assert top_k.top_k(d.limit(0), F.lit(True)).count() == 0


# 7, 10

def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib = Tokenizer.from_file(path)
    r = random.Random(7)
    texts = [*ODD, "<|endoftext|>a <|startoftext|> b'll '", "ﬁ Σας İstanbul ½ x²​\x1c tab\tÁ é", "don't <|endoftext|", "🙂🙂 ok", *[prose(r, 20).title() for _ in range(50)], *["".join(chr(r.randint(32, 0x24F)) for _ in range(40)) for _ in range(200)]]
    got = {x["doc_id"]: x for x in bpe.encode_digests(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), t
    assert bpe.encode(frame(spark, texts[:3]).withColumn("ids", F.lit(0)), path).columns == ["doc_id", "text", "ids"]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib, r = Tokenizer.from_file(path), random.Random(8)
    texts = [*ODD, *[prose(r, r.randint(1, 1500)) for _ in range(120)]]
    got = packing.pack_documents(frame(spark, texts), path).collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x)
    for i, t in enumerate(texts):
        ids, at = [*lib.encode(t or "", add_special_tokens=False).ids, 1], 0
        for k, x in enumerate(sorted(by[i], key=lambda x: x["piece"])):
            part = ids[at : at + 4096]
            assert (x["piece"], x["start"], x["length"], x["ids_crc32"]) == (k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += len(part)
        assert at == len(ids)
    check_bins(got, [x["length"] for x in got])
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def check_bins(got, lengths):
    bins = collections.defaultdict(list)
    for x in got:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == best_fit(lengths)


def best_fit(lengths, capacity=4096):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(20):
        ls = [min(50, max(1, int(r.expovariate(0.1)))) for _ in range(200)]
        plan = packing.plan_packing(collections.Counter(ls), 50)
        assert len({s + k for _, a, b, s, _ in plan for k in range(b - a)}) == best_fit(ls, 50)


# 8

def test_line_dedup_odd_rows(spark):
    lines = [f"line {i}" for i in range(9)]
    texts = [None, "", "\n\n\n\n", "\n".join(lines), "x\n" + "\n".join(lines[2:6]) + "\ny", "\n".join(lines[:2]), "\n".join(lines[:3] * 2), LONG]
    d = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)] + [(3, texts[3], "s", 7), (None, texts[3], "s", 7)], "doc_id long, text string, lines string, spans int")
    got = line_dedup.dedup_lines(d)
    assert got.columns[:4] == ["doc_id", "text", "lines", "spans"]
    by = collections.defaultdict(list)
    for x in got.collect():
        by[x["doc_id"]].append((x["text"], x["lines_removed"]))
    assert by[None] == [(texts[3], 0)] and by[3] == [("", 9)] * 2  # a null id comes first
    assert by[4] == [("x\ny", 4)] and by[5] == [(texts[5], 0)] and by[0] == [(None, 0)] and by[2] == [(texts[2], 0)]
    assert by[6] == [("", 6)] or by[6][0][1] >= 3
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


# 9

def near_oracle(texts):
    sets = {}
    for i, t in texts:
        ws = [lower(w) for w in SPACE.findall(t or "")]
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) > 4 else ({tuple(ws)} if ws else set())
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    head[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates(spark):
    r = random.Random(9)
    texts = [t for t in ODD if t != "x" * 50_000]
    for _ in range(12):
        base = prose(r, r.randint(4, 200)).split()
        for _ in range(r.randint(1, 8)):
            ws = list(base)
            for _ in range(r.randint(0, max(1, len(ws) // 40))):
                ws[r.randrange(len(ws))] = r.choice(VOCAB)
            texts.append(" ".join(ws))
            base = ws
    old = near_dup.STAR_ROUNDS, near_dup.BLOCK
    near_dup.STAR_ROUNDS, near_dup.BLOCK = 1, 2
    try:
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dup.near_duplicates(frame(spark, texts).withColumn("sig", F.lit(1))).collect()}
    finally:
        near_dup.STAR_ROUNDS, near_dup.BLOCK = old
    assert got == near_oracle(list(enumerate(texts)))
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_signature_is_circulant():
    s = near_dup.mix(np.arange(1, 50, dtype=np.uint64))
    places = (near_dup.mix(s) >> np.uint64(64 - near_dup.RING_BITS)).astype(np.int64)
    table = near_dup.ring()[:, 0]
    want = [min(int(table[(p + k) % len(table)]) for p in places) for k in range(near_dup.COORDINATES)]
    assert near_dup.signature(s).tolist() == want


# pipeline

def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs_in, docs = docs, corpus_pipeline.saved(stage(spark, docs, sf_dir), "test")
        kept[name] = docs.toPandas() if name != "packing" else None
        if name != "packing":
            assert docs.columns == docs_in.columns
    near = kept["near_dedup"]
    assert all(x[2] for x in near_oracle(list(zip(near.doc_id, near.text))).values())
    want = passage_oracle(list(zip(near.doc_id, near.text)))
    out = kept["passage_dedup"]
    assert {i: t for i, t in zip(out.doc_id, out.text)} == {i: t[0] for i, t in want.items()}
    pieces = docs.collect()
    assert {x["doc_id"] for x in pieces} == set(out.doc_id)
    check_bins(pieces, [x["length"] for x in pieces])


def test_html_entities_are_the_standard_ones():
    assert html_text.main_text("<article><p>" + "a &copy; &notit; &#x41; b" * 6 + "</p></article>") == " ".join(html.unescape("a &copy; &notit; &#x41; b" * 6).split())


def test_json_records_with_extra_fields(spark):
    want = {
        '{"id": 7, "prompt": "p", "response": "r"}': [("user", "p"), ("assistant", "r")],
        '{"prompt": "p", "response": "r", "meta": {"prompt": 1}, "tags": [1], "text": "t"}': [("user", "p"), ("assistant", "r")],
        '{"messages": [{"role": "user", "content": "x", "name": "n"}, {"role": "assistant", "content": "y"}], "source": "s", "id": 1}': [("user", "x"), ("assistant", "y")],
        '{"messages": [{"role": "user", "content": 1}, null, {"role": "gpt", "content": "y", "meta": {"a": [1]}}]}': [("user", "1"), ("", ""), ("assistant", "y")],
        '{"id": 1, "conversations": [{"from": "human", "value": "a", "weight": 0.5}, {"from": "gpt"}]}': [("user", "a"), ("assistant", "")],
        '{"instruction": "do", "input": "this", "output": "done", "split": "train"}': [("user", "do\n\nthis"), ("assistant", "done")],
        '{"messages": []}': [],
        '{"dialog": [], "id": 3}': [],
        '{"messages": ["x"]}': None,
        '{"messages": [{"role": "user", "content": ["x"]}, {"role": "user", "content": "y"}]}': None,
        '{"prompt": ["p"], "response": "r"}': None,
        '{"prompt": "p", "response": "r", "completion": "c"}': None,
        '{"id": 1}': None,
        "[1]": None,
    }
    d = spark.createDataFrame([(x,) for x in want], "j string")
    got = {x["j"]: None if x["turns"] is None else [tuple(t) for t in x["turns"]] for x in chat.json_turns(d, "j").collect()}
    assert got == want


def test_top_k_repeated_query_id_beside_copies(spark):
    vs = [(0, [0.5] * 4)] * 10 + [(i, [0.5] * 4) for i in (1, 2, 3)] + [(3, [0.5] * 4)] * 2
    d = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for x in sorted(top_k.top_k(d, F.col("vec_id") < 2).collect(), key=lambda x: x["rank"]):
        got[x["query_id"]].append(x["vec_id"])
    assert got == {0: [1, 2, 3, 3, 3], 1: [0, 0, 0, 0, 0]}


def test_top_k_scores_beyond_double_precision(spark):
    """Scores of about 2^62 that differ by one; also a cell of its own for each of two far groups."""
    big = 2.0**31
    vs = [(0, [big, 1.0])] + [(i, [big, float(i)]) for i in range(1, 8)] + [(100 + i, [-big, float(i)]) for i in range(8)]
    d = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    old, top_k.SHARD = top_k.SHARD, 2
    try:
        got = sorted((x["rank"], x["vec_id"], x["score"]) for x in top_k.top_k(d, F.col("vec_id") == 0, scale=1).collect())
    finally:
        top_k.SHARD = old
    assert got == [(r, i, 2**62 + i) for r, i in enumerate((7, 6, 5, 4, 3), 1)]


def test_top_k_odd_columns(spark):
    d = spark.createDataFrame([(0, [1.0], 1, "x", 0), (1, [2.0], 2, "y", 0), (2, [], 3, "z", 0), (4, [], 3, "z", 0)], "vec_id long, embedding array<double>, dims int, cell string, floor int")
    got = sorted(map(tuple, top_k.top_k(d, F.col("vec_id") % 2 == 0, scale=1).collect()))
    assert got == [(0, 1, 1, 2), (2, 1, 4, 0), (4, 1, 2, 0)]


def test_plan_refills_the_bin_just_used():
    r = random.Random(2)
    cases = [(20, {2: 186, 3: 69})] + [(r.choice((17, 20, 31)), {r.randint(1, 12): r.randint(1, 90) for _ in range(4)}) for _ in range(60)]
    for capacity, counts in cases:
        bins, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for length, a, b, s, at in packing.plan_packing(counts, capacity):
            ranks[length] += range(a, b)
            for k in range(b - a):
                bins[s + k].append((at, length))
        assert ranks == {x: list(range(n)) for x, n in counts.items()}
        for b in bins.values():
            ends = [0, *[at + n for at, n in sorted(b)]]
            assert [at for at, _ in sorted(b)] == ends[:-1] and ends[-1] <= capacity
        assert len(bins) == best_fit([x for x, n in counts.items() for _ in range(n)], capacity)


def test_block_links_do_not_depend_on_signatures():
    kinds = pa.schema([("cluster", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("doc_id", pa.int64()), ("component", pa.int64()), ("sig", pa.list_(pa.int32())), ("shingles", pa.list_(pa.int64()))])
    one = {"cluster": 1, "i": 0, "j": 0}
    rows_ = [
        {**one, "side": 0, "doc_id": 1, "component": 1, "sig": [0] * 128, "shingles": list(range(80))},
        {**one, "side": 1, "doc_id": 2, "component": 2, "sig": [0] * 74 + [1] * 54, "shingles": list(range(78))},
        {**one, "side": 1, "doc_id": 3, "component": 3, "sig": [0] * 128, "shingles": list(range(50, 150))},
    ]
    found = [b.to_pydict() for b in near_dup._block_links(75, 100)(iter([pa.RecordBatch.from_pylist(rows_, kinds)]))]
    assert found == [{"a": [1], "b": [2]}]


def test_near_duplicates_at_other_thresholds(spark):
    assert near_dup.banding(75, 100) == (32, 4)
    with pytest.raises(ValueError):
        near_dup.banding(1, 100)
    r = random.Random(50)
    texts = []
    for k in range(80):
        ws = [f"w{k}x{i}" for i in range(104)]  # 100 windows of five words; 67 of them stay, 67 / 133 is over a half
        texts += [" ".join(ws), " ".join([*ws[:71], *[f"v{k}x{r.random()}" for _ in range(33)]])]
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(frame(spark, texts), num=50).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}
