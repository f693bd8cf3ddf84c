"""run() of the corpus pipeline against a plain version of each stage, and its odd cases."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import ODD, check_bins, near_oracle, passage_oracle, prose, toxic_corpus
from tracelens.llm import queries, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
BLANK = re.compile(r"[ \t\n\x0b\f\r]*")


def line_oracle(docs):
    """Texts without lines under a window of three lines that an earlier place has, by (doc_id, line)."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        ls = (t or "").split("\n")
        gone = [False] * len(ls)
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if BLANK.fullmatch("".join(w)):
                continue
            if w in seen:
                gone[k : k + 3] = [True] * 3
            seen.add(w)
        out[i] = "\n".join(x for x, g in zip(ls, gone) if not g) if any(gone) else t
    return out


def pieces_oracle(docs):
    from tokenizers import Tokenizer

    lib, out = Tokenizer.from_file(queries.tokenizer_path()), set()
    for i, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out.add((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def test_run_against_plain_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(d.select("doc_id", "text"), labels)
    docs = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert len(dict(docs)) == len(docs)
    clean = [(i, t) for i, t in docs if model.score(t) < 0.3]
    lines = line_oracle(clean)
    assert len(clean) < len(docs) and any(lines[i] != t for i, t in clean)
    near = near_oracle(sorted(lines.items()))
    kept = [(i, lines[i]) for i in lines if near[i][2]]
    assert len(kept) < len(lines)
    texts = {i: x[0] for i, x in passage_oracle(kept).items()}
    assert {(x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got} == pieces_oracle(texts.items())
    check_bins(got, [x["length"] for x in got])


def test_run_over_odd_tables(spark, tmp_path):
    r = random.Random(77)
    docs, labels = toxic_corpus(r, 300)
    passage = prose(r, 70)
    rows = [(i, t, "en", "s", len(t), 1.5) for i, t in docs] + [(1000 + i, t, None, None, None, None) for i, t in enumerate(ODD)]
    rows += [(2000 + i, f"{prose(r, 30)} {passage} {prose(r, 30)}", "en", "s", 1, 2.5) for i in range(3)] + [(None, "no id", None, "s", 5, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").withColumns({"spans": F.lit("x"), "component_id": F.lit(1)})
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    d = odd
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, corpus_pipeline.saved(stage(spark, d, f"{tmp_path}/a"), "test")
        if name != "packing":
            assert d.columns == before.columns and d.count() <= before.count()
            assert d.where("text is not null and n_chars <> length(text)").isEmpty() or name in ("toxicity", "near_dedup")
    left = {x["doc_id"] for x in d.collect()}
    assert None in left and {1000 + i for i, t in enumerate(ODD) if t and t.strip()} & left
    toxic = {i for i, y in labels if y}
    assert not toxic & left and len(left & {i for i, y in labels if not y}) > 0.9 * (300 - len(toxic))

    odd.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
