import random

import public_tokenizers
from tokenizers import Tokenizer

from tracelens.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_the_librarys_words_are_the_tries():
    rng = random.Random(3)
    odd = ["", "a", "x" * 5000, "straße", "ÉCOLE", "日本語のテキスト", "it's we'll", "a\x00b", "naïve,co-op;", "<|endoftext|>", "a<|startoftext|>b", " x y", "é", "1234567", "🙂🙂 ok"]
    odd += ["".join(rng.choice("abcdeéß'.,-1 \n<|>") for _ in range(rng.randrange(40))) for _ in range(500)]
    lib, trie, mine = Tokenizer.from_file(PATH), bpe.WordTrieBpe(PATH), bpe.LibraryBpe(PATH)
    lib.no_truncation()
    lib.no_padding()
    assert mine.whole
    for x in odd:
        assert mine.encode(x) == trie.encode(x) == lib.encode(x, add_special_tokens=False).ids


def test_pieces_need_no_trie(spark, monkeypatch):
    import pyarrow as pa

    def refuse(*_):
        raise AssertionError("words go through the trie")

    monkeypatch.setattr(bpe.WordTrieBpe, "encode_words", refuse)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3]), "text": pa.array(["some words", None, ""])})
    got = next(packing._pieces(PATH, 4096, 1)(iter([batch])))
    assert got.column("length").to_pylist() == [3, 1, 1]
