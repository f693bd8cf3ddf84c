"""BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a block of texts form a trie; a depth-first walk over it keeps, for each prefix on the
path, the *last-token state*: the last token of that prefix's encoding. A prefix's encoding is that of a shorter
prefix plus one token, so the state is all that needs to be stored, and prefixes that words share are worked out
once. A token t may end a prefix when the token before it is compatible with it, that is when no merge of the
pair's own history, undone from the latest, would have joined symbols across the border earlier.

Files: the JSON of the `tokenizers` library with a BPE model, byte-level pre-tokenisation and perhaps a word-end suffix.
The file's normalizer and pre-tokenizer are compared with the patterns of the fast path when it is loaded; the library
normalises and splits the texts of other files, and texts with characters outside those patterns.
Nulls count as empty texts; an empty text has no tokens. Repeated rows and ties give equal results; texts and words
of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.llm.common import lean

#: Words a Python worker remembers before it starts anew: about 200 MB.
CACHE_WORDS = 700_000
#: Texts worked on at once.
BLOCK = 1024

# The byte alphabet of byte-level BPE, and the word pattern for texts of plain characters.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LATIN = "a-zß-öø-ÿ"
_PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
_WORD = re.compile(f"[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s{_LATIN}0-9]+")
#: The normalizer and pre-tokenizer that these two patterns stand for; texts of other files go through the library's.
_PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PLAIN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_PLAIN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PLAIN_PRETOKENIZER = {"type": "Sequence", "pretokenizers": [_PLAIN_SPLIT, _PLAIN_BYTES]}


def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    spare = iter(range(256, 512))
    return [chr(b) if b in set(_PRINTABLE) else chr(next(spare)) for b in range(256)]


class WordTrieBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.end = path, model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in added.items()}
        self.joined = spec.get("decoder") is None
        self._plain = spec.get("normalizer") == _PLAIN_NORMALIZER and spec.get("pre_tokenizer") == _PLAIN_PRETOKENIZER
        self._added = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._bytes = byte_alphabet()
        self._from = {c: b for b, c in enumerate(self._bytes)}
        self._spelling = dict(enumerate(self._bytes))
        #: what a merge makes and when; what a token was made of; a token's age (-1: a single symbol)
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.age: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[a, b], self.parts[c], self.age[c] = rank, (a, b), rank
        #: tokens that end words, by their text without the suffix, and the others
        n = len(self.end)
        self.final = {t[: len(t) - n]: i for t, i in self.vocab.items() if n and t.endswith(self.end)} or self.vocab
        self.inner = {t: i for t, i in self.vocab.items() if not (n and t.endswith(self.end))} if n else self.vocab
        #: lengths of the tokens that end with three symbols (or are two or one of them), longest first
        self.lengths, self.final_lengths = self._lengths(self.inner), self._lengths(self.final)
        self._fits: dict[tuple[int, int], bool] = {}
        self._lib: Any = None

    @staticmethod
    def _lengths(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """By the last three symbols, or two where there are no more or no token ends with the three."""
        found: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) > 2:
                found.setdefault(t[-3:], {1}).add(len(t))
            elif len(t) == 2:
                found[t] = {2, 1}
        for end, sizes in found.items():
            if len(end) == 3 and end[1:] in tokens:
                sizes.add(2)
        return {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}

    def fits(self, a: int, b: int) -> bool:
        """Whether a followed by b is how their joint text is encoded."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int, joined: bool = False) -> bool:
        """Undo the merges of both sides, latest first. The border falls if the two symbols at it have a merge
        of their own that comes before either is used up by its own side (at equal rank the left pair is first).
        joined: the merge of a and b themselves doesn't count."""
        merge, parts, age = self.merge, self.parts, self.age
        used_a = used_b = len(merge)
        while True:
            rank = merge.get((a, b))
            if rank is not None and rank < used_a and rank <= used_b and not joined:
                return False
            joined = False
            x, y = age.get(a, -1), age.get(b, -1)
            if x < 0 and y < 0:
                return True
            if x >= y:
                used_a, a = x, parts[a][1]
            else:
                used_b, b = y, parts[b][0]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of each distinct word (no white space, normalised, as text)."""
        out: dict[str, list[int]] = {}
        table = self._spelling
        # printable ASCII but the space stands for itself in the byte alphabet
        spelled = {w if w.isascii() and w.isprintable() and " " not in w else w.encode().decode("latin-1").translate(table): w for w in words}
        inner, final, lengths, final_lengths = self.inner, self.final, self.lengths, self.final_lengths
        fits, known = self.fits, self._fits
        one = (1,)
        path = ""  # symbols from the root to the current node
        last: list[int | None] = [-1]  # last token of each prefix on the path; None: not needed so far
        size: list[int] = [0]  # and its length in symbols

        def state(k: int) -> int:
            """Last token of the path's first k symbols. Exactly one token can end a prefix."""
            for n in lengths.get(symbols[k - 3 : k]) or lengths.get(symbols[k - 2 : k], one) if k > 2 else lengths.get(symbols[:k], one):
                i = k - n
                if i < 0:
                    continue
                t = inner.get(symbols[i:k])
                if t is None:
                    continue
                if i == 0:
                    if self._whole(t):
                        break
                    continue
                p = last[i]
                if p is None:
                    p = state(i)
                ok = known.get((p, t))
                if ok or ok is None and fits(p, t):
                    break
            else:
                raise ValueError(f"no token for {symbols[k - 1]!r} in {self.path}")
            last[k], size[k] = t, n
            return t

        for symbols in sorted(spelled):
            n = len(symbols)
            if not n:
                out[spelled[symbols]] = []
                continue
            depth, top = 0, min(len(path), n - 1)
            if path[:top] == symbols[:top]:
                depth = top
            else:
                while path[depth] == symbols[depth]:
                    depth += 1
            del last[depth + 1 :], size[depth + 1 :]  # back up to the node where the words part
            last += [None] * (n - 1 - depth)
            size += [0] * (n - 1 - depth)
            path = symbols[: n - 1]
            if n > 200:  # long words front to back, so that state() isn't nested
                for k in range(depth + 1, n):
                    state(k)
            for m in final_lengths.get(symbols[-3:]) or final_lengths.get(symbols[-2:], one):
                i = n - m
                if i < 0:
                    continue
                t = final.get(symbols[i:])
                if t is None:
                    continue
                if i == 0:
                    if self._whole(t):
                        break
                    continue
                p = last[i]
                if p is None:
                    p = state(i)
                ok = known.get((p, t))
                if ok or ok is None and fits(p, t):
                    break
            else:
                raise ValueError(f"no token for {symbols[-1]!r} in {self.path}")
            ids = [t]
            while i:
                if last[i] is None:
                    state(i)
                ids.append(last[i])
                i -= size[i]
            ids.reverse()
            out[spelled[symbols]] = ids
        return out

    def _whole(self, t: int) -> bool:
        """Whether a token's own text is encoded as that token alone."""
        known = self._fits.get((t, -1))
        if known is None:
            pair = self.parts.get(t)
            known = self._fits[t, -1] = pair is None or self._whole(pair[0]) and self._whole(pair[1]) and self._border_holds(*pair, joined=True)
        return known

    def units(self, text: str | None) -> list[str]:
        """What a text's encoding is put together from: runs without white space, lower-cased. Behind a zero byte
        stands the id of an added token, behind a one byte a single word that the library has split off."""
        if not text:
            return []
        if self._added and "<" in text and len(pieces := self._added.split(text)) > 1:
            return [u for x in pieces if x for u in ([f"\0{self.added[x]}"] if x in self.added else self._units(x))]
        return self._units(text)

    def _library(self) -> Any:
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
        return self._lib

    def _units(self, text: str) -> list[str]:
        if self._plain and _PLAIN.fullmatch(text):
            return text.lower().split()
        lib = self._library()
        parts = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text) if lib.normalizer else text)
        return ["\1" + bytes([self._from[c] for c in w]).decode() for w, _ in parts]

    def encode_units(self, units: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(unit, token ids) of distinct units."""
        split = _WORD.findall
        words = {u: (u,) if u.isalpha() and u.isascii() else [u[1:]] if u[0] == "\1" else split(u) for u in units if u[0] != "\0"}
        ids = self.encode_words({w for ws in words.values() for w in ws})
        for u, ws in words.items():
            yield u, ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
        for u in units:
            if u[0] == "\0":
                yield u, [int(u[1:])]

    def blocks(self, texts: list[str | None], caches: list[dict], renders: list) -> Iterator[list[str]]:
        """The units of each text; caches[k] then holds renders[k](ids) of each unit."""
        for lo in range(0, len(texts), BLOCK):
            found = [self.units(x) for x in texts[lo : lo + BLOCK]]
            if len(caches[0]) > CACHE_WORDS:
                for c in caches:
                    c.clear()
            for unit, ids in self.encode_units(set().union(*found).difference(caches[0])):
                for c, render in zip(caches, renders, strict=True):
                    c[unit] = render(ids)
            yield from found

    def encode(self, text: str | None) -> list[int]:
        known = dict(self.encode_units(set(units := self.units(text))))
        return [i for u in units for i in known[u]]

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode, special tokens included; for a file without decoder: tokens joined by one space."""
        if not self.joined:
            return self._library().decode(list(ids), skip_special_tokens=False)
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class LibraryBpe(WordTrieBpe):
    """The same with words encoded by the library's BPE model, in less than half the trie's time: for operators that need
    the ids and not this module's method."""

    def __init__(self, path: str):
        super().__init__(path)
        #: with a token for each byte, within words and at their ends, no word has an unknown symbol
        self.whole = all(c in self.inner and c in self.final for c in self._bytes)

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        if not self.whole:
            return super().encode_words(words)
        table, tokenize = self._spelling, self._library().model.tokenize
        return {w: [t.id for t in tokenize(w if w.isascii() and w.isprintable() and " " not in w else w.encode().decode("latin-1").translate(table))] for w in words}


_open: dict[tuple[str, type], WordTrieBpe] = {}


def tokenizer(path: str, kind: type[WordTrieBpe] = WordTrieBpe) -> WordTrieBpe:
    """One per Python worker and kind."""
    lean("bpe")
    if (path, kind) not in _open:
        _open[path, kind] = kind(path)
    return _open[path, kind]


_caches: dict[tuple, list[dict]] = {}


def caches(*key) -> list[dict]:
    """Two dictionaries for a use of a tokenizer, kept by the Python worker from task to task."""
    return _caches.setdefault(key, [{}, {}])


def forget() -> None:
    """Drop the tokenisers and dictionaries of this worker."""
    _open.clear()
    _caches.clear()


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (ids_of, text_of) = tokenizer(path), caches("digests", path)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for units in t.blocks(batch.column("text").to_pylist(), [ids_of, text_of], [lambda ids: " ".join(map(str, ids)), t.decode if t.joined else len]):
                ids = " ".join(map(ids_of.__getitem__, units))
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_hex.append(sha256(ids.encode()).hexdigest())
                text = " ".join(map(text_of.__getitem__, units)) if t.joined else t.decode(map(int, ids.split()))
                text_hex.append(sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its token count and the digests of its ids and of the text decoded from them. No shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the token ids of text_col as array<int>; all its columns stay."""
    schema = docs.drop(out_col).schema.add(out_col, T.ArrayType(T.IntegerType()))
    plain = docs.drop(out_col)

    def run(batches):
        t, (known, _) = tokenizer(path), caches("ids", path)
        for batch in batches:
            ids = [[i for u in units for i in known[u]] for units in t.blocks(batch.column(text_col).to_pylist(), [known], [list])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out_col])

    return plain.mapInArrow(run, schema)
