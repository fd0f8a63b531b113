"""BPE encoding and decoding with a queue of merge ranks over a linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batches, small_batches
from quarry.llm.token_count import LETTERS, NUMBERS, UNUSUAL, byte_symbols, once


#: Fixed value: the pattern by which tokenizers with word ends split a normalised text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: Above any position in a word; ids from UNKNOWN on stand for bytes that the vocabulary lacks.
SPAN, UNKNOWN = 1 << 40, 1 << 19
#: Words whose ids a worker remembers.
WORDS = 150_000


class Bpe:
    """A BPE tokenizer read from a file of the tokenizers library: words with an end mark, lower case, no decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or spec.get("decoder") is not None:
            raise ValueError("only BPE without prefix, byte fallback and decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.mark: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        symbols = byte_symbols()
        self.first = [self.vocab.get(c, UNKNOWN + b) for b, c in enumerate(symbols)]
        self.last = [self.vocab.get(c + self.mark, UNKNOWN + b) for b, c in enumerate(symbols)]
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.strings = {i: s for s, i in (self.vocab | added).items()}
        self.by_text = {str(i): x for i, x in self.strings.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        # the library's own normaliser and splitter, for text whose classes depend on the version of Unicode
        self.library = Tokenizer.from_file(path)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.usual = split["pattern"]["Regex"] == PATTERN
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("only NFC, white space and lower case before the words of a pattern")
        self.known: dict[str, str] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word.

        Queue entries are rank * SPAN + left position. An entry is stale, and
        skipped, if the pair now at its position has another rank.
        """
        s = [self.first[b] for b in word.encode()]
        n = len(s)
        if not n:
            return s
        s[-1] = self.last[word.encode()[-1]]
        rank = self.rank.get
        queue = [r * SPAN + i for i in range(n - 1) if (r := rank(s[i] << 20 | s[i + 1])) is not None]
        if not queue:
            return [x for x in s if x < UNKNOWN]
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        push, pop, made = heapq.heappush, heapq.heappop, self.made
        while queue:
            r, i = divmod(pop(queue), SPAN)
            j = after[i]
            if j >= n or s[i] < 0 or rank(s[i] << 20 | s[j]) != r:
                continue
            s[i], s[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(s[i] << 20 | s[k])) is not None:
                    push(queue, r * SPAN + i)
            if (h := before[i]) >= 0 and (r := rank(s[h] << 20 | s[i])) is not None:
                push(queue, r * SPAN + h)
        return [x for x in s if 0 <= x < UNKNOWN]  # without an unknown token the library leaves out what it doesn't know

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if not self.usual or UNUSUAL.search(text):
            text = self.library.normalizer.normalize_str(text)
            steps = self.library.pre_tokenizer.pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in steps]
        return WORD.findall(text.lower())  # composed already; white space only divides words

    def look_up(self, words: list[str]) -> list[str]:
        """The ids of each word as text, from memory or by merging; words without ids are left out."""
        known = self.known
        if len(known) > WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = " ".join(map(str, self.merge(w)))
        return [x for w in words if (x := known[w])]

    def written(self, text: str) -> str:
        """Ids of a text in decimal, joined by one space."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += self.look_up(self.pieces(text[at : m.start()]))
            out.append(str(self.added[m[0]]))
            at = m.end()
        return " ".join(out + self.look_up(self.pieces(text[at:])))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the library's encode() without special tokens added."""
        return list(map(int, self.written(text).split()))

    def decode(self, ids: list[int]) -> str:
        """The strings of the vocabulary joined by one space, as the library does without a decoder; unknown ids are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids of a text, SHA-256 of the ids as text and SHA-256 of what they decode to."""
        ids = self.written(text)
        each = ids.split()
        decoded = " ".join(map(self.by_text.__getitem__, each))
        return len(each), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _over(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(("bpe", path), lambda: Bpe(path))
        for whole in it:
            for batch in batches(whole, "text", 1 << 21):
                columns = list(zip(*(row(bpe, x) for x in pc.fill_null(batch.column("text"), "").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in schema.split(", ")[1:]]
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded_sha256) for each row of docs; see bpe_digests for null, repeated and other rows."""
    def row(bpe: Bpe, text: str):
        each = bpe.written(text).split()
        decoded = " ".join(map(bpe.by_text.__getitem__, each))
        return len(each), np.array(each, dtype=np.int32), hashlib.sha256(decoded.encode()).hexdigest()

    return _over(docs, path, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", row)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs (doc_id long, text string).

    path: a file of the tokenizers library, there on every executor; ids and
    decoded text equal the library's encode() without special tokens added
    and decode() with them kept. ids_sha256 is of the decimal ids joined by a
    space. A null text is empty: no ids, the digests are of nothing. Rows are
    kept as they are, repeated or with a null doc_id; other columns aren't
    read. Words are merged once and remembered by the worker, up to a bound.
    No shuffle.
    """
    return _over(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda bpe, x: bpe.digest(x))
