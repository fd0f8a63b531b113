"""Token counts of a byte-level BPE tokenizer, with huge documents encoded in overlapping chunks.

The library's pre-tokenizer reads a text from left to right and forgets what
came before each piece; a piece depends on the characters up to two after its
end (an apostrophe is one unless "ll", "re" or "ve" follow). So a boundary of
pieces that a chunk reports is a boundary of the whole text if the chunk began
at one and goes on for two characters and into another piece, and a later chunk,
wherever it began, agrees with the whole text from the first such boundary
that it shares. Chunks are spliced there: tokens never cross pieces. Where
two chunks share no boundary in their overlap, the overlap is widened.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batches, small_batches



def ranges(kind: str) -> str:
    """The characters below U+0250 of a general category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c)).startswith(kind))


LETTERS, NUMBERS = ranges("L"), ranges("N")
#: Fixed value: the pattern by which byte-level BPE of this family splits a text into pieces, over the usual characters.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Text outside these ranges, whose classes no version of Unicode has changed, is split by the library itself.
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r -\x7e\xa0-ɏ‐-‧‰-⁞€]")
#: Pieces whose counts a worker remembers.
REMEMBERED = 600_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts tokens as the library does with add_special_tokens=False, remembering the counts of pieces."""

    def __init__(self, path: str, chunk: int = 1 << 16, overlap: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        simple = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        self.by_piece = plain and simple and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        names = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True)))) if names else None
        self.symbols = byte_symbols()
        self.known: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        """Have the library's model count the pieces that aren't known."""
        known, size, symbols = self.known, self.tokenizer.model.tokenize, self.symbols
        if len(known) > REMEMBERED:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = len(size("".join(map(symbols.__getitem__, p.encode()))))

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens; joined they are the text."""
        if UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return PIECES.findall(text)

    @staticmethod
    def _sure(ends: np.ndarray, end: int) -> np.ndarray:
        """Boundaries that what follows a chunk can't change: the last piece may go on, those before it have seen two characters more."""
        return ends[:-1][ends[:-1] <= end - 2]

    def spliced(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text without special tokens, chunk by chunk."""
        start, n = 0, len(text)
        while n - start > self.chunk:
            end, overlap = start + self.chunk, self.overlap
            left = self.split(text[start:end])
            left_ends = start + np.cumsum([len(p) for p in left])
            sure = self._sure(left_ends, end)
            while True:
                began = max(start, end - overlap)
                right = self.split(text[began : min(n, end + overlap)])
                right_ends = began + np.cumsum([len(p) for p in right])
                shared = np.intersect1d(sure, np.concatenate([[began], right_ends[:-1]]))
                shared = shared[shared > start]
                if len(shared):
                    break
                if began == start:  # a single piece fills the chunk: take in more of the text
                    end = min(n, start + 2 * (end - start))
                    left = self.split(text[start:end])
                    if end == n:
                        yield left
                        return
                    left_ends = start + np.cumsum([len(p) for p in left])
                    sure = self._sure(left_ends, end)
                overlap *= 2
            at = int(shared[-1])
            yield left[: int(np.searchsorted(left_ends, at)) + 1]
            start = at
        yield self.split(text[start:]) if start < n else []

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        if not self.by_piece:
            return [len(e) for i in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
        out = []
        for text in texts:
            n, at = 0, 0
            cuts = [m.span() for m in self.special.finditer(text)] if self.special else []
            for a, b in [*cuts, (len(text), len(text))]:
                n += (a < b)
                for pieces in self.spliced(text[at:a]):
                    self.learn(pieces)
                    n += sum(map(self.known.__getitem__, pieces))
                at = b
            out.append(n)
        return out


_LOADED: dict[tuple, object] = {}


def once(key: tuple, make: Callable):
    """What make() gives, made once in each worker."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = 1 << 16) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id long, text string).

    path: a file of the tokenizers library, there on every executor. Counts
    are those of its encode() without special tokens added, truncation or
    padding; special strings within a text are one token each, its default.
    A null text is empty: 0 bytes, 0 tokens. Rows are kept as they are,
    repeated or with a null doc_id; other columns aren't read. A text of more
    than `chunk` characters is encoded in overlapping chunks. over_limit:
    n_tokens > limit. No shuffle.
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("count", path, chunk), lambda: Counter(path, chunk))
        for whole in it:
            for batch in batches(whole, "text"):
                text = pc.fill_null(batch.column("text"), "")
                n = np.array(counter.count(text.to_pylist()), np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(text).cast(pa.int64()), "n_tokens": n, "over_limit": n > limit})

    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
