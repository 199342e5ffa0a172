"""Token counts by the whole-token shortcut.

A piece model merges neighbouring symbols into vocabulary strings. Two facts
about the vocabulary, both checked when it is loaded, cut a text into parts
that cannot influence one another:

* no piece has a word mark (U+2581, which stands for a space) after another
  character, so nothing is merged over the left edge of a run of word marks;
* no piece has a line feed, so nothing is merged over one.

Every piece is then tried alone: those that come back as one token are proven
whole, and a part equal to one counts 1 without any merging. Only the other
parts go to the library, each once for as long as its count is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Remembered, slices

MARK = "▁"
#: Counts of parts that are no whole token which a worker remembers, and as many older ones.
REMEMBERED = 200_000

_PARTS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall


class PartCounts:
    """Tokens of whole texts; parts that are no whole token are counted by the library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [
            model.id_to_piece(i)
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in kept):
            raise ValueError(f"{path}: pieces reach over a word mark or a line feed, so texts cannot be cut there")
        self.lead = len(model.encode("\n"))
        # the proof: a piece is whole if it alone, after a line feed, is one token
        self.whole = frozenset(p for p, n in zip(kept, self.merged(kept), strict=True) if n == 1)
        self.rest = Remembered(REMEMBERED, self.merged)

    def merged(self, parts: list[str]) -> list[int]:
        """The library's count of each part, taken after a line feed so that no word mark is put before it."""
        return [len(x) - self.lead for x in self.model.encode(["\n" + p for p in parts], num_threads=1)] if parts else []

    def of(self, texts: list[str]) -> list[int]:
        parts = [_PARTS(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        self.rest.learn(set().union(*parts) - self.whole)
        whole, rest = self.whole, self.rest
        return [sum([1 if p in whole else rest[p] for p in x]) for x in parts]


@lru_cache(maxsize=2)
def part_counts(path: str) -> PartCounts:
    return PartCounts(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of each whole text under the piece model at ``path``.

    Null and empty texts have 0. No begin, end or other special token is
    added, and special strings inside a text are ordinary text, as the
    library's default has it.
    """

    @arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = part_counts(path)
        for batch in batches:
            found: list[int] = []
            for part in slices([pa.record_batch([batch], ["text"])], "text"):
                found += counts.of([x or "" for x in part.column(0).to_pylist()])
            yield pa.array(found, pa.int64())

    return counted(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of each row; all its columns and rows stay, in any shape.

    Repeated rows are counted each; an empty table gives an empty one. A column
    already named ``to`` is replaced.
    """
    return docs.withColumn(to, token_count(F.col(text), path))
