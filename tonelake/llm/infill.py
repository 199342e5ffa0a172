"""Fill-in-middle examples: texts cut into prefix, middle and suffix at ranked token offsets.

The Split pre-tokenizer of the tokenizers library, with the token pattern as
isolated matches, gives the code-point offsets of every token; nothing is
trained. The length of the offset array is n, its entries at two drawn ranks
are the cuts. Tasks return those three numbers only: texts are sliced and put
together where they already are, by columns.

A token takes the space before it, so a place where a space follows something
else always is an edge. Long texts are handed to the library in parts that end
at such places, which keeps the offsets of one part in memory at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import slices

SPACE = r"\x20\x09-\x0D"
#: Tokens: characters with the space before them, or the space that ends a text.
TOKENS = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
#: Code points that are handed to the library at once, and more only up to the next edge.
PART = 1 << 16
SENTINELS = ("<P>", "<S>", "<M>")

_EDGE = re.compile(f"[^{SPACE}](?=[{SPACE}])")


@lru_cache(maxsize=1)
def splitter():
    from tokenizers import Regex, pre_tokenizers

    # possessive counts match the same tokens and never step back over a long run of space
    return pre_tokenizers.Split(Regex(f"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++"), behavior="isolated")


def token_ends(text: str) -> np.ndarray:
    """Where each token ends, in code points; the empty text has none."""
    split, found, at = splitter(), [], 0
    while at < len(text):
        edge = _EDGE.search(text, at + PART - 1) if len(text) - at > PART else None
        to = edge.end() if edge else len(text)
        tokens = split.pre_tokenize_str(text[at:to])
        found.append(np.fromiter((end for _, (_, end) in tokens), np.int64, len(tokens)) + at)
        at = to
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cut_places(text: Column, one: Column, other: Column) -> Column:
    """Tokens of each text, and the code points before the lesser and the greater of two ranks that are drawn modulo n + 1."""

    @arrow_udf("n long, first long, second long")
    def placed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            found = []
            for part in slices([pa.record_batch(list(columns), ["text", "one", "other"])], "text"):
                for said, a, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ends = token_ends(said or "")
                    n = len(ends)
                    low, high = sorted((a % (n + 1), b % (n + 1)))
                    found.append((n, int(ends[low - 1]) if low else 0, int(ends[high - 1]) if high else 0))
            n, first, second = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, first, second)], ["n", "first", "second"])

    return placed(text, one, other)


def draws(key: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers of each key under a seed: the first digits of the SHA-256 of both; a null key counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output of each row.

    ``rate`` of a hundred keys are cut, ``spm`` of a hundred of those put the
    suffix first, the others the prefix. Both cuts are token edges; prefix or
    middle or suffix may be empty. A text that is empty or holds a sentinel is
    plain: output is the text, prefix_chars and middle_chars are null. A null
    text counts as empty, rows that repeat come out alike, an empty table gives
    an empty one, and a column already named as a new one is replaced.
    """
    cuts = "_".join(["cuts", *docs.columns])
    h1, h2, h3, h4 = draws(F.col(key), seed)
    said = F.coalesce(F.col(text), F.lit(""))
    plain = (said == "") | (h3 % 100 >= rate)
    for mark in SENTINELS:
        plain |= said.contains(mark)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    first, second = F.col(cuts)["first"], F.col(cuts)["second"]

    def part(start: Column, end: Column) -> Column:
        return F.substr(said, (start + 1).cast("int"), (end - start).cast("int"))

    prefix, middle, suffix = part(F.lit(0), first), part(first, second), part(second, F.length(said))
    output = (
        F.when(form == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
        .when(form == "spm", F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle))
        .otherwise(said)
    )
    new = {
        "n": F.col(cuts)["n"],
        "form": form,
        "prefix_chars": F.when(~plain, first),
        "middle_chars": F.when(~plain, second - first),
        "output": output,
    }
    return docs.withColumn(cuts, cut_places(said, h1, h2)).withColumns(new).drop(cuts)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    No sentinel is in a text that is cut, and none can arise where one meets a
    text, as ``<`` only starts and ``>`` only ends one: the first of each is the real one.
    """
    prefix_first = F.regexp_replace(output, r"(?s)\A<P>(.*?)<S>(.*?)<M>(.*)\z", "$1$3$2")
    suffix_first = F.regexp_replace(output, r"(?s)\A<S>(.*?)<P>(.*?)<M>(.*)\z", "$2$3$1")
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)
