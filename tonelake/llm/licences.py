"""License scans: notice phrases, identifier tags and the expressions that follow them.

One Aho-Corasick automaton over the words of a text finds every notice phrase
and every tag in one pass. What follows a tag and its colon is read as a
licence expression: a shunting-yard parser turns it round, and evaluating it
gives its licences and how restrictive it is. ``or`` leaves a choice, so the
least counts; ``and`` binds to both, so the greatest does; ``with`` an
exception is never more than weak.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import WORD_BYTES, slices

#: Characters that are handed to the automaton at once; its state goes on from one to the next.
PART = 1 << 20

# How restrictive a licence is, from 0 to 1. Fixed values.
FREE, PERMISSIVE, WEAK, STRONG, NETWORK, LIMITED, RESERVED = 0.1, 0.2, 0.5, 0.7, 0.8, 0.9, 1.0
#: Of a tag that no known licence follows.
UNRECOGNISED = 0.5

# The phrases that every scan has. Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Words of notices, what they are notices of, and how restrictive that is. Fixed values.
NOTICES = {
    "affero general public license": ("agpl", NETWORK),
    "all rights reserved": ("reserved", RESERVED),
    "apache license": ("apache", PERMISSIVE),
    "apache license version 2 0": ("apache-2.0", PERMISSIVE),
    "apache software license": ("apache", PERMISSIVE),
    "artistic license": ("artistic", PERMISSIVE),
    "boost software license": ("bsl-1.0", PERMISSIVE),
    "bsd license": ("bsd", PERMISSIVE),
    "cc0": ("cc0", FREE),
    "cc by": ("cc-by", PERMISSIVE),
    "cc by nc": ("cc-by-nc", LIMITED),
    "cc by nc nd": ("cc-by-nc-nd", LIMITED),
    "cc by nc sa": ("cc-by-nc-sa", LIMITED),
    "cc by nd": ("cc-by-nd", LIMITED),
    "cc by sa": ("cc-by-sa", WEAK),
    "creative commons attribution": ("cc-by", PERMISSIVE),
    "creative commons attribution noncommercial": ("cc-by-nc", LIMITED),
    "creative commons attribution sharealike": ("cc-by-sa", WEAK),
    "creative commons zero": ("cc0", FREE),
    "eclipse public license": ("epl", WEAK),
    "european union public licence": ("eupl", WEAK),
    "for non commercial use only": ("non-commercial", LIMITED),
    "free documentation license": ("gfdl", WEAK),
    "general public license": ("gpl", STRONG),
    "general public license version 2": ("gpl-2", STRONG),
    "general public license version 3": ("gpl-3", STRONG),
    "isc license": ("isc", PERMISSIVE),
    "lesser general public license": ("lgpl", WEAK),
    "library general public license": ("lgpl", WEAK),
    "mit license": ("mit", PERMISSIVE),
    "mozilla public license": ("mpl", WEAK),
    "permission is hereby granted free of charge": ("mit", PERMISSIVE),
    "redistribution and use in source and binary forms": ("bsd", PERMISSIVE),
    "released into the public domain": ("public-domain", FREE),
    "some rights reserved": ("some-rights", WEAK),
    "this is free and unencumbered software": ("unlicense", FREE),
    "zlib license": ("zlib", PERMISSIVE),
}

# Words of tags before an expression; whether one with nothing known after it is reported. Fixed values.
TAGS = {
    "license": False,
    "licence": False,
    "packagelicenseconcluded": True,
    "packagelicensedeclared": True,
    "spdx license identifier": True,
}

# Identifiers of licences by how restrictive they are, in lower case. Fixed values.
LICENCES = {
    FREE: "0bsd cc0-1.0 mit-0 pddl-1.0 unlicense wtfpl",
    PERMISSIVE: "afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 "
    "cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 curl ecl-2.0 icu isc libpng mit mit-cmu ms-pl ncsa odc-by-1.0 openssl php-3.01 postgresql psf-2.0 python-2.0 "
    "upl-1.0 w3c x11 zlib zpl-2.1",
    WEAK: "cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cpl-1.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.2 gfdl-1.3 "
    "lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mpl-1.1 mpl-2.0 ms-rl odbl-1.0 ofl-1.1",
    STRONG: "gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later osl-3.0 sleepycat",
    NETWORK: "agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later sspl-1.0",
    LIMITED: "busl-1.1 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0",
}
WEIGHTS = {name: weight for weight, names in LICENCES.items() for name in names.split()}

#: Higher binds closer.
BINDS = {"or": 1, "and": 2, "with": 3}

_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9]+(?:[.\-]+[A-Za-z0-9]+)*\+?)")
_COLON = re.compile(r"[ \t]*:")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(int(x) or 0x20 for x in WORD_BYTES)


# ------------------------------------------------------------------ expressions


def weight_of(name: str) -> float | None:
    """How restrictive the licence of an identifier is; None if it is not known. References to licences in a document are known, but not what they say."""
    if name.startswith(("licenseref-", "documentref-")):
        return UNRECOGNISED
    return WEIGHTS.get(name, WEIGHTS.get(name.removesuffix("+")))


def well_formed(text: str, at: int) -> list[str]:
    """The tokens of the longest licence expression that starts at ``at``, lower-cased; none if there is no known licence.

    It goes on for as long as licences that are known and operators take turns,
    and ends where the parentheses are even. Nothing after that is looked at.
    """
    tokens: list[str] = []
    depth = whole = 0
    wants = "licence"
    while found := _TOKEN.match(text, at):
        token = found[1].lower()
        at = found.end()
        if wants == "operator":
            if token == ")" and depth:
                depth -= 1
            elif token in ("and", "or") or token == "with" and tokens[-1] != ")" and tokens[-2:-1] != ["with"]:
                wants = "exception" if token == "with" else "licence"
            else:
                break
        elif wants == "exception":
            if "exception" not in token or token == ")":
                break
            wants = "operator"
        elif token == "(":
            depth += 1
        elif weight_of(token) is None:
            break
        else:
            wants = "operator"
        tokens.append(token)
        if wants == "operator" and not depth:
            whole = len(tokens)
    return tokens[:whole]


def postfix(tokens: list[str]) -> list[str]:
    """A well-formed expression with each operator after what it joins, by a yard that operators wait in."""
    out: list[str] = []
    yard: list[str] = []
    for token in tokens:
        if token == "(":
            yard.append(token)
        elif token == ")":
            while (waiting := yard.pop()) != "(":
                out.append(waiting)
        elif token in BINDS:
            while yard and yard[-1] != "(" and BINDS[yard[-1]] >= BINDS[token]:
                out.append(yard.pop())
            yard.append(token)
        else:
            out.append(token)
    return out + yard[::-1]


def evaluated(tokens: list[str]) -> tuple[set[str], float]:
    """The licences that a well-formed expression names, and how restrictive it is."""
    values: list[tuple[set[str], float, str]] = []
    for token in postfix(tokens):
        if token not in BINDS:
            values.append(({token}, weight_of(token) or 0.0, token))
            continue
        (more, right, name), (some, left, first) = values.pop(), values.pop()
        if token == "with":
            values.append(({f"{first}-with-{name}"}, min(left, WEAK), ""))
        else:
            values.append((some | more, (min if token == "or" else max)(left, right), ""))
    return values[0][:2]


# ------------------------------------------------------------------ texts


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in NOTICES.keys() | BASE.keys() | TAGS.keys():
        found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def places(text: str) -> tuple[int, list[tuple[str, int]]]:
    """How many words a text has, and all phrases and tags in it with the word each starts at, in the order of their ends."""
    words = text.encode().translate(_LOWER).split()
    said = f" {b' '.join(words).decode('latin-1')} "
    found: list[tuple[str, int]] = []
    search, passed, at = automaton().iter(""), 0, 0
    for start in range(0, len(said), PART):
        search.set(said[start : start + PART], False)
        for end, (phrase, length) in search:
            # the spaces up to here, the one before the text not counted, are the words that have ended
            passed += said.count(" ", at, end + 1)
            at = end + 1
            found.append((phrase, passed - 1 - length))
    return len(words), found


def scanned(text: str) -> dict:
    """The notices and expressions of a text."""
    n, found = places(text)
    notices = [(phrase, at) for phrase, at in found if phrase not in TAGS]
    tags = sorted((at, phrase) for phrase, at in found if phrase in TAGS)
    expressions = []
    if tags:
        ends = {at + phrase.count(" "): (at, phrase) for at, phrase in tags}
        for nth, word in enumerate(_WORD.finditer(text)):
            if nth in ends and (colon := _COLON.match(text, word.end())):
                at, phrase = ends[nth]
                tokens = well_formed(text, colon.end())
                if tokens:
                    licences, weight = evaluated(tokens)
                    expressions.append({"expression": " ".join(tokens), "licences": sorted(licences), "weight": weight, "word": at})
                elif TAGS[phrase]:
                    expressions.append({"expression": "", "licences": ["unrecognised"], "weight": UNRECOGNISED, "word": at})
    return {"n_words": n, "notices": [{"phrase": p, "word": at} for p, at in notices], "expressions": expressions}


_FOUND = "n_words long, notices array<struct<phrase string, word long>>, expressions array<struct<expression string, licences array<string>, weight double, word long>>"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("notices", pa.list_(pa.struct([("phrase", pa.string()), ("word", pa.int64())]))),
        (
            "expressions",
            pa.list_(pa.struct([("expression", pa.string()), ("licences", pa.list_(pa.string())), ("weight", pa.float64()), ("word", pa.int64())])),
        ),
    ]
)


def found_in(text: Column) -> Column:
    """What ``scanned`` finds in each text; a null one has no words."""

    @arrow_udf(_FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found: list[dict] = []
            for part in slices([pa.record_batch([batch], ["text"])], "text"):
                found += [scanned(x or "") for x in part.column(0).to_pylist()]
            yield pa.array(found, _ARROW)

    return find(text)


def _mapped(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, notices, expressions, base_labels, labels and score of each whole text.

    ``notices`` has every place of a phrase, ``expressions`` every tag with what
    follows it; both count words from 0. ``base_labels`` are those of the base
    phrases, ``labels`` all, each distinct and sorted. ``score`` is how
    restrictive the most restrictive of them is, 0 where there is none.

    A null text has no words. Rows that repeat are scanned each, an empty table
    gives an empty one, and a column already named as a new one is replaced.
    """
    found = "_".join(["found", *docs.columns])
    notices, expressions = F.col(found)["notices"], F.col(found)["expressions"]
    phrases = notices["phrase"]
    base = F.filter(phrases, lambda p: p.isin(*BASE))
    named, weights = _mapped({k: v for k, (v, _) in NOTICES.items()} | BASE), F.create_map(*[F.lit(x) for k, (_, w) in NOTICES.items() for x in (k, w)])
    names = F.concat(F.transform(phrases, lambda p: named[p]), F.flatten(expressions["licences"]))
    score = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform(phrases, lambda p: weights[p]), expressions["weight"]))
    new = {
        "n_words": F.col(found)["n_words"],
        "notices": notices,
        "expressions": expressions,
        "base_labels": F.array_sort(F.array_distinct(F.transform(base, lambda p: named[p]))),
        "labels": F.array_sort(F.array_distinct(names)),
        "score": score,
    }
    return docs.withColumn(found, found_in(F.col(text))).withColumns(new).drop(found)
