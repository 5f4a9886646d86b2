"""Web-style search strings as conditions on a column of words.

Words must all occur; ``"a phrase"`` must occur word by word; ``or`` between two
terms asks for one of them; ``-term`` must not occur.  A string without any
usable term matches nothing.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERM = re.compile(r'(-?)"([^"]*)"?|(\S+)')


def terms(text: str) -> list[list[tuple[bool, list[str]]]]:
    """All of these groups, of each any member: (negated, words)."""
    groups: list[list[tuple[bool, list[str]]]] = []
    joined = False
    for minus, phrase, bare in _TERM.findall(text):
        if bare.lower() == "or":
            joined = bool(groups)
            continue
        negated = bool(minus) or bare.startswith("-")
        words = re.findall(r"[^\W_]+", (phrase or bare.lstrip("-")).lower())
        if not words:
            continue
        if joined:
            groups[-1].append((negated, words))
        else:
            groups.append([(negated, words)])
        joined = False
    return groups


def matches(words: Column, text: str) -> Column:
    """Whether a passage's ``words`` (see ``functions.text.words``) match the search string."""
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def one(negated: bool, own: list[str]) -> Column:
        found = spaced.contains(" " + " ".join(own) + " ")
        return ~found if negated else found

    groups = [reduce(lambda a, b: a | b, (one(*t) for t in g)) for g in terms(text)]
    return reduce(lambda a, b: a & b, groups) if groups else F.lit(False)
