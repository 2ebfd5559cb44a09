r"""Terms of a text as Spark columns.

A term is a run of anything but the five ASCII white-space characters blank,
tab, line feed, form feed and carriage return; terms are case-sensitive. Tests
for terms need no token array: `contains`, which reaches the Parquet reader,
passes over most texts without a rare term, and a regular expression that looks
at the neighbours of the literal stops at the first occurrence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = " \t\n\f\r"
_RUN = r"[ \t\n\f\r]+"
_TERM = r"[^ \t\n\f\r]"
#: Longer lists of terms are compared as arrays.
_MOST_ALTERNATIVES = 64


def pieces(text: Column) -> Column:
    """The terms of a text in order, and maybe an empty string before and after them; null for null."""
    return F.split(text, _RUN)


def tok(text: Column) -> Column:
    """The terms of a text in order; null for null."""
    return F.filter(pieces(text), lambda x: x != "")


def is_term(term: str) -> bool:
    """Whether the string can be a term at all."""
    return term != "" and not any(c in SEPARATORS for c in term)


def _starting(literal: str) -> str:
    """The literal where a term begins. The literal comes first, for the search to skip ahead."""
    return f"{re.escape(literal)}(?<!{_TERM}{re.escape(literal)})"


def _whole(term: str) -> str:
    return f"{_starting(term)}(?!{_TERM})"


def has_term(text: Column, term: str) -> Column:
    if not is_term(term):
        return F.lit(False)
    return text.contains(term) & text.rlike(_whole(term))


def has_any_term(text: Column, terms: list[str]) -> Column:
    terms = [t for t in terms if is_term(t)]
    if not terms:
        return F.lit(False)
    if len(terms) > _MOST_ALTERNATIVES:
        return F.arrays_overlap(tok(text), F.array(*map(F.lit, terms)))
    return text.rlike(f"(?<!{_TERM})(?:{'|'.join(map(re.escape, terms))})(?!{_TERM})")


def has_prefix(text: Column, prefix: str) -> Column:
    if prefix == "":
        return text.rlike(_TERM)
    if not is_term(prefix):
        return F.lit(False)
    return text.contains(prefix) & text.rlike(_starting(prefix))


def like_pattern(pattern: str) -> str:
    r"""A wildcard pattern (* any string, ? one code point, nothing escapes) for LIKE with \ as the escape."""
    named = {"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}
    return "".join(named.get(c, c) for c in pattern)


def has_wildcard(text: Column, pattern: str) -> Column:
    """Whether a whole term matches."""
    if any(c in SEPARATORS for c in pattern):
        return F.lit(False)
    body = "".join(f"{_TERM}*" if c == "*" else _TERM if c == "?" else re.escape(c) for c in pattern)
    found = text.rlike(rf"(?:^|[ \t\n\f\r])(?=[^ \t\n\f\r]){body}(?:[ \t\n\f\r]|\z)")
    longest = max(re.split(r"[*?]+", pattern), key=len)
    return text.contains(longest) & found if longest else found


def has_phrase(text: Column, terms: list[str]) -> Column:
    """Whether the terms follow each other; all terms are looked for before their order is."""
    if not terms or not all(map(is_term, terms)):
        return F.lit(False)
    found = text.contains(terms[0])
    for t in dict.fromkeys(terms[1:]):
        found = found & text.contains(t)
    first = _starting(terms[0])
    rest = "".join(f"{_RUN}{re.escape(t)}" for t in terms[1:])
    return found & text.rlike(f"{first}{rest}(?!{_TERM})")


def term_frequency(text: Column, term: str) -> Column:
    """How often the term occurs; 0 for null."""
    if not is_term(term):
        return F.lit(0).cast("long")
    n = F.regexp_count(text, F.lit(_whole(term))).cast("long")
    return F.when(text.contains(term), n).otherwise(F.lit(0).cast("long"))
