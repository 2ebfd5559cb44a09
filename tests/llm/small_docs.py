"""Small documents for the tests of this folder."""

from __future__ import annotations

import random

STRUCT = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, rk long, size long, id long"
SYLLABLES = {"en": ["th", "er", "on", "ing", "ea", "st", "and", "he"], "fr": ["eau", "è", "ou", "que", "ment", "é", "tre", "ai"], "de": ["ung", "sch", "ß", "keit", "ei", "ö", "ver", "pf"]}


def sentence(r: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    """Documents with further columns whose names operators use themselves."""
    return (doc_id, text, lang, source, None if text is None else len(text), 7.0, 3, 1, 2, 5)
