"""Label strings of series, and the hash that identifies a series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.shipping import ship

#: Fixed value: the mark around every label of a label string.
MARK = "$#$"


def labels_str(labels: Column) -> Column:
    """map<string,string> to its label string, keys in order; the mark alone for no labels."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit(MARK)))
    return F.concat(F.lit(MARK), F.coalesce(F.array_join(pairs, ""), F.lit("")))


def parse_labels(text: Column) -> Column:
    """A label string to a map; pieces without = are left out, the first = splits, the last of equal keys counts."""
    pieces = F.filter(F.split(text, r"\$#\$"), lambda p: p.contains("="))
    pairs = F.transform(pieces, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.instr(p, "=") + F.lit(1), F.length(p)).alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def label(text: Column, key: str) -> Column:
    """The value of one label of a label string; null without it."""
    return F.try_element_at(parse_labels(text), F.lit(key))


@F.pandas_udf(T.LongType())
def _series_hash(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    low = lambda s: xxhash.xxh64_intdigest(s.encode("utf-16-le"), 0) & 0xFFFFFFFF
    for names, labels in batches:
        whole = ((low(a) << 32) | low(b) for a, b in zip(names, labels, strict=True))
        yield pd.Series([h - (1 << 64) if h >> 63 else h for h in whole], dtype="int64")


def series_hash(name: Column, labels: Column) -> Column:
    """Low 32 bits of xxh64 (seed 0, UTF-16LE) of the name, then of the label string. For distinct series; not for grouping."""
    ship(SparkSession.active())
    return _series_hash(name, labels)
