"""From queries to DataFrames, in two ways that give the same documents.

The scan plan is one predicate over the rows. Only below a negation are nulls
made false, so that other predicates reach the Parquet reader as they are. The
postings plan joins sets of document ids from a table of terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import tokens
from brindle.plans.query import And, Bool, MatchAll, MatchNone, Occur, Or, Phrase, Prefix, Query, Range, Term, Terms, Wildcard, simplified
from brindle.plans.schema import FieldSpec, Schema


def check(q: Query, schema: Schema) -> None:
    """Raise for ranges that end before they begin, and for phrases in fields without positions."""
    if isinstance(q, Bool):
        for _, x in q.clauses:
            check(x, schema)
    elif isinstance(q, Range) and q.low > q.high:
        raise ValueError(f"{q.field}: the range ends before it begins: {q.low} > {q.high}")
    elif isinstance(q, Phrase) and len(q.terms) > 1:
        spec = schema.get(q.field)
        if spec and spec.indexed and not spec.positions:
            raise ValueError(f"{q.field}: a phrase needs positions")


class ScanPlan:
    """Predicates over rows of one table. Fields that hold arrays match if any value does."""

    def __init__(self, schema: Schema, struct: T.StructType) -> None:
        self.schema = schema
        self.types = {f.name: f.dataType for f in struct.fields}

    def column(self, q: Query) -> Column:
        check(q, self.schema)
        return self._column(simplified(q))

    def _field(self, name: str, able) -> FieldSpec | None:
        spec = self.schema.get(name)
        return spec if spec and able(spec) and name in self.types else None

    def _any_value(self, name: str, test) -> Column:
        col = F.col(f"`{name}`")
        return F.exists(col, test) if isinstance(self.types[name], T.ArrayType) else test(col)

    def _column(self, q: Query) -> Column:
        if isinstance(q, MatchAll):
            return F.lit(True)
        if isinstance(q, MatchNone):
            return F.lit(False)
        if isinstance(q, Bool):
            return self._bool(q)
        if isinstance(q, Range):
            spec = self._field(q.field, lambda s: s.points)
            return self._any_value(q.field, lambda v: v.between(q.low, q.high)) if spec else F.lit(False)
        spec = self._field(q.field, lambda s: s.indexed)
        if spec is None:
            return F.lit(False)
        if isinstance(q, And):  # the document has all terms, whichever values they are in
            return reduce(Column.__and__, (self._column(Term(q.field, t)) for t in q.terms))
        tests = _text_test(q) if spec.tokenized else _keyword_test(q)
        return self._any_value(q.field, tests)

    def _bool(self, q: Bool) -> Column:
        must, should, no = (q.of(o) for o in (Occur.MUST, Occur.SHOULD, Occur.MUST_NOT))
        if must:
            out = reduce(Column.__and__, map(self._column, must))
        elif should:
            out = reduce(Column.__or__, map(self._column, should))
        else:
            out = F.lit(True)
        for x in no:
            out = out & ~F.coalesce(self._column(x), F.lit(False))
        return out


def _text_test(q: Query):
    if isinstance(q, Term):
        return lambda v: tokens.has_term(v, q.term)
    if isinstance(q, (Or, Terms)):
        return lambda v: tokens.has_any_term(v, list(q.terms))
    if isinstance(q, Prefix):
        return lambda v: tokens.has_prefix(v, q.prefix)
    if isinstance(q, Wildcard):
        return lambda v: tokens.has_wildcard(v, q.pattern)
    if isinstance(q, Phrase):
        return lambda v: tokens.has_phrase(v, list(q.terms))
    raise TypeError(f"not a query of terms: {q!r}")


def _keyword_test(q: Query):
    """A keyword is one term whatever it holds."""
    if isinstance(q, Term):
        return lambda v: v == q.term
    if isinstance(q, (Or, Terms)):
        return lambda v: v.isin(list(q.terms))
    if isinstance(q, Prefix):
        return lambda v: v.startswith(q.prefix)
    if isinstance(q, Wildcard):
        if set(q.pattern) == {"*"}:
            return lambda v: v.isNotNull()
        return lambda v: v.like(tokens.like_pattern(q.pattern))
    return lambda v: F.lit(False)


class PostingsPlan:
    """Sets of ids from postings (field, term, id, freq, positions); numeric fields and the set of all ids come from the rows."""

    def __init__(self, schema: Schema, docs: DataFrame, postings: DataFrame, id_col: str = "doc_id", df_of: dict[tuple[str, str], int] | None = None) -> None:
        self.schema, self.docs, self.postings, self.id_col = schema, docs, postings, id_col
        self.df_of = df_of or {}
        self.scan = ScanPlan(schema, docs.schema)

    def ids(self, q: Query) -> DataFrame:
        """One column, id, each document once."""
        check(q, self.schema)
        return self._ids(simplified(q))

    def _terms(self, field: str, test: Column) -> DataFrame:
        return self.postings.where((F.col("field") == field) & test).select("id")

    def _ids(self, q: Query) -> DataFrame:
        every = self.docs.select(F.col(self.id_col).alias("id"))
        if isinstance(q, MatchAll):
            return every
        if isinstance(q, MatchNone):
            return every.where(F.lit(False))
        if isinstance(q, Range):
            return self.docs.where(self.scan.column(q)).select(F.col(self.id_col).alias("id"))
        if isinstance(q, Bool):
            return self._bool(q, every)
        if not (spec := self.schema.get(q.field)) or not spec.indexed:
            return every.where(F.lit(False))
        term = F.col("term")
        if isinstance(q, Term):
            return self._terms(q.field, term == q.term)
        if isinstance(q, And):
            return self._meet([self._terms(q.field, term == t) for t in self._rarest_first(q.field, q.terms)])
        if isinstance(q, (Or, Terms)):
            return self._terms(q.field, term.isin(list(q.terms))).distinct()
        if isinstance(q, Prefix):
            return self._terms(q.field, term.startswith(q.prefix)).distinct()
        if isinstance(q, Wildcard):
            test = term.isNotNull() if set(q.pattern) == {"*"} else term.like(tokens.like_pattern(q.pattern))
            return self._terms(q.field, test).distinct()
        return self._phrase(q)

    def _rarest_first(self, field: str, terms) -> list[str]:
        return sorted(terms, key=lambda t: self.df_of.get((field, t), 1 << 62))

    @staticmethod
    def _meet(sets: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), sets)

    def _phrase(self, q: Phrase) -> DataFrame:
        places = {}
        for k, t in enumerate(q.terms):
            rows = self.postings.where((F.col("field") == q.field) & (F.col("term") == t))
            places[k] = rows.select("id", F.explode("positions").alias("at")).select("id", (F.col("at") - k).alias("first"))
        order = sorted(places, key=lambda k: self.df_of.get((q.field, q.terms[k]), 1 << 62))
        return reduce(lambda a, b: a.join(b, ["id", "first"], "left_semi"), (places[k] for k in order)).select("id").distinct()

    def _bool(self, q: Bool, every: DataFrame) -> DataFrame:
        must, should, no = (q.of(o) for o in (Occur.MUST, Occur.SHOULD, Occur.MUST_NOT))
        if must:
            out = self._meet([self._ids(x) for x in sorted(must, key=self._weight)])
        elif should:
            out = reduce(DataFrame.unionByName, map(self._ids, should)).distinct()
        else:
            out = every
        for x in no:
            out = out.join(self._ids(x), "id", "left_anti")
        return out

    def _weight(self, q: Query) -> int:
        """How many documents a clause may have, as far as the statistics say."""
        if isinstance(q, Term):
            return self.df_of.get((q.field, q.term), 1 << 61)
        if isinstance(q, (And, Phrase)):
            return min(self.df_of.get((q.field, t), 1 << 61) for t in q.terms)
        return 1 << 62
