"""Searching a table: counts, first and best documents, term sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.tokens import term_frequency
from brindle.plans import dsl
from brindle.plans.compile import PostingsPlan, ScanPlan, check
from brindle.plans.query import Bool, MatchAll, MatchNone, Occur, Query, Range, Term, simplified
from brindle.plans.schema import Schema


@dataclass(frozen=True)
class Result:
    """total: all matching documents; docs: the ids asked for, in order; values: their sort values, if sorted by a field."""

    total: int
    docs: list[int]
    values: list | None = None
    early_terminated: bool = False

    def to_json(self) -> str:
        import json

        return json.dumps({"total": self.total, "docs": self.docs}, separators=(",", ":"))


class Searcher:
    """One snapshot of a table.

    strategy: "scan" evaluates predicates over the rows; "postings" joins ids
    from a table of terms, and needs one. Both find the same documents.
    """

    def __init__(self, docs: DataFrame, schema: Schema, id_col: str = "doc_id", strategy: str = "scan", postings: DataFrame | None = None, stats: DataFrame | None = None, bounds: DataFrame | None = None) -> None:
        """stats: documents of terms (terms.stats_of). bounds: least and greatest points (terms.point_stats). Counts read them where they can."""
        if strategy not in ("scan", "postings") or strategy == "postings" and postings is None:
            raise ValueError("strategy is scan, or postings with a table of terms")
        self.docs, self.schema, self.id_col, self.strategy = docs, schema, id_col, strategy
        self.postings, self.stats, self.bounds = postings, stats, bounds

    def max_doc(self) -> int:
        return self.docs.count()

    def matching(self, q: Query) -> DataFrame:
        """The matching rows with all their columns, to aggregate as one likes."""
        if self.strategy == "scan":
            return self.docs.where(ScanPlan(self.schema, self.docs.schema).column(q))
        return self.docs.join(self.ids(q), self.id_col, "left_semi")

    def ids(self, q: Query) -> DataFrame:
        if self.strategy == "postings":
            return self._postings_plan(q).ids(q).withColumnRenamed("id", self.id_col)
        return self.matching(q).select(self.id_col)

    def _postings_plan(self, q: Query) -> PostingsPlan:
        known = {}
        if self.stats is not None and (terms := _terms_of(q)):
            asked = F.struct("field", "term").isin([F.struct(F.lit(f).alias("field"), F.lit(t).alias("term")) for f, t in terms])
            known = {(r.field, r.term): r.df for r in self.stats.where(asked).collect()}  # a row a term of the query
        return PostingsPlan(self.schema, self.docs, self.postings, self.id_col, known)

    def count(self, q: Query) -> int:
        """All matching documents, from statistics where they say it."""
        check(q, self.schema)
        known = self.known_count(simplified(q))
        return self.ids(q).count() if known is None else known

    def known_count(self, q: Query) -> int | None:
        """The count of a simplified query that needs no look at the rows: all, none, a term, a range that holds all points or
        none of a field, and whatever lacks one of these."""
        if isinstance(q, MatchNone):
            return 0
        if isinstance(q, MatchAll):
            return self.max_doc()
        spec = self.schema.get(q.field) if isinstance(q, (Term, Range)) else None
        if isinstance(q, Term) and not (spec and spec.indexed) or isinstance(q, Range) and not (spec and spec.points):
            return 0
        if isinstance(q, Term) and self.stats is not None:
            got = self.stats.where((F.col("field") == q.field) & (F.col("term") == q.term)).select("df").first()
            return got.df if got else 0
        if isinstance(q, Range) and self.bounds is not None:
            got = self.bounds.where(F.col("field") == q.field).first()
            if got is None or got.docs == 0 or q.high < got.min or got.max < q.low:
                return 0
            return got.docs if q.low <= got.min and got.max <= q.high else None
        if isinstance(q, Bool) and len(q.clauses) == 1 and q.clauses[0][0] is Occur.MUST_NOT:
            lost = self.known_count(q.clauses[0][1])
            return None if lost is None else self.max_doc() - lost
        return None

    def top_docs(self, q: Query, n: int) -> Result:
        """The first n by id."""
        found = self.ids(q)
        docs = [r[0] for r in found.orderBy(self.id_col).limit(n).collect()] if n else []
        return Result(self.count(q), docs)

    def by_field(self, q: Query, field: str, descending: bool = False, missing_first: bool = False) -> DataFrame:
        """Matching ids with the field's value, in order; ties by id. A field without numeric doc values is missing everywhere."""
        spec = self.schema.get(field)
        value = F.col(field) if spec and spec.doc_values == "numeric" and field in self.docs.columns else F.lit(None).cast("long")
        rows = self.matching(q).select(F.col(self.id_col), value.alias("value"))
        col = F.col("value")
        order = (col.desc_nulls_first() if missing_first else col.desc_nulls_last()) if descending else (col.asc_nulls_first() if missing_first else col.asc_nulls_last())
        return rows.orderBy(order, self.id_col)

    def top_docs_by_field(self, q: Query, field: str, n: int) -> Result:
        """The n least by a numeric field; documents without a value come last. The total is exact, whatever the order of the files."""
        return self._top(q, self.by_field(q, field), n)

    def search(self, q: Query, sort: tuple[str, bool] | None = None, n: int = 10) -> Result:
        """sort: field and whether descending. A missing value counts as less than all others, in either direction."""
        if sort is None:
            return self.top_docs(q, n)
        field, descending = sort
        return self._top(q, self.by_field(q, field, descending, missing_first=not descending), n)

    def _top(self, q: Query, ordered: DataFrame, n: int) -> Result:
        rows = ordered.limit(n).collect() if n else []
        return Result(self.count(q), [r[0] for r in rows], [r[1] for r in rows])

    def search_json(self, request: str | bytes) -> str:
        """A JSON request to {"total": N, "docs": [...]}."""
        r = dsl.from_json(request)
        return self.search(r.query, (r.sort_field, r.descending) if r.sort_field else None, r.top_n).to_json()

    def freq_sum(self, q: Query) -> int:
        """Occurrences of a term; documents for a query of all. Other queries have no frequencies."""
        q = simplified(q)
        if isinstance(q, MatchAll):
            return self.max_doc()
        if not isinstance(q, Term):
            raise ValueError("only a term has a sum of frequencies")
        spec = self.schema.get(q.field)
        if not spec or not spec.indexed:
            return 0
        if not spec.tokenized:
            return self.count(q)
        return self.docs.agg(F.coalesce(F.sum(term_frequency(F.col(q.field), q.term)), F.lit(0))).first()[0]

    def doc_values(self, field: str) -> DataFrame:
        """Ids and values of a field's doc values, numeric, sorted or binary, where documents have one; nothing for other fields."""
        spec = self.schema.get(field)
        if not spec or not spec.doc_values or field not in self.docs.columns:
            return self.docs.select(self.id_col, F.lit(None).cast(spec.data_type() if spec else "string").alias("value")).where(F.lit(False))
        value = F.col(f"`{field}`").cast(spec.data_type())
        return self.docs.select(self.id_col, value.alias("value")).where(F.col("value").isNotNull())

    def document(self, doc_id: int) -> dict | None:
        """The stored fields of a document that it has."""
        stored = [f.name for f in self.schema.fields.values() if f.stored and f.name in self.docs.columns]
        row = self.docs.where(F.col(self.id_col) == doc_id).select(*stored).first()
        return None if row is None else {k: v for k, v in row.asDict().items() if v is not None}


def _terms_of(q: Query) -> set[tuple[str, str]]:
    from brindle.plans.query import And, Bool, Phrase

    if isinstance(q, Bool):
        return set().union(*(_terms_of(x) for _, x in q.clauses))
    if isinstance(q, Term):
        return {(q.field, q.term)}
    return {(q.field, t) for t in q.terms} if isinstance(q, (And, Phrase)) else set()
