"""Named queries over the driver's tables, each with the SQL that says the same.

Every query runs over whole tables. A limit is part of a query only where it
asks for the first or best documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import hll, labels
from brindle.functions.shipping import shared_dir
from brindle.operators import metrics, terms
from brindle.operators.search import Searcher
from brindle.plans import dsl
from brindle.plans.query import And, Bool, MatchAll, Occur, Or, Phrase, Prefix, Query, Range, Term, Terms, Wildcard
from brindle.plans.schema import FieldSpec, Schema
from brindle.sources import jsonl, store

M, S, N = Occur.MUST, Occur.SHOULD, Occur.MUST_NOT
#: Documents with the labels that some of them have: quality is a field that most lack.
SCHEMA = Schema.of(
    FieldSpec.text("text", positions=True),
    FieldSpec.keyword("lang").with_doc_values("sorted"),
    FieldSpec.keyword("source").with_doc_values("sorted"),
    FieldSpec.long_point("n_chars").with_doc_values("numeric").with_stored(),
    FieldSpec.long_point("quality").with_doc_values("numeric"),
    FieldSpec.long_point("sizes"),
)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# --- SQL pieces ---
TOKS = r"list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '')"
D = f"(SELECT d.*, l.quality, {TOKS} AS toks FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def with_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with quality where it is known, and a field of several numbers."""
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    return documents(spark, sf_dir).join(known, "doc_id", "left")


def register(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _uses_quality(q: Query) -> bool:
    return any(_uses_quality(x) for _, x in q.clauses) if isinstance(q, Bool) else getattr(q, "field", "") == "quality"


def matching(name: str, q: Query, where: str) -> None:
    """A query and its documents' ids, by rows and by postings."""
    load = with_quality if _uses_quality(q) else documents
    sql = f"SELECT doc_id FROM {D} WHERE {where}"
    register(name, sql)(lambda spark, sf_dir: Searcher(load(spark, sf_dir), SCHEMA).ids(q))


def by_postings(name: str, q: Query, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = documents(spark, sf_dir)
        return Searcher(docs, SCHEMA, strategy="postings", postings=terms.postings(docs, SCHEMA)).ids(q)

    register(name, f"SELECT doc_id FROM {D} WHERE {where}")(run)


def has(term: str) -> str:
    return f"list_contains(toks, '{term}')"


def like(pattern: str) -> str:
    return f"len(list_filter(toks, lambda x: x LIKE '{pattern}' ESCAPE '\\')) > 0"


def phrase(*words: str) -> str:
    same = " AND ".join(f"toks[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"len(list_filter(range(1, len(toks) + 1), lambda i: coalesce({same}, false))) > 0"


def both(q1: str, q2: str) -> str:
    return f"({q1}) AND ({q2})"


def no(q: str) -> str:
    return f"NOT coalesce({q}, false)"


# --- leaves ---
register("match_all_count", "SELECT count(*) AS n FROM documents")(lambda s, d: Searcher(documents(s, d), SCHEMA).ids(MatchAll()).agg(F.count("*").alias("n")))
LONG = ("the", "and", "of", "is", "in", "to", "that", "it", "was", "for", "on", "are", "as", "with", "his", "they", "at", "be", "this", "from")
LEAVES: dict[str, tuple[Query, str]] = {
    "term_keyword": (Term("lang", "en"), "lang = 'en'"),
    "term_text": (Term("text", "the"), has("the")),
    "term_missing": (Term("text", "nosuchterm"), has("nosuchterm")),
    "term_unknown_field": (Term("nofield", "x"), "false"),
    "term_not_indexed": (Term("n_chars", "5"), "false"),
    "and_terms": (And("text", ("the", "of")), both(has("the"), has("of"))),
    "and_dup_term": (And("text", ("the", "the")), has("the")),
    "and_missing": (And("text", ("the", "nosuchterm")), "false"),
    "or_terms": (Or("text", ("une", "nicht")), f"{has('une')} OR {has('nicht')}"),
    "or_with_missing": (Or("text", ("une", "nosuchterm")), has("une")),
    "terms_in_small": (Terms("lang", ("de", "fr")), "lang IN ('de', 'fr')"),
    "terms_in_large": (Terms("text", LONG), "list_has_any(toks, [" + ", ".join(f"'{t}'" for t in LONG) + "])"),
    "terms_in_empty": (Terms("text", ()), "false"),
    "prefix_text": (Prefix("text", "tho"), like("tho%")),
    "prefix_keyword": (Prefix("source", "src1"), "starts_with(source, 'src1')"),
    "prefix_empty": (Prefix("text", ""), "len(toks) > 0"),
    "wildcard_exact": (Wildcard("text", "the"), has("the")),
    "wildcard_pure_prefix": (Wildcard("text", "then*"), like("then%")),
    "wildcard_prefix_filter": (Wildcard("text", "th*ing"), like("th%ing")),
    "wildcard_full_scan": (Wildcard("text", "*tionly"), like("%tionly")),
    "wildcard_question": (Wildcard("text", "th?t"), like("th_t")),
    "wildcard_non_ascii": (Wildcard("text", "d?s*é"), like("d_s%é")),
    "wildcard_percent": (Wildcard("text", "*%%%"), like(r"%\%\%\%")),
    "wildcard_keyword": (Wildcard("source", "src?"), "source LIKE 'src_'"),
    "phrase2": (Phrase("text", ("of", "the")), phrase("of", "the")),
    "phrase3": (Phrase("text", ("and", "of", "the")), phrase("and", "of", "the")),
    "phrase_repeat": (Phrase("text", ("the", "the")), phrase("the", "the")),
    "phrase_reversed": (Phrase("text", ("the", "of")), phrase("the", "of")),
    "phrase_single": (Phrase("text", ("une",)), has("une")),
    "phrase_missing": (Phrase("text", ("the", "nosuchterm")), "false"),
    "range_mid": (Range("n_chars", 500, 2000), "n_chars BETWEEN 500 AND 2000"),
    "range_point": (Range("n_chars", 1000, 1000), "n_chars = 1000"),
    "range_all": (Range("n_chars", -(1 << 63), (1 << 63) - 1), "n_chars IS NOT NULL"),
    "range_disjoint": (Range("n_chars", -10, -1), "false"),
    "range_sparse": (Range("quality", 1, 1), "quality = 1"),
    "range_not_points": (Range("text", 0, 5), "false"),
}
for _name, (_q, _where) in LEAVES.items():
    matching(_name, _q, _where)


@register("range_multivalued", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 900 AND 1100 OR doc_id BETWEEN 900 AND 1100")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("sizes", F.array("n_chars", "doc_id"))
    return Searcher(docs, SCHEMA).ids(Range("sizes", 900, 1100))


# --- Boolean queries ---
DE, FR, EN = Term("lang", "de"), Term("lang", "fr"), Term("lang", "en")
T = lambda w: Term("text", w)
BOOLS: dict[str, tuple[Query, str]] = {
    "bool_must": (Bool(((M, EN), (M, T("with")))), both("lang = 'en'", has("with"))),
    "bool_should": (Bool(((S, DE), (S, T("une")))), f"lang = 'de' OR {has('une')}"),
    "bool_must_should": (Bool(((M, EN), (S, T("with")))), "lang = 'en'"),
    "bool_must_not": (Bool(((M, EN), (N, T("with")))), both("lang = 'en'", no(has("with")))),
    "bool_only_not": (Bool(((N, EN), (N, DE))), "lang NOT IN ('en', 'de')"),
    "bool_not_missing": (Bool(((N, T("nosuchterm")),)), "true"),
    "bool_should_absent_not": (Bool(((S, T("nosuchterm")), (N, EN))), "false"),
    "bool_empty": (Bool(()), "false"),
    "bool_nested3": (Bool(((M, Bool(((S, DE), (S, Bool(((M, FR), (N, T("une")))))))), (N, Bool(((M, T("die")), (M, T("der"))))))), both(f"lang = 'de' OR (lang = 'fr' AND {no(has('une'))})", no(both(has("die"), has("der"))))),
    "bool_cross_field": (Bool(((M, EN), (M, Term("source", "src3")), (M, T("the")))), f"lang = 'en' AND source = 'src3' AND {has('the')}"),
    "bool_with_range": (Bool(((M, EN), (M, Range("n_chars", 0, 1500)), (N, Range("n_chars", 500, 700)))), "lang = 'en' AND n_chars BETWEEN 0 AND 1500 AND NOT n_chars BETWEEN 500 AND 700"),
    "bool_with_phrase": (Bool(((M, Phrase("text", ("of", "the"))), (N, Prefix("text", "thr")))), both(phrase("of", "the"), no(like("thr%")))),
    "bool_with_multiterm": (Bool(((S, Wildcard("text", "*lichkeit*")), (S, Prefix("text", "quel")), (N, Terms("source", ("src1", "src2"))))), f"({like('%lichkeit%')} OR {like('quel%')}) AND source NOT IN ('src1', 'src2')"),
    "bool_sparse_not": (Bool(((N, Range("quality", 1, 1)),)), "quality IS DISTINCT FROM 1"),
    "bool_double_not": (Bool(((N, Bool(((N, Range("quality", 1, 1)),))),)), "quality = 1"),
}
for _name, (_q, _where) in BOOLS.items():
    matching(_name, _q, _where)
for _name in ("term_text", "term_keyword", "and_terms", "or_terms", "terms_in_large", "prefix_text", "prefix_empty", "wildcard_prefix_filter", "wildcard_question", "phrase2", "phrase3", "phrase_repeat", "range_mid"):
    by_postings(f"postings_{_name}", *LEAVES[_name])
for _name in ("bool_must", "bool_should", "bool_must_not", "bool_only_not", "bool_nested3", "bool_with_range", "bool_with_phrase"):
    by_postings(f"postings_{_name}", *BOOLS[_name])


# --- collectors ---
FLAGSHIP = Bool(((M, EN), (M, T("the")), (N, Prefix("text", "thr"))))


@register("flagship_search", f"SELECT doc_id, n_chars FROM {D} WHERE lang = 'en' AND {has('the')} AND {no(like('thr%'))} ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10")
def _(spark, sf_dir):
    return Searcher(documents(spark, sf_dir), SCHEMA).by_field(FLAGSHIP, "n_chars", descending=True).limit(10).withColumnRenamed("value", "n_chars")


@register("top_docs_indexorder", f"SELECT doc_id FROM {D} WHERE {has('the')} ORDER BY doc_id LIMIT 20")
def _(spark, sf_dir):
    return Searcher(documents(spark, sf_dir), SCHEMA).ids(T("the")).orderBy("doc_id").limit(20)


def _sorted(name: str, direction: str, descending: bool, missing_first: bool, field: str = "quality") -> None:
    sql = f"SELECT doc_id, {field}::BIGINT AS value FROM {D} WHERE lang = 'en' ORDER BY {field} {direction}, doc_id LIMIT 200"
    register(name, sql)(lambda s, d: Searcher(with_quality(s, d), SCHEMA).by_field(EN, field, descending, missing_first).limit(200))


_sorted("top_by_field_asc", "ASC NULLS LAST", False, False)
_sorted("search_sort_desc", "DESC NULLS LAST", True, False)
_sorted("search_sort_asc_missing_first", "ASC NULLS FIRST", False, True)
_sorted("search_sort_n_chars_desc", "DESC NULLS LAST", True, False, "n_chars")


@register("search_totals", f"SELECT count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE {has('the')}) AS the, count(*) FILTER (WHERE {phrase('of', 'the')}) AS of_the FROM {D}")
def _(spark, sf_dir):
    from brindle.plans.compile import ScanPlan

    docs = documents(spark, sf_dir)
    plan = ScanPlan(SCHEMA, docs.schema)
    return docs.agg(*(F.count_if(plan.column(q)).alias(n) for n, q in (("en", EN), ("the", T("the")), ("of_the", Phrase("text", ("of", "the"))))))


@register("freq_sum", f"SELECT sum(len(list_filter(toks, lambda x: x = 'the')))::BIGINT AS n FROM {D}")
def _(spark, sf_dir):
    from brindle.functions.tokens import term_frequency

    return documents(spark, sf_dir).agg(F.sum(term_frequency(F.col("text"), "the")).alias("n"))


@register("freq_sum_keyword", "SELECT count(*) AS n FROM documents WHERE lang = 'de'")
def _(spark, sf_dir):
    return Searcher(documents(spark, sf_dir), SCHEMA).ids(DE).agg(F.count("*").alias("n"))


_UNNESTED = f"(SELECT doc_id, unnest(toks) AS term FROM {D})"


@register("term_stats", f"SELECT 'text' AS field, term, count(DISTINCT doc_id) AS df, count(*) AS ttf FROM {_UNNESTED} GROUP BY term")
def _(spark, sf_dir):
    return terms.term_stats(documents(spark, sf_dir), SCHEMA, only=["text"])


@register("term_dictionary_prefix", f"SELECT term, count(DISTINCT doc_id) AS df FROM {_UNNESTED} WHERE starts_with(term, 'tho') GROUP BY term")
def _(spark, sf_dir):
    return terms.term_stats(documents(spark, sf_dir), SCHEMA, only=["text"]).where(F.col("term").startswith("tho")).select("term", "df")


@register("dictionary_from", "SELECT term, count(*) AS df FROM (SELECT lang AS term FROM documents) WHERE term >= 'en' GROUP BY term")
def _(spark, sf_dir):
    return terms.dictionary(terms.term_stats(documents(spark, sf_dir), SCHEMA, only=["lang"]), "lang", "en").select("term", "df")


@register("postings_table", f"SELECT 'text' AS field, term, doc_id AS id, count(*) AS freq, list(place ORDER BY place)::BIGINT[] AS positions FROM (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS place FROM {D}) WHERE starts_with(term, 'the') GROUP BY term, doc_id")
def _(spark, sf_dir):
    return terms.postings(documents(spark, sf_dir), SCHEMA, only=["text"]).where(F.col("term").startswith("the"))


@register("postings_all_terms", f"SELECT 'text' AS field, term, doc_id AS id, count(*) AS freq, list(place ORDER BY place)::BIGINT[] AS positions FROM (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS place FROM {D}) GROUP BY term, doc_id")
def _(spark, sf_dir):
    return terms.postings(documents(spark, sf_dir), SCHEMA, only=["text"])


@register("dv_cardinality", f"SELECT count(quality) AS quality, count(n_chars) AS n_chars, count(lang) AS lang FROM {D}")
def _(spark, sf_dir):
    return with_quality(spark, sf_dir).agg(*(F.count(c).alias(c) for c in ("quality", "n_chars", "lang")))


@register("sorted_dict", "SELECT value, row_number() OVER (ORDER BY value) - 1 AS ord FROM (SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL)")
def _(spark, sf_dir):
    return terms.sorted_dictionary(documents(spark, sf_dir), "source", ranges=4)


@register("numeric_values", f"SELECT doc_id, quality::BIGINT AS quality FROM {D} WHERE quality IS NOT NULL")
def _(spark, sf_dir):
    return Searcher(with_quality(spark, sf_dir), SCHEMA).doc_values("quality").select("doc_id", F.col("value").alias("quality"))


@register("binary_values", "SELECT doc_id, hex(encode(source)) AS value FROM documents WHERE source IS NOT NULL")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("source").cast("binary").alias("raw"))
    return Searcher(docs, Schema.of(FieldSpec.binary_dv("raw"))).doc_values("raw").select("doc_id", F.hex("value").alias("value"))


@register("sorted_values", "SELECT doc_id, source AS value FROM documents WHERE source IS NOT NULL")
def _(spark, sf_dir):
    return Searcher(documents(spark, sf_dir), SCHEMA).doc_values("source")


#: Documents with repeated fields: a keyword of two values, and the lines of the text.
REPEATED = Schema.of(FieldSpec.keyword("tags"), FieldSpec.text("lines", positions=True))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array("lang", "source").alias("tags"), F.split("text", "\n").alias("lines"))


def _repeated_postings(spark, sf_dir, q: Query) -> DataFrame:
    docs = repeated(spark, sf_dir)
    return Searcher(docs, REPEATED, strategy="postings", postings=terms.postings(docs, REPEATED)).ids(q)


for _name, _q, _where in (
    ("and_repeated_keyword", And("tags", ("en", "src1")), "lang = 'en' AND source = 'src1'"),
    ("and_repeated_text", And("lines", ("of", "the", "with")), both(both(has("of"), has("the")), has("with"))),
    ("not_and_repeated_text", ~And("lines", ("of", "the")), no(both(has("of"), has("the")))),
):
    register(_name, f"SELECT doc_id FROM {D} WHERE {_where}")(lambda s, d, q=_q: Searcher(repeated(s, d), REPEATED).ids(q))
    register(f"postings_{_name}", f"SELECT doc_id FROM {D} WHERE {_where}")(lambda s, d, q=_q: _repeated_postings(s, d, q).withColumnRenamed("id", "doc_id"))


@register("known_counts", f"SELECT (SELECT count(*) FROM documents) AS every, (SELECT count(*) FROM documents WHERE lang = 'en') AS term, (SELECT count(n_chars) FROM documents) AS whole_range, 0 AS no_range, (SELECT count(*) FROM documents WHERE lang <> 'en') AS lacking")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    s = Searcher(docs, SCHEMA, stats=terms.term_stats(docs, SCHEMA, only=["lang"]), bounds=terms.point_stats(docs, SCHEMA))
    asked = {"every": MatchAll(), "term": EN, "whole_range": Range("n_chars", -1, 1 << 40), "no_range": Range("n_chars", -9, -1), "lacking": ~EN}
    return spark.createDataFrame([[s.known_count(q) for q in asked.values()]], ", ".join(f"{k} long" for k in asked))


@register("point_bounds", "SELECT min(n_chars) AS min, max(n_chars) AS max, count(n_chars) AS docs FROM documents")
def _(spark, sf_dir):
    return terms.bounds(documents(spark, sf_dir), "n_chars")


@register("stored_fields", "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id = 7")
def _(spark, sf_dir):
    return documents(spark, sf_dir).where(F.col("doc_id") == 7).select("doc_id", "text", "lang", "source", "n_chars")


# --- query languages ---
_JSON = '{"query": {"type": "bool", "clauses": [{"occur": "must", "query": {"type": "term", "field": "lang", "value": "en"}}, {"occur": "must", "query": {"type": "phrase", "field": "text", "terms": ["of", "the"]}}, {"occur": "must_not", "query": {"type": "prefix", "field": "source", "value": "src1"}}, {"occur": "must", "query": {"type": "range", "field": "n_chars", "low": 100, "high": 100000}}]}, "sort": {"field": "n_chars", "order": "asc"}, "top_n": 15}'


@register("json_dsl_search", f"SELECT doc_id, n_chars AS value FROM {D} WHERE lang = 'en' AND {phrase('of', 'the')} AND NOT starts_with(source, 'src1') AND n_chars BETWEEN 100 AND 100000 ORDER BY n_chars NULLS FIRST, doc_id LIMIT 15")
def _(spark, sf_dir):
    r = dsl.from_json(_JSON)
    return Searcher(documents(spark, sf_dir), SCHEMA).by_field(r.query, r.sort_field, r.descending, not r.descending).limit(r.top_n)


@register("json_result", "SELECT '{\"total\":' || count(*) || ',\"docs\":[' || string_agg(CASE WHEN n <= 10 THEN doc_id END, ',' ORDER BY n) || ']}' AS result FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE lang = 'fr')")
def _(spark, sf_dir):
    got = Searcher(documents(spark, sf_dir), SCHEMA).search_json('{"query": {"type": "term", "field": "lang", "value": "fr"}}')
    return spark.createDataFrame([(got,)], "result string")


@register("sexpr_search", f"SELECT doc_id FROM {D} WHERE (lang = 'de' OR {like('quel%')}) AND {no(has('une'))} AND n_chars BETWEEN 0 AND 5000")
def _(spark, sf_dir):
    q = dsl.from_sexpr("(BOOL (MUST (OR (TERM lang de) (PREFIX text quel))) (NOT (TERM text une)) (MUST (RANGE n_chars 0 5000)))")
    return Searcher(documents(spark, sf_dir), SCHEMA).ids(q)


_FILE = ["TERM\ttext\tthe\t9", "AND\thigh\tthe\tof", "PREFIX\ttext\ttho", "WILDCARD\ttext\tth?t", "TERMS\tlang\tde,fr", "PHRASE\ttext\tof\tthe", "RANGE\tn_chars\t500\t2000", "BOOL\tx\t(NOT (TERM lang en))"]
_FILE_WHERE = [has("the"), both(has("the"), has("of")), like("tho%"), like("th_t"), "lang IN ('de', 'fr')", phrase("of", "the"), "n_chars BETWEEN 500 AND 2000", "lang <> 'en'"]


@register("query_file", f"SELECT " + ", ".join(f"count(*) FILTER (WHERE {w}) AS q{k}" for k, w in enumerate(_FILE_WHERE)) + f" FROM {D}")
def _(spark, sf_dir):
    from brindle.plans.compile import ScanPlan

    docs = documents(spark, sf_dir)
    plan = ScanPlan(SCHEMA, docs.schema)
    return docs.agg(*(F.count_if(plan.column(q)).alias(f"q{k}") for k, (_, q) in enumerate(dsl.from_query_file(_FILE, "text"))))


# --- JSON ingest ---
def _props(spark, sf_dir, spec: str):
    lines = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return jsonl.bind(lines, Schema.parse(spec), order=F.col("event_id"), keep=("event_id",))[0]


register("json_bind_strict", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")(lambda s, d: _props(s, d, "k:longpoint+numericdv"))
register("json_bind_dynamic", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")(lambda s, d: _props(s, d, "$policy=dynamic"))
register("json_bind_alias", "SELECT event_id, json_extract_string(props, '$.k') AS name FROM events WHERE json_valid(props)")(lambda s, d: _props(s, d, "name:keyword@k"))
register("json_bind_stored_only", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_valid(props)")(lambda s, d: _props(s, d, "$policy=stored-only"))


@register("json_bind_bad_lines", "SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS ok, count(*) FILTER (WHERE event_id % 3 <> 0) AS failed FROM events")
def _(spark, sf_dir):
    bad = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("{"), "props")).otherwise(F.lit("[1, 2]"))
    return jsonl.counts(table(spark, sf_dir, "events").select(bad.alias("value")))


# --- store ---
def _folder(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("index_sorted_ids", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) - 1 AS sorted_doc_id FROM documents")
def _(spark, sf_dir):
    return store.sorted_ids(documents(spark, sf_dir), ("n_chars", True, False), ranges=16)


@register("index_sorted_ids_missing_first", f"SELECT doc_id, row_number() OVER (ORDER BY quality NULLS FIRST, doc_id) - 1 AS sorted_doc_id FROM {D}")
def _(spark, sf_dir):
    return store.sorted_ids(with_quality(spark, sf_dir), ("quality", False, True), ranges=4)


@register("index_sorted_ids_string", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS sorted_doc_id FROM documents")
def _(spark, sf_dir):
    return store.sorted_ids(documents(spark, sf_dir), ("source", False, False), ranges=8)


@register("force_merge_roundtrip", "SELECT * FROM documents")
def _(spark, sf_dir):
    docs, path = documents(spark, sf_dir), _folder(spark, "merge")
    writer = store.Writer(spark, path, docs.schema, sort=("n_chars", False, False))
    for k in range(2):
        writer.add(docs.where(F.col("doc_id") % 2 == k))
        writer.commit()
    writer.force_merge(8)
    return store.open_snapshot(spark, path)


@register("snapshot_versions", "SELECT v, count(*) AS n FROM documents, (SELECT unnest([1, 2]) AS v) WHERE doc_id % 2 < v GROUP BY v")
def _(spark, sf_dir):
    docs, path = documents(spark, sf_dir), _folder(spark, "versions")
    writer = store.Writer(spark, path, docs.schema)
    for k in range(2):
        writer.add(docs.where(F.col("doc_id") % 2 == k))
        writer.commit()
    parts = [store.open_snapshot(spark, path, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("v"), "n") for v in (1, 2)]
    return parts[0].unionByName(parts[1])


@register("live_search", f"SELECT doc_id FROM {D} WHERE lang = 'en' AND {has('with')}")
def _(spark, sf_dir):
    from brindle.streaming import live

    docs, path = documents(spark, sf_dir), _folder(spark, "live")
    writer = store.Writer(spark, path, docs.schema)
    writer.add(docs.where("doc_id % 10 <> 0"))
    writer.commit()
    return live.live_searcher(path, docs.where("doc_id % 10 = 0"), SCHEMA).ids(And("text", ("with",)) & EN)


@register("stream_ingest", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, sf_dir):
    from brindle.streaming import live

    docs, path = documents(spark, sf_dir), _folder(spark, "stream")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*")
    live.ingest(stream, f"{path}/table", f"{path}/progress").awaitTermination()
    return store.open_snapshot(spark, f"{path}/table").groupBy("lang").agg(F.count("*").alias("n"))


@register("text_source", r"SELECT trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS message, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' GROUP BY message")
def _(spark, sf_dir):
    from brindle.sources import text_files

    path = _folder(spark, "lines")
    documents(spark, sf_dir).where("text is not null").select("text").write.text(path)
    return text_files.numbered(text_files.read(spark, path)).groupBy("message").agg(F.count("*").alias("n"))


@register("documents_api", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS doc_id, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def _(spark, sf_dir):
    from brindle.sources.documents import Documents

    schema = Schema.of(FieldSpec.keyword("name"), FieldSpec.long_point("region"))
    path = _folder(spark, "documents")
    docs = Documents(store.Writer(spark, path, spark.createDataFrame([], "doc_id long, name string, region long").schema), schema, max_buffered=10)
    for row in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows, one call each: the feature
        docs.begin()
        docs.add("name", row.n_name)
        docs.add("region", int(row.n_regionkey))
        docs.end()
    docs.commit()
    return store.open_snapshot(spark, path)


@register("writer_refusals", "SELECT unnest(['existing table', 'other schema', 'rival commit']) AS refused")
def _(spark, sf_dir):
    docs, path, refused = table(spark, sf_dir, "region"), _folder(spark, "refusals"), []
    first, rival = store.Writer(spark, path, docs.schema), store.Writer(spark, path, docs.schema)
    first.add(docs)
    rival.add(docs)
    first.commit()
    for name, attempt in (("existing table", lambda: store.Writer(spark, path, docs.schema)), ("other schema", lambda: store.Writer(spark, path, docs.drop("r_name").schema, append=True)), ("rival commit", rival.commit)):
        try:
            attempt()
        except (FileExistsError, ValueError):
            refused.append((name,))
    return spark.createDataFrame(refused, "refused string")


@register("command_line_search", "SELECT '{\"total\":' || count(*) || ',\"docs\":[' || string_agg(CASE WHEN n <= 5 THEN doc_id END, ',' ORDER BY n) || ']}' AS result FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE lang = 'de')")
def _(spark, sf_dir):
    import contextlib
    import io

    from brindle.__main__ import main

    docs, path = documents(spark, sf_dir), _folder(spark, "searched")
    writer = store.Writer(spark, path, docs.schema)
    writer.add(docs)
    writer.commit()
    with contextlib.redirect_stdout(io.StringIO()) as out:
        main(["search", path, "(TERM lang de)", "--schema", "text:text+positions,lang:keyword", "--top", "5"])
    return spark.createDataFrame([(out.getvalue().strip(),)], "result string")


# --- metrics ---
def event_points(spark, sf_dir, shards: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts_ms", F.unix_millis(F.to_timestamp("ts")))
    if not shards:
        return metrics.points(events, F.col("event_type"), F.create_map(F.lit("user"), F.col("user_id").cast("string")), F.col("ts_ms"), F.col("value"))
    one = events.where("event_id % 2 = 0").withColumn("shard", F.lit(0))
    two = events.where("event_id % 2 = 1 or event_id % 3 = 0").withColumn("shard", F.lit(1)).withColumn("value", F.col("value") + 1000)
    return metrics.points(one.unionByName(two), F.col("event_type"), F.create_map(F.lit("user"), F.col("user_id").cast("string")), F.col("ts_ms"), F.col("value"), F.col("shard"), F.col("event_id"))


P = "(SELECT event_type AS metric_name, '$#$user=' || user_id || '$#$' AS labels, (epoch_us(ts) // 1000) AS ts_ms, value FROM events)"
P2 = "(SELECT metric_name, labels, ts_ms, value FROM (SELECT *, row_number() OVER (PARTITION BY metric_name, labels, ts_ms ORDER BY shard, event_id) AS n FROM (SELECT event_type AS metric_name, '$#$user=' || user_id || '$#$' AS labels, (epoch_us(ts) // 1000) AS ts_ms, value, 0 AS shard, event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, '$#$user=' || user_id || '$#$', (epoch_us(ts) // 1000), value + 1000, 1, event_id FROM events WHERE event_id % 2 = 1 OR event_id % 3 = 0)) WHERE n = 1)"


def _buckets(src: str, gran: int) -> str:
    return f"(SELECT metric_name, labels, {gran}::BIGINT AS gran_ms, ts_ms - ts_ms % {gran} AS bucket_time, count(*) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max, CASE WHEN arg_max(value, ts_ms) < arg_min(value, ts_ms) THEN arg_max(value, ts_ms) ELSE arg_max(value, ts_ms) - arg_min(value, ts_ms) END AS delta, max(ts_ms) AS point_max FROM {src} GROUP BY metric_name, labels, ts_ms - ts_ms % {gran})"


_ROUNDED = "SELECT metric_name, labels, gran_ms, bucket_time, count, round(sum, 6) AS sum, min, max, round(delta, 6) AS delta, point_max FROM "


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("sum", F.round("sum", 6)).withColumn("delta", F.round("delta", 6))


register("labels_str", "SELECT DISTINCT '$#$type=' || event_type || '$#$user=' || user_id || '$#$' AS labels FROM events")(lambda s, d: table(s, d, "events").select(labels.labels_str(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))).alias("labels")).distinct())
register("labels_parse", "SELECT DISTINCT user_id::VARCHAR AS user, event_type AS type FROM events")(lambda s, d: table(s, d, "events").select(F.concat(F.lit("$#$type="), "event_type", F.lit("$#$user="), F.col("user_id").cast("string"), F.lit("$#$")).alias("labels")).distinct().select(labels.label(F.col("labels"), "user").alias("user"), labels.label(F.col("labels"), "type").alias("type")))
register("metric_query_by_label", f"SELECT ts_ms, value FROM {P} WHERE metric_name = 'click' AND labels = '$#$user=5$#$'")(lambda s, d: event_points(s, d).where((F.col("metric_name") == "click") & (labels.label(F.col("labels"), "user") == "5")).select("ts_ms", "value"))
register("series_pack", f"SELECT metric_name, labels, min(ts_ms) AS time_min, max(ts_ms) AS time_max, count(*) AS sample_count, list(ts_ms ORDER BY ts_ms) AS times, list(value ORDER BY ts_ms, value) AS samples FROM {P} GROUP BY metric_name, labels, ts_ms - ts_ms % 86400000")(
    lambda s, d: metrics.packed(event_points(s, d)).select("metric_name", "labels", "time_min", "time_max", "sample_count", F.col("samples.t").alias("times"), F.col("samples.v").alias("samples"))
)
register("series_stats", f"SELECT metric_name, labels, min(ts_ms) AS time_min, max(ts_ms) AS time_max, count(*) AS sample_count FROM {P} GROUP BY metric_name, labels")(lambda s, d: metrics.series_stats(event_points(s, d)))


@register("shard_metadata", f"SELECT count(*) AS total_samples, count(DISTINCT metric_name || labels) AS series_count, min(ts_ms) AS min_time, max(ts_ms) AS max_time FROM {P}")
def _(spark, sf_dir):
    told = metrics.ShardMetadata("org", "2026-01-01", 1).with_points(event_points(spark, sf_dir))
    return spark.createDataFrame([(told.total_samples, told.series_count, told.min_time, told.max_time)], "total_samples long, series_count long, min_time long, max_time long")


def _shard(spark, sf_dir, **limits):
    """A shard that the events were written to in two writes, each flushed."""
    from brindle.operators import shards

    shard = shards.Shard(spark, _folder(spark, "shard"), **limits)
    pts = event_points(spark, sf_dir)
    for part in (pts.where("pmod(ts_ms, 2) = 0"), pts.where("pmod(ts_ms, 2) = 1")):
        shard.write_points(part)
        if not limits:
            shard.flush()
    return shard


@register("shard_points", f"SELECT metric_name, labels, ts_ms, value FROM {P}")
def _(spark, sf_dir):
    from brindle.operators import shards

    shard = _shard(spark, sf_dir)
    shard.commit()
    return shards.read(spark, shard.path).select("metric_name", "labels", "ts_ms", "value")


@register("shard_auto_flush", f"SELECT (pmod_ts)::INTEGER AS part, count(*) AS n FROM (SELECT ts_ms % 2 AS pmod_ts FROM {P}) GROUP BY pmod_ts")
def _(spark, sf_dir):
    return _shard(spark, sf_dir, max_total_points=100).points().groupBy("part").agg(F.count("*").alias("n"))


@register("shard_downsample_1h", _ROUNDED.replace("gran_ms,", "part, gran_ms,") + f"(SELECT metric_name, labels, part, 3600000::BIGINT AS gran_ms, ts_ms - ts_ms % 3600000 AS bucket_time, count(*) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max, CASE WHEN arg_max(value, ts_ms) < arg_min(value, ts_ms) THEN arg_max(value, ts_ms) ELSE arg_max(value, ts_ms) - arg_min(value, ts_ms) END AS delta, max(ts_ms) AS point_max FROM (SELECT *, (ts_ms % 2)::INTEGER AS part FROM {P}) GROUP BY metric_name, labels, part, ts_ms - ts_ms % 3600000)")
def _(spark, sf_dir):
    from brindle.operators import shards

    shard = _shard(spark, sf_dir)
    shard.commit()
    return _rounded(shards.downsample(spark, shard.path, _folder(spark, "buckets"), metrics.ONE_HOUR)[0])


@register("metric_batches", f"SELECT metric_name, labels, ts_ms, value FROM {P}")
def _(spark, sf_dir):
    from brindle.sources import metric_batch

    return metric_batch.decoded(metric_batch.encoded(event_points(spark, sf_dir))).drop("seq")


register("series_unpack", f"SELECT * FROM {P}")(lambda s, d: metrics.unpacked(metrics.packed(event_points(s, d))))
register("series_list", f"SELECT DISTINCT metric_name, labels FROM {P}")(lambda s, d: metrics.series_of(event_points(s, d)))
register("series_hash")(lambda s, d: metrics.series_of(event_points(s, d)).withColumn("series_hash", labels.series_hash(F.col("metric_name"), F.col("labels"))))
register("merge_intra", f"SELECT metric_name, labels, ts_ms, value FROM (SELECT *, row_number() OVER (PARTITION BY metric_name, labels, ts_ms ORDER BY value) AS n FROM {P}) WHERE n = 1")(lambda s, d: metrics.merged(event_points(s, d), ("value",)))
register("merge_cross_dedup", f"SELECT * FROM {P2}")(lambda s, d: metrics.merged(event_points(s, d, True)))


@register("merge_stats", f"SELECT 2 * count(*) FILTER (WHERE a > 0 AND b > 0) + count(*) FILTER (WHERE a = 0 OR b = 0) AS input_docs, count(*) AS output_docs, sum(a + b)::BIGINT AS input_points, (SELECT count(*) FROM {P2}) AS output_points, count(*) FILTER (WHERE a > 0 AND b > 0) AS merged_groups FROM (SELECT event_type, user_id, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1 OR event_id % 3 = 0) AS b FROM events GROUP BY event_type, user_id) WHERE a + b > 0")
def _(spark, sf_dir):
    pts = event_points(spark, sf_dir, True).withColumn("part", F.lit(0))
    return spark.createDataFrame([vars(metrics.merge_stats(pts, metrics.merged(pts)))], "input_docs long, output_docs long, input_points long, output_points long, merged_groups long")


register("downsample_5m", _ROUNDED + _buckets(P, 300000))(lambda s, d: _rounded(metrics.downsampled(event_points(s, d), metrics.FIVE_MINUTES)))
register("downsample_1h", _ROUNDED + _buckets(P, 3600000))(lambda s, d: _rounded(metrics.downsampled(event_points(s, d), metrics.ONE_HOUR)))
_UP = f"(SELECT metric_name, labels, 3600000::BIGINT AS gran_ms, bucket_time - bucket_time % 3600000 AS bucket_time, sum(count)::BIGINT AS count, sum(sum) AS sum, min(min) AS min, max(max) AS max, sum(delta) AS delta, max(point_max) AS point_max FROM {_buckets(P, 300000)} GROUP BY metric_name, labels, bucket_time - bucket_time % 3600000)"
register("downsample_rollup_5m_1h", _ROUNDED + _UP)(lambda s, d: _rounded(metrics.rolled_up(metrics.downsampled(event_points(s, d), metrics.FIVE_MINUTES), metrics.ONE_HOUR)))
register("downsample_counter_reset", f"SELECT count(*) AS n, round(sum(delta), 4) AS delta FROM {_buckets(P, 86400000)} WHERE delta = delta")(lambda s, d: metrics.downsampled(event_points(s, d), 86_400_000).agg(F.count("*").alias("n"), F.round(F.sum("delta"), 4).alias("delta")))


def _merged_shards(spark, sf_dir, name: str) -> DataFrame:
    return metrics.merge_shards(event_points(spark, sf_dir, True), _folder(spark, "shards"))[name]


register("merge_cross_shard_compact", f"SELECT * FROM {P2}")(lambda s, d: _merged_shards(s, d, "compact"))
register("merge_cross_shard_5m", _ROUNDED + _buckets(P2, 300000))(lambda s, d: _rounded(_merged_shards(s, d, "5m")))
register("merge_cross_shard_1h", _ROUNDED + _buckets(P2, 3600000))(lambda s, d: _rounded(_merged_shards(s, d, "1h")))


@register("stream_downsample", f"SELECT metric_name, labels, bucket_time, count, round(sum, 6) AS sum, min, max, round(delta, 6) AS delta FROM {_buckets(P, 300000)}")
def _(spark, sf_dir):
    from brindle.streaming import live

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    text = F.concat(F.lit(labels.MARK + "user="), F.col("user_id").cast("string"), F.lit(labels.MARK))
    pts = stream.select(F.col("event_type").alias("metric_name"), text.alias("labels"), F.unix_millis(F.to_timestamp("ts")).alias("ts_ms"), "value")
    return _rounded(live.into_table(live.downsampled(pts), _folder(spark, "buckets")))


# --- sketches ---
_HASH = "('0x' || substr(md5({0}::VARCHAR), 1, 16))::UBIGINT"


def _hashed(col: Column) -> Column:
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 16), 16, -10).cast("long")


_REGS = f"(SELECT event_type, (h & 4095)::INTEGER AS reg, max(least(15, 53 - CASE WHEN h >> 12 = 0 THEN 0 ELSE length(ltrim(bin(h >> 12), '0')) END))::INTEGER AS rho FROM (SELECT event_type, {_HASH.format('user_id')} AS h FROM events) GROUP BY event_type, reg)"


@register("hll_registers", f"SELECT * FROM {_REGS}")
def _(spark, sf_dir):
    return hll.registers(table(spark, sf_dir, "events"), _hashed(F.col("user_id")), "event_type")


@register("hll_estimate", f"SELECT event_type, round(CASE WHEN raw <= 2.5 * 4096 AND z > 0 THEN 4096 * ln(4096.0 / z) ELSE raw END, 6) AS estimate FROM (SELECT event_type, 4096 - count(*) AS z, 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / (4096 - count(*) + sum(pow(2.0, -rho))) AS raw FROM {_REGS} GROUP BY event_type)")
def _(spark, sf_dir):
    regs = hll.registers(table(spark, sf_dir, "events"), _hashed(F.col("user_id")), "event_type")
    return hll.estimate(regs, "event_type").withColumn("estimate", F.round("estimate", 6))


@register("hll_union", f"SELECT reg, max(rho)::INTEGER AS rho FROM {_REGS} WHERE event_type IN ('click', 'view') GROUP BY reg")
def _(spark, sf_dir):
    regs = hll.registers(table(spark, sf_dir, "events"), _hashed(F.col("user_id")), "event_type")
    one, two = (regs.where(F.col("event_type") == t).drop("event_type") for t in ("click", "view"))
    return hll.union(one, two)


register("hll_sketch")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 12)).alias("users")))


@register("hll_sketch_bounds", "SELECT event_type, true AS near FROM events GROUP BY event_type")
def _(spark, sf_dir):
    """A sketch of 2^12 registers is within five standard errors (1.6 % each) of the exact number."""
    users = table(spark, sf_dir, "events").groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 12)).alias("about"), F.countDistinct("user_id").alias("exact"))
    return users.select("event_type", (F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.08 * F.col("exact"))).alias("near"))
