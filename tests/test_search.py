"""Small corpora with known answers, by rows and by postings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.operators import terms
from brindle.operators.search import Searcher
from brindle.plans.query import And, Bool, MatchAll, Occur, Or, Phrase, Prefix, Range, Term, Terms, Wildcard, simplified
from brindle.plans.schema import FieldSpec, Schema

M, S, N = Occur.MUST, Occur.SHOULD, Occur.MUST_NOT
SCHEMA = Schema.of(FieldSpec.text("message", positions=True), FieldSpec.keyword("level"), FieldSpec.text("plain"), FieldSpec.long_point("ts").with_doc_values("numeric"), FieldSpec.int_point("lvl"))


def searchers(spark, rows, struct):
    docs = spark.createDataFrame(rows, struct).cache()
    table = terms.postings(docs, SCHEMA).cache()
    return [Searcher(docs, SCHEMA), Searcher(docs, SCHEMA, strategy="postings", postings=table, stats=terms.stats_of(table).cache())]


def found(searcher, q):
    return sorted(r[0] for r in searcher.ids(q).collect())


def T(w):
    return Term("message", w)


@pytest.fixture(scope="module", params=[0, 1], ids=["scan", "postings"])
def plan(request):
    return request.param


@pytest.fixture(scope="module")
def booleans(spark):
    levels = ["INFO", "WARN", "ERROR", "DEBUG"]
    return searchers(spark, [(i, levels[i % 4], "w0 w1" if i % 8 == 0 else f"w{i % 5}") for i in range(20)], "doc_id long, level string, message string")


BOOLS = [
    (Bool(((M, T("w0")), (M, T("w1")))), [0, 8, 16]),
    (Bool(((S, T("w0")), (S, T("w1")))), [0, 1, 5, 6, 8, 10, 11, 15, 16]),
    (Bool(((M, T("w0")), (S, T("w1")))), [0, 5, 8, 10, 15, 16]),
    (Bool(((M, T("w0")), (N, T("w1")))), [5, 10, 15]),
    (Bool(((N, T("nosuch")),)), list(range(20))),
    (Bool(((M, Bool(((S, T("w0")), (S, T("w2"))))), (N, Bool(((M, T("w1")),))))), [2, 5, 7, 10, 12, 15, 17]),
    (Bool(((M, Term("level", "INFO")), (M, T("w0")))), [0, 8, 16]),
    (Bool(()), []),
    (Bool(((S, T("nosuch")),)), []),
    (Bool(((S, T("nosuch")), (N, T("w1")))), []),
    (Bool(((M, T("w0")), (M, T("nosuch")))), []),
    (Bool(((M, MatchAll()), (N, MatchAll()))), []),
    (Bool(((N, Bool(())),)), list(range(20))),
    (T("w0") & ~T("w1"), [5, 10, 15]),
]


@pytest.mark.parametrize("q,expected", BOOLS)
def test_bool(booleans, plan, q, expected):
    assert found(booleans[plan], q) == expected
    assert booleans[plan].count(q) == len(expected)


def test_only_not(booleans, plan):
    assert len(found(booleans[plan], Bool(((N, T("w1")),)))) == 14


@pytest.fixture(scope="module")
def many_terms(spark):
    rows = [(i, "INFO", f"t{i % 20:02d} t{(i + 7) % 20:02d}") for i in range(40)] + [(40, None, "héllo world")]
    return searchers(spark, rows, "doc_id long, level string, message string")


@pytest.mark.parametrize(
    "q,n",
    [
        (Terms("message", ("t00",)), 4),
        (Terms("message", ()), 0),
        (Terms("message", ("t00", "zz1")), 4),
        (Terms("message", tuple(f"t{k:02d}" for k in range(18))), 40),
        (Or("message", ("t00", "t01")), 8),
        (And("message", ("t00", "t07")), 2),
        (Prefix("message", "t1"), 34),
        (Prefix("message", "t"), 40),
        (Prefix("message", ""), 41),
        (Prefix("level", "INF"), 40),
        (Prefix("level", ""), 40),
        (Wildcard("message", "t?7"), 8),
        (Wildcard("message", "*"), 41),
        (Wildcard("message", "h?llo"), 1),
        (Wildcard("message", "h?ll"), 0),
        (Wildcard("message", "t0*"), 34),
        (Wildcard("level", "I*O"), 40),
        (Wildcard("level", "*"), 40),
        (Bool(((M, Prefix("message", "t1")), (N, T("t07")))), 32),
        (Term("level", "INFO"), 40),
        (Term("nofield", "x"), 0),
        (Term("ts", "5"), 0),
        (MatchAll(), 41),
    ],
)
def test_term_sets(many_terms, plan, q, n):
    assert many_terms[plan].count(q) == n


@pytest.fixture(scope="module")
def phrases(spark):
    texts = ["quick brown fox", "quick fox brown", "quick quick brown", "foo foo bar", "foo bar foo", "a b c", "a b", "c a b"]
    return searchers(spark, [(i, t, t) for i, t in enumerate(texts)], "doc_id long, message string, plain string")


@pytest.mark.parametrize(
    "words,expected",
    [("quick brown", [0, 2]), ("quick fox", [1]), ("quick quick brown", [2]), ("foo foo", [3]), ("a b c", [5]), ("a b", [5, 6, 7]), ("brown quick", []), ("quick nosuch", []), ("", []), ("quick", [0, 1, 2])],
)
def test_phrase(phrases, plan, words, expected):
    assert found(phrases[plan], Phrase("message", tuple(words.split()))) == expected


def test_phrase_needs_positions(phrases, plan):
    with pytest.raises(ValueError):
        phrases[plan].ids(Phrase("plain", ("a", "b")))
    assert found(phrases[plan], Phrase("plain", ("quick",))) == [0, 1, 2]
    assert found(phrases[plan], Phrase("nofield", ("a", "b"))) == []


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, [i * 10] + ([10000, 20000] if i == 3 else [5] if i == 7 else []), i - 50, "INFO" if i % 2 else "WARN") for i in range(100)]
    return searchers(spark, rows, "doc_id long, ts array<long>, lvl int, level string")


LOW, HIGH = -(1 << 63), (1 << 63) - 1


@pytest.mark.parametrize("field,low,high,n", [("ts", 100, 250, 16), ("ts", 250, 250, 1), ("ts", 10000, 20000, 1), ("ts", 30000, 40000, 0), ("ts", LOW, HIGH, 100), ("ts", LOW, 0, 1), ("ts", 0, 5, 2), ("lvl", LOW, -40, 11), ("lvl", 1 << 40, 1 << 41, 0), ("lvl", -50, -50, 1), ("level", 0, 1, 0), ("nofield", 0, 1, 0)])
def test_range(points, plan, field, low, high, n):
    assert points[plan].count(Range(field, low, high)) == n


def test_range_backwards(points, plan):
    with pytest.raises(ValueError):
        points[plan].ids(Bool(((N, Range("ts", 2, 1)),)))


def test_null_under_not(spark, plan):
    rows = [(0, None, "INFO"), (1, "x", None), (2, "", "WARN")]
    s = searchers(spark, rows, "doc_id long, message string, level string")[plan]
    assert found(s, Bool(((N, T("x")),))) == [0, 2]
    assert found(s, Bool(((N, Term("level", "INFO")),))) == [1, 2]
    assert found(s, Bool(((N, Bool(((N, T("x")),))),))) == [1]
    assert found(s, Prefix("message", "")) == [1]


def test_only_ascii_space_splits(spark, plan):
    rows = [(0, "a\x0bb"), (1, "a b"), (2, "a\fb"), (3, "a\t\n b"), (4, "ab")]
    s = searchers(spark, rows, "doc_id long, message string")[plan]
    assert found(s, T("a")) == [2, 3]
    assert found(s, Phrase("message", ("a", "b"))) == [2, 3]
    assert found(s, Wildcard("message", "a?b")) == [0, 1]


def test_values_of_a_field_stay_apart(spark, plan):
    s = searchers(spark, [(0, ["x a", "b y"]), (1, ["a b"]), (2, None)], "doc_id long, message array<string>")[plan]
    assert found(s, Phrase("message", ("a", "b"))) == [1]
    assert found(s, T("b")) == [0, 1]
    assert found(s, Bool(((N, T("b")),))) == [2]


def test_and_takes_terms_from_any_value(spark, plan):
    rows = [(1, ["x y", "z"], ["a", "b"]), (2, ["x z"], ["a"]), (3, ["x", "y"], ["b", "b"]), (4, None, None)]
    s = searchers(spark, rows, "doc_id long, message array<string>, level array<string>")[plan]
    assert found(s, And("message", ("x", "z"))) == [1, 2] and found(s, And("level", ("a", "b"))) == [1]
    assert found(s, Bool(((N, And("level", ("a", "b"))),))) == [2, 3, 4]
    single = searchers(spark, [(1, "x", "a"), (2, "x z", "b")], "doc_id long, message string, level string")[plan]
    assert found(single, And("level", ("a", "b"))) == [] and found(single, And("message", ("x", "z"))) == [2]


@pytest.mark.parametrize("n", [63, 64, 65, 200])
def test_lists_of_terms_of_any_length(many_terms, plan, n):
    asked = ("t03", "héllo", "a b", "", *(f"zz{k}" for k in range(n - 4)))
    assert found(many_terms[plan], Terms("message", asked)) == sorted([*(k for k in range(40) if 3 in (k % 20, (k + 7) % 20)), 40])


def test_any_column_name(spark, plan):
    s = searchers(spark, [(1, "x", 5), (2, "y", 6)], "doc_id long, message string, _id long")[plan]
    assert [tuple(r) for r in s.matching(T("x")).collect()] == [(1, "x", 5)]


def test_counts_from_statistics(spark):
    rows = [(i, "INFO" if i % 3 else None, f"w{i % 4}", i * 10 if i % 2 else None, i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, level string, message string, ts long, lvl int").cache()
    stats, bounds = terms.term_stats(docs, SCHEMA).cache(), terms.point_stats(docs, SCHEMA).cache()
    assert {tuple(r) for r in bounds.collect()} == {("ts", 10, 390, 20), ("lvl", 0, 39, 40)}
    plain, told = Searcher(docs, SCHEMA), Searcher(docs, SCHEMA, stats=stats, bounds=bounds)
    known = [MatchAll(), Bool(()), T("w1"), T("nosuch"), Term("level", "INFO"), Term("nofield", "x"), Range("ts", 0, 1000), Range("ts", 10, 390), Range("ts", 391, 500), Range("nofield", 0, 1), ~T("w1"), ~Range("ts", 0, 1000), ~Term("nofield", "x")]
    for q in known:
        assert told.known_count(simplified(q)) == plain.count(q) == len(found(plain, q)), q
    for q in (Range("ts", 11, 390), T("w1") | T("w2"), Phrase("message", ("w1", "w2")), ~Range("ts", 11, 390)):
        assert told.known_count(simplified(q)) is None and told.count(q) == plain.count(q)
    with pytest.raises(ValueError):
        told.count(Range("ts", 2, 1))


def test_doc_values(spark):
    schema = Schema.of(FieldSpec.binary_dv("raw"), FieldSpec.sorted_dv("tag"), FieldSpec.numeric_dv("n"), FieldSpec.keyword("level"))
    docs = spark.createDataFrame([(1, bytearray(b"\x00\xff"), "b", 5, "x"), (2, None, None, None, "y"), (3, bytearray(b""), "a", -1, "z")], "doc_id long, raw binary, tag string, n long, level string")
    s = Searcher(docs, schema)
    got = {f: [(r.doc_id, bytes(r.value) if f == "raw" else r.value) for r in s.doc_values(f).orderBy("doc_id").collect()] for f in ("raw", "tag", "n", "level", "nofield")}
    assert got == {"raw": [(1, b"\x00\xff"), (3, b"")], "tag": [(1, "b"), (3, "a")], "n": [(1, 5), (3, -1)], "level": [], "nofield": []}


def test_sorting(spark):
    ts = [50, 10, 40, 20, 30, 90, 70, 80, 60, None]
    s = searchers(spark, [(i, "x", t) for i, t in enumerate(ts)], "doc_id long, message string, ts long")[0]
    r = s.top_docs_by_field(T("x"), "ts", 3)
    assert (r.docs, r.values, r.total, r.early_terminated) == ([1, 3, 4], [10, 20, 30], 10, False)
    assert s.top_docs_by_field(T("x"), "ts", 10).docs[-1] == 9
    assert s.search(T("x"), ("ts", False), 2).docs == [9, 1]
    assert s.search(T("x"), ("ts", True), 20).docs[-1] == 9
    assert s.search(T("x"), None, 0).docs == [] and s.search(T("x"), None, 0).total == 10
    assert s.search_json('{"query": {"type": "match_all"}, "sort": {"field": "ts", "order": "other"}, "top_n": 2}') == '{"total":10,"docs":[5,7]}'
    assert s.search(T("x"), ("nofield", True), 2).docs == [0, 1]


def test_frequencies(spark):
    s = searchers(spark, [(0, "a a a b", "INFO"), (1, "a  a\ta", "INFO"), (2, None, None)], "doc_id long, message string, level string")
    for x in s:
        assert x.freq_sum(T("a")) == 6 and x.freq_sum(T("b")) == 1 and x.freq_sum(T("c")) == 0
        assert x.freq_sum(Term("level", "INFO")) == 2 and x.freq_sum(MatchAll()) == 3
        with pytest.raises(ValueError):
            x.freq_sum(Or("message", ("a", "b")))
    stats = {(r.field, r.term): (r.df, r.ttf) for r in terms.term_stats(s[0].docs, SCHEMA).collect()}
    assert stats == {("message", "a"): (2, 6), ("message", "b"): (1, 1), ("level", "INFO"): (2, 2)}


def test_stored_document(spark):
    s = searchers(spark, [(0, "m", "INFO", 5)], "doc_id long, message string, level string, ts long")[0]
    assert s.document(0) == {"message": "m", "level": "INFO"} and s.document(1) is None


def test_plans_push_filters_and_read_few_columns(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"t{i}", "INFO", i) for i in range(100)], "doc_id long, message string, level string, ts long").write.parquet(path)
    s = Searcher(spark.read.parquet(path), SCHEMA)
    text = s.ids(Bool(((M, Term("level", "INFO")), (M, Range("ts", 5, 9))))).select(F.col("doc_id"))._jdf.queryExecution().toString()
    assert "EqualTo(level,INFO)" in text and "GreaterThanOrEqual(ts,5)" in text and "ReadSchema: struct<doc_id:bigint,level:string,ts:bigint>" in text
    assert "Exchange" not in text
