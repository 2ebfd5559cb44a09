"""python -m brindle: index JSON lines or text files, merge, search, dump, make documents, measure."""

from __future__ import annotations

import argparse
import json
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import terms
from brindle.operators.search import Searcher
from brindle.plans import dsl
from brindle.plans.query import And, Bool, MatchAll, Occur, Or, Phrase, Prefix, Query, Range, Term, Terms, Wildcard
from brindle.plans.schema import Schema
from brindle.sources import generators, jsonl, store, text_files

LOGS = "timestamp:longpoint+numericdv,level:keyword+sorteddv,trace_id:keyword,message:text+positions,duration_ms:longpoint+numericdv,size:numericdv,outcome:numericdv"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("brindle", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("jsonindex", help="JSON lines to a table")
    v.add_argument("input"), v.add_argument("table"), v.add_argument("--schema", required=True), v.add_argument("--append", action="store_true"), v.add_argument("--docs", type=int)
    v = verbs.add_parser("index", help="lines of text files to a table")
    v.add_argument("input"), v.add_argument("table"), v.add_argument("--docs", type=int, default=0)
    for name, told in (("write", "synthetic texts to a table"), ("bench", "the same, with its rate")):
        v = verbs.add_parser(name, help=told)
        v.add_argument("table"), v.add_argument("--docs", type=int, default=10_000), v.add_argument("--bytes", type=int, default=200), v.add_argument("--seed", type=int, default=1)
    for name, told in (("logwrite", "synthetic logs to a table"), ("logbench", "the same and its postings, with their rates")):
        v = verbs.add_parser(name, help=told)
        v.add_argument("table"), v.add_argument("--docs", type=int, default=10_000), v.add_argument("--sparse", action="store_true"), v.add_argument("--sort"), v.add_argument("--seed", type=int, default=1)
    v = verbs.add_parser("jsongen", help="synthetic JSON lines")
    v.add_argument("output"), v.add_argument("--docs", type=int, default=10_000)
    v = verbs.add_parser("forcemerge", help="all segments into one")
    v.add_argument("table"), v.add_argument("--files", type=int)
    v = verbs.add_parser("search", help="a JSON request, or an expression in brackets")
    v.add_argument("table"), v.add_argument("query"), v.add_argument("--schema", default=LOGS), v.add_argument("--top", type=int, default=10)
    v = verbs.add_parser("searchdump", help="each query of a file, or of a battery made from the table's terms, with its count and first ids")
    v.add_argument("table"), v.add_argument("file", nargs="?"), v.add_argument("--schema", default=LOGS), v.add_argument("--field", default="message"), v.add_argument("--top", type=int, default=20)
    v = verbs.add_parser("searchbench", help="times of each query of a file: counts, the first n, or all ids")
    v.add_argument("table"), v.add_argument("file"), v.add_argument("--schema", default=LOGS), v.add_argument("--field", default="message"), v.add_argument("--warmup", type=int, default=1), v.add_argument("--iter", type=int, default=3)
    v.add_argument("--topn", type=int), v.add_argument("--no-fast-count", action="store_true")
    return p


def battery(docs: DataFrame, schema: Schema, most: int = 3) -> tuple[list[tuple[str, str, str, int]], list[tuple[str, Query]]]:
    """Frequent, middling and rare terms of every indexed field, and queries of all kinds made of them and of the points."""
    told, queries = [], [("matchall", MatchAll())]
    for spec in schema.fields.values():
        if not spec.indexed or spec.name not in docs.columns:
            continue
        stats = terms.term_stats(docs, schema, only=[spec.name]).select("term", "df")
        often = [tuple(r) for r in stats.orderBy(F.desc("df"), "term").limit(most).collect()]
        edges = stats.agg(F.percentile_approx("df", 0.5)).first()[0] or 0
        middling = [tuple(r) for r in stats.where(F.col("df") <= edges).orderBy(F.desc("df"), "term").limit(most).collect()]
        rare = [tuple(r) for r in stats.orderBy("df", "term").limit(most).collect()]
        told += [(kind, spec.name, *t) for kind, found in (("high", often), ("med", middling), ("low", rare)) for t in found]
        if not often:
            continue
        a, b = often[0][0], often[min(1, len(often) - 1)][0]
        queries += [(f"term {spec.name}={t}", Term(spec.name, t)) for t, _ in often + rare[:1]] + [(f"term {spec.name}=\u2205", Term(spec.name, "\u2205"))]
        queries += [(f"and {spec.name}={a},{b}", And(spec.name, (a, b))), (f"or {spec.name}={a},{b}", Or(spec.name, (a, b))), (f"and {spec.name}={a},\u2205", And(spec.name, (a, "\u2205")))]
        every = tuple(t for t, _ in often + middling + rare)
        queries += [(f"terms {spec.name}={','.join(every)}", Terms(spec.name, every)), (f"prefix {spec.name}={a[:2]}", Prefix(spec.name, a[:2])), (f"wildcard {spec.name}={a[:1]}*{a[-1:]}", Wildcard(spec.name, f"{a[:1]}*{a[-1:]}")), (f"wildcard {spec.name}=?{a[1:]}", Wildcard(spec.name, f"?{a[1:]}"))]
        queries.append((f"bool +{a} -{b}", Bool(((Occur.MUST, Term(spec.name, a)), (Occur.MUST_NOT, Term(spec.name, b))))))
        queries.append((f"bool -{a}", Bool(((Occur.MUST_NOT, Term(spec.name, a)),))))
        if spec.positions:
            text = docs.where(F.col(spec.name).isNotNull()).select(spec.name).first()
            words = text[0].split()[:3] if text and isinstance(text[0], str) else []
            queries += [(f"phrase {spec.name}={','.join(w)}", Phrase(spec.name, tuple(w))) for w in (words[:2], words, words[1::-1]) if len(w) > 1]
    for spec in schema.fields.values():
        if spec.points and spec.name in docs.columns:
            low, high, n = terms.bounds(docs, spec.name).first()
            if n:
                middle = (low + high) // 2
                queries += [(f"range {spec.name}=[{x},{y}]", Range(spec.name, x, y)) for x, y in ((low, high), (low, middle), (middle, middle), (high + 1, high + 9))]
    return told, queries


def dump(searcher: Searcher, queries: list[tuple[str, Query]], top: int) -> None:
    for line, q in queries:
        print(line, searcher.top_docs(q, top).to_json(), sep="\t")


def bench(searcher: Searcher, queries: list[tuple[str, Query]], warmup: int, rounds: int, topn: int | None, fast: bool) -> None:
    """A JSON line for each query: the median and least time of a count, of the first n, or of going through all ids."""
    def run(q: Query) -> int:
        if topn is not None:
            return len(searcher.search(q, n=topn).docs)
        if fast:
            return searcher.count(q)
        searcher.ids(q).write.format("noop").mode("overwrite").save()
        return -1

    for line, q in queries:
        for _ in range(warmup):
            run(q)
        took = []
        for _ in range(max(1, rounds)):
            start = time.perf_counter()
            found = run(q)
            took.append(time.perf_counter() - start)
        print(json.dumps({"query": line, "mode": "top" if topn is not None else "count" if fast else "all", "found": found, "median_s": round(statistics.median(took), 4), "least_s": round(min(took), 4)}))


def rate(name: str, n: int, start: float) -> None:
    took = time.perf_counter() - start
    print(json.dumps({"what": name, "docs": n, "seconds": round(took, 3), "docs_per_second": round(n / took)}))


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("brindle").getOrCreate()
    if a.verb == "jsonindex":
        lines = spark.read.text(a.input).withColumn("doc_id", F.monotonically_increasing_id())
        lines = lines.limit(a.docs) if a.docs is not None else lines
        docs, _ = jsonl.bind(lines, Schema.parse(a.schema), order=F.col("doc_id"), keep=("doc_id",))
        writer = store.Writer(spark, a.table, docs.schema, append=a.append)
        writer.add(docs)
        writer.commit()
        print(jsonl.counts(lines).first().asDict())
    elif a.verb in ("index", "write", "bench", "logwrite", "logbench"):
        if a.verb == "index":
            docs = text_files.numbered(text_files.read(spark, a.input))
            docs = text_files.cycled(docs, a.docs) if a.docs else docs
        elif a.verb in ("write", "bench"):
            docs = generators.texts(spark, a.docs, a.bytes, a.seed)
        else:
            docs = generators.logs(spark, a.docs, a.sparse, a.seed)
        sort = getattr(a, "sort", None)
        start = time.perf_counter()
        writer = store.Writer(spark, a.table, docs.schema, sort=(sort, False, False) if sort else None)
        writer.add(docs)
        version = writer.commit()
        if a.verb.endswith("bench"):
            rate("rows", a.docs, start)
            start = time.perf_counter()
            written = store.open_snapshot(spark, a.table)
            terms.write_postings(terms.postings(written, Schema.parse(LOGS)), f"{a.table}/postings")
            rate("postings", a.docs, start)
        else:
            print({"version": version, "docs": store.open_snapshot(spark, a.table).count()})
    elif a.verb == "jsongen":
        generators.json_lines(spark, a.docs).write.text(a.output)
    elif a.verb == "forcemerge":
        struct = store.open_snapshot(spark, a.table).schema
        print({"version": store.Writer(spark, a.table, struct, append=True).force_merge(a.files)})
    else:
        docs, schema = store.open_snapshot(spark, a.table), Schema.parse(a.schema)
        searcher = Searcher(docs, schema)
        if a.verb == "search":
            print(searcher.search_json(a.query) if a.query.lstrip().startswith("{") else searcher.search(dsl.from_sexpr(a.query), n=a.top).to_json())
        elif a.file is None:
            found, queries = battery(docs, schema)
            print("maxDoc", searcher.max_doc(), sep="\t")
            for kind, name, term, df in found:
                print("TERM", name, term, df, kind, sep="\t")
            dump(searcher, queries, a.top)
        else:
            with open(a.file) as f:
                queries = dsl.from_query_file(f, a.field)
            if a.verb == "searchdump":
                dump(searcher, queries, a.top)
            else:
                bench(searcher, queries, a.warmup, a.iter, a.topn, not a.no_fast_count)
    return 0


if __name__ == "__main__":
    sys.exit(main())
