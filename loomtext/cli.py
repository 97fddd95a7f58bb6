"""Command line: index, crawl, search, stats, embed, serve. Errors are one line and exit status 1."""

from __future__ import annotations

import argparse
import asyncio
import json
import sys

from pyspark.sql import SparkSession


def _spark() -> SparkSession:
    return SparkSession.builder.appName("loomtext").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _index(args) -> None:
    from loomtext.operators.index import build_index
    from loomtext.sources.corpus import numbered, read_corpus
    from loomtext.sources.store import save

    save(build_index(numbered(read_corpus(_spark(), args.corpus, args.on_error, args.limit)), not args.no_positions, tokens_once=True), args.target)


def _search(args) -> None:
    from loomtext.functions.snippets import py_highlight
    from loomtext.operators.scoring import BM25, TfIdf
    from loomtext.operators.search import boolean_search
    from loomtext.operators.semantic import HashingEncoder, SemanticIndex, retrieve
    from loomtext.sources.store import load

    spark = _spark()
    index = load(spark, args.index, validate=False)
    if args.boolean:
        found = boolean_search(index, args.query, args.engine)
        for row in found.limit(args.k).join(index.docs.select("doc_id", "path"), "doc_id").orderBy("doc_id").collect():
            print(row.doc_id, row.path)
        return
    semantic = SemanticIndex.load(spark, args.embeddings, index) if args.embeddings else None
    first = semantic.passages.select("embedding").first() if semantic else None
    encoder = HashingEncoder(len(first[0])) if first else HashingEncoder()
    rows = retrieve(index, args.query, TfIdf() if args.scorer == "tfidf" else BM25(), args.k, mode=args.mode, semantic=semantic, encoder=encoder)
    if args.json:
        for line in rows.orderBy("rank").select("doc_id", "score", "title", "path", "snippet").toJSON().collect():
            print(line)
        return
    for r in rows.orderBy("rank").collect():
        print(f"{r['rank']:>3}  {r.score:.4f}  {r.title}  ({r.path})\n     {py_highlight(r.snippet, chr(27) + '[1m', chr(27) + '[0m', escape=False)}")


def _stats(args) -> None:
    """Of a saved index, or straight from a corpus."""
    from loomtext.api import stats
    from loomtext.operators.index import build_index
    from loomtext.sources.corpus import numbered, read_corpus
    from loomtext.sources.store import load

    spark = _spark()
    if args.corpus:
        index = build_index(numbered(read_corpus(spark, args.source, "skip", args.limit)), False, tokens_once=True)
    else:
        index = load(spark, args.source, validate=False)
    s = stats(index, args.top)
    if args.json:
        print(json.dumps(s, ensure_ascii=False))
        return
    print(f"documents {s['documents']}\ntokens {s['tokens']}\nterms {s['terms']}\naverage length {s['average_length']:.2f}")
    for term, times in s["top"]:
        print(f"{times:>10}  {term}")


def _embed(args) -> None:
    from loomtext.operators.semantic import HashingEncoder, SemanticIndex
    from loomtext.sources.store import load

    spark = _spark()
    known = SemanticIndex.load(spark, args.resume, dim=args.dim) if args.resume else None
    SemanticIndex.build(load(spark, args.index, validate=False), HashingEncoder(args.dim), known=known).save(args.target)


def _serve(args) -> None:
    from loomtext.service import serve
    from loomtext.sources.store import load

    serve(load(_spark(), args.index, validate=False), args.host, args.port)


def _crawl(args) -> None:
    from contextlib import nullcontext

    from loomtext.sources.crawl import collect, crawl_log

    with crawl_log(args.log) if args.log else nullcontext():
        stats = asyncio.run(collect(args.seed, args.target, most_pages=args.pages, workers=args.workers, delay=args.delay))
    print(f"pages {stats.pages}, requests {stats.requests}, blocked {stats.blocked}, failed {stats.failed}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomtext", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *arguments):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flags, options in arguments:
            p.add_argument(*flags, **options)

    arg = lambda *flags, **options: (flags, options)
    command("index", _index, arg("corpus"), arg("target"), arg("--no-positions", action="store_true"), arg("--on-error", choices=["skip", "fail"], default="fail"), arg("--limit", type=int))
    command(
        "search", _search, arg("index"), arg("query"), arg("-k", type=int, default=10), arg("--scorer", choices=["bm25", "tfidf"], default="bm25"),
        arg("--mode", choices=["keyword", "semantic", "hybrid"], default="keyword"), arg("--embeddings"), arg("--json", action="store_true"),
        arg("--boolean", action="store_true"), arg("--engine", choices=["columns", "sets"], default="columns"),
    )
    command(
        "stats", _stats, arg("source"), arg("--corpus", action="store_true", help="source is a corpus, not an index"), arg("--limit", type=int), arg("--json", action="store_true"),
        arg("--top", type=int, default=50),
    )
    command("serve", _serve, arg("index"), arg("--host", default="127.0.0.1"), arg("--port", type=int, default=8000))
    command("embed", _embed, arg("index"), arg("target"), arg("--dim", type=int, default=64), arg("--resume", help="embeddings of an earlier run"))
    command("crawl", _crawl, arg("seed", nargs="+"), arg("target"), arg("--pages", type=int, default=500), arg("--workers", type=int, default=10), arg("--delay", type=float, default=0.2), arg("--log"))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except Exception as e:  # the boundary: one line, whatever it was
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
