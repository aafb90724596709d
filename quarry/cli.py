"""Command line: build, search, serve, stats, eval."""

from __future__ import annotations

import argparse
import time

from quarry.operators import analytics
from quarry.operators import index as tables
from quarry.plans import search
from quarry.session import serving, session

SNIPPET = 220


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description="Search and link analysis on Spark.")
    p.add_argument("--data", default="quarry-data", help="folder of the corpus and the index, in any Hadoop store")
    commands = p.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="generate, crawl, index, rank")
    build.add_argument("--seed", type=int, default=7)
    build.add_argument("--docs", type=int, default=2500)
    find = commands.add_parser("search", help="run one query")
    find.add_argument("query")
    find.add_argument("--n", type=int, default=10)
    serve = commands.add_parser("serve", help="start the web interface")
    serve.add_argument("--port", type=int, default=8000)
    commands.add_parser("stats", help="figures of the index")
    commands.add_parser("eval", help="precision and reciprocal rank over the judged queries")
    return p


def shown(hits: list[dict], seconds: float) -> str:
    lines = [f"{len(hits)} results in {seconds * 1000:.1f} ms"]
    for i, h in enumerate(hits, 1):
        lines += [f"{i}. {h['title']}  [{h['score']}]", f"   {h['url']}", "   " + h["snippet"].replace("<mark>", "**").replace("</mark>", "**")[:SNIPPET]]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    path = f"{args.data}/index"
    if args.command == "build":
        search.build(spark, args.data, args.seed, args.docs)
        return 0
    index = tables.read(serving(spark) if args.command == "search" else spark, path)
    if args.command == "search":
        began = time.time()
        hits = search.search(index, args.query, args.n)
        print(shown(hits, time.time() - began))
        if better := search.did_you_mean(index, args.query):
            print(f"Did you mean: {better}")
    elif args.command == "serve":
        from quarry.web import serve

        serve(spark, path, args.port)
    elif args.command == "stats":
        row = analytics.index_stats(index).first()
        print(f"pages {row.pages}\nvocabulary {row.vocabulary}\naverage rank {row.avg_pagerank or 0:.6f}\nbytes {analytics.disk_bytes(spark, path)}")
        for r in analytics.top_queries(index.query_log).collect():
            print(f"  {r.n:6d}  {r.query}")
    else:
        rows = search.evaluate(index).orderBy("qid").collect()
        for r in rows:
            print(f"{search.JUDGED[r.qid][0]:40s} {r.p_at_k:5.2f} {r.rr:5.2f}")
        told = search.run_eval(index)
        print(f"{'mean':40s} {told['p_at_5']:5.2f} {told['mrr']:5.2f}  (n={told['n']})")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
