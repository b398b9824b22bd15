"""Commands: report, analyse, filter, chart, fetch, serve. `python -m larder COMMAND --help` tells each one's arguments."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def say(text: str, out=None) -> None:
    """Prints a line; characters that the stream's encoding lacks become question marks."""
    out = out or sys.stdout
    kind = getattr(out, "encoding", None) or "utf-8"
    print(text.encode(kind, "replace").decode(kind), file=out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larder")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("report", help="the report of one text")
    one.add_argument("text")
    one.add_argument("--form", choices=["plain", "markdown", "html"], default="plain")
    commands.add_parser("analyse", help="the matches of one text as a table").add_argument("text")
    for name, what in (("filter", "a country's rows of a dump, as CSV"), ("chart", "the commonest values of a dump's tag column, as SVG")):
        c = commands.add_parser(name, help=what)
        c.add_argument("dump")
        c.add_argument("out")
        if name == "chart":
            c.add_argument("--column", default="allergens")
            c.add_argument("--rows", type=int, default=15)
    fetch = commands.add_parser("fetch", help="a file over HTTP")
    fetch.add_argument("url")
    fetch.add_argument("out")
    fetch.add_argument("--keep", action="store_true")
    commands.add_parser("serve", help="the local page").add_argument("--port", type=int, default=5000)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "fetch":
        from .sources.files import fetch_file

        new = fetch_file(a.url, a.out, keep=a.keep, progress=lambda done, size, speed: say(f"{done} of {size or '?'} bytes, {speed:.0f} a second"))
        say(a.out if new else f"{a.out} is there already")
        return
    spark = spark or SparkSession.builder.appName("larder").getOrCreate()
    if a.command in ("report", "analyse"):
        from .operators import analysis, rules
        from .plans import knowledge
        from .present import documents, web

        if a.command == "analyse":
            docs = spark.createDataFrame([(1, a.text)], "doc_id int, text string")
            found = analysis.analyze(docs, knowledge.phrases(knowledge.lexicon(spark)), knowledge.allergens(spark), "doc_id", "text")
            say(rules.analysis_table(found).first()["table"])
        else:
            draw = {"plain": rules.render_text, "markdown": rules.render_markdown, "html": documents.render_html}[a.form]
            say(draw(web.one_report(spark, a.text)).first()[a.form])
    elif a.command == "serve":
        from .present import web

        web.serve(spark, port=a.port)
    else:
        from pyspark.sql import functions as F

        from .present import charts
        from .sources import products

        products.require(spark, a.dump)
        dump = products.read_dump(spark, a.dump)
        if a.command == "filter":
            kept, read, left = products.filter_dump(dump)
            products.write_csv(kept, a.out)
            say(f"{left.get['rows']} of {read.get['rows']} rows")
        else:
            tags = F.transform(F.split(F.col(a.column), ","), F.trim)
            counts = dump.select(F.explode(tags).alias("tag")).where("tag <> ''").groupBy("tag").count()
            charts.save_figure(charts.bar_chart(counts, "tag", "count", a.column, a.rows), a.out)
            say(a.out)


if __name__ == "__main__":
    main()
