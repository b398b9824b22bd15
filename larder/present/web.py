"""A local page that analyses one text; the analysis is the library's own, on a session given by the caller."""

from __future__ import annotations

from collections.abc import Callable
from html import escape
from urllib.parse import parse_qs
from wsgiref.simple_server import make_server

from pyspark.sql import DataFrame, SparkSession

from ..operators import rules
from ..plans import knowledge
from .documents import render_html

MOST = 1 << 20  # bytes of a request's body
PAGE = """<!doctype html><meta charset="utf-8"><title>Análise de rótulos</title>
<form method="post"><textarea name="texto" rows="8" cols="80">{text}</textarea><br><button>Analisar</button></form>
{result}"""


def one_report(spark: SparkSession, text: str) -> DataFrame:
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return rules.report(docs, knowledge.phrases(knowledge.lexicon(spark)), knowledge.allergens(spark))


def application(spark: SparkSession) -> Callable:
    """The page as a WSGI application: GET gives the form, POST of texto adds its report. Other methods and larger bodies are refused."""

    def page(environ, start):
        method, text, result, status = environ["REQUEST_METHOD"], "", "", "200 OK"
        size = int(environ.get("CONTENT_LENGTH") or 0)
        if method not in ("GET", "POST"):
            status = "405 Method Not Allowed"
        elif size > MOST:
            status, result = "413 Content Too Large", "<p>Texto demasiado longo.</p>"
        elif method == "POST":
            form = parse_qs(environ["wsgi.input"].read(size).decode("utf-8", "replace"))
            text = form.get("texto", [""])[0].strip()
            result = render_html(one_report(spark, text)).first()["html"] if text else "<p>Escreva um texto.</p>"
        body = PAGE.format(text=escape(text), result=result).encode()
        start(status, [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))])
        return [body]

    return page


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 5000) -> None:
    with make_server(host, port, application(spark)) as server:
        server.serve_forever()
