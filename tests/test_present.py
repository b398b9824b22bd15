"""Files over HTTP, pages, documents, charts and commands: against plain statements of what they hold."""

import http.server
import io
import threading
import urllib.error
import xml.dom.minidom
import zipfile
from urllib.parse import quote_plus

import pytest
from larder.__main__ import main, say
from larder.operators import metrics as M
from larder.present import charts, documents, web
from larder.sources import images
from larder.sources.files import fetch_file

BODY = bytes(range(256)) * 1000


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        short = self.path == "/short"
        self.send_response(200 if self.path in ("/body", "/short") else 404)
        self.send_header("Content-Length", str(len(BODY) + (5 if short else 0)))
        self.end_headers()
        if self.path != "/none":
            self.wfile.write(BODY)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(site, tmp_path):
    out, told = tmp_path / "a" / "body", []
    assert fetch_file(f"{site}/body", str(out), chunk=1000, progress=lambda *x: told.append(x), every=0.0)
    assert out.read_bytes() == BODY and told[-1][:2] == (len(BODY), len(BODY)) and len(told) > 100
    out.write_bytes(b"mine")
    assert not fetch_file(f"{site}/body", str(out), keep=True) and out.read_bytes() == b"mine"
    for name, error in (("none", urllib.error.HTTPError), ("short", OSError)):
        with pytest.raises(error):
            fetch_file(f"{site}/{name}", str(tmp_path / name))
        assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_html_and_docx(spark):
    text = "farinha de trigo, <b>sal</b>, leite, zzzzqqqq & kkkk"
    html = documents.render_html(web.one_report(spark, text), "A <b> & c").first()
    assert "<h1>A &lt;b&gt; &amp; c</h1>" in html["html"] and "Contem Gluten" in html["html"] and "<b>" not in html["html"]
    assert html["html"].count("<tr>") == 1 + len(html["rows"]) and all(f"<li>{r}</li>" in html["html"] for r in html["recommendations"])
    got = documents.render_docx(web.one_report(spark, text)).first()
    assert got["doc_id"] == 1
    with zipfile.ZipFile(io.BytesIO(got["docx"])) as z:
        parts = {n: xml.dom.minidom.parseString(z.read(n)) for n in z.namelist()}
    said = [t.firstChild.data for t in parts["word/document.xml"].getElementsByTagName("w:t") if t.firstChild]
    assert "Contem Gluten" in said and all(f"• {r}" in said for r in html["recommendations"])
    assert len(parts["word/document.xml"].getElementsByTagName("w:tr")) == 1 + len(html["rows"])


def test_docx_of_odd_texts():
    made = documents.docx([("title", ""), ("text", "a\x00<&\ud800"), ("table", [["x"], ["y\x0b"]])])
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        body = z.read("word/document.xml").decode()
    xml.dom.minidom.parseString(body)
    assert "a&lt;&amp;<" in body and made == documents.docx([("title", ""), ("text", "a\x00<&\ud800"), ("table", [["x"], ["y\x0b"]])])


def test_empty_reports(spark):
    for text in ("", None):
        assert "Nenhum ingrediente" in documents.render_html(web.one_report(spark, text)).first()["html"]


def test_charts(spark, tmp_path):
    df = spark.createDataFrame([("a & b", 3), ("c", 1), ("d", None), (None, 4)], "l string, v int")
    svg = charts.bar_chart(df, "l", "v", "T <1>", k=3)
    picture = xml.dom.minidom.parseString(svg)
    assert [r.getAttribute("width") for r in picture.getElementsByTagName("rect")] == ["360.00", "270.00", "90.00"]
    pie = xml.dom.minidom.parseString(charts.pie_chart(df, "l", "v", "T"))
    assert len(pie.getElementsByTagName("path")) == 3 and "37.5%" in pie.toxml()
    assert len(xml.dom.minidom.parseString(charts.pie_chart(df.where("v = 3"), "l", "v", "T")).getElementsByTagName("circle")) == 1
    for chart in (charts.bar_chart, charts.pie_chart):
        xml.dom.minidom.parseString(chart(df.limit(0), "l", "v", "T"))
    charts.save_figure(svg, str(tmp_path / "x" / "f.svg"))
    assert (tmp_path / "x" / "f.svg").read_text() == svg


def ask(app, method, body=b"", size=None):
    status = []
    out = app({"REQUEST_METHOD": method, "CONTENT_LENGTH": str(len(body) if size is None else size), "wsgi.input": io.BytesIO(body)}, lambda s, h: status.append(s))
    return status[0], b"".join(out).decode()


def test_page(spark):
    app = web.application(spark)
    assert ask(app, "GET")[1].count("<form") == 1
    status, page = ask(app, "POST", ("texto=" + quote_plus("cevada, <i>sal")).encode())
    assert status == "200 OK" and "Contem Gluten" in page and "cevada, &lt;i&gt;sal</textarea>" in page
    assert "Escreva um texto" in ask(app, "POST", b"texto=+")[1]
    assert ask(app, "DELETE")[0].startswith("405") and ask(app, "POST", size=web.MOST + 1)[0].startswith("413")


def test_commands(spark, tmp_path, capsys, site):
    main(["report", "trigo, sal"], spark)
    main(["analyse", "trigo, sal"], spark)
    main(["fetch", f"{site}/body", str(tmp_path / "f"), "--keep"])
    main(["fetch", f"{site}/body", str(tmp_path / "f"), "--keep"])
    dump = tmp_path / "d.tsv"
    dump.write_text("code\tcountries_tags\tallergens\n1\ten:portugal\ten:milk,en:soy\n2\ten:france\ten:milk\n")
    with pytest.warns(UserWarning):
        main(["filter", str(dump), str(tmp_path / "out")], spark)
        main(["chart", str(dump), str(tmp_path / "c.svg")], spark)
    said = capsys.readouterr().out
    assert "Contem Gluten" in said and "is there already" in said and "1 of 2 rows" in said
    assert (tmp_path / "c.svg").read_text().index("en:milk") < (tmp_path / "c.svg").read_text().index("en:soy")


def test_say():
    raw = io.BytesIO()
    out = io.TextIOWrapper(raw, encoding="ascii")
    say("glúten ✅", out)
    out.flush()
    assert raw.getvalue() == b"gl?ten ?\n"


def test_present_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    lines = M.present(M.confusion_matrix(df, "t", "p")).split("\n")
    assert [x.split() for x in lines[1:]] == [["a", "0.6667", "1.0000", "0.5000", "0.6667"], ["b", "0.6667", "0.5000", "1.0000", "0.6667"]]


def test_recogniser(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", "")
    with pytest.raises(RuntimeError):
        images.locate_recogniser([str(tmp_path / "no")])
    (tmp_path / "t").write_text("")
    assert images.locate_recogniser([str(tmp_path / "no"), str(tmp_path / "t")]) == str(tmp_path / "t")
    for name in ("por", "eng"):
        (tmp_path / f"{name}.traineddata").write_text("")
    assert images.languages(str(tmp_path)) == ["eng", "por"] and images.languages(str(tmp_path / "gone")) == []
