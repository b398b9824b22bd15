"""Reports as web pages (a native column) and as word-processor files (zipped XML, batch by batch)."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# The colour that each grade is shown in.
COLOURS = {"Contem Gluten": "#c0392b", "Alto Risco": "#d35400", "Medio Risco": "#b7950b", "Sem Gluten": "#1e8449"}
OTHER = "#555555"


def _items(texts: Column) -> Column:
    return F.concat(F.lit("<ul>"), F.array_join(F.transform(texts, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit("</ul>"))


def render_html(reports: DataFrame, title: Column | str = "Produto") -> DataFrame:
    """Adds html, the report as part of a page; every text of the input is escaped, a null title is Produto."""
    title = F.lit(title) if isinstance(title, str) else title
    esc = lambda c: X.html_escape(c)
    colour = F.lit(OTHER)
    for grade, value in COLOURS.items():
        colour = F.when(F.col("gluten_grade") == grade, value).otherwise(colour)
    sign = lambda r: F.when(r["symbol"] == "X", "❌").when(r["symbol"] == "OK", "✅").otherwise("⚠️")
    row = lambda r: F.concat(F.lit("<tr><td>"), esc(r["ingredient"]), F.lit("</td><td>"), sign(r), F.lit("</td><td>"), esc(r["observation"]), F.lit("</td></tr>"))
    unknown = F.size("unknown")
    parts = [
        F.concat(F.lit("<h1>"), esc(F.coalesce(title, F.lit("Produto"))), F.lit("</h1>")),
        F.concat(F.lit('<p><strong style="color:'), colour, F.lit('">'), esc(F.col("gluten_grade")), F.lit("</strong> · "), esc(F.col("allergen_status")), F.lit("</p>")),
        F.when(F.size("rows") > 0, F.concat(F.lit("<table><tr><th>Ingrediente</th><th>Estado</th><th>Observação</th></tr>"), F.array_join(F.transform("rows", row), ""), F.lit("</table>"))).otherwise("<p>Nenhum ingrediente reconhecido.</p>"),
        F.when(unknown > 0, F.format_string("<p>%d segmento(s) de texto não reconhecido(s).</p>", unknown)),
        F.when(F.size("allergens") > 0, _items(F.transform("allergens", lambda a: esc(F.concat(a["label"], F.lit(" ("), a["declaration"], F.lit(")")))))).otherwise("<p>Nenhum dos 14 alergénios obrigatórios detetado.</p>"),
        _items(F.transform("recommendations", esc)),
    ]
    return reports.withColumn("html", F.concat_ws("\n", *parts))


def _paragraph(text: str, style: str | None = None) -> str:
    # Characters that XML 1.0 can't hold are left out.
    text = "".join(c for c in text if c in "\t\n" or 0x20 <= ord(c) < 0xD800 or 0xE000 <= ord(c) < 0xFFFE or ord(c) > 0xFFFF)
    look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{look}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def _table(rows: list[list[str]]) -> str:
    edge = "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    grid = "<w:tblGrid>" + "<w:gridCol/>" * max(map(len, rows)) + "</w:tblGrid>"
    body = "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(cell)}</w:tc>" for cell in row) + "</w:tr>" for row in rows)
    return f"<w:tbl><w:tblPr><w:tblBorders>{edge}</w:tblBorders></w:tblPr>{grid}{body}</w:tbl>{_paragraph('')}"


def docx(blocks: list[tuple[str, object]]) -> bytes:
    """A word-processor file of blocks ('title' | 'heading' | 'text' | 'item', text) and ('table', rows of texts); equal blocks give equal bytes."""
    style = {"title": "Title", "heading": "Heading1", "text": None, "item": None}
    body = "".join(_table(x) if kind == "table" else _paragraph(f"• {x}" if kind == "item" else x, style[kind]) for kind, x in blocks if x)
    word, package = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    look = lambda name, size: f'<w:style w:type="paragraph" w:styleId="{name}"><w:name w:val="{name}"/><w:rPr><w:b/><w:sz w:val="{size}"/></w:rPr></w:style>'
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kinds}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kinds}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'<w:styles xmlns:w="{word}">{look("Title", 40)}{look("Heading1", 28)}</w:styles>',
        "word/document.xml": f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def render_docx(reports: DataFrame, id_col: str = "doc_id", title: str = "Produto") -> DataFrame:
    """(id, docx binary) of reports, built in the tasks from what the report's columns say."""
    own = reports.select(
        F.col(id_col).alias("id"),
        F.array("gluten_grade", "allergen_status").alias("state"),
        F.transform("rows", lambda r: F.array(r["ingredient"], r["symbol"], r["observation"])).alias("found"),
        F.transform("allergens", lambda a: F.concat(a["label"], F.lit(" ("), a["declaration"], F.lit(")"))).alias("allergens"),
        F.col("recommendations").alias("advice"),
    )
    kind = reports.schema[id_col].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for b in batches:
            files = []
            for state, found, allergens, advice in zip(b["state"], b["found"], b["allergens"], b["advice"], strict=True):
                table = [["Ingrediente", "Estado", "Observação"], *([x or "" for x in r] for r in found)]
                files.append(docx([("title", title), ("heading", "Resumo"), *(("text", x or "") for x in state), ("heading", "Ingredientes"), ("table", table), ("heading", "Alergénios"), *(("item", x) for x in allergens), ("heading", "Recomendações"), *(("item", x) for x in advice)]))
            yield pd.DataFrame({"id": b["id"], "docx": files})

    return own.mapInPandas(run, f"id {kind}, docx binary").withColumnRenamed("id", id_col)
