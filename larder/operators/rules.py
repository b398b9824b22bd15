"""Rules over tags and over analyses: status, grade, allergens, explanations, recommendations, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import knowledge as K

# States of tag rules.
STATES = ["contem", "suspeito", "sem", "desconhecido"]


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tag_status(allergens: Column, ingredients: Column, labels: Column, gluten: list[str] | None = None, ambiguous: list[str] | None = None, free: list[str] | None = None) -> Column:
    """Of comma lists of tags: an allergen or ingredient with gluten, a certified label, an ambiguous ingredient, none; first that holds."""
    tags = X.tag_list(ingredients)
    certified = F.arrays_overlap(X.tag_list(labels), _array(free or K.FREE_LABELS))
    return (
        F.when(F.lower(F.coalesce(allergens, F.lit(""))).contains("en:gluten"), "contem")
        .when(F.arrays_overlap(tags, _array(gluten or K.GLUTEN_TAGS)), "contem")
        .when(certified, "sem")
        .when(F.arrays_overlap(tags, _array(ambiguous or K.AMBIGUOUS_TAGS)), "suspeito")
        .when(F.coalesce(ingredients, F.lit("")) != "", "sem")
        .otherwise("desconhecido")
    )


def trainable(ingredients: Column, status: Column) -> Column:
    """Rows that teach: with ingredients and an informative state."""
    return ingredients.isNotNull() & (status != "desconhecido")


def evaluable(text: Column, allergens: Column) -> Column:
    """Rows that can be evaluated: with a text and a list of allergens that isn't blank."""
    return F.coalesce(text.isNotNull() & (F.trim(allergens) != ""), F.lit(False))


def truth(allergens: Column) -> Column:
    """The independent label: the allergen list names gluten."""
    return F.when(F.lower(F.coalesce(allergens, F.lit(""))).contains("en:gluten"), "contem").otherwise("sem")


def predicted(grade: Column) -> Column:
    """Only a declared gluten grade counts; traces don't."""
    return F.when(grade == "Contem Gluten", "contem").otherwise("sem")


def _where(matches: Column, f) -> Column:
    return F.filter(matches, f)


def _lines(items: Column, template: str, *fields: str) -> Column:
    return F.transform(items, lambda m: F.format_string(template, *(m[x] for x in fields)))


def allergen_entries(matches: Column) -> Column:
    """Array of (label, declaration): each label once in order of first appearance, with its strongest declaration."""
    labelled = F.filter(matches, lambda m: m["allergen_label"].isNotNull())
    names = F.array_distinct(F.transform(labelled, lambda m: m["allergen_label"]))

    def strongest(label: Column) -> Column:
        own = F.transform(F.filter(labelled, lambda m: m["allergen_label"] == label), lambda m: F.when(m["declaration"] == "ingrediente", 2).when(m["declaration"] == "contem", 1).otherwise(0))
        return F.element_at(_array(["tracos", "contem", "ingrediente"]), F.array_max(own) + 1)

    return F.transform(names, lambda x: F.struct(x.alias("label"), strongest(x).alias("declaration")))


def strongest_declaration(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, declaration) of a long table: the strongest declaration of each key, by partial aggregates."""
    order = _array(["tracos", "contem", "ingrediente"])
    strength = F.when(F.col("declaration") == "ingrediente", 2).when(F.col("declaration") == "contem", 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.max(strength).alias("_most")).select(*keys, F.element_at(order, F.col("_most") + 1).alias("declaration"))


def assess(analysis: DataFrame) -> DataFrame:
    """Adds gluten_grade, allergen_status, allergens (array of struct) and reasons (array of text)."""
    m, unknown = F.col("matches"), F.col("unknown")
    gluten = _where(m, lambda x: x["gluten"] == "gluten")
    declared, traces = _where(gluten, lambda x: x["declaration"] != "tracos"), _where(gluten, lambda x: x["declaration"] == "tracos")
    ambiguous = _where(m, lambda x: x["gluten"] == "ambiguous")
    free, some = F.col("gluten_free_label"), lambda a: F.size(a) > 0
    unsure = some(m) & (F.size(unknown) > F.size(m))
    grade = F.when(free, "Sem Gluten").when(some(declared), "Contem Gluten").when(some(traces), "Alto Risco").when(some(ambiguous), "Medio Risco").when(unsure, "Baixo Risco").when(some(m), "Sem Gluten").otherwise("Baixo Risco")
    text = lambda x: F.array(F.lit(x))
    conflict = F.when(some(declared), F.array(F.format_string("Atencao: rotulo sem gluten mas foram detetados cereais com gluten (%s).", F.array_join(F.transform(declared, lambda x: x["term"]), ", ")))).otherwise(F.array().cast("array<string>"))
    why = (
        F.when(free, F.concat(text('Rotulo "sem gluten" presente no texto.'), conflict))
        .when(some(declared), _lines(declared, "'%s' contem gluten (cereal/derivado).", "term"))
        .when(some(traces), _lines(traces, "'%s' presente apenas como possivel traco.", "term"))
        .when(some(ambiguous), _lines(ambiguous, "'%s': origem nao especificada -> risco potencial.", "term"))
        .when(unsure, text("Nenhum ingrediente de risco reconhecido, mas grande parte do texto nao foi interpretada (OCR incompleto)."))
        .when(some(m), text("Ingredientes reconhecidos sem cereais com gluten nem ingredientes ambiguos."))
        .otherwise(text("Texto insuficiente para uma classificacao fiavel."))
    )
    out = analysis.withColumn("allergens", allergen_entries(m)).withColumn("gluten_grade", grade)
    has = F.size("allergens") > 0
    status = F.when(has, "Possui alergenios").when(some(ambiguous), "Possui ingredientes suspeitos").otherwise("Sem alergenios conhecidos")
    also = F.when(has, _lines(F.col("allergens"), "Alergenio '%s' (%s).", "label", "declaration")).when(some(ambiguous), text("Ingredientes ambiguos podem esconder alergenios.")).otherwise(text("Nenhum dos 14 alergenios obrigatorios detetado."))
    return out.withColumn("allergen_status", status).withColumn("reasons", F.concat(why, also))


def explain(assessed: DataFrame) -> DataFrame:
    """Adds rows (array of ingredient, symbol, observation, tag) and the numbers of each symbol."""

    def row(m: Column) -> Column:
        allergen = m["allergen_label"].isNotNull()
        symbol = F.when(m["gluten"] == "gluten", "X").when((m["gluten"] == "ambiguous") | allergen, "?").otherwise("OK")
        base = F.when(m["gluten"] == "gluten", "Contem gluten (cereal ou derivado)").when(m["gluten"] == "ambiguous", "Origem nao especificada: pode conter gluten").otherwise("Sem gluten conhecido")
        named = F.when(allergen, F.concat(F.lit("; alergenio: "), m["allergen_label"])).otherwise("")
        about = F.when(m["method"] == "difuso", F.format_string(" [correspondencia aproximada %.0f%%]", m["score"] * 100.0)).otherwise("")
        suffix = F.when(m["declaration"] == "tracos", " (declarado apenas como possivel traco)").when(m["declaration"] == "contem", ' (na declaracao "contem")').otherwise("")
        return F.struct(m["term"].alias("ingredient"), symbol.alias("symbol"), F.concat(base, named, about, suffix).alias("observation"), m["tag"].alias("tag"))

    out = assessed.withColumn("rows", F.transform("matches", row))
    count = lambda s: F.size(F.filter("rows", lambda r: r["symbol"] == s)).cast("long")
    return out.withColumns({"n_gluten": count("X"), "n_ambiguous": count("?"), "n_safe": count("OK")})


def recommend(explained: DataFrame, ocr_quality: Column | None = None) -> DataFrame:
    """Adds recommendations (array of text) in fixed order."""
    grade = F.col("gluten_grade")
    doubtful = F.array_join(F.transform(F.filter("rows", lambda r: r["symbol"] == "?"), lambda r: r["ingredient"]), ", ")
    by_grade = (
        F.when(grade == "Contem Gluten", "Produto INADEQUADO para celiacos ou intolerantes ao gluten.")
        .when(grade == "Alto Risco", "Pode conter vestigios de gluten: evitar em caso de doenca celiaca ou alergia grave.")
        .when(grade == "Medio Risco", F.format_string("Confirmar a origem dos ingredientes ambiguos (%s) junto do fabricante antes de consumir.", doubtful))
        .when(grade == "Sem Gluten", "Produto aparentemente seguro quanto ao gluten.")
        .otherwise("Sem ingredientes de risco identificados, mas a analise nao foi conclusiva: confirmar no rotulo original.")
    )
    names = lambda traces: F.transform(F.filter("allergens", lambda a: (a["declaration"] == "tracos") == F.lit(traces)), lambda a: a["label"])
    firm, maybe = names(False), names(True)
    quality = F.lit(None).cast("double") if ocr_quality is None else ocr_quality
    every = F.array(
        by_grade,
        F.when(F.size(firm) > 0, F.format_string("Contem alergenios declarados: %s. Inadequado para alergicos a estes.", F.array_join(firm, ", "))),
        F.when(F.size(maybe) > 0, F.format_string("Pode conter vestigios de: %s.", F.array_join(maybe, ", "))),
        F.when(F.size("unknown") > F.size("rows"), "Parte do texto nao foi interpretada (imagem/OCR de baixa qualidade): rever manualmente o rotulo."),
        F.when(quality < 60, F.format_string("Confianca de OCR baixa (%.0f%%): fotografar o rotulo com melhor iluminacao e foco.", quality)),
        F.lit("Em caso de duvida, contactar sempre o fabricante."),
    )
    return explained.withColumn("recommendations", F.filter(every, lambda x: x.isNotNull()))


def report(docs: DataFrame, phrases: DataFrame, allergens: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Everything of one text, from segments to recommendations."""
    from .analysis import analyze

    return recommend(explain(assess(analyze(docs, phrases, allergens, id_col, text_col))))


def _join(items: Column, template: str, *fields: str) -> Column:
    return F.array_join(_lines(items, template, *fields), "\n")


def render_markdown(reports: DataFrame, title: Column | str = "Produto") -> DataFrame:
    """Adds markdown, the whole report as text."""
    title = F.lit(title) if isinstance(title, str) else title
    signs = F.transform("rows", lambda r: F.struct(r["ingredient"].alias("i"), F.when(r["symbol"] == "X", "❌").when(r["symbol"] == "OK", "✅").otherwise("⚠️").alias("s"), r["observation"].alias("o")))
    parts = [
        F.concat(F.lit("# Relatório de análise: "), title, F.lit("\n")),
        F.lit("## Resumo\n"),
        F.concat(F.lit("- **Estado relativo ao glúten:** "), F.col("gluten_grade")),
        F.concat(F.lit("- **Estado de alergénios:** "), F.col("allergen_status"), F.lit("\n")),
        F.lit("## Análise dos ingredientes\n"),
        F.lit("| Ingrediente | Estado | Observação |\n| --- | :---: | --- |"),
        F.nullif(_join(signs, "| %s | %s | %s |", "i", "s", "o"), F.lit("")),
        F.lit("\n## Alergénios detetados\n"),
        F.when(F.size("allergens") > 0, _join(F.col("allergens"), "- %s (%s)", "label", "declaration")).otherwise("- Nenhum dos 14 alergénios obrigatórios (UE) detetado."),
        F.lit("\n## Recomendações\n"),
        F.array_join(F.transform("recommendations", lambda r: F.concat(F.lit("- "), r)), "\n"),
        F.lit(""),
    ]
    return reports.withColumn("markdown", F.concat_ws("\n", *parts))


def render_text(reports: DataFrame, title: Column | str = "Produto") -> DataFrame:
    """Adds plain, the whole report with fixed-width columns."""
    title = F.lit(title) if isinstance(title, str) else title
    rule, thin = "#" * 70, "-" * 78
    rows = F.array_join(F.transform("rows", lambda r: F.format_string("%-28s %-7s %s", F.substring(r["ingredient"], 1, 27), r["symbol"], r["observation"])), "\n")
    unknown = F.size("unknown")
    parts = [
        F.concat(F.lit(f"{rule}\n# RELATORIO DE ANALISE: "), title, F.lit(f"\n{rule}\n")),
        F.concat(F.lit("== RESUMO ==\n  Estado relativo ao gluten : "), F.col("gluten_grade"), F.lit("\n  Estado de alergenios      : "), F.col("allergen_status"), F.lit("\n")),
        F.lit("== ANALISE DOS INGREDIENTES =="),
        F.lit(f"{'Ingrediente':<28} {'Estado':<7} Observacao\n{thin}"),
        F.nullif(rows, F.lit("")),
        F.when(unknown > 0, F.format_string(f"{thin}\n(%d segmento(s) de texto nao reconhecido(s) - ver limitacoes OCR)", unknown)),
        F.lit("\n== ALERGENIOS DETETADOS =="),
        F.when(F.size("allergens") > 0, _join(F.col("allergens"), "  - %s (%s)", "label", "declaration")).otherwise("  Nenhum dos 14 alergenios obrigatorios (UE) detetado."),
        F.lit("\n== RECOMENDACOES =="),
        F.array_join(F.transform("recommendations", lambda r: F.concat(F.lit("  * "), r)), "\n"),
        F.lit(""),
    ]
    return reports.withColumn("plain", F.concat_ws("\n", *parts))


def analysis_table(analysis: DataFrame) -> DataFrame:
    """Adds table: the analysis as fixed-width text."""
    row = lambda m: F.format_string("%-28s %-8s %-22s %-11s %5.0f%% (%s)", F.substring(m["term"], 1, 27), F.when(m["gluten"] == "gluten", "X").when(m["gluten"] == "ambiguous", "?").otherwise("OK"), F.substring(F.coalesce(m["allergen_label"], F.lit("-")), 1, 21), m["declaration"], m["score"] * 100.0, m["method"])
    thin = "-" * 78
    parts = [
        F.when(F.col("gluten_free_label"), 'Rotulo "sem gluten" detetado no texto.'),
        F.lit(f"{'Ingrediente':<28} {'Gluten':<8} {'Alergenio':<22} {'Decl.':<11} Conf.\n{thin}"),
        F.nullif(F.array_join(F.transform("matches", row), "\n"), F.lit("")),
        F.when(F.size("unknown") > 0, F.format_string(f"{thin}\nSegmentos nao reconhecidos: %d", F.size("unknown"))),
    ]
    return analysis.withColumn("table", F.concat_ws("\n", *parts))


def to_json(analysis: DataFrame) -> DataFrame:
    """Adds json: numbers, names and the list of matches of each analysis."""
    items = F.transform("matches", lambda m: F.struct(m["term"].alias("term"), m["gluten"].alias("gluten"), m["allergen"].alias("allergen"), m["tag"].alias("tag"), F.bround(m["score"], 3).alias("score"), m["method"].alias("method"), m["declaration"].alias("declaration")))
    names = lambda kind: F.transform(F.filter("matches", lambda m: m["gluten"] == kind), lambda m: m["term"])
    body = F.struct("gluten_free_label", names("gluten").alias("gluten_ingredients"), names("ambiguous").alias("ambiguous_ingredients"), F.map_from_entries(allergen_entries(F.col("matches"))).alias("allergens"), F.size("matches").alias("n_recognized"), F.size("unknown").alias("n_unknown"), items.alias("ingredients"))
    return analysis.withColumn("json", F.to_json(body, {"ignoreNullFields": "false"}))
