"""Analysis of ingredient lists: segments, lexicon matches, running declarations, first occurrences.

A document is analysed within its row, without an exchange: its segments are an array expression, and
their declarations, matches and what is unknown come from one pass (``lexicon``) in which each text is
folded and walks an automaton once. A lexicon too large for the workers is joined instead: exact matches are an equi-join of word runs
with the folded phrases; distinct runs of texts without one join on the pieces that ``lexicon`` states.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance
from ..functions import text as X
from .lexicon import FUZZY, FUZZY_LEAST, Lexicon, allowed_edits
from .ordered import running_any

# Fixed value: shortest unknown segment in letters.
UNKNOWN_LEAST = 4
#: Most phrases that are broadcast in joins.
BROADCAST_PHRASES = 200_000


def _declaration(traces: Column, contains: Column) -> Column:
    return F.when(traces, "tracos").when(contains, "contem").otherwise("ingrediente")


def items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: (id, gluten_free_label, items), items an array of (pos, raw, match, declaration, letters) of each segment that is no
    gluten-free claim. Once traces are announced all later segments are traces, else after 'contains' they are contained."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def told(raw: Column) -> Column:
        folded = F.transform(raw, lambda x, i: F.struct(i.alias("pos"), x.alias("raw"), X.fold(x).alias("folded")))
        return F.filter(folded, lambda s: ~s["folded"].rlike(X.CLAIM))

    def placed(segs: Column) -> Column:
        place = lambda marker: F.array_position(F.transform(segs, lambda s: marker(s["folded"])), True)
        return F.struct(segs.alias("segs"), place(X.has_trace_marker).alias("traces"), place(X.has_contains_marker).alias("contains"))

    def declared_items(p: Column) -> Column:
        since = lambda c, i: (p[c] > 0) & (i + 1 >= p[c])
        return F.transform(p["segs"], lambda s, i: F.struct(s["pos"].alias("pos"), s["raw"].alias("raw"), X.match_words(s["folded"]).alias("match"), _declaration(since("traces", i), since("contains", i)).alias("declaration"), X.letters(s["raw"]).alias("letters")))

    # Each step is computed once, as the next names it by a lambda's variable.
    rows = X.once(X.once(told(X.segments(text)), placed), declared_items)
    return docs.select(id_col, X.claims_gluten_free(F.col(text_col)).alias("gluten_free_label"), rows.alias("items"))


def small(df: DataFrame, most: int = BROADCAST_PHRASES) -> DataFrame:
    """df marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if _few(df, most) else df


def declared(segs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds declaration to segments as rows, for keys of any size (items() does it within a document's row)."""
    flags = {"_traces": X.has_trace_marker(F.col("folded")), "_contains": X.has_contains_marker(F.col("folded"))}
    told = running_any(segs, id_col, "pos", flags)
    return told.withColumn("declaration", _declaration(F.col("_traces"), F.col("_contains"))).drop(*flags)


def _runs(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(match, words, run): every run of so many words of each text."""
    words = F.split("match", " ")
    each = texts.select("match", words.alias("w"), F.explode(F.array(*map(F.lit, sizes))).alias("words")).where(F.size("w") >= F.col("words"))
    return each.select("match", "words", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("words") + 1), lambda i: F.array_join(F.slice("w", i, F.col("words")), " "))).alias("run"))


def _pieces(table: DataFrame, fuzzy: float) -> DataFrame:
    """(rank, folded, len, words, d, at, piece): each phrase in one piece more than the edits it may bear."""
    edits = F.floor((1 - fuzzy) * F.col("len") / fuzzy + 1e-9).cast("int")  # a run's length is len / fuzzy at most
    cut = table.where(F.col("len") >= FUZZY_LEAST).withColumn("d", edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    begin, end = F.floor(F.col("i") * F.col("len") / (F.col("d") + 1)), F.floor((F.col("i") + 1) * F.col("len") / (F.col("d") + 1))
    return cut.withColumn("at", begin.cast("int")).withColumn("piece", F.substr("folded", F.col("at") + 1, (end - begin).cast("int"))).drop("i")


def _nearest(runs: DataFrame, table: DataFrame, sizes: list[int], fuzzy: float) -> DataFrame:
    """(run, score, rank) of each distinct run's best phrase of as many words; sizes are the lengths of the pieces."""
    pieces = _pieces(table, fuzzy)
    keyed = runs.select("run", F.col("words").alias("n"), F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.length("run") >= F.col("size"))
    keyed = keyed.select("run", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1), lambda i: F.substr("run", i, F.col("size")))).alias("place", "key"))
    band = F.abs(F.length("run") - F.col("len")) <= F.floor((1 - fuzzy) * F.greatest(F.length("run"), F.col("len")) + 1e-9)
    met = keyed.join(pieces, (F.col("key") == F.col("piece")) & (F.col("n") == F.col("words")) & band & (F.abs(F.col("place") - F.col("at")) <= F.col("d")))
    scored = met.select("run", "rank", "folded").distinct().withColumn("score", distance.levenshtein_ratio(F.col("run"), F.col("folded"))).where(F.col("score") >= fuzzy)
    best = scored.groupBy("run").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank")).alias("b"))
    return best.select("run", (-F.col("b.s")).alias("score"), F.col("b.rank").alias("rank"))


def match_texts(texts: DataFrame, phrases: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """(match, rank, score, method) of the distinct texts (column match) that match.

    Exact: the most specific phrase that stands in the text. Else the best ratio of a run of as many
    words to a phrase, ties by rank (anything that can be ordered). With fuzzy over 1, exact ones only.
    """
    lexicon = Lexicon.of(phrases)
    if lexicon is None:
        return match_by_joins(texts, phrases, fuzzy)
    return lexicon.match(texts, fuzzy).dropDuplicates(["match"])


def match_by_joins(texts: DataFrame, phrases: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """match_texts() for a lexicon of any size."""
    phrases = phrases.select("rank", "folded", "words", "len")
    number, sizes, lengths = phrases.agg(F.count("*"), F.sort_array(F.collect_set("words")), F.sort_array(F.collect_set("len"))).first()  # a few numbers
    table = F.broadcast(phrases) if number <= BROADCAST_PHRASES else phrases
    texts = texts.select("match").where("match <> ''").distinct()
    kind = phrases.schema["rank"].dataType.simpleString()
    if not sizes:
        return texts.limit(0).select("match", F.lit(None).cast(kind).alias("rank"), F.lit(0.0).alias("score"), F.lit("").alias("method"))
    exact = _runs(texts, sizes).join(table, F.col("run") == F.col("folded")).groupBy("match").agg(F.min("rank").alias("rank"))
    exact = exact.select("match", "rank", F.lit(1.0).alias("score"), F.lit("exato").alias("method"))
    if fuzzy > 1:
        return exact
    # The lengths of pieces: see _pieces.
    edits = {n: allowed_edits(n, fuzzy) for n in lengths if n >= FUZZY_LEAST}
    cut = sorted({(i + 1) * n // (d + 1) - i * n // (d + 1) for n, d in edits.items() for i in range(d + 1)})
    if not cut:
        return exact
    rest = _runs(texts.join(exact.select("match"), "match", "left_anti"), sizes)
    near = _nearest(rest.select("run", "words").distinct(), table, cut, fuzzy)
    best = rest.select("match", "run").join(near, "run").groupBy("match").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank")).alias("b"))
    return exact.unionByName(best.select("match", F.col("b.rank").alias("rank"), (-F.col("b.s")).alias("score"), F.lit("difuso").alias("method")))


def _analyzed_by_joins(docs: DataFrame, phrases: DataFrame, allergens: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """analyze() for a lexicon of any size: segments as rows that join what they match. Rows of equal id are told apart by a number."""
    row = F.struct(F.monotonically_increasing_id().alias("n"))
    # Kept, in memory or on disk, as the number must be the same wherever it is read.
    rows = items(docs, id_col, text_col).withColumn("_row", row).persist(StorageLevel.MEMORY_AND_DISK)
    segs = rows.select("_row", F.explode("items").alias("i")).select("_row", "i.*")
    found = match_by_joins(segs, phrases).withColumnRenamed("match", "_text")
    # Texts without letters match nothing: each has a key of its own, so they don't meet in one task.
    key = F.when(F.col("match") != "", F.col("match")).otherwise(F.concat_ws(":", F.lit("\x00"), F.col("_row.n"), F.col("pos")))
    names = allergens.select(F.col("tag").alias("allergen"), F.col("label").alias("allergen_label"))
    out = segs.withColumn("_key", key).join(found, F.col("_key") == F.col("_text"), "left").join(small(phrases.select("rank", "term", "gluten", "allergen", "tag")), "rank", "left").join(small(names), "allergen", "left")
    item = F.struct("pos", "raw", "term", "gluten", "allergen", "allergen_label", "tag", "score", "method", "declaration")
    # The first of each term and declaration; all of an unknown one.
    unknown = F.col("term").isNull() & (F.col("letters") >= UNKNOWN_LEAST)
    first = out.where("term IS NOT NULL").groupBy("_row", "term", "declaration").agg(F.min(item).alias("m")).groupBy("_row").agg(F.array_sort(F.collect_list("m")).alias("matches"))
    rest = out.where(unknown).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("u"))
    every = rows.select(id_col, "_row", "gluten_free_label").join(first, "_row", "left").join(rest, "_row", "left")
    kind = every.schema["matches"].dataType.simpleString()
    return every.select(id_col, "gluten_free_label", F.coalesce("matches", F.array().cast(kind)).alias("matches"), F.coalesce(F.transform("u", lambda x: x["raw"]), F.array().cast("array<string>")).alias("unknown"))


def analyze(docs: DataFrame, phrases: DataFrame, allergens: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: gluten_free_label, matches (array of struct in order), unknown (array of text); all arrays empty for null and
    empty texts. A term counts once in each declaration. Repeated rows and rows of equal id are analysed each; no rows are exchanged."""
    names = allergens.select(F.col("tag").alias("allergen"), F.col("label").alias("allergen_label"))
    lexicon = Lexicon.of(phrases.join(F.broadcast(names), "allergen", "left"), "term", "gluten", "allergen", "allergen_label", "tag") if _few(names) else None
    if lexicon is None:
        return _analyzed_by_joins(docs, phrases, allergens, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return lexicon.analyze(docs.select(id_col, text.alias("text"), X.segments(text).alias("segments")), letters=UNKNOWN_LEAST)


def _few(df: DataFrame, most: int = BROADCAST_PHRASES) -> bool:
    return df.limit(most + 1).count() <= most
