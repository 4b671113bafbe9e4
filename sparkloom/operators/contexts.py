"""What a question's context is made of: blocks by kind, metadata, snippets, excerpts and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOINT = "\n\n---\n\n"
EXCERPT, EXCERPT_MARK, SNIPPET = 4000, "\n\n[Trecho truncado]", 1000
PER_DOCUMENT, PER_DOCUMENT_WHOLE = 4, 8
# Fixed value: what a query of whole coverage carries.
WHOLE_PERIODS = "todos os periodos disponiveis"


def node_label(file: Column, page: Column) -> Column:
    return F.concat(F.lit("Fonte: "), F.coalesce(file, F.lit("?")), F.when(page.isNull(), "").otherwise(F.concat(F.lit(", p./aba "), page.cast("string"))))


def context_block(nodes: DataFrame, question: str) -> DataFrame:
    """(question, context): series first, then tables, then the narrative, of nodes (question, kind, position, file, page, text, structured).

    Kinds: text, graph, table, series. Structured data stand under the distinct labels of their nodes;
    series that gave none are told with the narrative, behind text and graph. Tables that gave none are left out.
    """
    label = node_label(F.col("file"), F.col("page"))
    rank = F.when(F.col("kind") == "text", 0).when(F.col("kind") == "graph", 1).otherwise(2)
    told = nodes.select(question, "kind", rank.alias("rank"), "position", label.alias("label"), "text", F.nullif(F.trim("structured"), F.lit("")).alias("structured"))
    pick = lambda condition, value: F.array_sort(F.collect_list(F.when(condition, F.struct("rank", "position", value.alias("x")))))
    grouped = told.groupBy(question).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("structured"))).alias(f"{k}_data") for k in ("series", "table")],
        *[pick(F.col("kind") == k, F.col("label")).alias(f"{k}_labels") for k in ("series", "table")],
        *[pick(F.col("kind").isin(*ks), F.concat(F.lit("["), F.col("label"), F.lit("]\n"), F.col("text"))).alias(n) for n, ks in (("narrative", ("text", "graph")), ("raw", ("series",)))],
    )  # a question's few nodes
    texts = lambda c: F.transform(c, lambda x: x["x"])
    data = lambda k, title: F.when(F.col(f"{k}_data").isNotNull(), F.concat(F.lit(f"[{title}]\n"), F.array_join(F.transform(F.array_distinct(texts(f"{k}_labels")), lambda x: F.concat(F.lit("["), x, F.lit("]"))), "\n"), F.lit("\n"), F.col(f"{k}_data")))
    parts = F.when(F.col("series_data").isNull(), F.concat(texts("narrative"), texts("raw"))).otherwise(texts("narrative"))
    story = F.when(F.size(parts) > 0, F.concat(F.lit("[Contexto Narrativo dos Documentos]\n"), F.array_join(parts, JOINT)))
    sections = F.filter(F.array(data("series", "Dados de Séries Temporais"), data("table", "Dados Estruturados de Tabelas"), story), lambda x: x.isNotNull())
    return grouped.select(question, F.when(F.size(sections) > 0, F.concat(F.lit("\n\n"), F.array_join(sections, "\n\n"))).otherwise("").alias("context"))


def per_document_cap(query: Column) -> Column:
    """How many nodes of a document a result may have: more where the query asks for all periods."""
    return F.when(F.contains(F.lower(query), F.lit(WHOLE_PERIODS)), PER_DOCUMENT_WHOLE).otherwise(PER_DOCUMENT)


def diversify_by_query(nodes: DataFrame, group: list[str], query: str, source: str, position: str, limit: int) -> DataFrame:
    """Nodes of a group by position, a document's overflow behind, ``limit`` at most; how many a document has first follows the query's wording."""
    own = F.row_number().over(Window.partitionBy(*group, source).orderBy(position))
    over = nodes.withColumn("__own", own).where(F.col("__own") <= max(limit, PER_DOCUMENT_WHOLE)).withColumn("__over", F.col("__own") > per_document_cap(F.col(query)))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__over", position)).cast("long")
    return over.withColumn("place", place).where(F.col("place") <= limit).drop("__own", "__over")


def merged_metadata(told: Column, inferred: Column) -> Column:
    """A field of a table's metadata: what the model told, or what was inferred where that is empty."""
    return F.coalesce(F.nullif(told, F.lit("")), inferred)


def snippet_blocks(text: Column) -> Column:
    """(begin, end, snippet) of the blocks between rules ('---' alone on a line): their offsets, one ahead, and their lines trimmed, without blanks and source lines."""
    whole = F.concat(F.lit("\n"), text, F.lit("\n"))
    blocks = F.split(whole, r"\n[ \t]*---[ \t]*(?=\n)")
    rules = F.regexp_extract_all(whole, F.lit(r"\n[ \t]*---[ \t]*(?=\n)"), F.lit(0))
    none = F.struct(F.lit(0).alias("begin"), F.array().cast("array<struct<begin:int,end:int,snippet:string>>").alias("found"))
    steps = F.arrays_zip(blocks.alias("b"), F.concat(rules, F.array(F.lit(""))).alias("r"))

    def shown(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(F.lower(x), F.lit("fonte:")))
        return F.left(F.array_join(lines, "\n"), F.lit(SNIPPET))

    def add(state: Column, x: Column) -> Column:
        end = state["begin"] + F.length(x["b"])
        block = F.struct(state["begin"].alias("begin"), end.alias("end"), shown(x["b"]).alias("snippet"))
        return F.struct((end + F.length(x["r"])).alias("begin"), F.concat(state["found"], F.array(block)).alias("found"))

    return F.aggregate(steps, none, add)["found"]


def snippet_at(blocks: Column, at: Column) -> Column:
    """The snippet of that of ``snippet_blocks`` which holds offset ``at``."""
    return F.get(F.filter(blocks, lambda b: (at + 1 >= b["begin"]) & (at + 1 < b["end"])), 0)["snippet"]


def table_snippet(text: Column, at: Column) -> Column:
    """The block between rules that holds offset ``at``, as ``snippet_blocks`` shows it. Where a text has many offsets, find its blocks once."""
    return snippet_at(snippet_blocks(text), at)


def excerpt(text: Column) -> Column:
    """The trimmed text, or as much of it as leaves room for a mark."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(bare) <= EXCERPT, bare).otherwise(F.concat(F.rtrim(F.left(bare, F.lit(EXCERPT - len(EXCERPT_MARK)))), F.lit(EXCERPT_MARK)))


def usable_history(messages: DataFrame, role: str, content: str) -> DataFrame:
    """Messages of users and assistants with a text, trimmed; all others go."""
    bare = F.regexp_replace(F.col(content), r"(?U)^\s+|\s+$", "")
    return messages.withColumn(content, bare).where(F.col(role).isin("user", "assistant") & F.col(content).isNotNull() & (F.col(content) != ""))


def is_calendar_year(value: Column) -> Column:
    return F.rlike(F.trim(F.coalesce(value, F.lit(""))), F.lit(r"^(?:18|19|20|21)\d{2}$"))
