"""Answer policy: refusals, source choice, routing, quality gates, payloads and what an answer may show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import contains_word

from .recovery import REFUSAL

# Phrases that mark a refusal, for evaluation and for the quality gate.
REFUSALS_EVALUATION = (
    "não consta", "não está disponível", "não foi possível encontr", "não há informação", "não encontr", "não tenho informação", "não está nos documentos", "informação não consta",
    "não fornecem evidência suficiente", "não é possível determinar com segurança",
)
REFUSALS_GATE = ("não consta nos documentos", "não fornecem evidência suficiente", "não é possível determinar com segurança")
# How a question asks for its sources.
SOURCE_REQUESTS = (
    r"\b(?:qual|quais|liste|mostre|informe|indique)\s+(?:(?:foi|foram|[eé]|s[aã]o)\s+)?(?:a\s+|as\s+|o\s+|os\s+)?(?:fontes?|refer[eê]ncias?|documentos?|arquivos?|pdfs?)\b",
    r"\bde onde (?:veio|vem|saiu|foi retirada|foi obtida)\b",
    r"\bonde (?:isso|essa informa[cç][aã]o|esse dado|essa afirma[cç][aã]o) (?:consta|aparece|est[aá])\b",
    r"\borigem (?:da|dessa) informa[cç][aã]o\b",
)
# Words of the labour market, as the skill and as the interpreter of questions look for them.
LABOUR_SKILL = (
    "emprego", "desemprego", "desocupação", "desocupado", "ocupação", "ocupado", "trabalhador", "trabalho", "mercado de trabalho", "informalidade", "informal", "formal", "carteira assinada", "clt",
    "caged", "rais", "pnadc", "pnad contínua", "ped", "remuneração", "salário", "renda do trabalho", "admissão", "desligamento", "saldo de empregos", "vagas", "taxa de desocupação", "taxa de emprego",
    "taxa de informalidade", "pea", "população economicamente ativa", "subocupação", "subutilização", "rotatividade", "turnover", "demissão", "contratação", "setor formal", "setor informal",
    "emprego formal", "emprego informal",
)
LABOUR_INTERPRETER = (
    "emprego", "desemprego", "desocupação", "ocupação", "trabalho", "caged", "rais", "pnad", "pnadc", "ped", "salário", "remuneração", "rendimento", "renda do trabalho", "informalidade", "informal",
    "carteira assinada", "clt", "taxa de desocupação", "saldo de empregos", "rotatividade", "mercado de trabalho", "empregado", "desempregado",
)
# What a classification may hold, and what stands where it holds something else.
ALLOWED = {
    "intent": ("consulta_dado", "comparar", "resumir", "explicar", "verificar"),
    "query_type": ("pontual", "tabular", "temporal", "ampla", "comparativo", "relacional", "multi_hop", "verificacao"),
    "semantic_domain": ("emprego", "pib", "industria", "precos", "comercio", "servicos", "geral"),
    "specificity": ("especifica", "intermediaria", "ampla"),
    "expected_answer": ("numerico", "tabela", "serie", "narrativo", "comparativo"),
    "priority": ("precisao", "abrangencia"),
    "retrieval_need": ("lexical", "semantica", "hibrida"),
    "complexity": ("baixa", "media", "alta"),
}
DEFAULTS = {
    "intent": "consulta_dado", "query_type": "pontual", "semantic_domain": "geral", "specificity": "intermediaria", "expected_answer": "narrativo", "priority": "precisao", "retrieval_need": "hibrida", "complexity": "media",
    "needs_multi_hop": False, "in_scope": True, "confidence": 0.5,
}
# Words that classify a question without a model, in the order in which they are looked for.
COMPARING = ("compare", "comparação", "comparar", "versus", " vs ")
SUMMARISING = ("panorama", "resumo", "resuma", "evolução", "visão geral")
RELATING = ("relaç", "impacto", "influ", "correlaç")
# What each strategy is good for, by its priorities, retrievals and complexities; the keys are ours.
STRATEGIES = (
    ("hybrid", ("pontual", "tabular", "temporal", "relacional"), ("precisao",), ("lexical", "semantica", "hibrida"), ("baixa", "media")),
    ("hierarchical", ("ampla", "comparativo"), ("abrangencia",), ("semantica",), ("baixa", "media")),
    ("tools", ("multi_hop",), ("precisao",), ("hibrida",), ("alta",)),
    ("reflective", ("verificacao",), ("precisao",), ("semantica",), ("media", "alta")),
)
SURE, UNSURE, TIE = 0.75, 0.45, 1.0


def holds_any(text: Column, phrases: Sequence[str]) -> Column:
    """Whether the lower-case text holds one of the phrases; null holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def asks_for_sources(question: Column) -> Column:
    asked = F.coalesce(question, F.lit(""))
    found = F.lit(False)
    for pattern in SOURCE_REQUESTS:
        found = found | F.rlike(asked, F.lit(f"(?iU){pattern}"))
    return found


def chosen_sources(asked: Column, allowed: tuple[str, ...] = ("text", "tables", "timeseries", "graph")) -> Column:
    """Known sources only, in order; text first if it isn't among them; series wherever tables are."""
    known = F.filter(F.coalesce(asked, F.array().cast("array<string>")), lambda s: F.coalesce(s.isin(*allowed), F.lit(False)))
    with_text = F.when(F.array_contains(known, "text"), known).otherwise(F.concat(F.array(F.lit("text")), known))
    return F.when(F.array_contains(with_text, "tables") & ~F.array_contains(with_text, "timeseries"), F.concat(with_text, F.array(F.lit("timeseries")))).otherwise(with_text)


def quality_score(verified: Column, total: Column, sources: Column, refused: Column) -> Column:
    """-1 for a refusal, else ten times the verified share and up to five for sources."""
    ratio = F.when(total > 0, verified / total).otherwise(1.0)
    return F.when(refused, -1.0).otherwise(10 * ratio + F.least(sources, F.lit(5)))


def select_best(responses: DataFrame, question: str, position: str) -> DataFrame:
    """Per question the response of highest ``quality``; those with ``has_error`` only if all have."""
    order = Window.partitionBy(question).orderBy("has_error", F.col("quality").desc(), position)
    return responses.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def classification(payload: Column) -> Column:
    """A classification from an object (a column of ``json_object``): known values stay, others give way to defaults; confidence lies in 0..1."""
    said = lambda name, kind: F.try_variant_get(payload, f"$.{name}", kind)
    typed = lambda name: F.schema_of_variant(F.try_variant_get(payload, f"$.{name}", "variant"))
    fields = [F.when(said(name, "string").isin(*allowed) & (typed(name) == "STRING"), said(name, "string")).otherwise(F.lit(DEFAULTS[name])).alias(name) for name, allowed in ALLOWED.items()]
    fields += [F.when(typed(name) == "BOOLEAN", said(name, "boolean")).otherwise(F.lit(DEFAULTS[name])).alias(name) for name in ("needs_multi_hop", "in_scope")]
    confidence = F.coalesce(said("confidence", "double"), F.lit(DEFAULTS["confidence"]))
    return F.struct(*fields, F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def classify_question(question: Column) -> Column:
    """The fallback without a model: comparisons before summaries before relations; anything else asks for one fact. Confidence is 0.3."""
    rules = [
        (COMPARING, {"query_type": "comparativo", "intent": "comparar", "priority": "abrangencia", "expected_answer": "comparativo"}),
        (SUMMARISING, {"query_type": "ampla", "priority": "abrangencia", "specificity": "ampla", "expected_answer": "narrativo"}),
        (RELATING, {"query_type": "multi_hop", "needs_multi_hop": True, "complexity": "alta"}),
    ]
    rule = F.coalesce(*[F.when(holds_any(question, words), i) for i, (words, _) in enumerate(rules)], F.lit(-1))

    def field(name: str) -> Column:
        value = F.lit(DEFAULTS[name])
        for i, (_, set_) in enumerate(rules):
            if name in set_:
                value = F.when(rule == i, F.lit(set_[name])).otherwise(value)
        return value.alias(name)

    return F.struct(*[field(name) for name in (*ALLOWED, "needs_multi_hop", "in_scope")], F.lit(0.3).alias("confidence"))


def route_scores(questions: DataFrame, id_col: str) -> DataFrame:
    """(id, strategy, score, place): every strategy's fit with every question's ``classification``, a struct; equal scores keep the strategies' order.

    The strategies are a constant of a few rows that each question is exploded by.
    """
    rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(key).alias("strategy"), *[F.array(*map(F.lit, values)).alias(name) for name, values in zip(("good_for", "priority", "retrieval", "complexity"), rest)])
        for i, (key, *rest) in enumerate(STRATEGIES)
    ])
    c = F.col("classification")
    each = questions.select(id_col, "classification", F.explode(rows).alias("s"))
    fits = lambda name, value: F.array_contains(F.col(f"s.{name}"), value).cast("double")
    hops = (c["needs_multi_hop"] & F.array_contains("s.good_for", "multi_hop")).cast("double")
    score = 3 * fits("good_for", c["query_type"]) + 2 * hops + fits("priority", c["priority"]) + fits("retrieval", c["retrieval_need"]) + fits("complexity", c["complexity"])
    scored = each.select(id_col, F.col("s.strategy").alias("strategy"), F.col("s.pos").alias("pos"), score.alias("score"))
    order = Window.partitionBy(id_col).orderBy(F.col("score").desc(), "pos")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).drop("pos")


def route(questions: DataFrame, id_col: str, several: bool = False) -> DataFrame:
    """(id, mode, engines, margin, confidence): the best strategy, two of them (``several``) where the choice is close or unsure, none out of scope."""
    ranked = route_scores(questions, id_col)
    at = lambda column, place: F.max(F.when(F.col("place") == place, F.col(column)))
    two = ranked.groupBy(id_col).agg(at("strategy", 1).alias("first"), at("strategy", 2).alias("second"), (at("score", 1) - at("score", 2)).alias("margin"))
    both = questions.select(id_col, F.col("classification.confidence").alias("sure"), F.col("classification.in_scope").alias("in_scope")).join(two, id_col)
    refused = ~F.col("in_scope") & (F.col("sure") >= SURE)
    close = (F.col("margin") < TIE) | (F.col("sure") < UNSURE)
    mode = F.when(refused, "refuse").when(close & F.lit(several), "multi").otherwise("single_best")
    engines = F.when(mode == "refuse", F.array().cast("array<string>")).when(mode == "multi", F.array("first", "second")).otherwise(F.array("first"))
    confidence = F.when(mode == "refuse", F.col("sure")).otherwise(F.bround(0.6 * F.col("sure") + 0.4 * F.least(F.col("margin") / 3, F.lit(1.0)), 3))
    return both.select(id_col, mode.alias("mode"), engines.alias("engines"), "margin", confidence.alias("confidence"))


def healthy(payload: Column) -> Column:
    """Whether a health report lets calls through: an object whose status is ok or absent and which doesn't deny readiness."""
    report = json_object(payload)
    status = F.coalesce(F.try_variant_get(report, "$.status", "string"), F.lit("ok"))
    return report.isNotNull() & (status == "ok") & F.coalesce(F.try_variant_get(report, "$.engine_ready", "boolean"), F.lit(True))


def failover_order(ranked: DataFrame, tried: DataFrame, health: DataFrame, id_col: str) -> DataFrame:
    """(id, strategy, turn): the strategies that are left to try, by place: not ``tried`` (id, strategy), and healthy in ``health`` (strategy, payload)."""
    up = health.where(healthy(F.col("payload"))).select("strategy")
    left = ranked.join(tried.select(id_col, "strategy"), [id_col, "strategy"], "left_anti").join(up, "strategy", "left_semi")
    return left.select(id_col, "strategy", F.row_number().over(Window.partitionBy(id_col).orderBy("place")).cast("long").alias("turn"))


def match_skills(questions: DataFrame, id_col: str, text_col: str, keywords: Sequence[tuple[str, int, str]], limit: int = 2) -> DataFrame:
    """(id, domain, score, place): domains by whole-word keyword hits, each worth its words; best ``limit``.

    ``keywords`` are (domain, priority, keyword) of a configuration: a short list that each question looks through.
    """
    entries = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(p).alias("priority"), F.lit(w).alias("keyword")) for d, p, w in keywords])
    hits = F.filter(entries, lambda e: contains_word(F.col(text_col), e["keyword"]))
    found = questions.select(id_col, F.explode(hits).alias("h"))
    words = 1 + F.length("h.keyword") - F.length(F.replace(F.col("h.keyword"), F.lit(" "), F.lit("")))
    scored = found.groupBy(id_col, F.col("h.domain").alias("domain"), F.col("h.priority").alias("priority")).agg(F.sum(words).alias("score"))
    order = Window.partitionBy(id_col).orderBy(F.col("score").desc(), F.col("priority").desc(), "domain")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).select(id_col, "domain", F.col("score").cast("long"), "place")


def json_object(raw: Column) -> Column:
    """The text between the first brace and the last, parsed; null unless it is an object."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.nullif(body, F.lit("")))
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed)


# Other names under which payloads bring their rows and their columns.
ROW_NAMES, COLUMN_NAMES = ("rows", "linhas", "registros", "series"), ("columns", "colunas", "cabecalho", "headers")


def tabular_payloads(df: DataFrame, payload: str, max_rows: int = 500, max_columns: int = 50, max_cell: int = 5000) -> DataFrame:
    """Adds ok, reason, columns and rows of an object's column: columns and rows of cells, or rows as objects of the same keys.

    Objects give their own columns, in order of name; their rows need no column list.
    """
    first = lambda names, kind: F.coalesce(*[F.try_variant_get(payload, f"$.{n}", kind) for n in names])
    keys = lambda m: F.array_sort(F.map_keys(m))
    nested = lambda c: F.coalesce(F.rlike(F.schema_of_variant(c), F.lit("^(OBJECT|ARRAY)")), F.lit(False))
    found = df.withColumn("__rows", first(ROW_NAMES, "variant")).withColumn("__given", first(COLUMN_NAMES, "array<string>"))
    found = found.withColumn("__objects", F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get("__rows", "$[0]", "variant")), F.lit("OBJECT")), F.lit(False)))
    found = found.withColumn("__maps", F.when(F.col("__objects"), F.try_variant_get("__rows", "$", "array<map<string, variant>>")))
    found = found.withColumn("columns", F.when(F.col("__objects"), keys(F.col("__maps")[0])).otherwise(F.col("__given")))
    found = found.withColumn("__cells", F.when(F.col("__objects"), F.transform("__maps", lambda m: F.transform(keys(m), lambda k: F.element_at(m, k)))).otherwise(F.try_variant_get("__rows", "$", "array<array<variant>>")))
    found = found.withColumn("rows", F.transform("__cells", lambda r: F.transform(r, lambda c: F.try_variant_get(c, "$", "string"))))
    width = F.size("columns")
    reason = (
        F.when(F.col(payload).isNull(), "no object").when(F.col("__cells").isNull() | (F.size("__cells") == 0), "no rows").when(F.size("__cells") > max_rows, "too long")
        .when(F.col("columns").isNull() | (width == 0), "no columns").when(width > max_columns, "too wide").when(F.size(F.array_distinct("columns")) < width, "columns repeat")
        .when(F.col("__objects") & F.exists("__maps", lambda m: m.isNull() | (keys(m) != F.col("columns"))), "ragged").when(F.exists("__cells", lambda r: r.isNull() | (F.size(r) != width)), "ragged")
        .when(F.exists(F.flatten("__cells"), nested), "nested").when(F.exists(F.flatten("rows"), lambda c: F.length(c) > max_cell), "cell too long")
    )
    return found.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("__rows", "__given", "__objects", "__maps", "__cells")


# What an answer must not show, and what it leaves behind.
INTERNAL = r"\b(?:chunks?|embeddings?|reranking|re-ranking|scores? de similaridade|pontua[cç][aã]o de relev[aâ]ncia|contexto enviado ao modelo|contexto recuperado|documentos? recuperados?|trechos? recuperados?|recupera[cç][aã]o (?:de documentos|sem[aâ]ntica|vetorial)|sistema RAG|pipeline RAG)\b"
SOURCE_SENTENCE = r"(?:^|(?<=[.!?])\s+)(?:\*{0,2})?(?:fonte|fontes|documento|documentos|refer[eê]ncia|refer[eê]ncias)(?:\*{0,2})?\s*:[^\n]*?(?:[.!?](?=\s+[A-ZÁÉÍÓÚÂÊÔÃÕÇ])|$)"
SOURCE_SECTION = r"^\s{0,3}#{1,6}\s*(?:fontes?|refer[eê]ncias?|documentos?)\s*:?\s*$"
SOURCE_BULLET = r"^\s*[-*]\s+.*(?:\.(?:pdf|docx?|xlsx?|xls|csv|tsv|txt)\b|\bp(?:[áa]gina)?\.?\s*:?\s*\d+|\bscore\b).*$"
METADATA_LINE = r"^\s*(?:[-*]\s*)?(?:\*{0,2})?(?:fonte|fontes|documento|documentos|p[áa]gina|p[áa]ginas|aba|abas)(?:\*{0,2})?\s*:?.*$"
SOURCE_REMARKS = (
    r"\s*\(\s*(?:\*{0,2})?(?:fonte|fontes|documento|pdf|arquivo)(?:\*{0,2})?\s*(?::|,).*?\)",
    r"\s*\([^()\n]*\.(?:pdf|docx?|xlsx?|xls|csv|tsv|txt)[^()\n]*\)",
    r"\s*\[(?:\s*\d+(?:\s*[,;]\s*\d+)*\s*|\s*(?:fonte|fontes|documento|pdf|arquivo)\b[^\]]*)\]",
    r"\b(?:segundo|conforme|de acordo com)\s+(?:o|a|os|as)?\s*(?:documento|pdf|arquivo|fonte)s?(?:\s+[^,;:]+)?\s*[,;:]\s*",
    r"(?<![\w.-])[\wÀ-ÿ()_-]+(?:[ _-][\wÀ-ÿ()_-]+)*\.(?:pdf|docx?|xlsx?|xls|csv|tsv|txt)\b",
    r"(?:^|(?<=[.!?])\s+)[^.!?\n]*(?:aparece|consta|encontra-se|est[aá]|veja|consulte)\s+(?:na|no|à|a)?\s*(?:p(?:[áa]gina)?\.?|p\./aba|aba)\s*:?\s*\d+(?:\s*[-–—]\s*\d+)?[^.!?\n]*[.!?]?",
    r"\b(?:p(?:[áa]gina)?\.?|p\./aba|aba)\s*:?\s*\d+(?:\s*[-–—]\s*\d+)?\b",
)
CONNECTIVE = r"^\s*(?:ainda assim|em contrapartida|em compensa[cç][aã]o|no entanto|por[ée]m|contudo|entretanto|todavia|n[aã]o obstante|por outro lado)\s*[,:]\s*"
TIDYING = (
    (r"\(\s*[,;:-]?\s*\)", ""), (r"[ \t]+([,.;:!?])", "$1"), (r"(?<=\d)\.\s+(?=\d{3}(?!\d))", "."), (r"(?iU)(?<![A-Za-zÀ-ÿ])p\.\s+p\.", "p.p."),
    (r"[ \t]{2,}", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \t\n]+", ""), (rf"(?iU){CONNECTIVE}", ""), (r"^[ \t\n,;:-]+|[ \t\n,;:-]+$", ""),
)


def _without_source_lines(text: Column) -> Column:
    """Source sections (a heading and the bullets and blanks below it), lines of metadata and bullets that name files go."""
    section, bullet, metadata = (lambda x, p=p: F.rlike(x, F.lit(f"(?iU){p}")) for p in (SOURCE_SECTION, SOURCE_BULLET, METADATA_LINE))
    lines = F.split(text, r"\r\n|\n|\r")
    none = F.struct(F.lit(False).alias("inside"), F.filter(lines, lambda x: F.lit(False)).alias("kept"))

    def take(state: Column, line: Column) -> Column:
        inside = section(line) | state["inside"] & ((F.trim(line) == "") | bullet(line))
        drops = inside | metadata(line) | bullet(line)
        return F.struct(inside.alias("inside"), F.when(drops, state["kept"]).otherwise(F.concat(state["kept"], F.array(line))).alias("kept"))

    return F.array_join(F.aggregate(lines, none, take)["kept"], "\n")


def sanitise_answer(text: Column, question: Column | None = None) -> Column:
    """What an answer may show: no sentence about the machinery, no source remarks (unless its question asks for them), no refusal
    beside an answer, tidy spacing, no connective that has lost what it answered to, a capital first. Nothing left is the refusal."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s).+?(?:(?<=[.!?])\s+|\z)"), F.lit(0))
    shown = F.array_join(F.filter(pieces, lambda p: ~F.rlike(p, F.lit(f"(?iU){INTERNAL}"))), "")
    bare = _without_source_lines(F.regexp_replace(shown, f"(?iU){SOURCE_SENTENCE}", ""))
    for pattern in SOURCE_REMARKS:
        bare = F.regexp_replace(bare, f"(?iU){pattern}", "")
    out = bare if question is None else F.when(asks_for_sources(question), shown).otherwise(bare)
    refusal = rf"(?iU)\Q{REFUSAL}\E"
    rest = F.regexp_replace(out, refusal, "")
    out = F.when(F.rlike(out, F.lit(refusal)) & ~F.rlike(rest, F.lit(r"(?U)\w")), F.lit(REFUSAL)).otherwise(rest)
    for pattern, to in TIDYING:
        out = F.regexp_replace(out, pattern, to)
    capital = F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.greatest(F.length(out), F.lit(1))))
    return F.when(out == "", F.lit(REFUSAL)).otherwise(capital)
