"""Perturbed texts, stems, citations, source notes, chains and recovery against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import sparkloom.plans as plans
from sparkloom.functions import swaps
from sparkloom.functions import text as X
from sparkloom.functions.stemmer import stem, with_stems
from sparkloom.operators import chains, citations, recovery, table_sources
from sparkloom.plans.answers import EVERYDAY

# Pairs that the stemmer's publication lists.
STEMS = (
    "boa boa boainain boainain boas boas bôas bôas boassu boassu boataria boat boate boat boates boat boatos boat bob bob boba bob bobagem bobag bobagens bobagens bobalhões bobalhõ bobear bob bobeira bobeir bobinho bobinh "
    "bobinhos bobinh bobo bob bobs bobs boca boc bocadas boc bocadinho bocadinh bocado boc bocaiúva bocaiúv boçal boçal bocarra bocarr bocas boc bode bod bodoque bodoqu body body boeing boeing boem boem boemia boem boêmio boêmi "
    "boêmios boêmi bogotá bogot boi boi bóia bói boiando boi quiabo quiab quicaram quic quickly quickly quieto quiet quietos quiet quilate quilat quilates quilat quilinhos quilinh quilo quil quilombo quilomb quilométricas quilométr "
    "quilométricos quilométr quilômetro quilômetr quilômetros quilômetr quilos quil quimica quimic quimioterapia quimioterap quimioterápicos quimioteráp quimono quimon quincas quinc quinhão quinhã quinhentos quinhent quinn quinn "
    "quino quin quinta quint quintal quintal quintana quintan quintanilha quintanilh quintão quintã quintessência quintessent quintino quintin quinto quint quintos quint quintuplicou quintuplic quinze quinz quinzena quinzen quiosque quiosqu"
).split()


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "text string").select(build(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("word, root", list(zip(STEMS[::2], STEMS[1::2])))
def test_published_stems(word, root):
    assert stem(word) == root


def test_stems_join_back(spark):
    rows = spark.createDataFrame([(1, "taxas"), (2, "taxa"), (3, None), (4, "taxas"), (5, "")], "i int, term string")
    assert {(r["i"], r["stem"]) for r in with_stems(rows, "term").collect()} == {(1, "tax"), (2, "tax"), (3, None), (4, "tax"), (5, "")}


def test_stemmed_bm25(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", X.content_terms(F.col("text"), 2).alias("t")).collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", X.content_terms(F.col("text"), 2).alias("t")).collect()
    held = {r["doc_id"]: Counter(stem(w) for w in r["t"]) for r in docs if r["t"]}
    mean = sum(c.total() for c in held.values()) / len(held)
    df = Counter(w for c in held.values() for w in c)
    want = {}
    for item in items:
        asked = {stem(w) for w in item["t"]}
        for d, c in held.items():
            s = sum(math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w in asked if c[w])
            if s:
                want[item["item_id"], d] = s
    found = plans.queries()["stemmed_bm25"](spark, small).collect()
    assert all(r["score"] == pytest.approx(want[r["query_id"], r["doc_id"]], abs=2e-6) for r in found)
    per = Counter(q for q, _ in want)
    assert Counter(r["query_id"] for r in found) == {q: min(n, 80) for q, n in per.items()}


def test_swapping_twice_gives_the_text_back(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    twice = docs.select("text", swaps.swap_words(F.col("text"), EVERYDAY).alias("once")).withColumn("twice", swaps.swap_words(F.col("once"), EVERYDAY))
    assert twice.where("lower(twice) <> lower(text)").count() == 0 and twice.where("once <> text").count() > 50


def test_perturbations(spark):
    got = {r["kind"]: r["text"] for r in one(spark, "O emprego cresceu 2,0 p.p., acima da média. Maior alta; malta.", swaps.perturbations)}
    assert got["direcao"] == "O emprego recuou 2,0 p.p., acima da média. Maior queda; malta."
    assert got["comparacao"] == "O emprego cresceu 2,0 p.p., abaixo da média. Menor alta; malta."
    assert got["unidade_escala"].startswith("O emprego cresceu 2,0%, acima") and got["inferencia"].endswith(swaps.CAUSAL)
    assert {r["kind"] for r in one(spark, "Nada muda.", swaps.perturbations)} == {"controle", "inferencia"}
    assert [r["text"] for r in one(spark, "5% e 6%", swaps.perturbations) if r["kind"] == "unidade_escala"] == ["5 p.p. e 6%"]


def walk_citations(text, spans):
    cursor, out = 0, ""
    for start, position, end, value in sorted((s for s in spans if s[0] is not None and s[2] is not None), key=lambda s: (s[0], s[1])):
        if start < 0 or end <= start or end > len(text) or start < cursor or text[start:end] != value:
            continue
        out += text[cursor:start] + f"[{value}](#numeric-citation-{position})"
        cursor = end
    return out + text[cursor:]


def test_links(spark):
    """Random spans over a text with astral characters: overlaps, wrong values, ends beyond the text, nulls."""
    rng = random.Random(8)
    answers, spans, want = [(0, "plain"), (1, None)], [], {0: "plain", 1: None}
    for a in range(2, 30):
        text = "".join(rng.choice("ab𝟛é\n1,5 😀") for _ in range(60))
        own = []
        for k in range(12):
            start = rng.randrange(-2, 60)
            end = start + rng.randrange(0, 9)
            own.append((start, k, end, "zz" if k % 5 == 0 else text[max(start, 0) : max(end, 0)]))
        own += [(None, 90, 3, "a"), (1, 91, None, "a"), (0, 92, 1, None)]
        answers.append((a, text))
        spans += [(a, p, s, e, v) for s, p, e, v in own]
        want[a] = walk_citations(text, own)
    found = citations.link_citations(spark.createDataFrame(answers, "id int, text string"), spark.createDataFrame(spans, "id int, position long, start long, end long, value string"), "id")
    assert {r["id"]: r["text"] for r in found.collect()} == want and sum("](#" in (x or "") for x in want.values()) > 20


def test_source_notes(spark):
    text = "Início\n| a | b |\n|---|---|\n| 1.234,5 | 2020 |\n\nmeio 😀 77\n  | x |\t\r\n|9,9|\nfim"
    answers = spark.createDataFrame([(1, text), (2, "sem tabela"), (3, None), (4, "| 1 linha |\n\ntexto")], "id int, text string")
    sources = spark.createDataFrame(
        [(1, 0, "vale 1.234,5 em 2020", "d/um_a-b.pdf", "3"), (1, 1, "11.234,5 e 1.234,56 e 9,9.", "dois.csv", None), (1, 2, "nada", "três.txt", ""), (2, 0, "1.234,5", "x.pdf", "1")], "id int, source_id int, text string, file string, page string"
    )
    at = text.index("1.234,5")
    checks = spark.createDataFrame([(1, at, at + 7, True, 2), (1, text.index("77"), text.index("77") + 2, True, 1), (1, text.index("9,9"), text.index("9,9") + 3, False, 2)], "id int, start long, end long, verified boolean, source_id int")
    notes = table_sources.source_notes(answers, checks, sources, "id")
    shown = {r["id"]: r["text"] for r in table_sources.insert_notes(answers, notes, "id").collect()}
    first, second = "\n\n*Fonte: três; um a b, p. 3.*", "\n\n*Fonte: dois.*"
    assert shown == {1: text.replace("| 1.234,5 | 2020 |", "| 1.234,5 | 2020 |" + first).replace("|9,9|", "|9,9|" + second), 2: "sem tabela", 3: None, 4: "| 1 linha |\n\ntexto"}
    moved = sorted((r["start"], r["end"]) for r in table_sources.shift_spans(checks, notes, "id").collect())
    assert [shown[1][s:e] for s, e in moved] == ["1.234,5", "77", "9,9"]


def test_trimming(spark):
    text = "Primeira frase boa. Segunda sem apoio! Terceira com 5 sem apoio.\n# Título\nSegunda sem apoio"
    gone = F.array(F.lit("Segunda sem apoio!"), F.lit("Terceira com 5 sem apoio."), F.lit("Segunda sem apoio"))
    at = text.index("5")
    span = F.array(F.struct(F.lit(at).alias("start"), F.lit(at + 1).alias("end")))
    assert one(spark, text, lambda c: recovery.trim_unsupported(c, gone, span)) == "Primeira frase boa. Terceira com 5 sem apoio.\n# Título\n"
    assert one(spark, "Segunda sem apoio!", lambda c: recovery.trim_unsupported(c, gone, span)) == ""


def test_chain_outcomes(spark):
    rows = [
        (1, 0, "a", "text", None, "t"), (2, 0, "b", "table", "", "v 5"), (2, 1, "b", "table", "", "again"), (2, 2, "c", "table", "por setor", "v  5"), (2, 3, "d", "table", "Mensal", "9"), (3, 0, "e", "table", "", "none"),
        (4, 0, "f", "table", "mensal", "7"), (5, 0, "g", "table", "anual", "em 2020: 7"),
    ]
    df = spark.createDataFrame(rows, "q int, position int, node_id string, type string, granularity string, text string")
    digits = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), " ")
    static = {r["q"]: (r["outcome"], r["nodes"], r["structured"]) for r in chains.structured_chain(df, "q", False, digits).collect()}
    assert static == {1: ("none", None, None), 2: ("text", ["b"], "5"), 3: ("nodes", ["e"], None), 4: ("none", None, None), 5: ("none", None, None)}
    series = {r["q"]: (r["outcome"], r["nodes"], r["structured"]) for r in chains.structured_chain(df, "q", True, digits).collect()}
    assert series == {1: ("none", None, None), 2: ("nodes", ["d"], None), 3: ("none", None, None), 4: ("nodes", ["f"], None), 5: ("text", ["g"], "2020 7")}


def walk_recovery(coverage, first, second, third):
    """The policy step by step; an attempt is (refused, sourced, length, sentences, numbers, proven, unsupported, named)."""
    lacking = lambda a: a[4] - a[5]
    score = lambda a: (a[3], a[4], a[2])
    recovered = bool(lacking(first) or first[6] or (first[0] and first[1]) or (coverage and (first[3] < 2 or (first[4] < 4 and first[2] < 500))))
    held, name, refused_again = first, "first", False
    if recovered:
        refused_again = second[0]
        prefer = first[0] and not second[0]
        prefer = prefer or (not lacking(second) and not second[6] and (second[4] or first[6]))
        prefer = prefer or (second[5] > first[5] and lacking(second) <= lacking(first) and second[6] <= first[6])
        if prefer and (not coverage or score(second) >= score(first)):
            held, name = second, "second"
    again = (held[0] or (held[6] and not held[4])) and not (held[0] and refused_again)
    if again:
        full = not third[0] and not lacking(third) and not third[6]
        if (full or (third[4] and not lacking(third))) and (third[4] or not held[5]):
            name = "third"
        elif not held[5] and not third[0] and not third[4] and third[1] and third[7]:
            name = "names"
    return recovered, bool(again), name


def test_recovery(spark):
    rng = random.Random(2)

    def attempt():
        numbers = rng.choice((0, 0, 1, 3, 5))
        return (rng.random() < 0.4, rng.random() < 0.5, rng.choice((100, 600)), rng.choice((1, 2, 5)), numbers, rng.randint(0, numbers), rng.choice((0, 0, 1, 2)), rng.random() < 0.5)

    rows = [(i, rng.random() < 0.4, attempt(), attempt(), attempt()) for i in range(1500)]
    kinds = f"struct<{recovery.FIELDS.replace(' ', ':').replace(',:', ',')}>"
    df = spark.createDataFrame(rows, f"id int, coverage boolean, first {kinds}, second {kinds}, third {kinds}")
    found = {r["id"]: (r["recovered"], r["resynthesised"], r["chosen"]) for r in recovery.choose(df, "id", "coverage").collect()}
    assert found == {i: walk_recovery(*rest) for i, *rest in rows}
    assert set(c for *_, c in found.values()) == {"first", "second", "third", "names"}


@pytest.mark.parametrize("question, whole", [("Quais regiões cresceram?", True), ("compare os setores", True), ("Evolução por trimestre", True), ("setores com maior dinamismo", True), ("Qual a taxa?", False), ("Mostre tudo", False), (None, False)])
def test_coverage_questions(spark, question, whole):
    assert one(spark, question, recovery.wants_coverage) is whole


def test_levels(spark):
    rows = [(1, 2, "0", "b"), (1, 1, None, "a"), (1, 3, "2", "s"), (1, 4, "-3", "c"), (1, 5, "1", " "), (2, 1, "x", "")]
    found = chains.level_context(spark.createDataFrame(rows, "q int, position int, level string, text string"), "q").collect()
    assert [(r["q"], r["levels"]) for r in found] == [(1, 2)] and found[0]["context"] == "[Resumos automáticos — nível 2]\ns\n\n[Trechos originais (nível 0)]\na\n\n---\n\nb\n\n---\n\nc"
