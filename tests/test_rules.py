"""Number checks, citations, payloads and the answer policy against plain Python and worked cases."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import numbers as N
from sparkloom.functions.text import CONTEXT_STOPWORDS, METRIC_TERMS
from sparkloom.operators import policy, recovery, validate


def one(spark, build, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], kinds).select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


# ---- number checks: a second reading of the rules, number by number

NUMBER = re.compile(rf"(?<!\w)({N.ATOM})(?!\w)")


def folded(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def read_numbers(text):
    """Numbers of a text with what is told of them; the texts below have no list numbers, pages or references."""
    out = []
    marks = [m.span() for m in re.finditer(validate.CLAUSE_END, text, re.I)]
    for m in NUMBER.finditer(text):
        s, e = m.span(1)
        lo = max([max(0, s - 140)] + [b for a, b in marks if a >= s - 140 and b <= s])
        hi = min([min(len(text), e + 100)] + [a for a, b in marks if a >= e and b <= e + 100])
        near, head, tail = folded(text[lo:hi]), folded(text[max(0, s - 300) : s]), folded(text[e : e + 24])
        raw = m[1].strip()
        scale = re.match(validate.UNIT_BEHIND, tail)
        unit = "%" if raw.endswith("%") else re.sub(r"\s", "", scale[1]) if scale else next((u for u, names in validate.UNIT_HEADINGS if any(n in head for n in names)), "")
        plain = raw.rstrip("% ").replace("−", "-")
        value = float(plain.replace(".", "").replace(",", ".") if "," in plain else plain)
        words = {w for w in re.findall("[a-z]{3,}", near) if w not in CONTEXT_STOPWORDS or w in METRIC_TERMS}
        falls = bool(words & set(validate.NEGATIVE_WORDS)) or any(x in near for x in validate.NEGATIVE_STEMS)
        signed = -value if falls and value > 0 and (unit == "%" or not 1900 <= value <= 2100) else value
        out.append({"at": s, "raw": raw, "unit": unit, "value": value, "signed": signed, "words": words, "years": set(re.findall(r"\b20\d\d\b", near)), "q": {q for q in validate.QUARTERS if q in near}, "m": set(re.findall("|".join(validate.MONTHS), near))})
    return out


def clash(a, b):
    if a["years"] and b["years"] and not a["years"] & b["years"]:
        return True
    early, after = set(validate.FIRST_QUARTER), set(validate.AFTER_IT)
    return not a["q"] & b["q"] and bool((a["q"] & early and b["m"] & after) or (b["q"] & early and a["m"] & after))


def check_answer(text, sources):
    used, out = set(), {}
    held = [(k, n) for k, t in enumerate(sources) for n in read_numbers(t)]
    for r in read_numbers(text):
        pairs = [(k, n) for k, n in held if n["unit"] == r["unit"] and not clash(r, n) and (n["raw"] == r["raw"] or n["value"] == r["value"] or n["signed"] == r["signed"])]
        pairs = [x for x in pairs if x[1]["raw"] == r["raw"]] or pairs
        metric = set(METRIC_TERMS)
        best = None
        for k, n in pairs:
            shared, both = len(r["words"] & n["words"]), bool(r["words"] & metric and n["words"] & metric)
            if (k, n["at"]) not in used and (shared or both):
                score = 10 * shared + 3 * both + 5 * (n["raw"] == r["raw"])
                if best is None or score > best[0]:
                    best = (score, k, n["at"])
        if best:
            used.add(best[1:])
        out[r["at"]] = best[1:] if best else None
    return out


def test_numbers_compete_for_sources(spark):
    """Made answers of several numbers: units, headings, directions, years, quarters against months, and one source for two mentions."""
    rng = random.Random(17)
    subjects, verbs = ("a taxa de renda", "o valor da produção", "a exportação", "o índice de preços"), ("foi de", "recuou", "cresceu", "caiu para")
    values, units = ("5", "5,0", "12,5", "1.234", "1.234,50", "−3", "7", "2021"), ("%", " mil", " milhões", " p.p.", "", " por cento")
    times = ("", " em 2021", " em 2020", " no primeiro trimestre", " em abril", " em maio de 2021", " no 1T de 2020", " nos 12 meses")

    def sentence():
        return f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(values)}{rng.choice(units)}{rng.choice(times)}"

    def text(n):
        return "".join(sentence().capitalize() + rng.choice((". ", "; ", ", e ", " enquanto ", "\n\n")) for _ in range(n)) + rng.choice(("Em milhares: 7 e 12,5.", "Taxas (%): 5 | 7", "Fim."))

    rows = {i: (text(rng.randint(1, 5)), [text(rng.randint(1, 4)) for _ in range(rng.randint(0, 3))]) for i in range(150)}
    answers = spark.createDataFrame([(i, a) for i, (a, _) in rows.items()], "answer_id int, text string")
    sources = spark.createDataFrame([(i, k, t) for i, (_, ss) in rows.items() for k, t in enumerate(ss)], "answer_id int, source_id int, text string")
    found = {}
    for r in validate.verify_numbers(answers, sources).collect():
        assert r["applicable"] and (r["verified"] or r["source_id"] is None)
        found.setdefault(r["answer_id"], {})[r["start"]] = None if r["source_id"] is None else (r["source_id"], r["source_start"])
    want = {i: x for i, (a, ss) in rows.items() if (x := check_answer(a, ss))}
    assert found == want
    assert sum(v is not None for x in want.values() for v in x.values()) > 60


def test_no_statements_and_periods(spark):
    text = "1. Item um\n2) dois [3] na página 4 e p. 5: valor 6 no 1º trimestre de 2021, abril, nos 12 meses"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    found = {r["raw"]: r for r in validate.number_occurrences(df, ["id"], "text").collect()}
    assert set(found) == {"6", "2021", "12"}
    assert found["6"]["period"] == "1o trimestre, 2021, abril" and found["6"]["twelve_months"] and found["6"]["months"] == ["abril"]


def test_refusals_echo_numbers(spark):
    rows = [
        (1, "Não há dados sobre 12,5% de renda.", "E os 12,5%?"), (2, "A renda foi de 12,5%.", "E os 12,5%?"), (3, "Não há dados sobre 7 mil de renda.", "E os 12,5%?"),
        (4, "Não consta. " + "Palavra longa de renda. " * 20 + "A renda foi de 12,5%.", "E os 12,5%?"), (5, "x " * 200 + "Não consta a renda de 12,5% aqui.", "E os 12,5%?"), (6, None, None),
    ]
    answers = spark.createDataFrame(rows, "answer_id int, text string, question string")
    sources = spark.createDataFrame([(i, 0, "A renda foi de 12,5%.") for i in range(1, 6)], "answer_id int, source_id int, text string")
    assert {r["answer_id"]: (r["applicable"], r["verified"]) for r in validate.verify_numbers(answers, sources).collect()} == {1: (False, False), 2: (True, True), 3: (True, False), 4: (True, True), 5: (False, False)}


def test_derived_numbers(spark):
    answers = spark.createDataFrame([(1, "A renda foi de 10 e de 4. Logo 10 - 4 = 6 e 10 - 4 = 7.")], "answer_id int, text string")
    sources = spark.createDataFrame([(1, 0, "renda de 10"), (1, 1, "renda de 4")], "answer_id int, source_id int, text string")
    found = [(r["raw"], r["verified"], r["derived"]) for r in validate.verify_numbers(answers, sources).orderBy("start").collect()]
    assert ("6", True, True) in found and ("7", False, False) in found


@pytest.mark.parametrize("label, pages", [("3", {"3"}), ("p. 3, 5–7", {"3", "5", "6", "7"}), ("1-200", {"1", "200"}), ("9-7", {"9", "7"}), ("aba: Resumo.", {"resumo"}), (" . ", set()), ("Página 2", {"2"})])
def test_pages(spark, label, pages):
    assert set(one(spark, N.pages_of, label)) == pages


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x (Fonte: A.pdf, p. 2) (**Fonte:** `dir\\B.PDF`, página 1-2) (fonte: b.pdf, p. 3) (Fonte: c.pdf) (Fonte: d.csv, aba: Plan) (Fonte: d.csv, aba outra)"), (2, None)], "answer_id int, text string")
    sources = spark.createDataFrame([(1, "a.pdf", "2"), (1, "dir/b.pdf, z.pdf", "1"), (1, "dir/b.pdf", "2-4"), (1, "d.csv", "Plan"), (1, "", "9"), (1, "nopage.pdf", None)], "answer_id int, file string, page string")
    assert [r["verified"] for r in validate.citation_check(answers, sources).orderBy("position").collect()] == [True, True, True, False, True, False]


@pytest.mark.parametrize(
    "raw, shown",
    [
        ("O pipeline RAG usa embeddings.", recovery.REFUSAL), ("", recovery.REFUSAL), (None, recovery.REFUSAL), ("no entanto, a taxa caiu", "A taxa caiu"), ("A taxa caiu (fonte: x.pdf, p. 2).", "A taxa caiu."),
        ("Fonte: x.pdf\nA taxa subiu.\nPágina 3", "A taxa subiu."), ("A.\n## Fontes:\n- x.pdf\n\n- y\nB.", "A.\n- y\nB."), ("Conforme o documento anual, a renda subiu.", "A renda subiu."), ("Valor de 4. 038 e 2 p. p.", "Valor de 4.038 e 2 p.p."),
        ("Subiu [1; 2].", "Subiu."), ("Alta. " + recovery.REFUSAL, "Alta."), (recovery.REFUSAL, recovery.REFUSAL), ("x  ,  y\n\n\n\n   z ;", "X, y\n\nz"), ("Alta. O dado consta na página 7. Fim.", "Alta. Fim."),
    ],
)
def test_sanitiser(spark, raw, shown):
    assert one(spark, policy.sanitise_answer, raw) == shown


def test_sanitiser_keeps_sources_that_are_asked_for(spark):
    assert one(spark, policy.sanitise_answer, "Alta (fonte: x.pdf).", "Quais são as fontes?") == "Alta (fonte: x.pdf)."
    assert one(spark, policy.sanitise_answer, "Alta (fonte: x.pdf).", "Qual a taxa?") == "Alta."


@pytest.mark.parametrize(
    "payload, ok, columns",
    [
        ('{"rows": [{"b": 1, "a": null}, {"a": "x", "b": 2}]}', None, ["a", "b"]), ('{"rows": [{"a": 1}, {"b": 1}]}', "ragged", None), ('{"linhas": [[1, 2]], "cabecalho": ["x", "y"]}', None, ["x", "y"]), ('{"rows": [[1]]}', "no columns", None),
        ('{"columns": ["a"], "rows": []}', "no rows", None), ("[1]", "no object", None), ('{"columns": ["a"], "rows": [[[1]]]}', "nested", None), ('{"columns": ["a", "a"], "rows": [[1, 2]]}', "columns repeat", None), ('{"columns": ["a"], "rows": [["' + "x" * 5001 + '"]]}', "cell too long", None),
        ('{"columns": ["a"], "rows": [' + ",".join(["[1]"] * 501) + "]}", "too long", None),
    ],
)
def test_payloads(spark, payload, ok, columns):
    df = spark.createDataFrame([(payload,)], "t string").select(policy.json_object(F.col("t")).alias("p"))
    got = policy.tabular_payloads(df, "p").first()
    assert got["reason"] == ok and got["ok"] == (ok is None) and (columns is None or got["columns"] == columns)


@pytest.mark.parametrize("payload, up", [('{"status": "ok"}', True), ("{}", True), ('{"status": "down"}', False), ('{"engine_ready": false}', False), ('{"engine_ready": null}', True), ("[]", False), (None, False)])
def test_health(spark, payload, up):
    assert bool(one(spark, policy.healthy, payload)) is up


def test_numbers_meet_by_value_sign_and_spelling_once(spark):
    """Whatever way two numbers are equal, they are one pair; only equal ones meet: a pair of every two would be 40 000 an answer."""
    said = "A renda foi de 1.000,0. A renda recuou 5. A renda foi de 8. " + " ".join(f"A renda foi de {2000 + 3 * i},5." for i in range(200))
    told = "A renda foi de 1000. A renda foi de -5. " + " ".join(f"A renda foi de {2000 + 3 * i},50." for i in range(200))
    answers = spark.createDataFrame([(1, said)], "answer_id int, text string")
    found = validate.verify_numbers(answers, spark.createDataFrame([(1, "f", told)], "answer_id int, source_id string, text string"))
    rows = found.orderBy("start").collect()
    assert [r["verified"] for r in rows[:3]] == [True, True, False] and all(r["verified"] for r in rows[3:]) and len(rows) == 203
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(i#" in plan and "FlatMapGroupsInPandas" not in plan  # numbers of an answer join by key and pass in batches
