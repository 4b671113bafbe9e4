"""The published Snowball stemmer for Portuguese, once per distinct word.

Suffixes are found by their ends in a table from suffix to class; what is done then depends on the
class and on the regions of the word. Words come in lower case; characters other than letters stand
for consonants, as in the published description.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWELS = frozenset("aeiouáéíóúâêô")

# Fixed values of the published description, by step and class.
STANDARD = {
    "delete": "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância",
    "log": "logia logias",
    "u": "ução uções",
    "ente": "ência ências",
    "amente": "amente",
    "mente": "mente",
    "idade": "idade idades",
    "iva": "iva ivo ivas ivos",
    "ira": "ira iras",
}
VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo "
    "ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis "
    "áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)
RESIDUAL = "os a i o á í ó"


def _table(classes: dict[str, str]) -> dict[str, str]:
    """Suffix to class, in the inner spelling, where a tilde follows its vowel."""
    return {_inner(suffix): name for name, suffixes in classes.items() for suffix in suffixes.split()}


def _inner(word: str) -> str:
    return word.replace("ã", "a~").replace("õ", "o~")


_STANDARD, _VERB, _RESIDUAL = _table(STANDARD), _table({"delete": VERB}), _table({"delete": RESIDUAL})


def _after(word: str, begin: int) -> int:
    """Behind the first non-vowel that follows a vowel, from ``begin`` on."""
    for i in range(begin + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _verb_region(word: str) -> int:
    """Where RV begins: by the second letter, and by the first two if that is a vowel."""
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


def _longest(word: str, table: dict[str, str], region: int) -> tuple[str, str] | None:
    """The longest suffix of the table that ``word`` ends with from ``region`` on, and its class."""
    for begin in range(region, len(word)):
        if word[begin:] in table:
            return word[begin:], table[word[begin:]]
    return None


def _drop(word: str, region: int, *suffixes: str) -> str:
    """``word`` without the first of ``suffixes`` that it ends with, if that lies in the region."""
    for s in suffixes:
        if word.endswith(s):
            return word[: -len(s)] if len(word) - len(s) >= region else word
    return word


def _standard(word: str, rv: int, r1: int, r2: int) -> str:
    found = _longest(word, _STANDARD, 0)
    if not found:
        return word
    suffix, kind = found
    begin = len(word) - len(suffix)
    if kind == "ira":
        return word[:begin] + "ir" if begin >= rv and word[:begin].endswith("e") else word
    if begin < (r1 if kind == "amente" else r2):
        return word
    base = word[:begin]
    if kind == "log":
        return base + "log"
    if kind in ("u", "ente"):
        return base + kind
    if kind == "amente":
        for before in ("iv", "os", "ic", "ad"):
            if base.endswith(before) and len(base) - 2 >= r2:
                base = base[:-2]
                return _drop(base, r2, "at") if before == "iv" else base
        return base
    if kind == "mente":
        return _drop(base, r2, "ante", "avel", "ável", "ível")
    if kind == "idade":
        return _drop(base, r2, "abil", "ic", "iv")
    if kind == "iva":
        return _drop(base, r2, "at")
    return base


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    word = _inner(word)
    rv, r1 = _verb_region(word), _after(word, 0)
    r2 = _after(word, r1)
    out = _standard(word, rv, r1, r2)
    changed = out != word
    if not changed:
        found = _longest(word, _VERB, rv)
        if found:
            out, changed = word[: -len(found[0])], True
    if changed:
        if out.endswith("ci") and len(out) - 1 >= rv:
            out = out[:-1]
    else:
        found = _longest(out, _RESIDUAL, rv)
        if found:
            out = out[: -len(found[0])]
    last = out[-1:]
    if last in ("e", "é", "ê") and len(out) - 1 >= rv:
        out = out[:-1]
        if (out.endswith("gu") or out.endswith("ci")) and len(out) - 1 >= rv:
            out = out[:-1]
    elif last == "ç":
        out = out[:-1] + "c"
    return out.replace("a~", "ã").replace("o~", "õ")


def with_stems(df: DataFrame, term: str, name: str = "stem") -> DataFrame:
    """Adds the stem of each row's term: stemmed once per distinct term and joined back."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    words = df.select(F.col(term).alias("__term")).where(F.col(term).isNotNull()).distinct()
    return df.join(words.select("__term", stems("__term").alias(name)), F.col(term) == F.col("__term"), "left").drop("__term")
