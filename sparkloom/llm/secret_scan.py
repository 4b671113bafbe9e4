"""Secret scans: candidates from whole texts, false positives removed by a random forest.

Candidates are all values assigned to a secret-sounding name, whatever their length and characters,
and all runs of key-like characters that hold a digit or are long. Features: length, entropy,
character transitions (log-probability under letter pairs of the corpus), dictionary coverage (by the
corpus's commonest words), shape, the path the text came from, and the neighbouring words on both
sides. Words and letter pairs are counted over all documents in Spark; the dictionary keeps the
``LEXICON_WORDS`` commonest. The forest is trained on labelled findings: a table (value, before,
after, path, label) of which up to ``EXAMPLES`` rows are used, or else findings made from public
formats of keys and of their look-alikes in sentences of the corpus's own words.

Null and empty texts have no findings; texts of any length are read whole. Offsets are code points
into the text. Rows that repeat an id are scanned row by row; a null id stays null. Paths may be
null. An empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut
from .textkernel import chunks, word_spans

#: Labelled findings that are used, the forest's size, and the words of the dictionary.
EXAMPLES, TREES, DEPTH, LEXICON_WORDS = 6000, 40, 10, 50_000
THRESHOLD = 0.5
#: Runs of key-like characters: the least length with a digit, and without.
MIN_LENGTH, MIN_LETTERS = 8, 20
_CONTEXT = 48
#: What the letter pairs of the corpus weigh together, so that the features don't follow its size.
_PAIR_MASS = 1_000_000

# Names before a secret, words before harmless look-alikes, and placeholders.
_SECRET_WORDS = frozenset(
    "password passwd pwd pass passphrase secret token apikey api key auth authorization bearer credential credentials private access client aws login pin".split()
)
_HARMLESS_WORDS = frozenset(
    "commit sha sha1 sha256 md5 checksum digest hash uuid guid version release id ip host phone tel fax mail email card order invoice ticket issue date time isbn doi color build revision".split()
)
_PLACEHOLDERS = ("example", "changeme", "your", "placeholder", "dummy", "sample", "xxxx", "1234567", "test", "todo", "redacted", "****", "${", "{{", "environ", "getenv")
_TEST_PATHS = ("test", "example", "sample", "fixture", "doc", "mock")

_KEY_BYTE = np.zeros(256, dtype=bool)
_KEY_BYTE[[ord(c) for c in string.ascii_letters + string.digits + "_+/=.~$@:-!#%^&*"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_ASSIGN = re.compile(r"([A-Za-z_][\w.\-]*)[\"'\]]?\s*(?::=|=>|[=:])\s*[\"'`]?$")
_NAME = re.compile(rb"([A-Za-z_][\w.\-]*)[\"'\]]?[ \t]{0,3}$")
_VALUE = re.compile(r"([=>]?[ \t]{0,3}(?:(?:Bearer|Basic|Token)[ \t]+)?)(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|([^\s\"'`]+))")
_SPLIT = re.compile(r"^([A-Za-z_][\w.\-]*?)(?::=|=|:)(?=[^=:/])(.+)$")
_WORD = re.compile(r"[A-Za-z0-9]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLASSES = {c: i for i, c in enumerate(string.ascii_lowercase)} | {c: 26 for c in string.digits} | {c: 27 for c in string.ascii_uppercase}
_SYMBOL, _N = 28, 29

FEATURES = (
    "length", "entropy", "digits", "capitals", "distinct", "hex", "transition", "worst_transition", "coverage", "slashes", "dots", "at", "alternations",
    "assigned", "secret_word", "harmless_word", "placeholder", "test_path", "symbols", "numeric", "blanks", "known_before", "known_after",
)


@dataclass(frozen=True)
class Finding:
    value: str
    before: str
    after: str
    path: str
    label: int = 0


def _classes(text: str) -> list[int]:
    return [_CLASSES.get(c, _SYMBOL) for c in text]


def _name_parts(name: str) -> set[str]:
    """The words of a variable name, and the name as one word."""
    return {p.lower() for p in _PARTS.findall(name)} | {p for p in re.split(r"[_\W]+", name.lower()) if p}


@dataclass
class Lexicon:
    """Common words and letter pairs of a corpus."""

    words: frozenset[str]
    pairs: dict[str, float]
    transitions: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self._fill([])

    def _fill(self, harmless: list[str]) -> None:
        counts = np.full((_N, _N), 0.5)
        total = sum(self.pairs.values()) or 1.0
        for pair, n in self.pairs.items():
            a, b = _classes(pair)
            counts[a, b] += n * _PAIR_MASS / total
        for value in harmless:
            c = _classes(value)
            np.add.at(counts, (c[:-1], c[1:]), 1)
        self.transitions = np.log(counts / counts.sum(axis=1, keepdims=True))

    def learn(self, findings: list[Finding]) -> Lexicon:
        """Transitions between other characters, from findings labelled harmless."""
        self._fill([f.value for f in findings if not f.label])
        return self

    def coverage(self, value: str) -> float:
        """Share of the characters that known words cover; longest word first at each place."""
        low, covered, at = value.lower(), 0, 0
        while at < len(low):
            for n in range(min(16, len(low) - at), 2, -1):
                if low[at : at + n] in self.words:
                    covered += n
                    at += n
                    break
            else:
                at += 1
        return covered / max(1, len(low))

    def features(self, f: Finding) -> list[float]:
        v, n = f.value, max(1, len(f.value))
        c = _classes(v)
        steps = self.transitions[c[:-1], c[1:]] if len(c) > 1 else np.zeros(1)
        seen = Counter(v)
        near, then = ([w.lower() for w in _WORD.findall(x)] for x in (f.before, f.after))
        near, then = near[-4:], then[:4]
        assigned = _ASSIGN.search(f.before)
        parts = set(near) | (_name_parts(assigned[1]) if assigned else set())
        kinds = [0 if x < 26 else x for x in c]
        low = v.lower()
        known = lambda words: sum(w in self.words for w in words) / max(1, len(words))
        return [
            float(n), -sum(k / n * math.log2(k / n) for k in seen.values()), sum(ch.isdigit() for ch in v) / n, sum("A" <= ch <= "Z" for ch in v) / n,
            len(seen) / n, float(re.fullmatch(r"[0-9a-fA-F]+", v) is not None and any(ch.isalpha() for ch in v)), float(steps.mean()), float(steps.min()),
            self.coverage(v), v.count("/") / n, v.count(".") / n, float("@" in v), sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
            float(assigned is not None), float(bool(parts & _SECRET_WORDS)), float(bool(parts & _HARMLESS_WORDS)),
            float(any(p in low for p in _PLACEHOLDERS) or len(seen) <= 2), float(any(p in f.path.lower() for p in _TEST_PATHS)), sum(x == _SYMBOL for x in c) / n,
            float(re.fullmatch(r"[\d.\-+:/]+", v) is not None), v.count(" ") / n, known(near), known(then),
        ]


def corpus_lexicon(df: DataFrame, text_col: str, words: int = LEXICON_WORDS) -> Lexicon:
    """The commonest words, ``words`` at most, and the letter pairs of all texts; counted in Spark, of bounded size here.

    The least count of a common word comes from the number of words of each count, so that no task
    sends its own list; words of a count that would exceed the bound are all left out.
    """
    found = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit("[a-z]{3,24}"), F.lit(0))
    counts = cut(df.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("words").over(Window.orderBy(F.col("n").desc()))  # a row per distinct count
    least = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("upto", upto).where(F.col("upto") <= words).agg(F.min("n").alias("n")).first()["n"]
    top = counts.where(F.col("n") >= least).collect() if least is not None else []
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair")
    letters = counts.select(pairs, "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 676 rows at most
    return Lexicon(frozenset(r["word"] for r in top), {r["pair"]: float(r["n"]) for r in letters})


def example_findings(words: list[str], count: int = EXAMPLES, seed: int = 10) -> list[Finding]:
    """Labelled findings in public formats of secrets and of their look-alikes, between ``words``; half of each."""
    rng = random.Random(seed)
    words = words or ["word"]
    hexa, digits, letters = "0123456789abcdef", string.digits, string.ascii_lowercase
    alnum, base64 = string.ascii_letters + digits, string.ascii_letters + digits + "+/"

    def word() -> str:
        return rng.choice(words)

    def draw(chars: str, least: int, most: int = 0) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.randint(least, most or least)))

    def prose(most: int) -> str:
        return " ".join(word() for _ in range(rng.randint(0, most)))

    def lead(names: tuple[str, ...]) -> str:
        """An assignment in one of the usual notations."""
        name = rng.choice(names)
        if rng.random() < 0.5:
            name = rng.choice((f"{word()}_{name}", name.upper(), f"{word().upper()}_{name.upper()}", word() + name.title()))
        return name + rng.choice(("=", ": ", " = ", ' = "', "='", '": "', ":", ' => "'))

    secret_names = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "pin", "passphrase", "credentials")
    plain_names = ("commit", "checksum", "id", "uuid", "version", "digest", "order", "session", "build", "etag", "name", "url", "path", "color", "phone", "date", "size", "count")
    password = lambda: rng.choice((
        word().title() + draw("!#$%&*?", 1) + draw(digits, 2, 4) + word(), draw(alnum + "!#$%&*?-_", 8, 20), draw(letters, 9, 16), draw(string.ascii_uppercase, 8, 16),
        draw(alnum, 8, 14), word() + draw(digits, 3, 5) + draw("!?.#", 1),
    ))
    assigned = (password, password, lambda: draw(hexa, 16, 64), lambda: draw(alnum, 16, 48), lambda: draw(base64, 20, 64) + rng.choice(("", "=", "==")), lambda: draw(digits, 4, 8), lambda: draw(alnum + "-_", 24, 60))
    known = (
        lambda: rng.choice(("AKIA", "ASIA")) + draw(string.ascii_uppercase + digits, 16), lambda: rng.choice(("ghp_", "gho_", "ghs_")) + draw(alnum, 36), lambda: "glpat-" + draw(alnum + "-_", 20),
        lambda: rng.choice(("sk", "rk", "pk")) + rng.choice(("_live_", "_prod_")) + draw(alnum, 24), lambda: "sk-" + draw(alnum, 48), lambda: rng.choice(("xoxb-", "xoxp-", "xoxa-")) + draw(digits, 10, 13) + "-" + draw(alnum, 24),
        lambda: "AIza" + draw(alnum + "-_", 35), lambda: rng.choice(("npm_", "hf_", "pypi-")) + draw(alnum, 34, 40), lambda: f"SG.{draw(alnum, 22)}.{draw(alnum, 43)}",
        lambda: f"eyJ{draw(alnum, 20, 40)}.eyJ{draw(alnum, 30, 60)}.{draw(alnum + '-_', 43)}", lambda: draw(alnum, 32, 64), lambda: draw(base64, 40) + "=",
    )
    holders = (
        lambda: "changeme", lambda: f"your-{word()}-here", lambda: f"<{word()}>", lambda: "*" * rng.randint(4, 12), lambda: "x" * rng.randint(4, 16), lambda: "${" + word().upper() + "}", lambda: "{{ " + word() + " }}",
        lambda: rng.choice(("None", "null", "true", "false", "example", "test123", "placeholder", "REDACTED", "TODO")), lambda: f"os.environ['{word().upper()}']", lambda: f"get_{word()}()", word, word, lambda: f"{word()},", lambda: f"{word()} {word()} {word()}",
    )
    group = lambda sizes, mark, chars=hexa: mark.join(draw(chars, n) for n in sizes)
    harmless = (
        lambda: draw(hexa, 40), lambda: draw(hexa, 64), lambda: draw(hexa, 32), lambda: group((8, 4, 4, 4, 12), "-"), lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: f"{word()}{rng.choice(('.', '_', ''))}{rng.choice((word(), draw(digits, 1, 4)))}@{word()}{rng.choice(('.com', '.org', '.net', '.io', '.co.uk'))}",
        lambda: rng.choice(("+", "", "00")) + group((2, 3, 3, 4), rng.choice(("-", ".", "")), digits), lambda: group((3, 4, 4), "-", digits), lambda: draw(digits, 8, 19), lambda: group((4, 4, 4, 4), rng.choice(("-", "")), digits),
        lambda: f"{rng.randint(0, 30)}.{rng.randint(0, 40)}.{rng.randint(0, 99)}" + rng.choice(("", "-rc1", "-beta.2", "+build7")), lambda: f"{rng.randint(1950, 2060)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}" + rng.choice(("", f"T{rng.randint(10, 23)}:{rng.randint(10, 59)}:00")),
        lambda: f"/{word()}/{word()}/{word()}.{draw(hexa, 8)}.{rng.choice(('js', 'css', 'png'))}", lambda: f"https://{word()}.{rng.choice(('org', 'com'))}/{word()}/{draw(digits, 3, 8)}?{word()}={draw(digits, 1, 4)}",
        lambda: f"{word()}_{word()}_{rng.randint(1, 999)}", lambda: f"{word()}{word().title()}{word().title()}{rng.choice(('', str(rng.randint(1, 99))))}", lambda: "".join(word() for _ in range(rng.randint(3, 6))), lambda: f"{word()}-{word()}-{word()}-{word()}",
        lambda: draw(string.ascii_uppercase, 2, 4) + "-" + draw(digits, 4, 9), lambda: f"{word()}_{draw(digits, 8)}_{draw(digits, 6)}.{rng.choice(('jpg', 'pdf', 'csv'))}", lambda: "978-" + group((1, 4, 4, 1), "-", digits), lambda: "=" * rng.randint(8, 60), lambda: "-" * rng.randint(20, 60),
    )
    out = []
    for k in range(count):
        secret, kind = k % 2, rng.random()
        if secret:
            named = kind < 0.7
            before = lead(secret_names) if named or kind < 0.8 else ""
            value = rng.choice(assigned)() if named else rng.choice(known)()
        elif kind < 0.3:
            before, value = lead(secret_names), rng.choice(holders)()
        else:
            before = lead(plain_names) if kind < 0.5 else rng.choice(("", "", f"{rng.choice(plain_names)} "))
            value = rng.choice(harmless)()
        path = rng.choice(("", word(), f"{word()}/{word()}.py", "config.yml")) if secret or rng.random() < 0.8 else rng.choice((f"tests/{word()}.py", f"docs/{word()}.md", "example.env"))
        out.append(Finding(value, f"{prose(6)} {before}"[-_CONTEXT:], rng.choice(('"', "", "'", ";")) + " " + prose(4), path, secret))
    return out


def assigned_values(raw: bytes, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) in bytes of every value behind a secret-sounding name and a sign of assignment."""
    signs = np.flatnonzero((data == ord("=")) | (data == ord(":")))
    rows = np.searchsorted(offsets, signs, side="right") - 1
    past = -1
    for p, row in zip(signs.tolist(), rows.tolist()):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        if p < past or not (m := _NAME.search(raw[max(lo, p - 80) : p])) or not _name_parts(m[1].decode("ascii", "ignore")) & _SECRET_WORDS:
            continue
        size = 256
        while True:
            window = raw[p + 1 : min(hi, p + 1 + size)].decode("utf-8", "ignore")
            v = _VALUE.match(window)
            if p + 1 + size >= hi or v and v.end() < len(window) - 8:
                break
            size *= 8
        if not v:
            continue
        value = next(filter(None, v.groups()[1:]), "")
        quoted = 1 if v.group(5) is None else 0
        value = value if quoted else value.rstrip(".,;)]}>")
        if value:
            start = p + 1 + len(v[1].encode()) + quoted
            past = start + len(value.encode())
            yield row, start, past


def text_findings(data: np.ndarray, offsets: np.ndarray, paths: list[str | None]) -> Iterator[tuple[int, int, int, Finding]]:
    """(row, start, end, finding) of every candidate of a chunk; offsets are code points."""
    raw = data.tobytes()
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))

    def finding(row: int, s: int, e: int) -> tuple[int, int, int, Finding]:
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        before, after = raw[max(lo, s - _CONTEXT) : s].decode("utf-8", "ignore"), raw[e : min(hi, e + _CONTEXT)].decode("utf-8", "ignore")
        at = points[offsets[row]]
        return row, int(points[s] - at), int(points[e] - at), Finding(raw[s:e].decode("utf-8", "replace"), before, after, paths[row] or "")

    named = list(assigned_values(raw, data, offsets))
    for x in named:
        yield finding(*x)
    taken = np.zeros(len(data) + 1, dtype=np.int32)
    for _, s, e in named:
        taken[s] += 1
        taken[e] -= 1
    taken = np.append(0, np.cumsum(np.cumsum(taken)[:-1]))
    starts, ends, rows = word_spans(data, offsets, _KEY_BYTE)
    if not len(starts):
        return
    digits = np.append(0, np.cumsum(_DIGIT[data]))
    length, n_digits = ends - starts, digits[ends] - digits[starts]
    likely = (length >= MIN_LENGTH) & ((n_digits > 0) | (length >= MIN_LETTERS)) & (taken[ends] == taken[starts])
    for k in np.flatnonzero(likely).tolist():
        s, e, row = int(starts[k]), int(ends[k]), int(rows[k])
        value = raw[s:e].decode("ascii")
        trimmed = value.rstrip(".:=!-")
        lead = len(trimmed) - len(trimmed.lstrip(".:=!-"))
        if (m := _SPLIT.match(trimmed[lead:])) and len(m[2]) >= MIN_LENGTH:
            lead += m.start(2)
        kept = trimmed[lead:]
        if len(kept) >= MIN_LENGTH and (any(c.isdigit() for c in kept) or len(kept) >= MIN_LETTERS):
            yield finding(row, s + lead, s + len(trimmed))


def train_forest(spark: SparkSession, findings: list[Finding], lexicon: Lexicon, seed: int = 10) -> RandomForestClassificationModel:
    rows = [(float(f.label), lexicon.features(f)) for f in findings]
    table = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, cacheNodeIds=False).fit(table)


def labelled_findings(table: DataFrame, most: int = EXAMPLES) -> list[Finding]:
    """Up to ``most`` rows of (value, before, after, path, label), drawn by hash; rows without a value or a label are left out."""
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "after", "path")]
    rows = table.where("value is not null and label is not null").select("value", *columns, F.col("label").cast("int").alias("label"))
    return [Finding(**r.asDict()) for r in rows.orderBy(F.xxhash64("value", "before", "path"), "value", "before", "after", "path", "label").limit(most).collect()]


def find_secrets(df: DataFrame, id_col: str, text_col: str, path_col: str | None = None, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, start, end, value, before, score, secret): every candidate with the forest's probability."""
    spark = df.sparkSession
    lexicon = corpus_lexicon(df, text_col)
    findings = labelled_findings(labelled) if labelled is not None else example_findings(sorted(lexicon.words))
    lexicon = lexicon.learn(findings)
    forest = train_forest(spark, findings, lexicon)
    holder = spark.sparkContext.broadcast(lexicon)  # LEXICON_WORDS words and a table of 29 by 29
    ddl = "id long, start long, end long, value string, before string, x array<double>"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = holder.value
        for batch in batches:
            ids, paths = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, data, offsets in chunks(batch.column(1)):
                got = [(ids[lo + r], s, e, f.value, f.before, lex.features(f)) for r, s, e, f in text_findings(data, offsets, paths[lo : lo + len(offsets) - 1])]
                columns = zip(*got) if got else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "start", "end", "value", "before", "x"])

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    found = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), path.alias("path")).mapInArrow(run, ddl)
    scored = forest.transform(found.withColumn("features", array_to_vector("x")))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(id_col), "start", "end", "value", "before", score.alias("score"), (score >= threshold).alias("secret"))


def op10_forest_secret_scan(documents: DataFrame) -> DataFrame:
    """Every candidate secret of ``documents`` with the forest's verdict; one row per candidate."""
    return find_secrets(documents, "doc_id", "text", "source")
