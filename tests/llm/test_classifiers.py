"""Held-out accuracy of the trained operators, and their odd rows."""

import itertools
import random
import re
import string
import zlib

import numpy as np
import pyarrow.parquet as pq

from sparkloom.llm.language_id import op8_compression_language_id
from sparkloom.llm.secret_scan import FEATURES, corpus_lexicon, example_findings, find_secrets, op10_forest_secret_scan
from sparkloom.llm.toxicity import THRESHOLD, _forward_backward, op9_crf_toxicity

MIDDLE = "/root/testdata/sf0.01"
ODD = [(1, None, None, "x"), (2, "", "en", "x"), (3, "12 34 --", None, "x"), (3, "the word and the other", "en", "y"), (None, "nothing", "en", None), (4, "lang word " * 20_000, "en", "x")]


def odd(spark):
    return spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id long, text string, lang string, source string, score double")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = op8_compression_language_id(docs).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    told = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in told) >= 0.95 * len(told)


def test_language_odd_rows(spark):
    rows = op8_compression_language_id(odd(spark)).collect()
    assert len(rows) == len(ODD) and sum(r["lang_pred"] == "und" for r in rows) >= 3
    assert op8_compression_language_id(odd(spark).limit(0)).collect() == []


def test_language_ties_and_copies(spark):
    """Texts that fit two languages alike get the first by name at score 0, however often they stand in the table."""
    text = "same words in both of them " * 4
    rows = [(i, text, lang, "s") for i in range(1, 41) for lang in ("aa", "bb")] + [(99, text, None, "s")] * 3
    got = [r for r in op8_compression_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected string")).collect() if r["doc_id"] == 99]
    assert len(got) == 3 and len({(r["lang_pred"], r["score"]) for r in got}) == 1 and got[0]["lang_pred"] in ("aa", "bb") and got[0]["score"] <= 0.5


def test_field_marginals_against_enumeration():
    """Forward-backward against the sum over all taggings of short chains."""
    rng = np.random.default_rng(8)
    lengths = [1, 5, 3, 7, 7, 2]
    starts = np.cumsum([0, *lengths[:-1]])
    scores, moves = rng.normal(0, 2, sum(lengths)), rng.normal(0, 1, (2, 2))
    marginal, expected = _forward_backward(scores, starts, moves)
    counts = np.zeros((2, 2))
    for at, n in zip(starts, lengths):
        total, by_tag = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(scores[at + k] for k in range(n) if tags[k]) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            by_tag += weight * np.array(tags)
        for tags in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(scores[at + k] for k in range(n) if tags[k]) + sum(moves[a, b] for a, b in zip(tags, tags[1:]))) / total
            for a, b in zip(tags, tags[1:]):
                counts[a, b] += weight
        assert np.allclose(marginal[at : at + n], by_tag / total)
    assert np.allclose(expected, counts)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{MIDDLE}/labels.parquet").to_pylist()}
    rows = op9_crf_toxicity(docs, labels).collect()
    told = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert all(r["predicted"] == int(r["score"] >= THRESHOLD) for r in rows)
    hits = sum(r["predicted"] and truth[r["doc_id"]] for r in told)
    assert hits >= 0.8 * sum(truth[r["doc_id"]] for r in told) and hits >= 0.9 * sum(r["predicted"] for r in told)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert all(0 <= s["start"] < s["end"] <= len(texts[r["doc_id"]]) for r in rows for s in r["spans"])


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, None), (2, 0, 1), (2, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert op9_crf_toxicity(odd(spark), labels).count() == len(ODD)
    assert op9_crf_toxicity(odd(spark), labels.limit(0)).count() == len(ODD)
    assert op9_crf_toxicity(odd(spark).limit(0), labels).collect() == []


def planted(count, seed, words):
    """(text, value, label): findings in notations of this test's own, apart from those that the scan trains on."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, num = string.ascii_lowercase, string.ascii_uppercase, string.digits
    secrets = [
        ("export DB_PASSWORD={}", lambda: pick(low + num, 14)), ('{{"clientSecret": "{}"}}', lambda: pick(low + up + num + "~.", 34)), ("aws_access_key_id = {}", lambda: "AKIA" + pick(up + num, 16)),
        ("the pin: {}", lambda: pick(num, 4)), ("Authorization: Bearer {}", lambda: pick(low + up + num, 40)), ("smtp.passwd='{}'", lambda: pick(low, 5) + ", " + pick(num, 4) + ";ñ]" + pick(up, 4)),
        ("push with {} then", lambda: "ghp_" + pick(low + up + num, 36)), ("PRIVATE_TOKEN={}", lambda: pick(up, 24)), ("api-key => `{}`", lambda: pick("abcdef" + num, 48)),
    ]
    plain = [
        ("see commit {} for it", lambda: pick("abcdef" + num, 40)), ("uuid {} of the row", lambda: "-".join(pick("abcdef" + num, n) for n in (8, 4, 4, 4, 12))), ("version {} is out", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}-beta"),
        ("password: {} and more", lambda: rng.choice(("changeme", "your-password-here", "example123", "${DB_PASS}"))), ("token: {} it is", lambda: rng.choice(words)), ("call {} today", lambda: "+49-30-" + pick(num, 8)),
        ("open /srv/data/{}.csv now", lambda: f"report_{pick(num, 8)}"), ("at {} sharp", lambda: f"2019-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10:00:00"), ("mail {} please", lambda: f"{rng.choice(words)}.{rng.choice(words)}{pick(num, 2)}@{rng.choice(words)}.net"),
    ]
    for k in range(count):
        form, make = rng.choice(plain if k % 2 else secrets)
        value = make()
        yield " ".join(rng.choice(words) for _ in range(8)) + " " + form.format(value) + " " + " ".join(rng.choice(words) for _ in range(5)), value, 1 - k % 2


def test_secrets_planted_in_texts(spark, small):
    """Trained on made findings, held against planted ones of other notations in sentences of the table's words."""
    texts = [r["text"] or "" for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    words = sorted({w for t in texts for w in re.findall("[a-z]{3,9}", t)})[::5]
    held = list(planted(400, 5, words))
    rows = [(i, t, "notes") for i, (t, _, _) in enumerate(held)] + [(1000 + i, t, "web") for i, t in enumerate(texts)]
    found = find_secrets(spark.createDataFrame(rows, "id long, text string, path string"), "id", "text", "path").collect()
    by_id = dict((i, t) for i, t, _ in rows)
    assert all(by_id[r["id"]][r["start"] : r["end"]] == r["value"] for r in found)
    values = {(r["id"], r["value"]) for r in found}
    assert all((i, v) in values for i, (_, v, label) in enumerate(held) if label)  # every planted secret is a candidate, whole
    caught = {r["id"] for r in found if r["secret"]}
    hits, alarms = (sum(i in caught for i, h in enumerate(held) if h[2] == label) for label in (1, 0))
    assert hits >= 0.9 * 200 and alarms <= 0.1 * 200


def test_secrets_from_a_table_of_labels(spark):
    """The forest follows the labels it is given."""
    rng = random.Random(1)
    code = lambda: f"ZZ-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}"
    sha = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(40))
    labels = [(code(), "badge ", " end", None, 1) for _ in range(150)] + [(sha(), "token=", None, "src", 0) for _ in range(150)] + [(None, "x", "y", "z", 1), ("a1b2c3d4", "x", "y", "z", None)]
    table = spark.createDataFrame(labels, "value string, before string, after string, path string, label int")
    df = spark.createDataFrame([(1, f"badge {code()} end"), (2, f"token={sha()}")], "id long, text string")
    assert {(r["id"], r["secret"]) for r in find_secrets(df, "id", "text", labelled=table).collect()} == {(1, True), (2, False)}


def test_secret_features(spark):
    lexicon = corpus_lexicon(spark.createDataFrame([("The quick brown fox; the fox",), (None,), ("",)], "text string"), "text", 3)
    assert lexicon.words == {"the", "fox"} and lexicon.pairs["th"] == 2 and lexicon.pairs["ox"] == 2
    assert lexicon.coverage("TheFox99") == 6 / 8
    held = example_findings(["word", "other"], 300, seed=99)
    assert all(len(lexicon.features(f)) == len(FEATURES) for f in held) and example_findings([], 4)


def test_secrets_odd_rows(spark):
    df = spark.createDataFrame([(None, "password: hunter" + "7" * 5000 + " end", 1), (None, None, 1), (2, "token = \"", 1), (2, "token = \"", 1)], "doc_id long, text string, start int")
    rows = find_secrets(df, "doc_id", "text").collect()
    assert [len(r["value"]) for r in rows if r["doc_id"] is None] == [5006] and all(r["doc_id"] is None for r in rows)
    assert op10_forest_secret_scan(odd(spark).limit(0)).collect() == []
    assert op10_forest_secret_scan(odd(spark)).where("secret").collect() == []
