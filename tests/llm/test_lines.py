"""Line dedup against edit similarity alone: the brute force knows nothing of hashes or blocks."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from sparkloom.llm.edit_distance import characters_bound, edit_distance, within_edits, words_bound
from sparkloom.llm.line_dedup import CROWD, dedup_lines, mark_lines

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normal(line):
    return b" ".join(WORD.findall(line.encode())).lower().decode("utf-8", "replace")


def similar(x, y):
    if (Counter(x) - Counter(y)).total() > 0.1 * max(len(x), len(y)):
        return False
    return within_edits(x, y, int(max(len(x), len(y)) * 0.1 + 1e-9))


def brute_pairs(lines):
    lines = sorted(lines, key=len)
    return [(x, y) for i, x in enumerate(lines) for y in lines[i + 1 :] if len(y) * 0.9 <= len(x) + 1e-9 and similar(x, y)]


def components(lines, pairs):
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        root[find(x)] = find(y)
    return {x: find(x) for x in lines}


def groups(spark, rows):
    """Normalised line -> (first id, first line) as marked, one for all occurrences."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts, found = dict(rows), {}
    for r in mark_lines(df, "doc_id", "text").collect():
        line = normal(texts[r["doc_id"]].split("\n")[r["line"]])
        assert found.setdefault(line, (r["first_id"], r["first_line"])) == (r["first_id"], r["first_line"])
        assert r["kept"] == ((r["doc_id"], r["line"]) == (r["first_id"], r["first_line"]))
    return found


def check(found, least):
    """Groups lie within components of the brute force, and similar pairs share a group at least so often."""
    pairs = brute_pairs(found)
    whole = components(found, pairs)
    by_group = {}
    for line, first in found.items():
        assert by_group.setdefault(first, whole[line]) == whole[line]
    together = sum(found[x] == found[y] for x, y in pairs)
    assert pairs and together >= least * len(pairs)
    return together, len(pairs)


def test_whole_table_against_edit_similarity(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    check(groups(spark, rows), 0.97)


@pytest.mark.parametrize("kind", ["letter", "word", "tenth"])
def test_made_edits(spark, small, kind):
    rng = random.Random(4)
    lines = {normal(x) for r in pq.read_table(f"{small}/documents.parquet").to_pylist() for x in (r["text"] or "").split("\n")}
    lines = sorted(x for x in lines if 12 <= len(x) <= 600)
    words = [w for x in lines for w in x.split()]
    rows = []
    for i, x in enumerate(rng.sample(lines, 250)):
        w = x.split()
        if kind == "letter":
            at = rng.randrange(len(x))
            y = x[:at] + rng.choice("abcdefgh") + x[at + 1 :]
        else:
            for _ in range(1 if kind == "word" else max(1, len(w) // 13)):
                w[rng.randrange(len(w))] = rng.choice(words)
            y = " ".join(w)
        rows.append((i, f"{x}\n{y}"))
    check(groups(spark, rows), 0.95)


def test_crowds(spark):
    """Thousands of lines share frequent words, hundreds are copies of one with a word replaced."""
    rng = random.Random(2)
    own = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    rows = [(i, "the of and to " + " ".join(own() for _ in range(8))) for i in range(1500)]
    base = [own() for _ in range(30)]
    for i in range(2000, 2300):
        w = list(base)
        w[rng.randrange(30)] = own()
        rows.append((i, " ".join(w)))
    short = "a line of eight words that is short"
    rows += [(3000 + i, short.replace("short", "short" + "s" * (i % 4))) for i in range(5 * CROWD)]
    rows += [(4000 + i, "log entry of the system number " + str(7919 * i) + " took " + str(104729 * i % 99991) + " steps to end") for i in range(300)]
    found = groups(spark, rows)
    texts = dict(rows)
    assert {found[normal(texts[i])] for i in range(2000, 2300)} == {(2000, 0)}
    assert {found[normal(texts[3000 + i])] for i in range(5 * CROWD)} == {(3000, 0)}
    assert all(found[normal(texts[i])] == (i, 0) for i in range(1500))
    check({k: v for k, v in found.items() if v[0] >= 1900}, 0.95)


@pytest.mark.parametrize("pairs", [400, 4000])
@pytest.mark.parametrize("own", [1, 4])
def test_templates_with_partners(spark, pairs, own):
    """All lines share 14 words; a pair differs in two letters of one of its own words. Against edit similarity alone: every pair has it."""
    rng = random.Random(31 * pairs + own)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, rows, partners = [word(6) for _ in range(14)], [], []
    for i in range(pairs):
        mine = [word(44 if own == 1 else 9) for _ in range(own)]
        line = list(template)
        places = sorted(rng.sample(range(14), own))
        for at, w in zip(reversed(places), mine):
            line.insert(at, w)
        other = list(line)
        at = other.index(rng.choice(mine))
        letters = list(other[at])
        for k in rng.sample(range(len(letters)), 2):
            letters[k] = rng.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != letters[k]])
        other[at] = "".join(letters)
        x, y = " ".join(line), " ".join(other)
        assert within_edits(x, y, int(len(x) * 0.1 + 1e-9))
        rows += [(2 * i, x), (2 * i + 1, y)]
        partners.append((2 * i, 2 * i + 1))
    found = {r["doc_id"]: r["first_id"] for r in mark_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    linked = sum(found[a] == found[b] for a, b in partners)
    assert linked >= 0.9 * pairs
    assert len(set(found.values())) >= 0.95 * pairs  # strangers stay apart


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "shared line of some words here"), (3, "alpha beta\nshared line of some words here"), (3, "gamma delta\nunique text of the second row")]
    rows += [(5, "the same row twice over")] * 3
    got = sorted(r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())
    assert got == ["", "", "alpha beta", "gamma delta\nunique text of the second row", "shared line of some words here", "the same row twice over"]


def test_lines_leave_rows_and_columns(spark):
    schema = "doc_id long, text string, line long, id string, row int, __gone string"
    rows = [(1, "a b\nc d", 7), (2, "A b\n\n---\nnew", 8), (3, None, 9), (None, "a b", 1), (4, "", 0)]
    df = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], schema)
    out = dedup_lines(df, "doc_id", "text")
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["line"], r["id"], r["row"]) for r in out.collect()) == [
        (0, "a b", 1, "x", 5), (1, "a b\nc d", 7, "x", 5), (2, "\n---\nnew", 8, "x", 5), (3, None, 9, "x", 5), (4, "", 0, "x", 5),
    ]
    assert dedup_lines(df.limit(0), "doc_id", "text").collect() == []
    assert mark_lines(df.limit(0), "doc_id", "text").collect() == []


def test_digits_and_long_lines(spark):
    rows = [(1, "12 345 678\n2021-03-04\nChapter 1"), (2, "90 111 222\n1998-12-31\nChapter 2"), (3, "12 345 678\nthe meeting of the whole board was held in room 7")]
    rows += [(4, "the meeting of the whole board was held in room 8")]
    long = [f"w{i * 7919 % 10007}" for i in range(60_000)]
    rows += [(5, " ".join(long)), (6, " ".join(long[:30_000] + ["other"] + long[30_001:])), (7, "\n".join(["same"] * 20_000 + ["last"]))]
    rows += [(8, "漢" * 400), (9, "漢" * 399 + "字")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line"]): (r["first_id"], r["first_line"]) for r in mark_lines(df, "doc_id", "text").collect()}
    moved = {k: v for k, v in got.items() if k != v and k[0] != 7}
    assert moved == {(3, 0): (1, 0), (4, 0): (3, 1), (6, 0): (5, 0), (9, 0): (8, 0)}
    assert dedup_lines(df, "doc_id", "text").where("doc_id = 7").first()["text"] == "same\nlast"


def plain_distance(a, b):
    table = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        table, last = [i], table
        for j, y in enumerate(b, 1):
            table.append(min(last[j] + 1, table[-1] + 1, last[j - 1] + (x != y)))
    return table[-1]


def test_edits_against_the_table_of_distances():
    rng = random.Random(7)
    words = ["aa", "ab", "ba", "c", "", "ñé", "漢字", "abc"]
    for _ in range(600):
        a = " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(("", "a", " ", "字", "ab "))
        b = "".join(b)
        true = plain_distance(a, b)
        assert edit_distance(a, b) == true and characters_bound(a, b) <= true <= words_bound(a.split(" "), b.split(" "))
        assert all(within_edits(a, b, n) == (true <= n) for n in (true - 1, true, true + 1) if n >= 0)


def test_crowd_partners_edited_at_both_ends(spark):
    """All lines share 30 words; a pair differs in a letter of its first and of its last word, so that neither order of letters brings it together."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, rows = [word(6) for _ in range(30)], []
    for i in range(80):
        front, back = word(32), word(32)
        rows.append((2 * i, " ".join([front, *template, back])))
        rows.append((2 * i + 1, " ".join([chr(219 - ord(front[0])) + front[1:], *template, back[:-1] + chr(219 - ord(back[-1]))])))
    found = {r["doc_id"]: r["first_id"] for r in mark_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(80)) >= 78 and len(set(found.values())) >= 78


def test_cells_leave_no_pair_out():
    """Close lines of a crowd, found in tiles, against every pair."""
    from sparkloom.llm.line_dedup import MAX_BITS, _close_rows

    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(80, 100, 3000))
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)[rng.integers(0, 40, 3000)]
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(8, 64, (3000, 2, 9), dtype=np.uint64), axis=2)
    table = [size, base[:, 0] ^ flips[:, 0], (base[:, 1] ^ flips[:, 1]) & ~np.uint64(255)]
    bits = sum(np.bitwise_count(h[:, None] ^ h[None, :]).astype(int) for h in table[1:3])
    right = (bits <= MAX_BITS) & (np.abs(size[:, None] - size[None, :]) <= 3)
    pairs = lambda *a: sorted((i, j) for x, y in _close_rows(*a) for i, j in zip(x.tolist(), y.tolist()))
    assert pairs(table, table, True) == list(zip(*(x.tolist() for x in np.nonzero(np.triu(right, 1)))))
    left, other = [x[::2] for x in table], [x[1::2] for x in table]
    assert right[::2, 1::2].sum() > 1000 and pairs(left, other, False) == list(zip(*(x.tolist() for x in np.nonzero(right[::2, 1::2]))))


def test_a_frequent_word_makes_no_crowd():
    """Half of every line's words are one word: lines that share no other words share no block that many lines have."""
    from sparkloom.llm.line_dedup import chunk_lines

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    lines = []
    for _ in range(500):
        w = ["the"] * 20 + [word() for _ in range(20)]
        rng.shuffle(w)
        lines.append(" ".join(w))
    text = "\n".join(lines).encode()
    found = chunk_lines(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[4]
    blocks = Counter(b for f in found for b in f[3].tolist())
    assert sum(n for n in blocks.values() if n > CROWD) < 0.1 * sum(blocks.values())
