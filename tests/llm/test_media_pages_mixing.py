"""Round trips of media and packing, page rules, and the mix against its targets."""

import functools
import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm.html_text import extract_text, op5_block_rules_extraction
from sparkloom.llm.mpeg_audio import allocation_checksum, encode, op4_mpeg_audio, pad_payload, probe, read_header, stored_bytes
from sparkloom.llm.packing import cutting_patterns, op7_cutting_stock_packing, price_pattern
from sparkloom.llm.pivotal_mix import mix_sources, op6_pivotal_mixing, take_copies

ODD = [(1, None, None), (2, "", "a"), (3, "word", "a"), (3, "word", "a"), (4, "many words here " * 9000, "b"), (5, "Grüße 😀\x00 <|endoftext|>", None), (6, "zwei drei", "b")]


def odd(spark):
    return spark.createDataFrame([(*r, 5) for r in ODD], "doc_id long, text string, source string, size long")


def test_media_round_trip(spark, small):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    rows = op4_mpeg_audio(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = pad_payload(texts[r["doc_id"]])
        assert r["seek_offsets"] == probe(encode(payload)).offsets.tolist() and len(r["seek_offsets"]) == r["frames"] == len(payload) // 192
        assert r["duration_us"] == r["frames"] * 36_000
        assert len(payload) % 192 == 0 and payload.rstrip(b" ") == texts[r["doc_id"]].rstrip(b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["crc_failed"] == 0 and r["media_sha256"] == hashlib.sha256(encode(payload)).hexdigest()


def test_media_odd_rows_and_broken_streams(spark):
    assert op4_mpeg_audio(odd(spark)).count() == len(ODD) and op4_mpeg_audio(odd(spark).limit(0)).collect() == []
    media = encode(pad_payload(b"some bytes to keep " * 200))
    whole = probe(media)
    assert stored_bytes(whole) == pad_payload(b"some bytes to keep " * 200) and not whole.skipped
    junk = probe(media[: whole.offsets[3]] + b"\x00\xff junk \xfb" * 7 + media[whole.offsets[3] :])
    assert len(junk.offsets) == len(whole.offsets) and junk.skipped == 63 and stored_bytes(junk) == stored_bytes(whole)
    bad = bytearray(media)
    bad[whole.offsets[2] + 8] ^= 0x40  # in the side information, which the checksum covers
    assert probe(bytes(bad)).failed == 1
    for at in range(192):  # bytes of a text that look like a tag are not one
        text = pad_payload(b"x" * at + b"TAG" + b"ID3" * 5)
        assert stored_bytes(probe(encode(text))) == text
    tagged = probe(media + b"TAG" + b"A title".ljust(125, b"\0"))
    assert stored_bytes(tagged) == stored_bytes(whole) and tagged.tags["TIT1"] == "A title" and not tagged.skipped
    assert len(probe(b"").offsets) == 0 and probe(b"\xff" * 1000).samples == 0


def _frame(head, rng):
    """A frame of random allocations behind ``head``, with its checksum from the bits that the format names."""
    body = bytearray(head) + b"\0\0" + bytes(rng.integers(0, 256, read_header(bytes(head)).length - 6, dtype=np.uint8))
    crc = allocation_checksum(np.frombuffer(bytes(body), dtype=np.uint8), read_header(bytes(head)))
    body[4], body[5] = crc >> 8, crc & 255
    return bytes(body)


@pytest.mark.parametrize(
    "head, certain",
    [
        (b"\xff\xfe\x90\x00", 32), (b"\xff\xfe\x90\xc0", 16), (b"\xff\xfe\x90\x50", 20),  # Layer I: stereo, mono, joint from subband 8 on
        (b"\xff\xfc\x84\x00", 22), (b"\xff\xfc\x24\xc0", 3), (b"\xff\xf4\x84\xc0", 9),  # Layer II: tables a and c, the low rates
    ],
)
def test_media_checksums_of_other_layers(head, certain):
    """A bit that the checksum covers for certain makes its frame fail, one beyond it doesn't."""
    rng = np.random.default_rng(3)
    frames = [_frame(head, rng) for _ in range(5)]
    found = probe(b"".join(frames))
    assert (len(found.offsets), found.checked, found.failed) == (5, 5, 0)
    for at in (6, 6 + certain // 2, 5 + certain):
        bad = bytearray(frames[2])
        bad[at] ^= 1
        assert probe(b"".join([*frames[:2], bytes(bad), *frames[3:]])).failed == 1
    bad = bytearray(frames[2])
    bad[-1] ^= 1
    assert probe(b"".join([*frames[:2], bytes(bad), *frames[3:]])).failed == 0


def test_media_vbr_tables():
    media = encode(pad_payload(b"x" * 2000))
    first = probe(media)
    assert first.table["frames"] == 11 and first.table["bytes"] == 12 * 216
    frames = media[first.offsets[0] :]
    head = b"\xff\xfb\x38\xc0" + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 12 * 216, 11, 3, 1, 2, 4) + struct.pack(">HHH", 864, 864, 648)
    found = probe(head.ljust(216, b"\0") + frames)
    assert (found.table["frames"], found.table["bytes"], found.table["frames_an_entry"]) == (11, 12 * 216, 4)
    assert found.table["toc_crc"] == zlib.crc32(struct.pack(">HHH", 864, 864, 648)) and len(found.offsets) == 11
    xing = b"\xff\xfb\x38\xc0" + bytes(17) + b"Xing" + struct.pack(">II", 1, 11)
    assert probe(xing.ljust(216, b"\0") + frames).table == {"flags": 1, "frames": 11}


def test_media_rows_nulls_and_clashes(spark):
    df = spark.createDataFrame([(None, "x", b"a", 1), (None, "x", b"a", 1), (7, None, None, 2)], "doc_id long, text string, media binary, n long")
    rows = op4_mpeg_audio(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"]) for r in rows) == [(0, 1, 192), (0, 1, 192), (7, 0, 192)]


def test_pages():
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Head &amp; tail</h1><p>First  <b>bold</b>\n text<p>Second &lt;x&gt; text</p><ul><li>one<li>two</ul></article>"
        "<section id=comments><p>Reader says something long about it all</p></section><footer>&copy; us</footer></body></html>"
    )
    assert extract_text(page) == "Head & tail\nFirst bold text\nSecond <x> text\none\ntwo"
    assert extract_text(None) == extract_text("") == extract_text("<script>x</script>") == ""
    assert extract_text("just words <b") == "just words <b"
    assert extract_text("<div>" * 3000 + "deep words") == "deep words"


def test_pages_article_is_one_feature_of_many():
    prose = "It was the end of the day and all of the people who had been at the market were on their way to the river with what they had left. " * 3
    tail = "There was not one of them who would have said that it was the last time they had been there, and so it is told by all to this day. " * 3
    teaser = f"<html><body><div>{prose}</div><div>{tail}</div><article><h3>More news</h3><p>Short card</p></article></body></html>"
    assert prose.strip() in extract_text(teaser) and tail.strip() in extract_text(teaser)
    words = "Widget gadget gizmo premium offer bargain discount voucher outlet clearance catalogue warehouse delivery returns"
    inside = f"<html><body><article><h1>Market day</h1><p>{prose}</p><p>{words}</p><p>&copy; 2020 Market Press</p><p>{tail}</p></article></body></html>"
    assert extract_text(inside) == f"Market day\n{prose.strip()}\n{tail.strip()}"
    other = "<html><body><article><p>" + "Ez a szöveg olyan nyelven íródott, amelynek gyakori szavait ez az eljárás egyáltalán ismeri. " * 3 + "</p></article></body></html>"
    assert extract_text(other).startswith("Ez a szöveg")


def test_pages_attributes_are_read_one_by_one():
    """Values and longer names don't count as attributes; class names count whole."""
    head = "<html><body><article><h1>Title</h1>"
    for opening in (
        '<p title="hidden gems">', '<p data-id="menu-item">', '<p title=\'x class="footer"\'>', '<p class="form-factor">', '<div class="related-work">', '<div id="notice-board">',
        '<div class="skip-connection">', '<p data-hidden="1" alt=style>', '<p aria-label="role=dialog">', '<p hiddenness="a">',
    ):
        assert extract_text(f"{head}{opening}Kept text</article>") == "Title\nKept text", opening
    for opening in ('<p hidden>', '<p class="lead ad">', '<div class="search-form">', '<div id=site-footer>', "<p style='display: none'>", '<p role="dialog" title="a">', '<div class="cookieBanner">', '<p CLASS="ad-slot-2">'):
        assert extract_text(f"{head}<p>Kept text</p>{opening}Gone</article>") == "Title\nKept text", opening


def test_pages_without_article():
    """Text in plain blocks: density, length and neighbours decide."""
    prose = "It was the end of the day and all of the people who had been at the market were on their way to the river with what they had left. " * 3
    links = "".join(f"<li><a href=/{i}>Some place number {i}</a></li>" for i in range(9))
    page = f"<body><ul>{links}</ul><div>Markets of the coast</div><div>{prose}</div><div>And so it went.</div><div>{prose}</div><ul>{links}</ul><div>Imprint</div></body>"
    text = extract_text(page).split("\n")
    assert [x.strip() for x in text if len(x) > 100] == [prose.strip()] * 2 and "And so it went." in text
    assert "Imprint" not in text and not any("place number" in x for x in text)


def test_pages_odd_rows(spark):
    long = "<article>" + "<p>There is a lot of text that is on this page and it goes on for a while. </p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (1, None, ""), (None, "u", "<p>Some words"), (2, "v", long), (2, "v", long)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, id int")
    got = op5_block_rules_extraction(df).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in got) == sorted([(1, "u", 0), (1, "", 0), (0, "u", 10), *[(2, "v", len(extract_text(long)))] * 2])
    assert extract_text(long).count("\n") == 19_999
    assert op5_block_rules_extraction(df.limit(0)).collect() == []


def test_pages_whole_table(spark, small):
    rows = op5_block_rules_extraction(spark.read.parquet(f"{small}/pages.parquet")).collect()
    assert len(rows) == pq.read_table(f"{small}/pages.parquet").num_rows
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and not any("©" in r["text"] for r in rows)


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in full}
        rest = total - sum(full.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = {s: 2.0 * sizes[s] for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return full | share
        full |= over


def check_mix(rows):
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = targets(sizes)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in want)


def test_mixing_meets_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    rows = [r.asDict() | {"source": source[r["doc_id"]]} for r in op6_pivotal_mixing(docs).collect()]
    assert len(rows) == len(source)
    check_mix(rows)
    assert sorted(map(str, rows)) == sorted(str(r.asDict() | {"source": source[r["doc_id"]]}) for r in op6_pivotal_mixing(docs.repartition(7)).collect())


def test_mixing_odd_rows(spark):
    rows = op6_pivotal_mixing(odd(spark)).collect()
    assert len(rows) == len(ODD) and op6_pivotal_mixing(odd(spark).limit(0)).collect() == []
    taken = take_copies(odd(spark), "doc_id", "text", "source")
    assert taken.columns == ["doc_id", "text", "source", "size"]
    words = sum(len((r["text"] or "").split()) for r in taken.collect())
    assert words == sum(r["taken"] for r in rows)


def test_mixing_equal_rows_and_clashing_columns(spark):
    """Tens of thousands of equal rows, nulls included, in one source or id."""
    equal = spark.range(50_000).selectExpr("cast(null as long) as doc_id", "'one two three' as text", "'a' as source", "1 as size", "2 as rows", "'x' as s", "3 as __row")
    own = spark.range(3_000).selectExpr("id as doc_id", "repeat('w ', cast(id % 40 as int)) as text", "if(id % 2 = 0, 'a', 'b') as source", "1 as size", "2 as rows", "'x' as s", "3 as __row")
    df = equal.unionByName(own)
    items = mix_sources(df, "doc_id", "text", "source").groupBy("source").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"))
    rows = {r["source"]: r for r in items.collect()}
    assert {s: r["n"] for s, r in rows.items()} == {"a": 51_500, "b": 1_500}
    want = targets({s: r["size"] for s, r in rows.items()})
    assert all(abs(r["taken"] - want[s]) <= 40 and abs(r["target"] - want[s]) < 1e-6 * want[s] for s, r in rows.items())
    taken = take_copies(df, "doc_id", "text", "source")
    assert taken.columns == df.columns
    words = {r["source"]: r["w"] for r in taken.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[^ ]+"))).alias("w")).collect()}
    assert words == {s: r["taken"] for s, r in rows.items()}


def check_pieces(rows, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r["length"] for r in rows) / (2048 * len(sequences))


@pytest.mark.parametrize("units", [1, 6, 9])
def test_knapsack_against_enumeration(units):
    rng = np.random.default_rng(units)
    for _ in range(20):
        values = rng.random(units) * np.arange(1, units + 1) * rng.integers(0, 2, units)
        best = [0.0] * (units + 1)
        for room in range(1, units + 1):
            best[room] = max([best[room - 1], *(best[room - c] + values[c - 1] for c in range(1, room + 1))])
        value, pattern = price_pattern(values, units)
        assert abs(value - best[units]) < 1e-9 and abs(pattern @ values - value) < 1e-9 and pattern @ np.arange(1, units + 1) <= units


@pytest.mark.parametrize("counts", [[0, 0, 4, 0, 2, 0, 0, 3], [5, 4, 3, 2, 1, 0], [0, 0, 7], [1, 0, 0, 0, 9, 1, 0, 0, 0, 2]])
def test_patterns_against_the_fewest_bins(counts):
    """Patterns hold every class exactly as often as asked, in one sequence more than the fewest possible at most."""
    counts = np.array(counts)
    units = len(counts)
    patterns = cutting_patterns(counts)
    assert (sum(n * p for n, p in patterns) == counts).all() and all(p @ np.arange(1, units + 1) <= units for _, p in patterns)

    @functools.cache
    def fewest(left, room):
        if not any(left):
            return 0
        options = [1 + fewest(left, units)] if room < units else []
        for c in range(units):
            if left[c] and c + 1 <= room:
                options.append(fewest(left[:c] + (left[c] - 1,) + left[c + 1 :], room - c - 1))
        return min(options)

    assert sum(n for n, _ in patterns) <= 1 + (1 + fewest(tuple(counts.tolist()), units))


def test_packing_covers_every_token(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    assert check_pieces(op7_cutting_stock_packing(spark.read.parquet(f"{small}/documents.parquet")).collect(), docs) > 0.97


def test_packing_odd_rows(spark):
    rows = op7_cutting_stock_packing(odd(spark).where("doc_id <> 3")).collect()
    check_pieces(rows, [(i, t) for i, t, _ in ODD if i != 3])
    assert op7_cutting_stock_packing(odd(spark).limit(0)).collect() == []
    assert op7_cutting_stock_packing(odd(spark)).where("doc_id = 3").count() == 2
