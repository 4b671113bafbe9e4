"""Main text against pages whose text is known, and broken pages in bounded time."""

import html
import random
import time
from collections import Counter

import pyarrow.parquet as pq

from sparkloom.llm.html_text import extract_text


def made_pages(count):
    """(page, main text) in several layouts: text of a corpus in the middle, menus, adverts, notices, comments and footers around it."""
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t and len(t) > 600 and "\n" in t]
    rng = random.Random(12)
    link = lambda: f'<a href="/x">{rng.choice(("Home", "News", "About us", "Contact", "Prices of the week", "All stories"))}</a>'
    for _ in range(count):
        paragraphs = [" ".join(p.split()) for p in rng.choice(texts).split("\n") if len(p.split()) > 3][:8]
        body = []
        for k, p in enumerate(paragraphs):
            inner = html.escape(p)
            if k % 3 == 1:
                words = inner.split(" ")
                words[1] = f'<a href="/y">{words[1]}</a>'
                inner = " ".join(words)
            body.append(f"<p>{inner}</p>" if k % 4 else f"<p><b>{inner}</b></p>")
        rows = [("Iron", "Iron ore"), ("Tin", "Cassiterite")]
        table = "<table>" + "".join(f'<tr><td>{a}</td><td><a href="/z">{b}</a></td></tr>' for a, b in rows) + "</table>"
        layout = rng.randrange(3)
        main = "\n".join(paragraphs)
        if layout == 0:
            middle = f"<article>{''.join(body)}{table}</article>"
            main += "\n" + "\n".join(x for r in rows for x in r)
        elif layout == 1:
            middle = f'<main><div class="content">{"".join(body)}</div></main>'
        else:
            middle = f'<div id="main"><div class="post-content">{"".join(body)}</div></div>'
        menu = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(8)) + "</ul>"
        page = (
            f"<html><head><title>T</title><style>p {{ color: red }}</style><script>var a = '<p>no</p>';</script></head><body><header><nav>{menu}</nav></header><div class='cookie-notice'>We use cookies on this site.</div>{middle}"
            f"<div class='sidebar'>{menu}</div><aside class='ad'>Buy the best of the best things now!</aside><section class='comments'><p>I think that this is the worst text of them all, and I have read all of them.</p></section>"
            f"<form><label>Search</label><input></form><footer>© 2024 Acme of the world. All rights reserved. {link()}</footer></body></html>"
        )
        yield page, main


def test_words_of_known_pages():
    right = found = due = 0
    for page, main in made_pages(120):
        got, want = Counter(extract_text(page).split()), Counter(main.split())
        right += (got & want).total()
        found += got.total()
        due += want.total()
    assert right / found > 0.98 and right / due > 0.98


def test_formulas_signs_and_cells_of_an_article_stay():
    page = (
        "<article><p>The energy of the body is given by <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in all of the frames that were looked at by the authors.</p>"
        "<p>The label © 1999 Acme stood on the box that they had found in the attic of the house.</p><table><tr><td>Iron</td><td><a href='x'>Iron ore</a></td></tr></table></article><footer>© 2020 Acme</footer>"
    )
    assert extract_text(page).split("\n") == [
        "The energy of the body is given by E=m in all of the frames that were looked at by the authors.", "The label © 1999 Acme stood on the box that they had found in the attic of the house.", "Iron", "Iron ore",
    ]


def test_broken_pages_take_linear_time():
    for page in ("<a " * 700_000, "<option>x" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, '<a ">' * 100_001, "< " * 1_000_000, "<!-- x " * 300_000):
        began = time.perf_counter()
        extract_text(page)
        assert time.perf_counter() - began < 5
