import html as entities
import re

import pytest

from urna.llm import extract, queries
from urna.llm.common import read


def _text(html, known=frozenset()):
    page = extract.Page(html)
    return page.text(set(known))


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b", "a\nb"),
        ("<nav>menu</nav><article><h1>T</h1><p>x &amp; y&nbsp;&#233;</p></article><footer>f</footer>", "T\nx & y é"),
        ("<article><p><b>un<br><p>closed</article><p>after", "un\nclosed"),
        ("<article>a<script>var t='</p><p>no';</script>b<style>p{}</style><!-- c --></article>", "ab"),
        ("<article><p>a <em>b</em>c\n\t d</p><div class='ad'>buy</div><form>f</form><aside>s</aside></article>", "a bc d"),
        ("<article><p>t</p><section id='comments'><p>reader</p></section><div role=alert>n</div></article>", "t"),
        ("<main><div><p>m</p></div></main><div>o</div>", "m"),
        ("<body><header>h</header><div>a</div><div>b</div><div class='cookie-notice'>c</div></body>", "a\nb"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<article><p>x</p><script>never closed", "x"),
        ("<article class='sidebar'><p>kept</p></article>", "kept"),
        ("<article><div class='post-header'><p>Body text here.</p></div><p>x</p></article>", "Body text here.\nx"),
        ("<article><div class='post-header'><p>By me</p></div><p>A longer body text.</p></article>", "A longer body text."),
        ("<article><p>t</p><div class='comments'><p>a reader's very long comment</p></div></article>", "t"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article><p title='a>b'>q</p></article", "q"),
    ],
)
def test_pages(html, text):
    assert _text(html) == text


def test_equal_subtrees_have_equal_hashes():
    a, b = extract.Page("<div><p>x</p><p>y</p></div>"), extract.Page("<body><div> <p>x</p><p>y</p> </div></body>")
    assert a.hashes[1] == b.hashes[2] and a.hashes[2] != a.hashes[3]


@pytest.fixture(scope="module")
def site(spark):
    box = "<div><b>Call us</b> on <i>0800</i></div>"
    rows = [(i, f"http://s.example/{i}", f"<body>{box}<div><p>story {i}</p><p>shared line</p></div></body>") for i in range(8)]
    rows += [(20 + i, "http://copies.example/", f"<body>{box}<div><p>one story</p></div></body>") for i in range(8)]
    rows += [(40 + i, f"http://t.example/{i}", f"<body>{box}<article><p>said {i}</p><p>often quoted</p>{box}</article></body>") for i in range(6)]
    rows += [(60, None, None), (61, "odd", ""), (62, "http://one.example/", f"<body>{box}</body>"), (62, "http://one.example/", f"<body>{box}</body>")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, host string, templates string")


@pytest.mark.parametrize("broadcast", [1_000_000, -1])
def test_what_a_site_repeats_goes(site, broadcast, monkeypatch):
    monkeypatch.setattr(extract, "BROADCAST_TEMPLATES", broadcast)
    rows = extract.extract(site).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == site.count() and all(r.n_chars == len(r.text) for r in rows)
    # The shared line recurs outside an article, so it is template; copies of a page are one page.
    assert all(got[i] == f"story {i}" for i in range(8))
    assert all(got[20 + i] == "Call us on 0800\none story" for i in range(8))
    assert all(got[40 + i] == f"said {i}\noften quoted" for i in range(6))
    assert got[60] == "" and got[61] == "" and got[62] == "Call us on 0800"


def test_no_pages(site):
    assert extract.extract(site.limit(0)).count() == 0


def test_whole_table_equals_a_plain_reading(spark, small):
    want = {}
    for r in read(spark, small, "pages").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside[1].replace("<br>", " ")) if inside else "")
        want[r.page_id] = "\n".join(b for b in (" ".join(entities.unescape(x).split()) for x in parts) if b)
    got = {r.page_id: r.text for r in queries.op2_html_extraction(spark, small).collect()}
    assert got == want


def test_a_section_box_of_a_large_host_goes(spark):
    """On 6 of 1,200 pages: 0.5 %."""
    rows = [(i, f"http://big.example/{i}", f"<body>{'<div><b>Call us</b></div>' if i < 6 else ''}<div>story {i}</div></body>") for i in range(1200)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"story {i}" for i in range(1200)}
