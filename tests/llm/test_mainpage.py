from time import process_time

import pytest

from spanlight.llm import mainpage
from spanlight.llm.mainpage import main_text

LONG = "The engine of the boat was in a shed on the hill and it was not to be used by the men who had come from the town for the day with it. "
JUNK = "zxq wvu tsr qpo nml kji hgf edc baz yxw vut srq pon mlk jih gfe dcb azy xwv uts rqp onm lkj ihg fed cba zyx wvu "


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("no tags at all", ""),
        ("<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p><b>One<br>two\n three<p>To.</article><footer>&copy; x</footer>", "A & B\nOne two three\nTo."),
        (f"<body><header>Site</header><main><p>{JUNK}</p><aside>side</aside><form><p>Name</p><input></form><p>End</p></main>", f"{JUNK.strip()}\nEnd"),
        (f"<article><h2>T</h2><p>{LONG}</p><div class='share-buttons'>Share</div><section id=comments><p>{LONG}</p></section></article>", f"T\n{LONG.strip()}"),
        (f'<article>{LONG}<p class="ad">buy<b><i><u><s><em><b><i><u><s><em>this<div>{LONG}</div></article>', f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<article><ul><li><a href=1>One story</a></ul><p>short</p><ul><li><a href=2>Another story</a></ul><p>{LONG}</p></article>", LONG.strip()),
        (f"<article><p>{LONG}</p><div class=ad>x</div><p>short</p><div class=ad>y</div><p>{JUNK}</p></article>", f"{LONG.strip()}\nshort\n{JUNK.strip()}"),
        (f"<p>{LONG * 2}</p><p>{JUNK}</p><p>short</p><p>{LONG * 2}</p>", f"{(LONG * 2).strip()}\n{JUNK.strip()}\nshort\n{(LONG * 2).strip()}"),
        (f"<article><p>{LONG}<div class=ad><p>{LONG}</p></div><p>x</article><div>{LONG}</div>", f"{LONG.strip()}\nx"),
        (f"<body><div class='cookie-notice'>{LONG * 3}</div><h1>Title</h1><p>{LONG * 2}</p><p>Short one.</p><p>{LONG * 2}</p><p><a href=1>more</a></p><div>{JUNK}</div>", f"Title\n{(LONG * 2).strip()}\nShort one.\n{(LONG * 2).strip()}"),
        ("<article><script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>1 &lt; 2 &#233;&nbsp;x</p><p hidden>no</p><p style='display: none'>no</p><noscript>no</noscript></article>", "1 < 2 é x"),
        ("<article class='post has-sidebar'><p>yes</p><p>a<span class=ad>buy</span>b</p></article>", "yes\nab"),
        ("<article><p>unclosed <a href='x'>link<p>next</article", "unclosed link\nnext"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul><pre>f\n  g</pre></article>", "a\nb\nc\nd\ne\nf g"),
        ("<article><ul><li><a href=1>Related story about things</a></li></ul><p>t</p></article>", "t"),
        ("<article><header><h1>H</h1><p>by someone</p></header><p>t</p></article>", "H\nt"),
        ('<article><p title="a > b">x</p><p title="unclosed>y</p></article>', "x\ny"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_long_and_broken_pages_take_linear_time():
    assert main_text("<article>" + "<p>word</p>" * 30_000 + "</article>").count("\n") == 29_999
    assert main_text("<article>" + "<b>" * 400 + "x" * 100_000) == "x" * 100_000
    main_text('<a b="' * 3000)
    for part in ("<i>", "<i></b>", "<p><i><a>x", "<li><i>", "<blockquote>x<li>y</li>", "<td><i>z", "<div></p>"):
        began = process_time()
        main_text("<article><b>" + part * 40_000)
        assert process_time() - began < 5


def test_first_pass_by_density_length_and_links():
    def block(text, links=0, tag="div", article=False):
        return mainpage.first_pass(mainpage.Block(text.strip(), links, tag, False, article), article)

    assert [block(LONG * 2), block(LONG), block(JUNK), block("a few words"), block(LONG, 100), block("home", 4)] == ["good", "near", "bad", "open", "bad", "bad"]
    assert [block(x, tag="p", article=True) for x in (LONG, JUNK, "a few words")] == ["good", "open", "open"]


def test_pages_table_with_and_without_the_article_mark(spark):
    """Containers are features only: without the article's mark, density and neighbours still find most of it."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    marked = unmarked = 0
    for html in pages:
        found = mainpage.blocks(html or "")
        want = [b.text for b, good in zip(found, mainpage.classify(found)) if good]
        for b in found:
            b.article = False
        got = [b.text for b, good in zip(found, mainpage.classify(found)) if good]
        assert not set(got) - set(want)
        marked, unmarked = marked + sum(map(len, want)), unmarked + sum(map(len, got))
    assert unmarked >= 0.8 * marked > 0


def test_query(spark, tmp_path):
    rows = [(1, "u", "<article><p>é😀</p></article>", 3), (2, None, None, 4), (None, "v", "<p>", 5), (1, "u", "<article><p>é😀</p></article>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in mainpage.op3_html(spark, str(tmp_path)).collect()), key=str)
    assert got == [(0, "v", "", 0), (1, "u", "é😀", 2), (1, "u", "é😀", 2), (2, None, "", 0)]
    assert mainpage.extract(pages.limit(0)).count() == 0
