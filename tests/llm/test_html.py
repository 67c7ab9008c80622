"""Main texts of pages whose content is known."""

import html
import re
import time
from collections import Counter

from dupeloom.llm.htmlmain import extract_main_text, labelled_pages, learned_scores, main_text, region


def article_of(page):
    """What stands in the pages' one article element."""
    inside = page[page.index("<article>") :].split("</article>")[0]
    inside = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", inside))
    return " ".join(html.unescape(inside).split())


def test_articles_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: (r.url, article_of(r.html)) for r in pages.collect()}
    rows = extract_main_text(pages).collect()
    assert len(rows) == len(truth)
    assert all((r.url, r.text) == truth[r.page_id] and r.n_chars == len(r.text) for r in rows)


def test_other_layouts():
    scores = learned_scores()
    page = """<html><head><title>No</title></head><body><header><a href=/>Home</a><nav><a>One</a><a>Two</a></nav></header>
    <div class="cookie-notice">We use cookies here on this very site</div>
    <div id="content"><h1>A  headline</h1><p>First &amp; foremost,&nbsp;a <b>bo</b>ld <a href="/x">link</a> in text.</p>
    <script>var x = "<p>not this</p>";</script><div class="ad">Buy this now, only today, so cheap</div><!-- <p>nor this</p> -->
    <p>Second paragraph with more words<br>and a break<p>Third, unclosed &lt;tag&gt; &#233;</div>
    <aside>Related stories you may like</aside><form>Subscribe <input name=a> now</form>
    <section class="comments"><p>I disagree with all of this, said a reader at length.</p></section>
    <footer>Copyright 2020 by the owner of it</footer></body></html>"""
    assert main_text(page, scores) == "A headline First & foremost, a bold link in text. Second paragraph with more words and a break Third, unclosed <tag> é"
    plain = "<p>Just some text in a <a>linked</a> paragraph.</p><ul><li>One item</li><li>Two</li></ul>"
    assert main_text(plain, scores) == "Just some text in a linked paragraph. One item Two"


def test_region_is_the_greatest_sum():
    items = [("a b", 0, -1.0), ("c d e", 0, 1.0), (None, 1, -0.5), ("x", 0, -1.0), ("f g", 0, 2.0), (None, 1, -0.1), ("y z", 0, -3.0)]
    assert region(items) == (1, 5) and region([("a", 0, -1.0)]) == (0, 0) and region([]) == (0, 0)


#: Layouts that none of the labelled pages has: (page, its main text).
HELD_OUT = {
'divs':("<body><div>My Site</div><div><a href=1>One</a> <a href=2>Two</a></div><div>A long first paragraph of plain text, with several words in it, goes here.</div><div>And a second one follows it, which says some more about the same thing.</div><div>Sign up for our newsletter</div><div>Copyright 2021</div></body>","A long first paragraph of plain text, with several words in it, goes here. And a second one follows it, which says some more about the same thing."),
'colophon':("<body><div class=wrap><h1>The title</h1><p>Some text of a paragraph here, long enough to be one.</p><p>Another paragraph of it, and that is all there is to say.</p></div><div class=colophon>Made by us in the year 2020 with software</div><ol class=thread><li>He said that he liked it a lot.</li><li>She did not agree with him at all.</li></ol></body>","The title Some text of a paragraph here, long enough to be one. Another paragraph of it, and that is all there is to say."),
'tags':("<body><article><h1>T</h1><p>Intro text that is a sentence of its own here.</p><p class='tags-input highlight'>The widget accepts tags as its input, and highlights those that are known to it already.</p><p>End of the text, it is.</p></article></body>","T Intro text that is a sentence of its own here. The widget accepts tags as its input, and highlights those that are known to it already. End of the text, it is."),
'table':("<body><table><tr><td><a>Home</a><br><a>News</a><br><a>Links</a></td><td><h2>Old pages</h2>Text in a table cell, as pages had it once.<br><br>More of that text, which goes on for a while and then ends.<p>Last paragraph of the old page here.</td><td>Advertisement<br><a>Click here</a></td></tr></table><center><small>Last updated 1999</small></center></body>","Old pages Text in a table cell, as pages had it once. More of that text, which goes on for a while and then ends. Last paragraph of the old page here."),
'section':("<body><header class='hdr'><h1><a>Site name</a></h1><nav><a>A</a><a>B</a></nav></header><section><h2>Heading of the text</h2><p>First.</p><p>This section has a paragraph of reasonable length in it.</p><aside>Related: some other story</aside><p>It goes on after the aside with another one.</p><ul><li>an item</li><li>another item</li></ul></section><section id=comments><p>Nice text, I liked it very much indeed, thank you!</p></section><footer>c</footer></body>","Heading of the text First. This section has a paragraph of reasonable length in it. It goes on after the aside with another one. an item another item"),
'cookie':("<body><div id='cookie-banner'>We use cookies on this site.<button>OK</button></div><div class=content-area><p>Text about cookies and their use in kitchens, which is long enough for a paragraph.</p><p>Copyright law is its second subject, and privacy policy its third one.</p></div><div class=social-share><a>Facebook</a><a>Twitter</a></div></body>","Text about cookies and their use in kitchens, which is long enough for a paragraph. Copyright law is its second subject, and privacy policy its third one."),
'de':("<body><div class=kopf><a>Startseite</a> <a>Impressum</a></div><div><h1>Der Titel</h1><p>Ein Absatz mit einigen Worten, der lang genug ist.</p><p>Noch ein Absatz, der auch einige Worte hat.</p></div><div class=fuss>Impressum Datenschutz</div></body>","Der Titel Ein Absatz mit einigen Worten, der lang genug ist. Noch ein Absatz, der auch einige Worte hat."),
'forum':("<body><div id=hd><a>Forum</a> &raquo; <a>Board</a></div><div class='article-text'>Opening text without a paragraph, which has a number of words in it.<br>A second line of it, also long enough, ends here.</div><div class='reader-comments'><div>Well said, I thought the same thing when I saw it.</div><div>Not at all, sir.</div></div><form><textarea>x</textarea><button>Post</button></form></body>","Opening text without a paragraph, which has a number of words in it. A second line of it, also long enough, ends here."),
'promo':("<body><main><h1>Name</h1><p>One paragraph that has a few words, and then it ends.</p><div class='promo'><p>Buy our great product now, it is cheap and good for you.</p></div><p>Next paragraph that has a few words, and then it ends too.</p><div class='newsletter-form'><p>Get the best of us in your inbox every week.</p></div></main><footer>&copy; 2022</footer></body>","Name One paragraph that has a few words, and then it ends. Next paragraph that has a few words, and then it ends too."),
'short':("<body><nav><a>x</a></nav><article><p>Short.</p></article><footer>Imprint</footer></body>","Short."),
}


def test_layouts_that_were_not_learned():
    scores = learned_scores()
    assert {k: main_text(page, scores) for k, (page, _) in HELD_OUT.items()} == {k: wanted for k, (_, wanted) in HELD_OUT.items()}


def test_labelled_pages_that_were_not_learned():
    """Weights of half of the labelled pages, on the other half: words of main text found, and others left out."""
    scores = learned_scores(120)
    found = missed = wrong = 0
    for pieces in labelled_pages()[120:]:
        plain = lambda part: re.sub(r"<[^>]*>", " ", part).split()
        got = Counter(main_text("".join(t for t, _ in pieces), scores).split())
        main = Counter(w for t, m in pieces if m for w in plain(t))
        found += (got & main).total()
        missed += (main - got).total()
        wrong += (got - main).total()
    assert found > 0.97 * (found + missed) and wrong < 0.02 * found


def test_broken_and_deep_markup_takes_linear_time():
    start = time.process_time()
    assert main_text("<div>" * 50_000 + "</p></i></b>" * 50_000 + "<p>deep</p>", learned_scores()) == "deep"
    assert time.process_time() - start < 10


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>text"), (3, "w", "plain words < no tag"), (4, "x", "<<<>>>&&&<a <b <!-- open"), (4, "x", "<p>" + "long " * 50_000), (5, "y", "<p>&#xD800;a&#0;b"), (6, "z", "<div>" * 3000 + "deep" + "</p></i>" * 10)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.url): r for r in extract_main_text(pages).collect()}
    assert got[1, "u"].text == got[2, None].text == "" and got[1, "u"].n_chars == 0
    assert got[None, "v"].text == "text" and got[3, "w"].text == "plain words < no tag"
    assert got[4, "x"].n_chars in (0, 249_999) and got[6, "z"].text == "deep"
    assert extract_main_text(pages).count() == len(rows) and extract_main_text(pages.where("false")).collect() == []
