"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

Every word scores by the elements that it stands in, by its block (how long it is, how much of it is links, whether
it ends as a sentence does) and by itself; every tag scores by its name.  The weights are log-odds counted on
labelled pages, which are made from layouts, names and wordings by ``labelled_pages``.  One linear scan finds the
contiguous run of words and tags with the greatest sum: the content region.  Of it, blocks whose own score is
negative (an advert between paragraphs) are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRACTED = "page_id long, url string, text string, n_chars long"

#: What pages say beside their main text, by what it is: wordings, and names that its element may have.
BESIDE = {
    "header": (("Home", "My Site", "The Daily Page", "Welcome to our website", "Log in", "Register", "Skip to content", "Search"), ("header", "site-header", "masthead", "top", "topbar", "logo", "branding", "banner")),
    "nav": (("Home", "About us", "Contact", "News", "Products", "Blog", "Services", "Help", "Sitemap", "Archive", "Login", "Startseite", "Kontakt", "Accueil", "Inicio", "Contacto"), ("nav", "navbar", "menu", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip")),
    "footer": (("Copyright 2021", "All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Contact us", "Powered by software", "© 2020 by the owner", "Legal notice", "Cookie policy", "Impressum", "Datenschutz", "Alle Rechte vorbehalten", "Mentions legales", "Tous droits reserves", "Aviso legal", "Todos los derechos reservados"), ("footer", "site-footer", "colophon", "copyright", "legal", "bottom", "credits", "disclaimer")),
    "sidebar": (("Popular posts", "Recent articles", "Categories", "Tags", "Most read", "You may also like", "Related stories", "Follow us", "Top ten", "Trending now"), ("sidebar", "side", "widget", "widget-area", "complementary", "recent", "popular", "trending", "more-stories", "recommended", "related", "outbrain")),
    "notice": (("We use cookies to improve your experience.", "Accept all cookies", "This site uses cookies.", "Please enable JavaScript.", "Subscribe to continue reading", "Your browser is out of date.", "Accept", "Diese Website verwendet Cookies.", "Ce site utilise des cookies.", "Este sitio usa cookies."), ("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "banner", "popup", "modal", "warning", "overlay")),
    "advert": (("Advertisement", "Sponsored", "Buy now and save", "Click here for our offer", "Limited offer, only today", "Free shipping on all orders", "Shop now", "Anzeige", "Werbung", "Publicité", "Publicidad"), ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "dfp")),
    "form": (("Sign up for our newsletter", "Your email address", "Subscribe", "Enter your name", "Send", "Password", "Sign up", "Search this site", "Submit", "Newsletter abonnieren", "Anmelden", "Inscription", "Suscribirse"), ("newsletter", "subscribe", "signup", "search", "login", "contact-form", "form")),
    "share": (("Share", "Tweet", "Share on Facebook", "Email", "Print", "Posted by admin", "Filed under", "Comments off", "Permalink", "Read more", "Teilen", "Partager", "Compartir"), ("share", "social", "sharing", "byline", "meta", "post-meta", "tags", "tools", "print")),
    "comments": (("I disagree with this.", "Great post, thanks for sharing!", "Leave a comment", "Reply", "First!", "3 comments", "Anonymous said on Monday", "You are wrong, and here is why, my friend.", "Kommentare", "Antworten", "Commentaires", "Comentarios", "Responder"), ("comments", "comment", "comment-list", "respond", "replies", "reply", "thread", "discussion", "disqus", "reviews", "responses")),
}
#: The elements that such parts come in, by what they are; a name, if there is a place for one, goes into class or id.
ELEMENTS = {
    "header": ("<header{}>%</header>", "<header{}><p>%</p></header>", "<div{}>%</div>"),
    "nav": ("<nav{}><ul><li><a>%</a></li><li><a>%</a></li><li><a>%</a></li></ul></nav>", "<ul{}><li><a>%</a></li><li><a>%</a></li><li><a>%</a></li></ul>", "<div{}><a>%</a> | <a>%</a> | <a>%</a></div>", "<menu{}><li>%</li></menu>"),
    "footer": ("<footer{}><p>%</p><p><a>%</a> <a>%</a></p></footer>", "<div{}>% <a>%</a></div>", "<footer{}><small>%</small></footer>", "<div><p{}>%</p></div>"),
    "sidebar": ("<aside{}><h2>%</h2><ul><li><a>%</a></li><li><a>%</a></li></ul></aside>", "<div{}><h3>%</h3><a>%</a><br><a>%</a></div>", "<td{}><a>%</a><br><a>%</a></td>", "<section{}><h4>%</h4><p><a>%</a></p></section>"),
    "notice": ("<div{}>% <button>%</button></div>", "<div{}><p>%</p></div>", "<section{}><p>%</p><a>%</a></section>", "<dialog{}>%</dialog>"),
    "advert": ("<div{}>%</div>", "<div{}><p>%</p><a>%</a></div>", "<aside{}><a>%</a></aside>", "<ins{}>%</ins>", "<div{}><h4>%</h4><p>%</p></div>"),
    "form": ("<form{}><label>%</label><button>%</button></form>", "<div{}><form><p>%</p><button>%</button></form></div>", "<div{}><p>%</p></div>"),
    "share": ("<div{}><a>%</a> <a>%</a></div>", "<ul{}><li><a>%</a></li><li>%</li></ul>", "<p{}>% <a>%</a></p>"),
    "comments": ("<section{}><h3>%</h3><div><p>%</p></div><div><p>%</p></div></section>", "<ol{}><li><b>%</b> %</li><li>% <a>%</a></li></ol>", "<div{}><h3>%</h3><p>%</p><p>%</p></div>", "<ul{}><li><p>%</p></li></ul>"),
}
#: Where the main text stands (* is its body), and what it is made of (+ is a sentence, - a few words).
FRAMES = (
    "<main><article>*</article></main>", "<article>*</article>", "<div id='content' class='post'><div class='entry-content'>*</div></div>", "<div>*</div>", "<div class='main article-body' role='main'>*</div>",
    "<div class='story text'>*</div>", "<section class='page'>*</section>", "<table><tr><td>*</td></tr></table>", "<div id='wrapper'><div id='main'>*</div></div>", "<article><header><h1>-</h1><h2>-</h2></header>*</article>",
    "<div class='container'><div class='row'><div class='col'>*</div></div></div>", "<div itemprop='articleBody'>*</div>",
)
BODIES = (
    "<h1>-</h1><p>+ +</p><p>+ <b>-</b> +</p><h2>-</h2><p>+ <a>-</a> + +</p>",
    "<h1>-</h1><div>+ +</div><div>+ + +</div><div>+</div>",
    "<p>+ + +</p><ul><li>-</li><li>- +</li><li><a>-</a> -</li></ul><p>+ +</p>",
    "<h2>-</h2><p><b>+</b><br></p><p>+</p><p>-</p><blockquote>+ +</blockquote><p>+ <i>-</i> <em>-</em> <strong>-</strong> +</p>",
    "<h1>-</h1><p>+ <a>-</a> + <code>-</code> +</p><pre>- -</pre><h3>-</h3><ol><li>+</li><li>+</li></ol><table><tr><td>-</td><td>-</td></tr></table>",
    "<p>+ +<br><br>+ + +<br><br>+</p>",
    "<h1>-</h1><figure><figcaption>+</figcaption></figure><p>+ +</p><dl><dt>-</dt><dd>+</dd></dl><p>+ <span>-</span> <small>-</small> +</p><h4>-</h4><p>+</p>",
    "<div>+ + +</div><div>+ +</div><h3>-</h3><div>+ <a>-</a> <u>-</u> +</div>",
    "<h1 class='top-title'>-</h1><p class='meta-text'>+</p><p class='tags-note'>+ +</p><div class='side-note'>+</div><p class='more-text'>+ +</p><div class='print-body'><p>+</p></div>",
    "<p class='top-story'>+ +</p><div class='widget-demo'>+</div><div class='search-result'><p>+</p></div><ul class='list-area'><li>-</li><li>+</li></ul><p class='body-form'>+</p><p class='skip-print'>+</p>",
)
#: Plain words of main text.
PLAIN = "the of and to in a is that it was for on as with he be at by this had not are but from or have an they which one were all her she there would their we him been has when who will no more if out so what up said its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many before must through".split()


def labelled_pages(n: int = 240) -> list[list[tuple[str, bool]]]:
    """Pages as (html, whether its words are main text) pieces, dealt from the layouts, names and wordings above by a fixed seed."""
    import random

    rng = random.Random(7)
    few = lambda: " ".join(rng.choices(PLAIN, k=rng.randint(1, 6))).capitalize()
    sentence = lambda: " ".join(rng.choices(PLAIN, k=rng.randint(5, 30))).capitalize() + rng.choice(".....?!")

    def part(kind: str) -> tuple[str, bool]:
        wordings, names = BESIDE[kind]
        name = rng.choice([f" class='{rng.choice(names)}'", f" id='{rng.choice(names)}'", f" class='{rng.choice(names)} {rng.choice(names)}'", ""])
        pieces = rng.choice(ELEMENTS[kind]).replace("{}", name).split("%")
        said = [rng.choice(wordings) for _ in pieces[1:]]
        return pieces[0] + "".join(w + p for w, p in zip(said, pieces[1:], strict=True)), False

    out = []
    for i in range(n):
        body = "".join({"+": sentence, "-": few}.get(c, lambda c=c: c)() for c in BODIES[i % len(BODIES)])
        before, after = FRAMES[i * 5 % len(FRAMES)].replace("-", few()).split("*") if "-</h" in FRAMES[i * 5 % len(FRAMES)] else FRAMES[i * 5 % len(FRAMES)].split("*")
        middle = [(body, True)]
        if rng.random() < 0.6:  # something between two blocks of it
            ends = [k for k in range(len(body)) if body.startswith(("</p>", "</div>", "</ul>"), k)]
            at = body.index(">", rng.choice(ends)) + 1
            middle = [(body[:at], True), part(rng.choice(("advert", "share", "notice", "form", "sidebar"))), (body[at:], True)]
        top = [part(k) for k in ("notice", "header", "nav", "advert") if rng.random() < 0.6]
        end = [part(k) for k in ("share", "comments", "sidebar", "form", "footer") if rng.random() < 0.6]
        out.append([("<body>", False), *top, (before, True), *middle, (after, True), *end, ("</body>", False)])
    return out


#: Elements whose content is never text of the page, those without content, and those that begin a new block. Fixed values.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "head", "title", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_RAW_NAMES = "|".join(RAW)
_token = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW_NAMES})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|(?=<body\b)|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>(?:[^<]|<(?![a-z!?/]))+)",
    re.I | re.S,
)
_attribute = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_split = re.compile(r"[^a-z]+")

#: How far a word's score can go, what speaks for a word where no feature is known, and how much more weighs what
#: speaks against one: a block in an article that is marked as an advert is one.
#: A block in a region takes at most LEAST a word from its sum, so that a short one beside long text cannot split it.
FARTHEST, NEUTRAL, AGAINST, LEAST = 6.0, 1.5, 2.0, -1.5
#: How far the weights of a block's shape (a quarter of it for what speaks against short ones, as items of lists are) and
#: of a word itself can go, and in how many pages a word must stand to have one.
SHAPE_MOST, WORD_MOST, WORD_PAGES = 2.0, 3.0, 3
#: Elements that stand in text as well as beside it; what speaks against these are the links in them, so they do so by a quarter at most.
COMMON = frozenset(f"<{t}>" for t in (*INLINE, "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "p", "header", "table", "tr", "td"))
#: Elements that hold anything.
FRAME = frozenset(("<body>", "<html>", "<div>", "<section>", "<td>", "<tr>", "<table>", "<tbody>", "<center>"))
MOST_CONTEXTS = 20_000


def features(name: str, attributes: str) -> frozenset[str]:
    """What an element says about its content: its name, and the names in its class, id and role, each whole and, with ~, by its words."""
    found = {f"<{name}>"}
    if "=" in attributes:
        for groups in _attribute.findall(attributes):
            for whole in "".join(groups).lower().split():
                found.add(whole)
                found.update(f"{whole}~{w}" for w in _split.split(whole) if w)
    return frozenset(found)


class Scores:
    """Weights of features, tags, blocks' shapes and words, and the contexts met so far, each with its score."""

    def __init__(self, weights: dict[str, float], tags: dict[str, float], unknown_tag: float, shapes: dict[str, float] | None = None, words: dict[str, float] | None = None):
        self.weights, self.tags, self.unknown_tag, self.shapes, self.words = weights, tags, unknown_tag, shapes or {}, words or {}
        self.clear()

    def clear(self) -> None:
        self.sets: list[frozenset[str]] = [frozenset()]
        self.values = [NEUTRAL]
        self.below: dict[tuple[int, str, str], int] = {}

    def weight(self, feature: str) -> float:
        """A known name's own weight, else six tenths of its words', from -4.5 to 2 each."""
        whole, _, word = feature.partition("~")
        if word:
            return 0.0 if whole in self.weights else max(-4.5, min(2.0, 0.6 * self.weights.get(f"~{word}", 0.0)))
        return self.weights.get(feature, 0.0)

    def enter(self, context: int, name: str, attributes: str) -> int:
        """The context inside an element of another context."""
        attributes = attributes if "=" in attributes and _attribute.search(attributes) else ""
        key = (context, name, attributes)
        found = self.below.get(key)
        if found is None:
            whole = self.sets[context] | features(name, attributes)
            score = NEUTRAL + sum(self.weight(f) for f in whole)
            found = self.below[key] = len(self.sets)
            self.sets.append(whole)
            self.values.append(max(-FARTHEST, min(FARTHEST, score)))
        return found


def shape(n_words: int, n_linked: int, text: str) -> tuple[str, str, str]:
    """What a block's form says: its length, the share of links, and how it ends."""
    long = "1" if n_words < 2 else "2-4" if n_words < 5 else "5-9" if n_words < 10 else "10-24" if n_words < 25 else "25+"
    share = n_linked / max(1, n_words)
    return f"words {long}", "links " + ("none" if not n_linked else "some" if share < 0.34 else "many" if share < 0.9 else "all"), "ends " + ("so" if text.rstrip()[-1:] in ".!?:;…\"”»" else "open")


def read(page: str, scores: Scores) -> list[tuple[str | None, int, float]]:
    """(text, context, score of a word) of each run of text, and (None, 1 if it ends a block, score) of each tag, in page order."""
    if len(scores.sets) > MOST_CONTEXTS:
        scores.clear()
    out: list[tuple[str | None, int, float]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter = Counter()
    block: list[int] = []  # the runs of text of the block so far

    def leave(names: tuple[str, ...], within: int) -> None:
        """Close the innermost of some elements, if one is open among the last few."""
        if not any(opened[name] for name in names):
            return
        for k in range(len(stack) - 1, max(0, len(stack) - 1 - within), -1):
            if stack[k][0] in names:
                for name, _ in stack[k:]:
                    opened[name] -= 1
                del stack[k:]
                return

    def end_block() -> None:
        """Adds what the block's shape and its words say to the scores of its runs."""
        sizes = [len(out[i][0].split()) for i in block]
        n = sum(sizes)
        if n:
            linked = sum(k for i, k in zip(block, sizes, strict=True) if "<a>" in scores.sets[out[i][1]])
            form = sum(scores.shapes.get(f, 0.0) for f in shape(n, linked, next(out[i][0] for i in reversed(block) if out[i][0].strip())))
            said = [w for i in block for w in _split.split(out[i][0].lower()) if w] if scores.words and n < 25 else []
            told = [scores.words[w] for w in said if w in scores.words]
            own = sum(told) * min(1.0, 2.5 * len(told) / max(1, len(said)))  # some such words in a longer text say little
            for i in block:
                out[i] = (*out[i][:2], out[i][2] + form + max(-WORD_MOST, min(WORD_MOST, own)))
        block.clear()

    for m in _token.finditer(page):
        if m["text"] is not None:
            context = stack[-1][1]
            block.append(len(out))
            out.append((m["text"], context, scores.values[context]))
        elif m["name"]:
            name = m["name"].lower()
            if name not in INLINE:
                end_block()
            out.append((None, name not in INLINE, scores.tags.get(name, scores.unknown_tag)))
            if m["end"]:
                leave((name,), len(stack))
            elif name not in VOID and not m["attributes"].endswith("/"):
                if name in CLOSES_P:
                    leave(("p",), 8)
                elif name in ITEMS:
                    leave(ITEMS[name], 6)
                stack.append((name, scores.enter(stack[-1][1], name, m["attributes"])))
                opened[name] += 1
            elif name in CLOSES_P:
                leave(("p",), 8)
        elif m["raw"]:
            apart = m["raw"].lower() not in ("svg", "math", "select")
            if apart:
                end_block()
            out.append((None, apart, scores.unknown_tag))
    end_block()
    return out


def learned_scores(n_pages: int = 240) -> Scores:
    """Naive log-odds of main against the rest for each feature, shape and word; a tag's score is negative, the more so the rarer it is among main text.

    Elements are counted by their blocks, so that a long text does not outweigh many short ones.
    """
    main, rest, tag_main, tag_rest = Counter(), Counter(), Counter(), Counter()
    pages_of: Counter = Counter()
    n_main = n_rest = 0
    for pieces in labelled_pages(n_pages):
        plain = Scores({}, {}, -1.0)
        marks, page = [], ""
        for text, is_main in pieces:
            page += text
            marks.append((len(page), is_main))
        at, met, blocks = 0, set(), [[]]
        for text, context, _ in read(page, plain):  # where each run stands: texts come in the order of the page
            if text is None:
                if context:  # it ends a block
                    blocks.append([])
                continue
            at = page.index(text, at)
            blocks[-1].append((text, context, next(m for end, m in marks if at < end)))
            at += len(text)
        for runs in blocks:
            runs = [(text, context, is_main) for text, context, is_main in runs if text.strip()]
            if not runs:
                continue
            size = sum(len(text.split()) for text, _, _ in runs)
            linked = sum(len(text.split()) for text, context, _ in runs if "<a>" in plain.sets[context])
            form = shape(size, linked, runs[-1][0])
            for text, context, is_main in runs:
                n_main, n_rest = n_main + is_main, n_rest + (not is_main)
                own = {f"word {w}" for w in _split.split(text.lower()) if w}
                met |= own
                for f in {*("~" + f.partition("~")[2] if "~" in f else f for f in plain.sets[context]), *form, *own}:
                    (main if is_main else rest)[f] += 1
                for f in plain.sets[context]:
                    if f[0] == "<":
                        (tag_main if is_main else tag_rest)[f[1:-1]] += 1
        pages_of.update(met)
    weight = lambda f: math.log((main[f] + 0.5) / (n_main + 1)) - math.log((rest[f] + 0.5) / (n_rest + 1))
    some = {*main, *rest} - FRAME
    within = lambda x, most: max(-most, min(most, x))
    tags = {t: -0.25 * math.log1p((tag_rest[t] + 0.5) / (tag_main[t] + 0.5)) for t in (*tag_main, *tag_rest)}
    tags |= {t: max(w, -0.1) for t, w in tags.items() if f"<{t}>" in COMMON}
    weights = {f: weight(f) for f in some if " " not in f}
    shapes = {f: max(within(weight(f), SHAPE_MOST), -SHAPE_MOST if f[0] == "l" else -SHAPE_MOST / 4) for f in some if f.split()[0] in ("words", "links", "ends") and " " in f}
    words = {f[5:]: within(weight(f), WORD_MOST) for f in some if f.startswith("word ") and pages_of[f] >= WORD_PAGES and f[5:] not in PLAIN}
    return Scores({f: max(w, -0.25) if f in COMMON else w * (AGAINST if w < 0 else 1) for f, w in weights.items()}, tags, -0.25, shapes, words)


def region(items: list[tuple[str | None, int, float]]) -> tuple[int, int]:
    """The items of the run with the greatest sum of scores: the first of them, the longest of those; (0, 0) if none is positive."""
    best = total = 0.0
    start, found = 0, (0, 0)
    for i, (text, _, score) in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        total += score if text is None else max(score, LEAST) * len(text.split())
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, scores: Scores) -> str:
    """The text of a page's content region: white space within a block as one space, blocks joined by one space."""
    items = read(page or "", scores)
    start, end = region(items)
    parts = []
    for text, breaks, score in items[start:end]:
        if text is None:
            if breaks:
                parts.append(" ")
        elif score > 0:
            parts.append(html.unescape(text))
    return " ".join("".join(parts).split())


@lru_cache(maxsize=1)
def _scores() -> Scores:
    return learned_scores()


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scores = _scores()
    for batch in batches:
        texts = [main_text(page, scores) for page in batch.column(2).to_pylist()]
        # a lone surrogate, which a numeric reference can name, is no character
        texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) of each row of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text; unclosed and broken markup is read as far as it goes; nulls in
    page_id and url stay; repeated rows give a row each; an empty table gives none; other columns are ignored.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_extracted, EXTRACTED)
