"""Main text of web pages by a tree-structured graphical model.

Every block element and every text block of a page is a node that is content or not.
A node has a potential from its own features, an edge one from the pair of labels of
parent and child. On a tree, one pass of messages up and one down (sum-product) gives
the exact marginals; text blocks with a marginal of one half or more are the main text.

The weights are fitted by the gradient of the likelihood on labelled pages. The
tables hold no labels for pages, so the default ones are drawn by `labelled_pages`: a
fixed number of layouts with known roles, a documented parameter and no sample of the data.

Defined results: a missing or empty html has no text; pages are read whole; broken markup
is read as far as it goes (open elements end with the page); white space inside a block
is one space, blocks are joined by an empty line, in page order; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from legnet.llm.batches import map_batches
from legnet.llm.dom import Node, features, parse

#: Labelled pages the default model is fitted on, and passes over them.
TRAINING_PAGES, EPOCHS, SEED = 300, 16, 11


def _logaddexp(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def kind(node: Node) -> int:
    """Which edge potentials tie a node to its parent."""
    return 1 if node.text is not None else 0


class Model:
    """weights: feature -> score of `content`; pairs[kind][parent][child]: edge scores."""

    def __init__(self, weights: dict[str, float] | None = None, pairs=None):
        self.weights = weights or {}
        self.pairs = pairs or [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]

    def marginals(self, nodes: list[Node], own: list[list[str]], edges: bool = False):
        """Probability of content per node; with edges also of (content, content) etc.

        Messages run over arrays in page order, where parents stand first, so depth
        costs no stack.
        """
        get, pairs = self.weights.get, self.pairs
        n = len(nodes)
        unary = [0.0] * n
        for i, fs in enumerate(own):
            s = 0.0
            for f in fs:
                s += get(f, 0.0)
            unary[i] = s
        # up[i]: what the subtree of i says about i being 0 or 1.
        up0, up1 = [0.0] * n, unary[:]
        send0, send1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            p, w = nodes[i].parent, pairs[kind(nodes[i])]
            a = _logaddexp(up0[i] + w[0][0], up1[i] + w[0][1])
            b = _logaddexp(up0[i] + w[1][0], up1[i] + w[1][1])
            send0[i], send1[i] = a, b
            up0[p] += a
            up1[p] += b
        down0, down1 = [0.0] * n, [0.0] * n
        belief = [0.0] * n
        joint = [None] * n
        for i in range(n):
            if i:
                p, w = nodes[i].parent, pairs[kind(nodes[i])]
                # The parent's belief without what this child said.
                a = up0[p] + down0[p] - send0[i]
                b = up1[p] + down1[p] - send1[i]
                down0[i] = _logaddexp(a + w[0][0], b + w[1][0])
                down1[i] = _logaddexp(a + w[0][1], b + w[1][1])
                if edges:
                    cell = [
                        a + w[0][0] + up0[i], a + w[0][1] + up1[i],
                        b + w[1][0] + up0[i], b + w[1][1] + up1[i],
                    ]
                    top = max(cell)
                    cell = [math.exp(c - top) for c in cell]
                    whole = sum(cell)
                    joint[i] = [c / whole for c in cell]
            d = up1[i] + down1[i] - up0[i] - down0[i]
            belief[i] = 1 / (1 + math.exp(-d)) if d > -700 else 0.0
        return (belief, joint) if edges else belief

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        nodes = parse(html)
        belief = self.marginals(nodes, features(nodes))
        return "\n\n".join(
            [x.text for x, b in zip(nodes, belief) if x.text is not None and b >= 0.5]
        )


def truth(nodes: list[Node]) -> list[int]:
    """Labels from `data-label` attributes, which hold for all inside; elements without
    one are content if they hold labelled content alone."""
    marks: list[str | None] = []
    for node in nodes:
        above = marks[node.parent] if node.parent >= 0 else None
        marks.append(node.data or above)
    return [1 if m == "content" else 0 for m in marks]


def fit(pages: list[str], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Weights by gradient ascent on the labelled pages' likelihood (adaptive steps)."""
    seen = []
    for html in pages:
        nodes = parse(html)
        seen.append((nodes, features(nodes), truth(nodes)))
    model = Model()
    past: dict = {}

    def move(table, key, gradient, name):
        past[name] = past.get(name, 1e-6) + gradient * gradient
        return rate * gradient / math.sqrt(past[name])

    for _ in range(epochs):
        for nodes, own, labels in seen:
            belief, joint = model.marginals(nodes, own, edges=True)
            change: dict[str, float] = {}
            edge = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]
            for i, (fs, y) in enumerate(zip(own, labels)):
                for f in fs:
                    change[f] = change.get(f, 0.0) + y - belief[i]
                if i:
                    e = edge[kind(nodes[i])]
                    e[labels[nodes[i].parent]][y] += 1
                    for c, v in enumerate(joint[i]):
                        e[c >> 1][c & 1] -= v
            for f, g in change.items():
                w = model.weights.get(f, 0.0)
                model.weights[f] = w + move(None, f, g - decay * w, f)
            for k in range(2):
                for a in range(2):
                    for b in range(2):
                        w = model.pairs[k][a][b]
                        model.pairs[k][a][b] = w + move(None, None, edge[k][a][b] - decay * w, (k, a, b))
    return model


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Pages of many layouts; `data-label` tells the article from all else."""
    rnd = random.Random(seed)
    syllables = "ba den tor el mi ran sol ve ka pur lin os ter und qua ille ber".split()

    def words(lo: int, hi: int, stop: str = "") -> str:
        out = ["".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(rnd.randint(lo, hi))]
        return " ".join(out).capitalize() + stop

    def prose(lo=1, hi=5) -> str:
        return " ".join(words(1, 18, rnd.choice(". . . . ! ? * #".split())) for _ in range(rnd.randint(lo, hi)))

    def pick(*names: str) -> str:
        return rnd.choice(names)

    def element(name: str, inner: str, cls: str = "", label: str = "") -> str:
        a = f' class="{cls}"' if cls and rnd.random() < 0.9 else ""
        b = f' data-label="{label}"' if label else ""
        end = "" if name in ("p", "li") and rnd.random() < 0.15 else f"</{name}>"
        return f"<{name}{a}{b}>{inner}{end}"

    def links(lo=2, hi=8, lo_words=1, hi_words=3) -> str:
        item = lambda: element("li", f'<a href="/x">{words(lo_words, hi_words)}</a>')
        return element(pick("ul", "ol"), "".join(item() for _ in range(rnd.randint(lo, hi))))

    def paragraph() -> str:
        text = prose(1, 5) if rnd.random() < 0.85 else words(1, 4, pick("", "."))
        if rnd.random() < 0.3:
            text = pick("<b>{}</b>", "<em>{}</em>", '<a href="#">{}</a>', "<b>{}<br>", "<span>{}</span>").format(text)
            if rnd.random() < 0.5:
                text += " " + prose(1, 2)
        return element("p", text)

    def body_part() -> str:
        r = rnd.random()
        if r < 0.62:
            return paragraph()
        if r < 0.72:
            return element(pick("h2", "h3", "h4"), words(1, 7))
        if r < 0.79:
            return element(pick("ul", "ol"), "".join(element("li", words(2, 14, pick("", "."))) for _ in range(rnd.randint(2, 6))))
        if r < 0.84:
            return element("blockquote", paragraph())
        if r < 0.88:
            return element("pre", words(4, 20))
        if r < 0.92:
            rows = "".join(
                "<tr>" + "".join(element("td", words(1, 3)) for _ in range(3)) + "</tr>" for _ in range(3)
            )
            return element("table", rows)
        if r < 0.96:
            return element("figure", '<img src="x">' + element("figcaption", words(4, 12, ".")))
        return element("div", prose(1, 3))

    def not_content(where: str) -> str:
        """A block that is no part of the article."""
        x = "other"
        choice = {
            "top": ["menu", "menu", "header", "header-div", "notice", "advert", "crumbs", "form"],
            "bottom": ["footer", "footer", "footer-div", "comments", "comments", "related", "form", "menu", "advert", "notice"],
            "side": ["aside", "side-div", "related", "advert", "form"],
            "inside": ["advert", "share", "related", "aside", "comments", "form", "notice"],
        }[where]
        what = rnd.choice(choice)
        if what == "menu":
            return element("nav", links(), pick("", "nav", "menu", "main-nav"), x)
        if what == "crumbs":
            return element(pick("div", "nav", "ul"), " / ".join(f'<a href="/">{words(1, 2)}</a>' for _ in range(3)), pick("breadcrumb", "breadcrumbs"), x)
        if what == "header":
            return element("header", element(pick("h1", "div", "p"), words(1, 4)) + pick("", links(), element("p", words(2, 8))), pick("", "site-header", "masthead"), x)
        if what == "header-div":
            return element("div", element(pick("div", "p", "h2"), words(1, 5)) + pick("", links()), pick("header", "site-header", "masthead", "topbar", "banner"), x)
        if what == "notice":
            return element(pick("div", "section", "aside", "dialog"), element("p", prose(1, 2)) + pick("", element("button", words(1, 2))), pick("cookie-notice", "notice", "cookie-banner", "consent", "alert", "notice notice-info", "gdpr"), x)
        if what == "advert":
            return element(pick("div", "section", "aside", "p"), pick(prose(1, 2), element("p", prose(1, 2)), words(2, 8)), pick("ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "promo"), x)
        if what == "form":
            return element("form", element("label", words(1, 3)) + "<input>" + element("button", words(1, 2)) + pick("", element("p", prose(1, 1))), pick("", "search", "newsletter", "signup"), x)
        if what == "footer":
            return element("footer", pick("&copy; 2024 ", "") + pick(words(2, 8), prose(1, 1), element("p", prose(1, 2)), links()), pick("", "footer", "site-footer"), x)
        if what == "footer-div":
            return element("div", pick("&copy; ", "") + prose(1, 2), pick("footer", "site-footer", "copyright", "legal"), x)
        if what == "comments":
            one = lambda: element(pick("div", "li", "article"), element("p", prose(1, 3)), pick("comment", "comment-body", "reply"))
            return element(pick("section", "div", "ol"), element("h3", words(1, 3)) + "".join(one() for _ in range(rnd.randint(1, 4))), pick("comments", "comment-list", "responses", "discussion"), x)
        if what == "related":
            inner = element(pick("h2", "h3", "h4"), words(1, 3)) + links(2, 5, 3, 9)
            return element(pick("section", "div", "aside"), inner, pick("related", "related-posts", "recommended", "more-stories", "trending"), x)
        if what == "share":
            return element("div", pick(words(1, 3), links(2, 4, 1, 1)), pick("share", "social", "share-buttons"), x)
        inner = pick(links(), element("h3", words(1, 3)) + element("p", prose(1, 2)), prose(1, 2))
        return element("aside" if what == "aside" else "div", inner, pick("", "sidebar") if what == "aside" else pick("sidebar", "widget", "side-column"), x)

    pages = []
    for _ in range(count):
        head = element("h1", words(2, 9)) if rnd.random() < 0.9 else ""
        if rnd.random() < 0.12:
            head = element("header", head + pick("", element("p", words(3, 12))))
        parts = [head, *(body_part() for _ in range(rnd.randint(0, 9)))]
        for _ in range(pick(0, 0, 0, 1, 2)):
            parts.insert(rnd.randint(1, len(parts)), not_content("inside"))
        article = element(
            *pick(
                ("article", "".join(parts), pick("", "", "post", "article-body")),
                ("article", "".join(parts), ""),
                ("div", "".join(parts), pick("content", "article", "post", "entry-content", "story", "article-body")),
                ("main", "".join(parts), pick("", "content")),
                ("section", "".join(parts), pick("content", "article", "post-body")),
            ),
            "content",
        )
        if rnd.random() < 0.25:
            article = element("main", article + pick("", not_content("side")), pick("", "main"))
        body = "".join(not_content("top") for _ in range(rnd.randint(0, 3))) + article
        body += "".join(not_content("side") for _ in range(pick(0, 0, 1, 2)))
        body += "".join(not_content("bottom") for _ in range(rnd.randint(0, 3)))
        if rnd.random() < 0.2:
            body = element("div", body, pick("", "page", "wrapper", "container"))
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body>{body}" + pick("</body></html>", ""))
    return pages


_MODEL: list[Model] = []


def default_model() -> Model:
    if not _MODEL:
        _MODEL.append(fit(labelled_pages()))
    return _MODEL[0]


def extract(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
    model: Model | None = None,
) -> DataFrame:
    """id, url, text (empty if there is none) and n_chars of every page."""
    model = model or default_model()
    schema = StructType.fromDDL("id long, url string, text string, n_chars long")

    def run(rows):
        texts = [model.text(h) for h in rows["_html"]]
        return {"id": rows["_id"], "url": rows["_url"], "text": texts, "n_chars": [len(t) for t in texts]}

    given = pages.select(
        pages[id_col].cast("long").alias("_id"), pages[url].alias("_url"), pages[html].alias("_html")
    )
    return map_batches(given, run, schema).toDF(id_col, url, "text", "n_chars")
