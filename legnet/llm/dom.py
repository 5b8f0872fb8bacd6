"""A small HTML tree: block elements, text blocks and the features of both.

Only what the content model needs: elements that lay out blocks are nodes, inline
elements are not, and consecutive inline text of one block is one text block. Raw
text of scripts, styles and the like never becomes a block.
"""

from __future__ import annotations

import re
from html import unescape

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "object", "select")
BLOCK = frozenset(
    "html body div p article section main nav header footer aside ul ol li dl dt dd table thead tbody tfoot tr"
    " td th caption blockquote pre form fieldset legend figure figcaption address details summary dialog menu h1 h2 h3 h4 h5 h6"
    " button label center hgroup search".split()
)
CLOSES_P = BLOCK - {"html", "body", "button", "label", "legend", "summary"}
#: An opening tag ends open elements of these names, up to the nearest scope.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
SCOPE = frozenset("ul ol dl table td th div section article main body".split())

_attribute = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_space = re.compile(r"\s+")
_raw_end = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
_name_end = re.compile(r"[\s/>]")
_special = re.compile(r"[>\"']")


class _Tags:
    """Comments, declarations and tags of a page, in one pass.

    A tag is `<`, maybe `/`, a name (a letter and all up to white space, `/` or `>`), and
    all up to the first `>` outside quotes; a name may end before a quote if only so the
    quotes close. What does not end is text. Every place is looked at a bounded number of
    times, as what follows from a place is remembered.
    """

    def __init__(self, html: str):
        self.html = html
        self.next = {_name_end: (0, -1), _special: (0, -1)}  # place asked, place found
        self.ends: dict[int, int] = {}  # of a special sign outside quotes: the tag's end, or -1
        self.cuts: dict[int, int] = {}  # of a name's end: the last quote before it to end at

    def _following(self, what: re.Pattern, at: int) -> int:
        """First place from `at` on with one of the signs, the page's length without any."""
        asked, found = self.next[what]
        if not asked <= at <= found:
            m = what.search(self.html, at)
            found = m.start() if m else len(self.html)
            self.next[what] = at, found
        return found

    def _end(self, place: int) -> int:
        """The end of a tag that goes on outside quotes at a special sign, -1 if it has none."""
        passed = []
        while place not in self.ends:
            passed.append(place)
            sign = self.html[place : place + 1]
            if sign == ">":
                self.ends[place] = place + 1
                break
            close = self.html.find(sign, place + 1) if sign else -1
            if close < 0:
                self.ends[place] = -1
                break
            place = self._following(_special, close + 1)
        out = self.ends[place]
        for p in passed:
            self.ends[p] = out
        return out

    def _tag(self, at: int):
        """(end, closing, name, attributes) of the tag at a `<`, or None."""
        html = self.html
        first = at + 2 if html.startswith("/", at + 1) else at + 1
        if not ("a" <= html[first : first + 1].lower() <= "z" and html[first].isascii()):
            return None
        stop = self._following(_name_end, first + 1)
        end = self._end(self._following(_special, stop))
        if end < 0:
            if stop not in self.cuts:
                places = (i for i in range(stop - 1, first, -1) if html[i] in "\"'" and self._end(i) >= 0)
                self.cuts[stop] = next(places, -1)
            stop = self.cuts[stop]
            if stop <= first:
                return None
            end = self._end(stop)
        return end, first == at + 2, html[first:stop], html[stop : end - 1]

    def search(self, at: int):
        """(start, end, closing, name, attributes) of what stands next; name None for no tag."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), False, None, ""
            if html.startswith(("<!", "<?"), start):
                end = html.find(">", start + 2)
                return start, end + 1 if end >= 0 else len(html), False, None, ""
            if (tag := self._tag(start)) is not None:
                return (start, *tag)
            at = start + 1
        return None


class Node:
    """A block element (text None) or a text block; parent is a position, -1 for the root."""

    __slots__ = ("name", "parent", "marks", "text", "links", "data", "depth")

    def __init__(self, name, parent, marks, depth):
        self.name, self.parent, self.marks, self.depth = name, parent, marks, depth
        self.text, self.links, self.data = None, 0, None


def parse(html: str) -> list[Node]:
    """Nodes in page order: a parent stands before its children."""
    nodes = [Node("root", -1, "", 0)]
    stack = [0]
    inline: list[str] = []  # open inline elements, for links only
    parts: list[tuple[str, bool]] = []

    def flush():
        if parts:
            text = _space.sub(" ", "".join([p for p, _ in parts])).strip()
            if text:
                leaf = Node("#text", stack[-1], "", nodes[stack[-1]].depth + 1)
                leaf.text = text
                linked = sum(len(p.strip()) for p, in_link in parts if in_link)
                leaf.links = min(1.0, linked / len(text))
                nodes.append(leaf)
            parts.clear()

    def say(text: str):
        if text:
            parts.append((unescape(text), "a" in inline))

    def close(name: str, scope) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if nodes[stack[i]].name == name:
                flush()
                del stack[i:]
                return
            if nodes[stack[i]].name in scope:
                return

    at, end, tags = 0, len(html), _Tags(html)
    while at < end:
        m = tags.search(at)
        if m is None:
            say(html[at:])
            break
        start, stop, closing, name, rest = m
        say(html[at:start])
        at = stop
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name in BLOCK:
                inline.clear()
                close(name, ())
            elif name in inline:
                del inline[len(inline) - 1 - inline[::-1].index(name) :]
            continue
        if name in _raw_end:
            if name not in ("noscript", "object"):
                raw = _raw_end[name].search(html, at)
                close_at = html.find(">", raw.end()) if raw else -1
                at = close_at + 1 if close_at >= 0 else end
            if name == "select" or name == "textarea":
                say(" ")
            continue
        if name in VOID:
            if name in ("br", "hr", "img"):
                say(" ")
            if name == "hr":
                flush()
            continue
        if name not in BLOCK:
            if name == "a" and "a" in inline:
                inline.remove("a")
            if not rest.rstrip().endswith("/"):
                inline.append(name)
            continue
        flush()
        inline.clear()
        if name in CLOSES_P:
            close("p", SCOPE)
        for other in ENDS.get(name, ()):
            close(other, SCOPE - {"td", "th"} if name in ("td", "th", "tr", "tbody") else SCOPE)
        if name[0] == "h" and len(name) == 2 and nodes[stack[-1]].name[:1] == "h" and len(nodes[stack[-1]].name) == 2:
            flush()
            stack.pop()
        marks, data = "", None
        if rest and not rest.isspace():
            for a in _attribute.finditer(rest):
                key = a[1].lower()
                if key in ("class", "id", "role", "itemprop", "aria-label"):
                    marks += " " + (a[2] or a[3] or a[4] or "").lower()
                elif key == "hidden" or (key == "style" and "display:none" in (a[2] or a[3] or "").replace(" ", "")):
                    marks += " hidden"
                elif key == "data-label":
                    data = a[2]
        node = Node(name, stack[-1], marks, nodes[stack[-1]].depth + 1)
        node.data = data
        nodes.append(node)
        stack.append(len(nodes) - 1)
    flush()
    return nodes


# Cues in class, id, role and label values, by what they point to.
CUES = {
    "menu": r"nav|menu|breadcrumb|pagination|pager|tabs|toc\b|skip",
    "head": r"masthead|banner|site-?head|page-?head|topbar|logo|branding|\bheader\b",
    "foot": r"foot|copyright|legal|colophon",
    "side": r"side|widget|related|recommend|trending|popular|promo|teaser|rail|more-|read-?next|tags?\b|archive",
    "advert": r"\bads?\b|\bad-|-ad\b|advert|sponsor|banner-|dfp|commercial|affiliate|shop",
    "notice": r"cookie|consent|gdpr|notice|alert|warning|modal|popup|overlay|paywall|subscribe|newsletter|signup|sign-up|toast|hidden",
    "comment": r"comment|disqus|respon[ds]|reply|replies|discussion|review",
    "share": r"share|social|follow|byline|author|meta\b|post-meta|date|toolbar|print",
    "form": r"form|search|login|input|field",
    "content": r"article|content|entry|post-?body|story|main|text|prose|body|markdown|blog-post|\bpost\b",
}
_cues = {k: re.compile(v).search for k, v in CUES.items()}
_memory: dict[str, tuple[str, ...]] = {}


def cues(marks: str) -> tuple[str, ...]:
    if not marks:
        return ()
    found = _memory.get(marks)
    if found is None:
        if len(_memory) > 20_000:
            _memory.clear()
        found = _memory[marks] = tuple(k for k, search in _cues.items() if search(marks))
    return found


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features that hold for each node."""
    own = []
    inside: list[frozenset] = []  # names of an element's ancestors that tell its place
    telling = frozenset("nav header footer aside form article main figure table blockquote button label".split())
    for node in nodes:
        above = inside[node.parent] if node.parent >= 0 else frozenset()
        if node.text is None:
            f = ["bias", "e:" + node.name]
            f += ["c:" + c for c in cues(node.marks)]
            here = above | {node.name} if node.name in telling else above
            if node.name == "header" and ("article" in above or "main" in above):
                f.append("header-in-article")
            inside.append(here)
        else:
            parent = nodes[node.parent].name
            text = node.text
            n = len(text)
            f = ["bias", "text", "in:" + parent]
            f.append("len:" + str(min(6, (n // 20 + 1).bit_length())))
            f.append("link:" + str(int(node.links * 4)))
            if text[-1] in ".!?:;\"”»…)":
                f.append("ends")
            if "©" in text:
                f.append("copyright")
            inside.append(above)
        own.append(f)
    return own
