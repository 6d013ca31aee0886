"""Main text of web pages by composite text density.

A page becomes a tree. For every node the link-adjusted characters per tag (composite text density) are computed from the
characters, link characters, tags and link tags below it; a node's density sum adds up the densities of its children. The node of
the greatest density sum is content, widened along its path to the body to the farthest ancestor whose density reaches a
half of its own; an ``<article>`` or ``<main>`` weighs four times in that, and needs no more than a line of text (``LINE``) for each tag. The least density on the path to the body is the
threshold: outside, every node that reaches it (articles four times again) marks the subtree of the greatest density sum in it as content too.

Menus, footers, sidebars, adverts, forms, comments of readers and everything that isn't text (scripts, styles, ...) are left out
by element and role, and by class words of two kinds. Words that name such a part cut it, as do forms, unless no article stands outside and
under a tenth of the text would be left (a form or a class ``informed-consent-study`` around a page); words that may also stand in the
class of running text (``header``, ``search``, ``notice``, ...) cut a node only where its density sum stays under that of the best node without it,
or under half of the densest such node, and never where the class also names content. A node that holds an article isn't cut by its class, and an article's own header stays.

Pages are read in one pass in time that grows with their length, however broken they are. Broken markup is read as browsers do:
unknown end tags are dropped, ``<p>``, ``<li>``, table parts and the like close what they imply, what is open at the end closes
there; a quote that never closes ends with its tag, and a tag, script or comment that never ends takes the rest. Character references are decoded,
white space inside a block is one space, blocks (block elements, table cells and line breaks) are joined by one line feed in page
order. Null and empty html, and pages without text, give an empty string; an empty table gives an empty result. Rows are kept one for one, repeated ones
too; extra columns are kept.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, settled, spread

# Names of elements and words of classes.
VOID = set("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msub msup msqrt semantics".split())
CUT = set("nav footer aside button input dialog menu canvas audio video map head noscript template svg select".split())
# Elements that some pages wrap around their whole text.
WRAPPERS = set("form fieldset label object".split())
CUT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form tablist".split())
CUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager sidebar sidebars footer cookie cookies consent gdpr popup modal newsletter signup login "
    "comment comments commentlist disqus replies reply respond copyright".split()
)
# Words that running text may have in its class, too.
MAYBE_WORDS = set(
    "promo promotion promoted menu menus aside header masthead notice notices banner overlay alert subscribe subscription "
    "share sharing social related recommended recommendations widget widgets toolbar search skip".split()
)
CONTENT_WORDS = set("article content entry main post story text".split())
NOT_WORDS = set("with has no without".split())  # a class that begins so tells of a layout
ARTICLE_WEIGHT, WIDE, LINE = 4, 0.5, 25
# An open element that a start tag closes, and the elements that end the search for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
SCOPE = set("html table td th caption button body article main".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
RAW_END = {name: re.compile(rf"</{name}(?![\w-])", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden|itemprop)(?![\w-])(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
WORD = re.compile(r"[a-z]+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NEVER, ALWAYS, MAYBE, UNLESS_ALL = 0, 1, 2, 3  # the last: cut, unless next to nothing is left without it
STRENGTH = [NEVER, MAYBE, UNLESS_ALL, ALWAYS]
REST = 0.1


class Page:
    """The tree of a page as arrays, and its text in page order as (node, text) with (-1, '') between blocks."""

    def __init__(self, html: str):
        self.name, self.up, self.cut = ["#page"], [-1], [NEVER]
        self.told: list[tuple[int, str]] = []
        self.stack, self.open, self.seen = [0], {}, set()  # open: for each name the places in the stack where it is
        at, quotes = 0, True
        while at < len(html):
            start = html.find("<", at)
            if start < 0:
                self._text(html[at:])
                break
            sign = html[start + 1 : start + 2]
            closing = sign == "/"
            named = NAME.match(html, start + 1 + closing)
            if not (named or sign in ("!", "?") or closing and html[start + 2 : start + 3]):
                self._text(html[at : start + 1])  # a sign of the text
                at = start + 1
                continue
            if start > at:
                self._text(html[at:start])
            if not named:
                comment = html.startswith("<!--", start)
                end = html.find("-->" if comment else ">", start + (2 if comment else 1))
                if end < 0:
                    break
                at = end + (3 if comment else 1)
                continue
            inside = INSIDE.match(html, named.end()) if quotes else None
            if inside:
                at = inside.end()
            else:
                quotes = False  # a quote is open to the end, so from here on quotes say nothing
                end = html.find(">", named.end())
                if end < 0:
                    break
                at = end + 1
            name = named[0].lower()
            if closing:
                self._end(name)
                continue
            self._start(name, html[named.end() : at - 1])
            if name in RAW:
                end = RAW_END[name].search(html, at)
                if not end:
                    break
                at = html.find(">", end.end()) + 1
                if not at:
                    break

    def _text(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self.told.append((self.stack[-1], text))

    def _push(self, node: int) -> None:
        name = self.name[node]
        self.open.setdefault(name, []).append(len(self.stack))
        if name in SCOPE:
            self.open.setdefault("#scope", []).append(len(self.stack))
        self.stack.append(node)

    def _pop(self, depth: int) -> None:
        block = False
        while len(self.stack) > depth:
            name = self.name[self.stack.pop()]
            self.open[name].pop()
            if name in SCOPE:
                self.open["#scope"].pop()
            block = block or name not in INLINE
        if block:
            self.told.append((-1, ""))

    def _last(self, names) -> int:
        """The place in the stack of the innermost open element of these names; 0 if none is open."""
        return max((p[-1] for p in map(self.open.get, names) if p), default=0)

    def _end(self, name: str) -> None:
        depth = self._last((name,))
        if depth and not (name in INLINE and self._last(("#scope",)) > depth):
            self._pop(depth)
        elif name in ("br", "p"):
            self.told.append((-1, ""))

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES:
            closed, until = CLOSES[name]
            limit = self._last(until)
            inside = [p[k] for p in map(self.open.get, closed) if p and (k := bisect_right(p, limit)) < len(p)]
            if inside:
                self._pop(min(inside))
        if name in CLOSES_P:
            depth = self._last(("p",))
            if depth > self._last(("#scope",)):
                self._pop(depth)
        if name not in INLINE:
            self.told.append((-1, ""))
        if name in ("html", "body"):
            if name in self.seen:
                return
            self.seen.add(name)
        node = len(self.name)
        self.name.append(name)
        self.up.append(self.stack[-1])
        self.cut.append(ALWAYS if name in CUT or name in RAW or name == "header" else max(self._unwanted(name, attributes), UNLESS_ALL if name in WRAPPERS else NEVER, key=STRENGTH.index))
        if name not in VOID and name not in RAW and not attributes.rstrip().endswith("/"):
            self._push(node)

    @staticmethod
    def _unwanted(name: str, attributes: str) -> int:
        out = NEVER
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return ALWAYS
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return ALWAYS
            if key == "role" and value.lower() in CUT_ROLES:
                return ALWAYS
            if key in ("class", "id", "itemprop") and name not in ("html", "body", "main"):
                for token in value.split():
                    words = [w.lower() for w in WORD.findall(CAMEL.sub(" ", token))]
                    if not words or words[0] in NOT_WORDS:
                        continue
                    if not CUT_WORDS.isdisjoint(words):
                        out = UNLESS_ALL
                    if out == NEVER and not MAYBE_WORDS.isdisjoint(words) and CONTENT_WORDS.isdisjoint(words):
                        out = MAYBE
        return out

    def measure(self) -> None:
        """Composite text density and density sum of each node, and which nodes are left out: for the tree without all cuts, then with doubtful ones that are denser than the rest."""
        n, up, name = len(self.name), self.up, self.name
        # an article in a node shows that its class names a layout; a header in an article is part of it, a header around one isn't cut
        holds, self.inside, self.link = [False] * n, [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            if holds[i] or name[i] in ("article", "main") and not self.cut[i]:
                holds[up[i]] = True
        self.kind = list(self.cut)
        for i in range(1, n):
            self.inside[i] = self.inside[up[i]] or name[i] in ("article", "main")
            self.link[i] = self.link[up[i]] or name[i] == "a"
            if self.kind[i] and name[i] not in CUT and (holds[i] or name[i] == "header" and self.inside[up[i]]):
                self.kind[i] = NEVER
        self._keep_whole()
        if MAYBE in self.kind:
            self._densities([k == ALWAYS for k in self.kind])
            with_all = self.total
            self._densities([k > NEVER for k in self.kind])
            best = max((t for t, c in zip(self.total, self.left_out, strict=True) if not c), default=0.0)
            own = [max(a, d) if k == MAYBE else 0.0 for a, d, k in zip(with_all, self._alone(), self.kind, strict=True)]
            best = max(best, WIDE * max(own))
            self._densities([k == ALWAYS or k == MAYBE and own[i] <= best for i, k in enumerate(self.kind)])
        else:
            self._densities([k == ALWAYS for k in self.kind])

    def _keep_whole(self) -> None:
        """Decide on nodes of the kind ``UNLESS_ALL``: one is kept if no article stands outside such nodes and they hold all but ``REST`` of the text."""
        n, up, kind = len(self.name), self.up, self.kind
        while UNLESS_ALL in kind:
            inside = [-1] * n  # the outermost such node that a node stands in; -2 in one that is cut in any case
            for i in range(1, n):
                inside[i] = inside[up[i]] if inside[up[i]] != -1 else -2 if kind[i] == ALWAYS else i if kind[i] == UNLESS_ALL else -1
            chars: dict[int, int] = {}
            for i, text in self.told:
                if i >= 0 and not self.link[i]:
                    chars[inside[i]] = chars.get(inside[i], 0) + len("".join(text.split()))
            held = {i: c for i, c in chars.items() if i >= 0}
            most = max(held.values(), default=0)
            if not most or chars.get(-1, 0) > REST * most or any(inside[i] == -1 and self.name[i] in ("article", "main") for i in range(n)):
                break
            for i, c in held.items():
                if c > REST * most:
                    kind[i] = NEVER
        self.kind = [ALWAYS if k == UNLESS_ALL else k for k in kind]

    def _alone(self) -> list[float]:
        """The density of each node that may be left out, as if it were kept: its text may stand in it without an element of its own."""
        chars, tags = [0] * len(self.name), [0] * len(self.name)
        for i, text in self.told:
            if i >= 0 and not self.link[i]:
                chars[i] += len("".join(text.split()))
        for i in range(len(self.name) - 1, 0, -1):
            if self.kind[i] != ALWAYS:
                chars[self.up[i]] += chars[i]
                tags[self.up[i]] += tags[i] + 1
        return [self._density(c, 0, t, 0, 0.0) if k == MAYBE else 0.0 for c, t, k in zip(chars, tags, self.kind, strict=True)]

    @staticmethod
    def _density(c: int, lc: int, t: int, lt: int, whole: float) -> float:
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + whole * c + math.e) + 1
        return max(c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1e-9) / math.log(base), 0.0)

    def _densities(self, own: list[bool]) -> None:
        n, up, name, link = len(self.name), self.up, self.name, self.link
        cut = list(own)
        for i in range(1, n):
            cut[i] = cut[i] or cut[up[i]]
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for i, text in self.told:
            if i >= 0 and not cut[i]:
                size = len("".join(text.split()))
                chars[i] += size
                if link[i]:
                    link_chars[i] += size
        for i in range(n - 1, 0, -1):
            if not cut[i]:
                p = up[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (name[i] == "a")
        self.body = name.index("body") if "body" in self.seen else 0
        whole = link_chars[self.body] / max(chars[self.body], 1)
        self.density, self.total, self.left_out = [0.0] * n, [0.0] * n, cut
        for i in range(n - 1, -1, -1):
            if not cut[i]:
                self.density[i] = self._density(chars[i], link_chars[i], tags[i], link_tags[i], whole)
                if i:
                    self.total[up[i]] += self.density[i]

    def content(self) -> list[bool]:
        """Whether each node belongs to the main text."""
        self.measure()
        n, up, density, total, cut, body = len(self.name), self.up, self.density, self.total, self.left_out, self.body
        best = list(range(n))  # the node of the greatest density sum in each subtree; the outer one of equals
        below = [i == body for i in range(n)]
        for i in range(1, n):
            below[i] = below[i] or below[up[i]]
        for i in range(n - 1, 0, -1):
            if not cut[i] and total[best[i]] > total[best[up[i]]]:
                best[up[i]] = best[i]
        top = best[body]
        article = [name in ("article", "main") for name in self.name]
        weighed = [d * ARTICLE_WEIGHT if a else d for d, a in zip(density, article, strict=True)]
        path = [top]
        while path[-1] != body and path[-1] > 0:
            path.append(up[path[-1]])
        top = [i for i in path if i == top or i != body and (weighed[i] >= WIDE * density[top] or article[i] and density[i] >= LINE)][-1]
        threshold, above = min(density[i] for i in path), set(path)
        marked = [False] * n
        marked[top] = True
        for i in range(1, n):  # parents come before their children
            if marked[up[i]]:
                marked[i] = True
            elif below[i] and i != body and not cut[i] and i not in above and density[i] > 0 and weighed[i] >= threshold:
                # all of an article; elsewhere the densest part
                marked[i if article[i] else best[i]] = True
        for i in range(1, n):
            marked[i] = marked[i] or marked[up[i]]
        return marked

    def text(self) -> str:
        marked = self.content()
        blocks, parts = [], []
        for i, text in [*self.told, (-1, "")]:
            if i >= 0:
                if marked[i] and not self.left_out[i]:
                    parts.append(text)
            elif parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
        return "\n".join(b for b in blocks if b)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` (with html) but html itself, and text; a column of that name is replaced."""
    rest = [c for c in pages.columns if c not in ("html", "text")]
    schema = T.StructType([*pages.select(*rest).schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [main_text(h) for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(found, pa.string())], names=[*rest, "text"])

    return pages.select(*rest, "html").mapInArrow(settled(run), schema)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
