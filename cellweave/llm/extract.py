"""Main-text extraction from HTML by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each at an element of the
tree of structural tags (inline tags form no path). Decisions are made in this order:

1. Over each root-to-leaf tag path, text length, punctuation and linked length per block are
   aggregated. The first two ratios are laid out in page order and smoothed with a Gaussian whose
   weights fall with the dissimilarity of two blocks' paths, then fused as a product with the share
   of text outside links. What tags, roles, classes and ids say (menu, footer, advert, article ...)
   is one more factor of the product, not a rule of its own.
2. Blocks over the threshold (a share of the fused values' mean over all characters) are seeds. The
   content node is the deepest element that holds all seeds, or the article around it (without
   one main, without one the next element that a class or id names content); blocks outside it go.
3. Inside the content node nothing goes but: blocks that the hints call noise, boxes of links alone
   (outside article and main), and, where the content node is the page's body itself, boxes without
   a seed before the first or after the last one that are no headings.

A hint by class or id is the last word of a token, words of layout aside, unless a negation, "has" or
"with" stands before it. It does not hold for an element with most of the page's unlinked text, unless
an article or main outside it has text; the same goes for form, fieldset and header elements.

Text: character references decoded, white space runs inside a block as one space, blocks in page
order joined by one newline; nothing is capped. Null, empty and text-less pages give ''. Unclosed
and stray tags are tolerated: an unclosed script or style runs to the end of the page, an unclosed
control (button, select, svg ...) hides nothing, a tag without its end is dropped. Time and memory are
linear in the page's length, whatever it holds. Repeated rows repeat; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML and MathML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li listing main menu nav "
    "ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Their content is text for the parser, to the closing tag; the first two need none.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: Controls and embedded things, left out with all inside if they are closed.
SKIPPED = frozenset("annotation annotation-xml audio button canvas noscript object select svg template video".split())
#: A second one closes the first.
SINGLE = frozenset(["button", "select"])
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
#: Elements whose open tag ends an open one of the same group.
GROUPS = ({"p"}, {"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"})
ENDS = {tag: k for k, group in enumerate(GROUPS) for tag in group}
BOUNDARY = frozenset("article aside blockquote body div dl footer form header html main nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table tbody thead tr td th figure figcaption".split())
NOISE_TAGS = frozenset("nav footer aside menu dialog".split())
#: Noise as well, but not against most of the page's text.
WEAK_TAGS = frozenset("form fieldset header".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup "
    "sidebar widget widgets related recommended share sharing social comment comments commentlist disqus respond reply replies nav navbar navigation menu breadcrumb breadcrumbs pager pagination "
    "footer header masthead popup modal overlay disclaimer legal copyright login search toolbar".split()
)
#: Words of a class or id that name a box or a place, that name the content, and that turn the next one into a property of the page.
LAYOUT_WORDS = frozenset("area bar block bottom box button buttons col column container content div group holder inner item items left links list main outer panel placeholder posts right row section slot top unit wrap wrapper zone".split())
CONTENT_WORDS = frozenset("article content entry main post story".split())
BEFORE_WORDS = frozenset("has hide hides no non not with without".split())

SIGMA = 1.0
THRESHOLD = 0.4
#: Weight of a neighbour in the smoothing: of the same path, of a path next to it, of another.
ALIKE = (1.0, 0.5, 0.0)
#: Factors of the fused value: under noise by hint, in an article or main.
NOISE_FACTOR, CONTENT_FACTOR = 0.02, 2.0
#: A box whose text is linked to more than this share, by two links or more, is a menu.
MENU = 0.6

_name = re.compile(r"/?([A-Za-z][^\s/>]*+)")
_stop = re.compile(r">|=\s*+([\"'])")
_attribute = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_comment_end = re.compile(r"--!?>")
_zeros = re.compile(r"&#0++(?=[0-9])")
_beyond = re.compile(r"&#[0-9]{8,}+;?")
_split = re.compile(r"[^a-z]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_raw_end = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_skipped = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in SKIPPED}
_hides = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_points = re.compile(r"[.,;:!?…。，！？¿¡]")

NONE, WEAK, NOISE, CONTENT = 0, 1, 2, 3


def decode(text: str) -> str:
    """Character references decoded; numbers beyond all code points become U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _beyond.sub("�", _zeros.sub("&#", text))
    return entities.unescape(text)


def _named(value: str) -> int:
    """What a class or id says: noise (weak), content, or nothing."""
    found = NONE
    for token in value.split():
        words = [w for w in _split.split(_camel.sub("-", token).lower()) if w]
        if words and words[-1] in CONTENT_WORDS and found == NONE:
            found = CONTENT
        while len(words) > 1 and words[-1] in LAYOUT_WORDS:
            words.pop()
        if words and words[-1] in NOISE_WORDS and not (len(words) > 1 and words[-2] in BEFORE_WORDS):
            return WEAK
    return found


def hint(tag: str, attributes: str) -> int:
    """What an element says of itself: noise, noise by name only (weak), content by name, or nothing."""
    found = NOISE if tag in NOISE_TAGS else WEAK if tag in WEAK_TAGS else NONE
    if not attributes or tag in ("html", "body", "article", "main"):
        return found
    for name, value in _attribute.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if found in (NONE, CONTENT):
                found = _named(value) or found
        elif (name == "role" and value.lower() in NOISE_ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _hides.search(value)):
            found = NOISE
    return found


class Page:
    """The structural tree of a page, elements in page order, and its blocks of text."""

    def __init__(self, page: str, hints: bool = True):
        self.parent, self.tag, self.hint, self.path = [-1], [""], [NONE], [0]
        self.at, self.text, self.linked, self.links = [], [], [], []  # of blocks: element, text, length of its linked part, links
        self.paths: dict[tuple[int, str], int] = {}
        self.path_parent = [-1]
        self.hints = hints
        self._stack, self._scopes, self._open = [0], [(-1,) * len(GROUPS)], {}
        self._parts, self._in_link, self._linked, self._links = [], 0, 0, 0
        self._read(page)

    # -- tree

    def _flush(self) -> None:
        if self._parts:
            joined = " ".join(decode("".join(self._parts)).split())
            if joined:
                self.at.append(self._stack[-1])
                self.text.append(joined)
                self.linked.append(min(self._linked, len(joined)))
                self.links.append(self._links)
            self._parts.clear()
        self._linked = self._links = 0

    def _push(self, tag: str, attributes: str) -> None:
        above, k = self._stack[-1], len(self._stack)
        step = (self.path[above], tag)
        if step not in self.paths:
            self.paths[step] = len(self.path_parent)
            self.path_parent.append(self.path[above])
        self._stack.append(len(self.parent))
        self.parent.append(above)
        self.tag.append(tag)
        self.hint.append(hint(tag, attributes) if self.hints else NONE)
        self.path.append(self.paths[step])
        # Where the open element of each group stands, if no boundary lies between.
        scope = self._scopes[-1]
        if tag in BOUNDARY:
            scope = (-1,) * len(GROUPS)
        if tag in ENDS:
            scope = (*scope[: ENDS[tag]], k, *scope[ENDS[tag] + 1 :])
        self._scopes.append(scope)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _cut(self, k: int) -> None:
        """Close the elements from the ``k``-th open one on."""
        self._flush()
        for node in self._stack[k:]:
            self._open[self.tag[node]] -= 1
        del self._stack[k:], self._scopes[k:]
        if self._in_link > len(self._stack):
            self._in_link = 0

    def _end_group(self, group: int) -> None:
        if self._scopes[-1][group] > 0:
            self._cut(self._scopes[-1][group])

    # -- reading

    def _skips(self, page: str, tag: str) -> dict[int, int]:
        """Begin of each closed element of this name -> begin of its closing tag."""
        out, waiting = {}, []
        for m in _skipped[tag].finditer(page):
            if not m[1]:
                if tag in SINGLE:
                    waiting.clear()
                waiting.append(m.start())
            elif waiting:
                out[waiting.pop()] = m.start()
        return out

    def _read(self, page: str) -> None:
        at, end, gone, skips = 0, len(page), set(), {}

        def find(what: str, begin: int) -> int:
            """The place of ``what``, or -1; what is not found is not looked for again."""
            if what in gone:
                return -1
            if (k := page.find(what, begin)) < 0:
                gone.add(what)
            return k

        def add(begin: int, stop: int) -> None:
            if stop > begin:
                self._parts.append(page[begin:stop])
                if self._in_link:
                    self._linked += stop - begin

        while at < end:
            k = page.find("<", at)
            if k < 0:
                add(at, end)
                break
            add(at, k)
            if page.startswith("<!--", k):
                m = _comment_end.search(page, k + 2) if "-->" not in gone else None
                if m is None:
                    gone.add("-->")
                at = m.end() if m else end
                continue
            m = _name.match(page, k + 1)
            if not m:
                mark = page[k + 1 : k + 2]
                if mark in ("!", "?") or (mark == "/" and find(">", k) >= 0):
                    stop = find("]]>", k) + 3 if page.startswith("<![CDATA[", k) else find(">", k) + 1
                    at = stop if stop > 2 else end
                else:
                    add(k, k + 1)
                    at = k + 1
                continue
            # The tag's end: a quote counts after "=" only, and only if it is closed.
            stop = m.end()
            while (s := _stop.search(page, stop)) is not None and s[1]:
                close = find(s[1], s.end())
                stop = close + 1 if close >= 0 else s.end()
            if s is None:
                break  # a tag without its end: nothing follows
            tag, attributes, at = m[1].lower(), page[m.end() : s.start()], s.end()
            self._tag(tag, page[k + 1] == "/", attributes)
            if page[k + 1] != "/" and not attributes.endswith("/"):
                if tag in RAW and ("</" + tag) not in gone:
                    found = _raw_end[tag].search(page, at)
                    if found is None:
                        gone.add("</" + tag)
                    if found or tag in ("script", "style"):
                        at = found.start() if found else end
                elif tag in SKIPPED:
                    if tag not in skips:
                        skips[tag] = self._skips(page, tag)
                    at = skips[tag].get(k, at)
        self._flush()

    def _tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._parts.append(" ")
            elif tag == "hr":
                self._flush()
                self._end_group(0)
        elif tag == "a":
            self._in_link = 0 if closing else len(self._stack)
            self._links += not closing
        elif tag in BLOCK or "-" in tag and tag not in SKIPPED:
            if closing:
                self._flush()
                if self._open.get(tag):
                    k = len(self._stack) - 1
                    while self.tag[self._stack[k]] != tag:
                        k -= 1
                    self._cut(k)
            else:
                self._flush()
                if tag in CLOSES_P:
                    self._end_group(0)
                if tag in ENDS:
                    self._end_group(ENDS[tag])
                    if tag == "tr":
                        self._end_group(ENDS["td"])
                if not attributes.endswith("/"):
                    self._push(tag, attributes)

    # -- judgement

    def noise(self) -> list[bool]:
        """Whether each element lies under noise by hint."""
        n = len(self.parent)
        sure, article = [False] * n, [-1] * n  # under noise for sure; the outermost article or main around
        for e in range(1, n):
            up = self.parent[e]
            sure[e] = sure[up] or self.hint[e] == NOISE
            article[e] = article[up] if article[up] >= 0 else e if self.tag[e] in ("article", "main") else -1
        held, marked = [0] * n, [0] * n
        for e, text, linked in zip(self.at, self.text, self.linked, strict=True):
            if not sure[e]:
                held[e] += len(text) - linked
                marked[e] += (len(text) - linked) * (article[e] >= 0)
        for e in range(n - 1, 0, -1):
            held[self.parent[e]] += held[e]
            marked[self.parent[e]] += marked[e]
        out = [False] * n
        for e in range(1, n):
            weak = self.hint[e] == WEAK and (2 * held[e] <= held[0] or (article[e] < 0 and marked[e] < marked[0]))
            out[e] = out[self.parent[e]] or sure[e] or weak
        # A title in the header of an article belongs to the article.
        for e in range(1, n):
            up = self.parent[e]
            if out[e] and self.tag[e] in HEADINGS and self.tag[up] == "header" and self.tag[self.parent[up]] == "article" and not out[self.parent[up]] and self.hint[e] == NONE:
                out[e] = False
        return out

    def fused(self, noise: list[bool]) -> list[float]:
        """The fused value of every block."""
        n = len(self.at)
        keys = [(self.path[e], noise[e]) for e in self.at]
        length, points, linked, count = {}, {}, {}, {}
        for key, text, in_links in zip(keys, self.text, self.linked, strict=True):
            length[key] = length.get(key, 0) + len(text)
            points[key] = points.get(key, 0) + len(_points.findall(text))
            linked[key] = linked.get(key, 0) + in_links
            count[key] = count.get(key, 0) + 1
        inside = [False] * len(self.parent)
        for e in range(1, len(inside)):
            inside[e] = inside[self.parent[e]] or self.tag[e] in ("article", "main")
        reach = max(1, math.ceil(2 * SIGMA))
        kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
        out = []
        for k in range(n):
            total = text_ratio = point_ratio = 0.0
            path, _ = keys[k]
            for j in range(max(0, k - reach), min(n, k + reach + 1)):
                key = keys[j]
                other = key[0]
                near = key == keys[k] or self.path_parent[other] in (path, self.path_parent[path]) or other == self.path_parent[path]
                w = kernel[j - k + reach] * (ALIKE[0] if key == keys[k] else ALIKE[1] if near and key[1] == keys[k][1] else ALIKE[2])
                total += w
                text_ratio += w * length[key] / count[key]
                point_ratio += w * points[key] / count[key]
            key, e = keys[k], self.at[k]
            factor = NOISE_FACTOR if noise[e] else CONTENT_FACTOR if inside[e] and self.hints else 1.0
            out.append(factor * text_ratio / total * (1 + point_ratio / total) * (1 - linked[key] / length[key]))
        return out


def main_text(page: str | None, hints: bool = True) -> str:
    """The main text of one page; without ``hints``, tag paths, punctuation and links alone decide."""
    if not page:
        return ""
    tree = Page(page, hints)
    if not tree.at:
        return ""
    noise = tree.noise()
    fused = tree.fused(noise)
    # The mean over characters: most of a page's text says what its text looks like.
    least = THRESHOLD * sum(f * len(t) for f, t in zip(fused, tree.text, strict=True)) / sum(map(len, tree.text))
    seeds = [e for e, f in zip(tree.at, fused, strict=True) if f >= least and f > 0 and not noise[e]]
    if not seeds:
        return ""
    # The deepest element around the first and the last seed; elements are numbered in page order.
    first, last = min(seeds), max(seeds)
    while first != last:
        if first > last:
            first = tree.parent[first]
        else:
            last = tree.parent[last]
    node = first
    # A paragraph, list or table is no content node: the element around it is. A part of an article (or, without one, of main) stands for all of it.
    while tree.tag[node] in LEAVES:
        node = tree.parent[node]
    around, up = {}, node
    while hints and up > 0:
        around[tree.tag[up]] = up
        if tree.hint[up] == CONTENT:
            around.setdefault("named", up)
        up = tree.parent[up]
    node = next((around[x] for x in ("article", "main", "named") if x in around), node)
    n = len(tree.parent)
    box, article = [-1] * n, [False] * n  # the content node's child around each element
    for e in range(1, n):
        up = tree.parent[e]
        article[e] = article[up] or tree.tag[e] in ("article", "main")
        if up == node:
            box[e] = e
        elif up > node:
            box[e] = box[up]
    # Blocks that stand in the content node itself are boxes of their own.
    boxes = [-1 if e < node or (e > node and box[e] < 0) else n + k if e == node else box[e] for k, e in enumerate(tree.at)]
    if article[node]:
        return "\n".join(t for t, b, e in zip(tree.text, boxes, tree.at, strict=True) if b >= 0 and not noise[e])
    sown = {b for b, f, e in zip(boxes, fused, tree.at, strict=True) if b >= 0 and f >= least and f > 0 and not noise[e]}
    length, linked, links, titled = {}, {}, {}, set()
    for b, e, text, in_links, m in zip(boxes, tree.at, tree.text, tree.linked, tree.links, strict=True):
        length[b], linked[b], links[b] = length.get(b, 0) + len(text), linked.get(b, 0) + in_links, links.get(b, 0) + m
        if tree.tag[e] in HEADINGS:
            titled.add(b)
    whole = tree.tag[node] in ("", "html", "body")
    low, high = min(k for k, b in enumerate(boxes) if b in sown), max(k for k, b in enumerate(boxes) if b in sown)

    def stays(k: int, b: int) -> bool:
        if b in sown:
            return True
        if links[b] > 1 and linked[b] > MENU * length[b]:
            return False
        return not whole or low < k < high or b in titled

    return "\n".join(t for k, (t, b, e) in enumerate(zip(tree.text, boxes, tree.at, strict=True)) if b >= 0 and not noise[e] and stays(k, b))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
