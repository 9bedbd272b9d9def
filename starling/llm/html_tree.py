"""An HTML tokenizer and tree builder: implied tags, raw text, foreign content, and structure of tables and selects.

Every step moves forward in the page and each open element is closed once, so the time is linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

# Fixed values of the HTML standard: kinds of elements.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset(("textarea", "title"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Start tags that close an open paragraph.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary ul xmp".split())
#: Elements that an end tag of another element does not reach across.
SCOPE = ("applet", "caption", "marquee", "object", "table", "td", "template", "th", "foreignobject")
#: Start tags of HTML that end svg and math.
BREAKOUT = HEADINGS | frozenset("b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext".split())
#: Elements whose end tag may be left out, closed when another element ends around them.
IMPLIED_ENDS = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
GROUPS = frozenset(("tbody", "thead", "tfoot"))
IN_SELECT = frozenset("option optgroup hr script template".split())

NAME = re.compile(r"[^\t\n\f />]+")
GAP = re.compile(r"[\t\n\f /]*")
ATTRIBUTE = re.compile(r"[^\t\n\f />][^\t\n\f />=]*")
EQUALS = re.compile(r"[\t\n\f ]*=[\t\n\f ]*")
UNQUOTED = re.compile(r"[^\t\n\f >]*")
COMMENT_END = re.compile(r"--!?>")
SCRIPT_STEP = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.IGNORECASE)


class Node:
    __slots__ = ("attrs", "children", "depth", "foreign", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, depth: int = 0, foreign: bool = False):
        self.tag, self.attrs, self.children, self.depth, self.foreign = tag, attrs or {}, [], depth, foreign


class TreeBuilder:
    """Builds the tree of one page. `root` is the html element and `body` its only child; the head needs no node, as nothing in it shows."""

    def __init__(self, html: str):
        self.html = html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
        self.root = Node("html")
        self.body = Node("body", depth=1)
        self.root.children.append(self.body)
        self.open = [self.root, self.body]
        self.by_tag: dict[str, list[Node]] = {}  # open nodes of each tag, outermost first
        self.skip_newline = False
        self._run()

    # Open elements.

    def _push(self, tag: str, attrs: dict[str, str] | None = None, foreign: bool = False) -> Node:
        node = self._leaf(tag, attrs, foreign)
        self.open.append(node)
        self.by_tag.setdefault(tag, []).append(node)
        return node

    def _leaf(self, tag: str, attrs: dict[str, str] | None = None, foreign: bool = False) -> Node:
        node = Node(tag, attrs, len(self.open), foreign)
        self.open[-1].children.append(node)
        return node

    def _pop(self) -> None:
        node = self.open.pop()
        same = self.by_tag[node.tag]
        if same and same[-1] is node:  # a formatting element may have been closed before
            same.pop()

    def _last(self, *tags: str) -> int:
        """Depth of the innermost open element of these tags, 0 if there is none."""
        return max((found[-1].depth for t in tags if (found := self.by_tag.get(t))), default=0)

    def _pop_to(self, depth: int) -> None:
        """Closes all elements deeper than depth."""
        while len(self.open) > depth + 1 and len(self.open) > 2:
            self._pop()

    def _close(self, tag: str, *fences: str) -> bool:
        """Closes the innermost `tag`, with all in it, unless one of the fences or of SCOPE is nearer."""
        at = self._last(tag)
        if at and at > self._last(*(f for f in SCOPE + fences if f != tag)):
            self._pop_to(at - 1)
            return True
        return False

    def _ready(self) -> None:
        """Drops formatting elements that were closed while a block stood in them, once they are innermost."""
        while len(self.open) > 2 and self.open[-1].tag in FORMATTING and not self.open[-1].foreign and self._last(self.open[-1].tag) != self.open[-1].depth:
            self._pop()

    # Tags.

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        self._ready()
        here = self.open[-1]
        if here.foreign and here.tag not in HTML_INSIDE:
            if tag not in BREAKOUT and not (tag == "font" and attrs.keys() & {"color", "face", "size"}):
                if closed:
                    self._leaf(tag, attrs, True)
                else:
                    self._push(tag, attrs, True)
                return
            while self.open[-1].foreign and self.open[-1].tag not in HTML_INSIDE:
                self._pop()
        if tag in ("html", "body", "head", "frameset"):
            node = {"html": self.root, "body": self.body}.get(tag)
            if node:
                node.attrs = attrs | node.attrs
            return
        select = self._last("select")
        if select and select > self._last("template"):
            if tag == "select":
                return self._pop_to(select - 1)
            if tag in ("input", "textarea", "keygen") or (tag in TABLE_PARTS | {"table"} and self._last("td", "th", "caption")):
                self._pop_to(select - 1)
            elif tag not in IN_SELECT:
                return
        if tag in TABLE_PARTS:
            return self._table_part(tag, attrs)
        if tag in ENDS_P or (tag == "table" and self._last("p")):
            self._close("p", "button")
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop()
        elif tag == "li":
            self._close("li", "ul", "ol", "menu", "dir")
            self._close("p", "button")
        elif tag in ("dd", "dt"):
            if not self._close("dd", "dl"):
                self._close("dt", "dl")
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self._pop()
            if tag == "optgroup" and self.open[-1].tag == "optgroup":
                self._pop()
        elif tag in ("button", "nobr", "a"):
            if tag == "button":
                self._close(tag)
            else:
                self._end_formatting(tag)
                self._ready()
        elif tag in ("rt", "rp", "rb", "rtc"):
            while self.open[-1].tag in ("rt", "rp", "rb") or (self.open[-1].tag == "rtc" and tag in ("rb", "rtc")):
                self._pop()
        elif tag == "form" and self._last("form"):
            return
        elif tag == "table" and self._last("table") > self._last("td", "th", "caption", "template"):
            self._pop_to(self._last("table") - 1)
        elif tag == "image":
            tag = "img"
        if tag in ("svg", "math"):
            if closed:
                self._leaf(tag, attrs, True)
            else:
                self._push(tag, attrs, True)
        elif tag in VOID:
            self._leaf(tag, attrs)
        else:
            self._push(tag, attrs)
            self.skip_newline = tag in ("pre", "listing", "textarea")

    def _table_part(self, tag: str, attrs: dict[str, str]) -> None:
        """Opens a part of the innermost table, with the row and the group it implies; outside of tables the tag is ignored."""
        table = self._last("table")
        if not table or self._last("template") > table:
            return
        if tag in ("td", "th", "tr"):
            group = self._last(*GROUPS)
            if group < table:
                self._pop_to(table)
                group = self._push("tbody").depth
            row = self._last("tr")
            if tag == "tr":
                self._pop_to(group)
            elif row < group:
                self._pop_to(group)
                self._push("tr")
            else:
                self._pop_to(row)
        else:
            self._pop_to(table)
        if tag == "col":
            self._leaf(tag, attrs)
        else:
            self._push(tag, attrs)

    def _end_formatting(self, tag: str) -> None:
        """Closes a formatting element. Blocks that were opened in it stay open, so it ends where they do for them only."""
        at = self._last(tag)
        if not at or at < self._last(*SCOPE):
            return
        if at < self._last("p", "div", "li", "ul", "ol", "dl", "dd", "dt", "section", "article", "blockquote", *HEADINGS):
            self.by_tag[tag].pop()
        else:
            self._pop_to(at - 1)

    def end(self, tag: str) -> None:
        self._ready()
        here = self.open[-1]
        if here.foreign and tag not in ("p", "br"):
            at = self._last(tag)
            if at and (tag in ("svg", "math") or at > self._last("svg", "math", *HTML_INSIDE)):
                self._pop_to(at - 1)
                return
            if self._last("svg", "math") > at:
                return
        if tag == "br":
            return self.start("br", {}, False)
        if tag in ("html", "body", "head", "frameset"):
            return
        if tag == "p":
            if not self._close("p", "button"):
                self.start("p", {}, False)  # a stray end tag is an empty paragraph
                self._close("p", "button")
        elif tag in HEADINGS:
            at = self._last(*HEADINGS)
            if at > self._last(*SCOPE):
                self._pop_to(at - 1)
        elif tag in TABLE_PARTS or tag == "table":
            at = self._last(tag)
            if at and at >= self._last("table", "template"):
                self._pop_to(at - 1)
        elif tag == "li":
            self._close("li", "ul", "ol", "menu", "dir")
        elif tag == "select":
            if self._last("select") > self._last("table", "template"):
                self._pop_to(self._last("select") - 1)
        elif tag in FORMATTING:
            self._end_formatting(tag)
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option" and tag == "optgroup":
                self._pop()
            if self.open[-1].tag == tag:
                self._pop()
        elif tag in SCOPE or tag in ENDS_P or tag in ("button", "object"):
            self._close(tag)
        else:  # an element of no own rule ends if no block has been opened in it
            at = self._last(tag)
            if at and at > self._last(*SCOPE, *ENDS_P - {tag} - IMPLIED_ENDS):
                self._pop_to(at - 1)

    def text(self, data: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            data = data.removeprefix("\n")
        if data:
            self._ready()
            self.open[-1].children.append(data)

    # Tokens.

    def _run(self) -> None:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            lt = html.find("<", at)
            while lt >= 0 and not (html[lt + 1 : lt + 2].isalpha() and html[lt + 1].isascii()) and html[lt + 1 : lt + 2] not in ("/", "!", "?"):
                lt = html.find("<", lt + 1)  # no markup
            if lt < 0:
                lt = n
            if lt > at:
                self.text(unescape(html[at:lt]))
            if lt == n:
                return
            at = self._markup(lt)

    def _markup(self, lt: int) -> int:
        """Handles the markup that starts at lt; returns where it ends."""
        html, n, c = self.html, len(self.html), self.html[lt + 1]
        if c == "!":
            if html.startswith("--", lt + 2):
                if html.startswith((">", "->"), lt + 4):
                    return html.index(">", lt + 4) + 1
                found = COMMENT_END.search(html, lt + 4)
                return found.end() if found else n
            if html.startswith("[CDATA[", lt + 2) and self.open[-1].foreign:
                end = html.find("]]>", lt + 9)
                self.text(html[lt + 9 : end if end >= 0 else n])
                return end + 3 if end >= 0 else n
            return self._after_gt(lt)
        if c == "?":
            return self._after_gt(lt)
        if c == "/":
            follows = html[lt + 2 : lt + 3]
            if follows == "":
                self.text("</")
                return n
            if not (follows.isalpha() and follows.isascii()):
                return self._after_gt(lt)
            name, _, end, _ = self._tag(lt + 2)
            if end <= n:
                self.skip_newline = False
                self.end(name)
            return min(end, n)
        name, attrs, end, closed = self._tag(lt + 1)
        if end > n:
            return n  # the page ends within a tag, which so is none
        self.skip_newline = False
        foreign = self.open[-1].foreign and self.open[-1].tag not in HTML_INSIDE
        self.start(name, attrs, closed)
        if foreign and self.open[-1].foreign:
            return end
        if name == "plaintext":
            self.text(html[end:])
            return n
        if name in RAW or name in RCDATA or name == "script":
            if self.open[-1].tag == name:
                return self._raw(name, end)
        return end

    def _after_gt(self, at: int) -> int:
        end = self.html.find(">", at)
        return end + 1 if end >= 0 else len(self.html)

    def _tag(self, at: int) -> tuple[str, dict[str, str], int, bool]:
        """Name, attributes (the first of each name), the end, which is beyond the page if it ends in the tag, and whether a slash closes it."""
        html, n = self.html, len(self.html)
        found = NAME.match(html, at)
        name, at, attrs = found[0].lower(), found.end(), {}
        while True:
            at = GAP.match(html, at).end()
            if at >= n:
                return name, attrs, n + 1, False
            if html[at] == ">":
                return name, attrs, at + 1, html[at - 1] == "/"
            found = ATTRIBUTE.match(html, at)
            key, at, value = found[0].lower(), found.end(), ""
            if equals := EQUALS.match(html, at):
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = html.find(quote, at + 1)
                    if end < 0:
                        return name, attrs, n + 1, False
                    value, at = html[at + 1 : end], end + 1
                else:
                    found = UNQUOTED.match(html, at)
                    value, at = found[0], found.end()
            if key not in attrs:
                attrs[key] = unescape(value)

    def _raw(self, name: str, at: int) -> int:
        """The text of an element that holds no markup, up to its end tag or the end of the page."""
        html, n = self.html, len(self.html)
        if name == "script":
            end = self._script_end(at)
        else:
            found = re.compile(rf"</{name}(?=[\t\n\f />])", re.IGNORECASE).search(html, at)
            end = found.start() if found else n
        data = html[at:end]
        self.text(unescape(data) if name in RCDATA else data)
        self.skip_newline = False
        if self.open[-1].tag == name:
            self._pop()
        return min(self._tag(end + 2)[2], n) if end < n else n

    def _script_end(self, at: int) -> int:
        """Within <!-- a script in a script does not end the outer one."""
        comment = inner = False
        for found in SCRIPT_STEP.finditer(self.html, at):
            if found[0] == "<!--":
                comment = True
            elif found[0] == "-->":
                comment = inner = False
            elif found[1] and not inner:
                return found.start()
            elif found[1]:
                inner = False
            elif comment:
                inner = True
        return len(self.html)
