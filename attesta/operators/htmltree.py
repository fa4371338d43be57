"""Text nodes of a page, as HTML's rules for building a tree give them.

One pass over the page: a stack of open elements, the list of formatting elements that are opened again after their
block ends, and for each table the place before it, where text goes that may not stand in a table. No tree is kept; text
nodes are written to lists in document order, with ``None`` where an element or comment begins or ends, so that text
joins only within a node. Frames, templates' own modes and the escapes within scripts are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

# Elements by what HTML's rules say of them.
HIDDEN = frozenset("script style noscript template svg".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noframes style script template noscript".split())
IN_HEAD_NOSCRIPT = frozenset("basefont bgsound link meta noframes style".split())
VOID = frozenset("area base basefont bgsound br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup hr h1 h2 h3 h4 h5 h6 li dd dt form listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
BLOCK_ENDS = frozenset("address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer form header hgroup li listing main menu nav ol pre search section summary ul dd dt applet marquee object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED = frozenset("applet marquee object td th caption template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template mi mo mn ms mtext annotation-xml foreignobject desc".split())
SPECIAL = (CLOSES_P | BLOCK_ENDS | VOID | MARKED | HIDDEN | frozenset("body button colgroup frame frameset head html iframe noembed noframes select tbody textarea tfoot thead title tr".split())) - {"dialog", "svg"}
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
TABLE_NODES = frozenset("table tbody tfoot thead tr".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SVG_POINTS = frozenset("foreignobject desc title".split())
MATH_POINTS = frozenset("mi mo mn ms mtext".split())

_ATTRIBUTES = r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++))?+)*+"""
_TAG = re.compile(rf"<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})>")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW | ESCAPABLE}


class _Element:
    __slots__ = ("name", "ns", "point", "sink", "before", "attrs")

    def __init__(self, name: str, ns: str, point: bool, sink: list, before: list | None, attrs: str) -> None:
        self.name, self.ns, self.point, self.sink, self.before, self.attrs = name, ns, point, sink, before, attrs


class _Page:
    def __init__(self) -> None:
        self.out: list = []
        self.open: list[_Element] = []
        self.count: Counter[str] = Counter()
        self.formatting: list[_Element | None] = []  # None: a marker
        self.hidden = 0
        self.in_body = False
        self.foster = False

    # The stack.

    def node(self) -> _Element | None:
        return self.open[-1] if self.open else None

    def push(self, name: str, ns: str = "", attrs: str = "", point: bool = False) -> _Element:
        e = self.node()
        sink = self.out if e is None else e.sink
        if self.foster and e is not None and e.name in TABLE_NODES:
            sink = next(x.before for x in reversed(self.open) if x.name == "table")
        before = None
        if name == "table" and not ns:
            before = []
            sink.append(before)
        sink.append(None)
        e = _Element(name, ns, point, sink, before, attrs)
        self.open.append(e)
        self.count[name] += 1
        self.hidden += name in HIDDEN
        return e

    def pop(self) -> _Element:
        e = self.open.pop()
        e.sink.append(None)
        self.count[e.name] -= 1
        self.hidden -= e.name in HIDDEN
        return e

    def pop_to(self, *names: str) -> None:
        while self.pop().name not in names:
            pass

    def remove(self, e: _Element) -> None:
        at = next(i for i, x in enumerate(self.open) if x is e)
        del self.open[at]
        self.count[e.name] -= 1
        self.hidden -= e.name in HIDDEN

    def within(self, name: str, more: frozenset[str] = frozenset(), scope: frozenset[str] = SCOPE) -> bool:
        """Whether an element of the name is open within the scope of the current one."""
        if not self.count[name]:
            return False
        for e in reversed(self.open):
            if e.name == name and not e.ns:
                return True
            if e.name in scope or e.name in more or e.ns == "svg" and e.name == "title":
                return False
        return False

    def implied(self, but: str = "") -> None:
        while self.open and self.open[-1].name in IMPLIED and self.open[-1].name != but:
            self.pop()

    def close_p(self) -> None:
        if self.within("p", frozenset(["button"])):
            self.implied("p")
            self.pop_to("p")

    # Formatting elements.

    def is_open(self, e: _Element) -> bool:
        return self.count[e.name] > 0 and any(x is e for x in reversed(self.open))

    def reconstruct(self) -> None:
        f = self.formatting
        at = len(f)
        while at and f[at - 1] is not None and not self.is_open(f[at - 1]):
            at -= 1
        for i in range(at, len(f)):
            f[i] = self.push(f[i].name, attrs=f[i].attrs)

    def note(self, e: _Element) -> None:
        """A new formatting element; of equal ones, at most three since the last marker."""
        same = []
        for i in range(len(self.formatting) - 1, -1, -1):
            x = self.formatting[i]
            if x is None:
                break
            if (x.name, x.attrs) == (e.name, e.attrs):
                same.append(i)
        if len(same) >= 3:
            del self.formatting[same[-1]]
        self.formatting.append(e)

    def to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def noted(self, name: str) -> _Element | None:
        for x in reversed(self.formatting):
            if x is None or x.name == name:
                return x
        return None

    def adopt(self, name: str) -> None:
        """The end of a formatting element: blocks within it stay open, without it."""
        e = self.noted(name)
        if e is None:
            return self.other_end(name)
        if not self.is_open(e):
            self.formatting.remove(e)
            return None
        if not self.within(name):
            return None
        self.formatting.remove(e)
        at = next(i for i, x in enumerate(self.open) if x is e)
        if any(x.name in SPECIAL and not x.ns for x in self.open[at + 1 :]):
            self.open[-1].sink.append(None)
            self.remove(e)
        else:
            while self.pop() is not e:
                pass
        return None

    # Text.

    def text(self, data: str) -> None:
        if not self.in_body:
            if self.open and self.open[-1].name == "noscript":
                if not data.strip(" \t\n\f\r"):
                    return
                self.pop()
            data = data.lstrip(" \t\n\f\r")
            if not data:
                return
            self.in_body = True
        e = self.node()
        if e is not None and e.ns and not e.point:
            return self.put(e.sink, data)
        if e is not None and e.name == "colgroup" and data.strip(" \t\n\f\r"):
            self.pop()
            e = self.node()
        sink = self.out if e is None else e.sink
        if e is not None and e.name in TABLE_NODES:
            if not data.strip(" \t\n\f\r"):
                return None
            self.foster = True
            self.reconstruct()
            self.foster = False
            last = self.open[-1]
            sink = next(x.before for x in reversed(self.open) if x.name == "table") if last.name in TABLE_NODES else last.sink
            return self.put(sink, data)
        if data.strip(" \t\n\f\r") or self.formatting:
            self.reconstruct()
            sink = self.open[-1].sink if self.open else self.out
        return self.put(sink, data)

    def put(self, sink: list, data: str) -> None:
        if not self.hidden:
            if sink and isinstance(sink[-1], str):
                sink[-1] += data
            else:
                sink.append(data)

    def cut(self) -> None:
        """A comment ends a text node."""
        (self.open[-1].sink if self.open else self.out).append(None)

    # Tags.

    def start(self, name: str, attrs: str, closed: bool) -> bool:
        """Whether the element's content is raw text."""
        e = self.node()
        if e is not None and e.ns and not (e.point and not (e.ns == "math" and name in ("mglyph", "malignmark")) or e.name == "annotation-xml" and name == "svg"):
            if not (name in BREAKOUT or name == "font" and re.search(r"(?i)(?:^|[\s/])(?:color|face|size)\s*=", attrs)):
                self.foreign(name, e.ns, attrs, closed)
                return False
            while self.open and self.open[-1].ns and not self.open[-1].point:
                self.pop()
        if not self.in_body:
            if name in ("html", "head"):
                return False
            if self.open and self.open[-1].name == "noscript" and name not in IN_HEAD_NOSCRIPT:
                if name == "noscript":
                    return False
                self.pop()
            if name in IN_HEAD:
                self.push(name, attrs=attrs)
                if name in VOID:
                    self.pop()
                if name == "template":
                    self.in_body = True  # whatever it holds is hidden; what follows it is found by its end
                return name in RAW or name in ESCAPABLE
            self.in_body = True
            if name == "body":
                return False
        return self.start_in_table(name, attrs, closed) if self.count["table"] or self.count["select"] else self.start_in_body(name, attrs, closed)

    def place(self) -> str:
        """The part of a table, or the select, that the current element lies in."""
        for e in reversed(self.open):
            if not e.ns and (e.name in TABLE_NODES or e.name in ("td", "th", "caption", "colgroup", "select", "template")):
                return e.name
        return ""

    def start_in_table(self, name: str, attrs: str, closed: bool) -> bool:
        at = self.place()
        if at == "select":
            if name in ("option", "optgroup", "hr"):
                if self.open[-1].name == "option":
                    self.pop()
                if name != "option" and self.open[-1].name == "optgroup":
                    self.pop()
                self.push(name)
                if name == "hr":
                    self.pop()
                return False
            if name in ("script", "template"):
                return self.start_in_body(name, attrs, closed)
            if name in ("select", "input", "keygen", "textarea") or name in TABLE_PARTS and self.count["table"] or name == "table" and self.count["table"]:
                self.pop_to("select")
                return name != "select" and self.start(name, attrs, closed)
            return False
        if at == "colgroup":
            if name == "col":
                self.push(name)
                self.pop()
                return False
            if name != "template":
                self.pop_to("colgroup")
                return self.start(name, attrs, closed)
        if at in ("td", "th", "caption"):
            if name in TABLE_PARTS:
                self.end_cell(at)
                return self.start(name, attrs, closed)
            return self.start_in_body(name, attrs, closed)
        if at in TABLE_NODES:
            if name in TABLE_PARTS:
                within = at
                if name in ("td", "th"):
                    if within == "table":
                        self.clear("table")
                        self.push("tbody")
                        within = "tbody"
                    if within != "tr":
                        self.clear("tbody", "tfoot", "thead")
                        self.push("tr")
                    self.clear("tr")
                    self.push(name)
                    self.formatting.append(None)
                elif name == "tr":
                    if within == "tr":
                        self.clear("tr")
                        self.pop()
                    elif within == "table":
                        self.clear("table")
                        self.push("tbody")
                    self.clear("tbody", "tfoot", "thead")
                    self.push("tr")
                else:
                    self.clear("table")
                    if name == "col":
                        self.push("colgroup")
                    self.push(name)
                    if name == "col":
                        self.pop()
                    if name == "caption":
                        self.formatting.append(None)
                return False
            if name == "table":
                self.pop_to("table")
                return self.start(name, attrs, closed)
            if name in ("style", "script", "template"):
                return self.start_in_body(name, attrs, closed)
            if name == "form":
                if not self.count["form"]:
                    self.push(name)
                    self.pop()
                return False
            self.foster = True
            raw = self.start_in_body(name, attrs, closed)
            self.foster = False
            return raw
        return self.start_in_body(name, attrs, closed)

    def clear(self, *names: str) -> None:
        while self.open[-1].name not in names and self.open[-1].name != "template":
            self.pop()

    def end_cell(self, at: str) -> None:
        self.implied()
        self.pop_to(at)
        self.to_marker()

    def start_in_body(self, name: str, attrs: str, closed: bool) -> bool:
        if name in ("html", "head", "body", "frame", "frameset") or name in TABLE_PARTS:
            return False
        if name == "image":
            name = "img"
        if name == "form" and self.count["form"] and not self.count["template"]:
            return False
        if name in CLOSES_P:
            if name in ("li", "dd", "dt") and (self.count["li"] if name == "li" else self.count["dd"] + self.count["dt"]):
                for e in reversed(self.open):
                    if e.name in (("li",) if name == "li" else ("dd", "dt")):
                        self.implied(e.name)
                        self.pop_to(e.name)
                        break
                    if e.name in SPECIAL and e.name not in ("address", "div", "p"):
                        break
            self.close_p()
            if name in HEADINGS and self.open and self.open[-1].name in HEADINGS:
                self.pop()
        elif name == "button":
            if self.within("button"):
                self.implied()
                self.pop_to("button")
            self.reconstruct()
        elif name == "a":
            if (old := self.noted("a")) is not None:
                self.adopt("a")
                if old in self.formatting:
                    self.formatting.remove(old)
                if self.is_open(old):
                    self.remove(old)
            self.reconstruct()
        elif name == "nobr":
            self.reconstruct()
            if self.within("nobr"):
                self.adopt("nobr")
                self.reconstruct()
        elif name in ("option", "optgroup"):
            if self.open and self.open[-1].name == "option":
                self.pop()
            self.reconstruct()
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.within("ruby"):
                self.implied("rtc" if name in ("rp", "rt") else "")
        elif name not in IN_HEAD or name == "noscript":
            if name not in ("param", "source", "track", "noembed"):
                self.reconstruct()
        if name in ("svg", "math"):
            self.foreign(name, name, attrs, closed)
            return False
        e = self.push(name, attrs=attrs)
        if name in VOID:
            self.pop()
        elif name in FORMATTING:
            self.note(e)
        elif name in MARKED:
            self.formatting.append(None)
        return name in RAW or name in ESCAPABLE

    def foreign(self, name: str, ns: str, attrs: str, closed: bool) -> None:
        point = name in (SVG_POINTS if ns == "svg" else MATH_POINTS) or name == "annotation-xml" and bool(re.search(r"""(?i)encoding\s*=\s*["']?(?:text/html|application/xhtml\+xml)""", attrs))
        self.push(name, ns, attrs, point)
        if closed:
            self.pop()

    def end(self, name: str) -> None:
        e = self.node()
        if e is not None and e.ns:
            if name in ("p", "br") and not e.point:
                while self.open and self.open[-1].ns and not self.open[-1].point:
                    self.pop()
            elif self.count[name]:
                for x in reversed(self.open):
                    if not x.ns:
                        break
                    if x.name == name:
                        while self.pop() is not x:
                            pass
                        return
        if not self.in_body:
            if name in ("noscript", "title", "style", "script", "noframes", "template") and self.open and self.open[-1].name == name:
                self.pop()
            elif name in ("body", "html", "br"):
                self.in_body = True
                self.open.clear()
                self.hidden = 0
                self.count.clear()
                if name == "br":
                    self.cut()
            return
        if self.count["table"] or self.count["select"]:
            at = self.place()
            if at == "select":
                if name == "optgroup" and self.open[-1].name == "option" and len(self.open) > 1 and self.open[-2].name == "optgroup":
                    self.pop()
                if name == self.open[-1].name and name in ("option", "optgroup"):
                    self.pop()
                elif name == "select" or name in TABLE_PARTS | {"table"} and self.within(name, scope=frozenset(["table", "template", "html"]) - {name}):
                    self.pop_to("select")
                    if name != "select":
                        self.end(name)
                elif name == "template":
                    self.end_in_body(name)
                return
            if at == "colgroup" and name != "template":
                if name != "col":
                    self.pop_to("colgroup")
                    if name != "colgroup":
                        self.end(name)
                return
            table_scope = frozenset(["html", "table", "template"])
            if at in ("td", "th", "caption"):
                if name == at:
                    self.end_cell(at)
                    return
                if name in ("table", "tbody", "tfoot", "thead", "tr"):
                    if self.within(name, scope=table_scope - {name}):
                        self.end_cell(at)
                        self.end(name)
                    return
                if name in TABLE_PARTS or name in ("body", "html"):
                    return
            elif at in TABLE_NODES:
                if name == "table":
                    self.pop_to("table")
                    return
                if name in ("tbody", "tfoot", "thead", "tr"):
                    if self.within(name, scope=table_scope):
                        self.pop_to(name)
                    return
                if name in TABLE_PARTS or name in ("body", "html"):
                    return
        self.end_in_body(name)

    def end_in_body(self, name: str) -> None:
        if name in ("body", "html"):
            return
        if name == "template":
            if self.count["template"]:
                self.pop_to("template")
                self.to_marker()
                if not self.open and not self.out_has_text():
                    self.in_body = False
            return
        if name == "p":
            if not self.within("p", frozenset(["button"])):
                self.push("p")
            self.implied("p")
            self.pop_to("p")
        elif name == "br":
            self.reconstruct()
            self.cut()
        elif name in HEADINGS:
            if any(self.within(h) for h in HEADINGS):
                self.implied()
                self.pop_to(*HEADINGS)
        elif name in BLOCK_ENDS:
            if self.within(name, frozenset(["ol", "ul"]) if name == "li" else frozenset()):
                self.implied(name if name in ("li", "dd", "dt") else "")
                self.pop_to(name)
                if name in MARKED:
                    self.to_marker()
        elif name in FORMATTING:
            self.adopt(name)
        else:
            self.other_end(name)

    def out_has_text(self) -> bool:
        return any(self.out)

    def other_end(self, name: str) -> None:
        if not self.count[name]:
            return
        for e in reversed(self.open):
            if e.name == name:
                self.implied(name)
                while self.pop() is not e:
                    pass
                return
            if e.name in SPECIAL and not e.ns:
                return


def text_nodes(page: str) -> list[str]:
    """The page's visible text nodes, in document order."""
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    p, at, end = _Page(), 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            p.text(unescape(page[at : lt if lt >= 0 else end]))
            if lt < 0:
                break
        m = _TAG.match(page, lt)
        if m:
            at, name = m.end(), m[2].lower()
            if m[1]:
                p.end(name)
            elif p.start(name, m[3], m[3].endswith("/")):
                close = _RAW_END[name].search(page, at)
                raw = page[at : close.start() if close else end]
                if raw and not p.hidden and p.in_body:
                    p.put(p.open[-1].sink, unescape(raw) if name in ESCAPABLE else raw)
                at = end
                if close:
                    p.pop()
                    at = page.find(">", close.end()) + 1 or end
            elif name == "plaintext" and p.open and p.open[-1].name == name:
                p.text(page[at:])
                at = end
        elif page.startswith("<!--", lt):
            p.cut()
            if page.startswith(("<!-->", "<!--->"), lt):
                at = page.index(">", lt) + 1
            else:
                m = _COMMENT_END.search(page, lt + 4)
                at = m.end() if m else end
        elif page.startswith("<![CDATA[", lt) and p.open and p.open[-1].ns:
            close = page.find("]]>", lt)
            p.text(page[lt + 9 : close if close >= 0 else end])
            at = close + 3 if close >= 0 else end
        elif page.startswith(("<!", "<?"), lt) or page.startswith("</", lt) and lt + 2 < end and not page[lt + 2].isalpha():
            if not page[lt + 1 : lt + 9].lower().startswith("!doctype") and not page.startswith("</>", lt):
                p.cut()
            at = page.find(">", lt) + 1 or end
        elif lt + 1 < end and (page[lt + 1].isascii() and page[lt + 1].isalpha() or page[lt + 1] == "/" and lt + 2 < end):
            break  # a tag that the page ends in
        else:
            p.text("<")
            at = lt + 1
    return _flat(p.out)


def _flat(out: list) -> list[str]:
    """Text nodes of the lists within lists; text joins over the border of a list that an element's end doesn't mark."""
    nodes: list[str] = []
    joins = False
    stack = [iter(out)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, list):
                stack.append(iter(x))
                break
            if x is None:
                joins = False
            elif joins:
                nodes[-1] += x
            else:
                nodes.append(x)
                joins = True
        else:
            stack.pop()
    return nodes


def blocks_of(page: str | None) -> str:
    """Visible text, a block on each line: each line of each text node, white space folded."""
    lines = (_SPACE.sub(" ", line).strip() for node in text_nodes(page or "") for line in node.split("\n"))
    return "\n".join(line for line in lines if line)
