"""Visible text of HTML pages, laid out.

A page is read tag by tag into a stack of open elements, with the end tags and
table rows that HTML implies, and what the stack says of a place decides
whether its text is visible and where it goes. Blocks become lines with blank
lines where margins are, list items get markers and indents, preformatted text
keeps its spaces, and table cells are padded to common columns.
"""

from __future__ import annotations

import html
import re
from bisect import bisect, bisect_left
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import slices

# Element names of HTML by how they are laid out.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
NEVER = frozenset("head script style template noscript title iframe noembed noframes audio video canvas datalist meter progress".split())
#: In svg and math: what is never shown, where HTML goes on, and the HTML elements that end them.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter metadata desc annotation annotation-xml".split())
INWARD = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
OUTWARD = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCK = frozenset("plaintext address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre listing xmp search section summary ul table caption".split())
SPACED = frozenset("plaintext p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre listing xmp figure table fieldset".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "caption"} | {"hr"}
FENCE = frozenset("td th caption table html template object".split())
#: What a start tag closes if it is open, and the elements that stop the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
IMPLIED = {tag: (tuple(closes), (*stops, *FENCE)) for tag, (closes, stops) in IMPLIED.items()}
P_FENCE = (*FENCE, "button")

# A quote opens a value only right after "=", elsewhere it is a character like others; only a value that stays open does not end.
_W = r"[ \t\n\r\f]"
_NAME, _VALUE = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+", r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^ \t\n\r\f>]*+)"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|{_NAME}(?:{_W}*+={_W}*+{_VALUE}|(?!{_W}*+=)))*+)>")
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_W}*+={_W}*+({_VALUE}))?+")
_UNQUOTED = re.compile(rf"""={_W}*[^ \t\n\r\f"'>][^ \t\n\r\f>]*$""")
_LOOK = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?")
_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|<!--|-->|("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|[{};]|[^{};"'/<-]++|.)""", re.S)
_AT = re.compile(r"@([\w-]+)(.*)", re.S)
_COMPOUND = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
#: Lines of cells longer than this do not widen their column.
WIDEST = 80


def declared(style: str) -> dict[str, tuple[str, bool]]:
    """display and visibility as a style sets them, each (value, whether important)."""
    found: dict[str, tuple[str, bool]] = {}
    for name, value, important in _LOOK.findall(style.lower()):
        if important or not found.get(name, ("", False))[1]:
            found[name] = (value, bool(important))
    return found


def on_screen(query: str) -> bool:
    """Whether a list of media queries holds for a screen of which nothing else is known."""
    words = [" ".join(x.lower().split()).removeprefix("only ") for x in query.split(",")]
    return any(x in ("", "all", "screen") or x.startswith("not ") and x[4:].isalpha() and x[4:] not in ("all", "screen") for x in words)


def sheet_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a sheet's rules that hold on a plain screen.

    @media that asks for more than a screen, @container, @supports not and rules inside rules are not read.
    """
    kept, said, head = [True], [""], ""  # of each open brace, whether rules inside it hold; and its selectors
    body: list[str] = []
    for m in _CSS.finditer(sheet):
        token = m[1]
        if token is None:
            head += " "
        elif token == "{":
            what = head.strip()
            group = _AT.match(what)
            name, rest = (group[1].lower(), group[2].strip()) if group else ("", "")
            holds = not group or name == "layer" or name == "media" and on_screen(rest) or name == "supports" and not rest.lower().startswith("not")
            kept.append(kept[-1] and holds and not said[-1])
            said.append("" if group else what or "?")
            head, body = "", []
        elif token == "}":
            if len(kept) > 1:
                if said[-1] and kept[-1]:
                    yield said[-1], "".join([*body, head])
                kept.pop()
                said.pop()
            head, body = "", []
        elif token == ";":
            body += [head, ";"]
            head = ""
        else:
            head += token


class Sheet:
    """Rules on display and visibility, by compounds: each is a bit, set for an element it and all before it fit.

    Selectors are tags, classes, ids and *, joined by blanks or >; others are not read.
    """

    def __init__(self) -> None:
        #: By tag, .class, #id or *: (bit, tag, marks, bit before or 0, whether that is the parent's, rule or None).
        self.by: dict[str, list[tuple[int, str, frozenset[str], int, bool, tuple | None]]] = {}
        self.many = self.rules = 0

    def add(self, sheet: str) -> bool:
        before = self.many
        for selectors, body in sheet_rules(sheet):
            look = declared(body)
            if not look:
                continue
            self.rules += 1
            for one in selectors.split(","):
                parts = one.replace(">", " > ").split()
                found = [None if x == ">" else _COMPOUND.fullmatch(x) for x in parts]
                if not parts or any(x != ">" and m is None for x, m in zip(parts, found, strict=True)) or any(x == ">" and (k in (0, len(parts) - 1) or parts[k - 1] == ">") for k, x in enumerate(parts)):
                    continue
                marks = [frozenset(re.findall(r"[.#][\w-]+", m[2])) if m else frozenset() for m in found]
                weight = (sum(x[0] == "#" for s in marks for x in s), sum(x[0] == "." for s in marks for x in s), sum(bool(m and m[1] and m[1] != "*") for m in found))
                last = 0
                for k, m in enumerate(found):
                    if m is None:
                        continue
                    tag = (m[1] or "*").lower()
                    key = min(marks[k]) if marks[k] else tag
                    bit = 1 << self.many
                    self.many += 1
                    rule = (weight, self.rules, look) if k == len(found) - 1 else None
                    self.by.setdefault(key, []).append((bit, "" if tag == "*" else tag, marks[k], last, k > 0 and parts[k - 1] == ">", rule))
                    last = bit
        return self.many > before

    def fit(self, tag: str, has: dict[str, str], parent: tuple[int, int]) -> tuple[tuple[int, int], list[tuple]]:
        """Bits of an element and of it with all around it, and the rules that hold for it."""
        marks = {"." + x for x in has.get("class", "").split()} | ({"#" + has["id"]} if has.get("id") else set())
        own, rules = 0, []
        for key in (tag, "*", *marks):
            for bit, name, needs, last, direct, rule in self.by.get(key, ()):
                if (not name or name == tag) and needs <= marks and (not last or parent[0 if direct else 1] & last):
                    own |= bit
                    if rule:
                        rules.append(rule)
        return (own, own | parent[1]), rules

    @staticmethod
    def look(rules: list[tuple], inline: str) -> dict[str, str]:
        """What display and visibility come to."""
        ranked = [(important, (0, *weight), nth, name, value) for weight, nth, look in rules for name, (value, important) in look.items()]
        ranked += [(important, (1, 0, 0, 0), 0, name, value) for name, (value, important) in declared(inline).items()]
        return {name: value for *_, name, value in sorted(ranked)}


class Lines:
    """Lines, and how many there are of each width up to the widest that counts.

    Of two that are joined the longer one takes in the other at either end, so
    that lines are not moved again at each of the tables they are in.
    """

    def __init__(self) -> None:
        self.all: deque[str] = deque()
        self.widths: dict[int, int] = {}

    def count(self, line: str, by: int) -> None:
        if len(line) <= WIDEST:
            self.widths[len(line)] = self.widths.get(len(line), 0) + by

    def add(self, line: str) -> None:
        self.all.append(line)
        self.count(line, 1)

    def then(self, other: Lines) -> Lines:
        """These lines and then the others; neither is of use after it."""
        most, less = (self, other) if len(self.all) >= len(other.all) else (other, self)
        if most is self:
            most.all.extend(less.all)
        else:
            most.all.extendleft(reversed(less.all))
        for width, n in less.widths.items():
            most.widths[width] = most.widths.get(width, 0) + n
        return most

    def widest(self) -> int:
        return max((width for width, n in self.widths.items() if n), default=0)


class Flow:
    """Lines of one stretch of text: of the page, or of a table cell."""

    def __init__(self) -> None:
        self.lines = Lines()
        self.parts: list[str] = []
        self.gap, self.pad, self.mark, self.pre = 0, "", None, 0

    def text(self, data: str) -> None:
        if self.pre:
            head, *rest = data.replace("\r\n", "\n").split("\n")
            self.parts.append(head)
            for x in rest:
                self.newline()
                self.parts.append(x)
            return
        data = _SPACES.sub(" ", data)
        if (not self.parts or self.parts[-1].endswith(" ")) and data.startswith(" "):
            data = data[1:]
        if data:
            self.parts.append(data)

    def newline(self) -> None:
        """Ends the line even if it is empty."""
        line = "".join(self.parts).rstrip()
        self.parts = []
        self.gaps()
        self.lines.add(((self.mark if self.mark is not None else self.pad) + line).rstrip())
        self.mark = None

    def gaps(self) -> None:
        if self.lines.all:
            for _ in range(self.gap):
                self.lines.add("")
        self.gap = 0

    def take(self, lines: Lines) -> None:
        """Goes on with lines that are whole."""
        if not lines.all:
            return
        if self.pad or self.mark:
            for line in lines.all:
                self.parts = [line]
                self.newline()
            return
        self.parts, self.mark = [], None
        self.gaps()
        self.lines = self.lines.then(lines)

    def block(self, margin: int = 0) -> None:
        if any(x.strip() for x in self.parts):
            self.newline()
        self.parts = []
        self.gap = max(self.gap, margin)

    def done(self) -> Lines:
        self.block()
        return self.lines


class Table:
    """Rows of cells, each (lines, columns it spans, rows it spans)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[Lines, int, int]]] = []

    def lines(self) -> Lines:
        placed: list[list[tuple[int, int, Lines]]] = []
        busy: dict[int, int] = {}
        for row in self.rows:
            at, out, taken = 0, [], {c: n - 1 for c, n in busy.items() if n > 1}
            for lines, across, down in row:
                while busy.get(at, 0) > 0:
                    at += 1
                out.append((at, across, lines))
                if down > 1:
                    taken |= dict.fromkeys(range(at, at + across), down - 1)
                at += across
            placed.append(out)
            busy = {c: n for c, n in taken.items()}
        wide: dict[int, int] = {}
        for row in placed:
            for at, across, lines in row:
                if across == 1:
                    wide[at] = max(wide.get(at, 0), lines.widest())
        start, total = {}, 0
        for c in range(max([at + across for row in placed for at, across, _ in row], default=0)):
            start[c] = total
            total += wide[c] + 2 if wide.get(c) else 0
        out = Lines()
        for row in placed:
            out = out.then(beside([(start[at], lines) for at, _, lines in row]))
        return out


def beside(cells: list[tuple[int, Lines]]) -> Lines:
    """Cells next to each other, each from its own column on. Lines of the first that no other reaches stay where they are."""
    if not cells:
        return Lines()
    whole = cells[0][1] if cells[0][0] == 0 else Lines()
    rest = [(at, lines.all) for at, lines in cells if lines is not whole]
    most = max((len(x) for _, x in rest), default=0)
    first = [whole.all.popleft() for _ in range(min(most, len(whole.all)))]
    for line in first:
        whole.count(line, -1)
    ends = [""] * most
    ends[: len(first)] = first
    for at, lines in rest:
        for k, said in enumerate(lines):
            if said:
                line = ends[k].ljust(at)
                ends[k] = line + ("  " if line and not line.endswith("  ") else "") + said
    head = Lines()
    for line in ends:
        head.add(line.rstrip())
    return head.then(whole)


def attributes_of(said: str) -> dict[str, str]:
    return {k.lower(): v[1:-1] if v[:1] in ("'", '"') else v for k, v in _ATTRIBUTE.findall(said)}


class Page:
    """Reads one page.

    ``stack`` holds open elements as [tag, gone, unseen, what to undo at its
    end, number, attributes, bits of its sheet rules, place, serial]. Serials
    grow, and ``open`` has those of each tag's open elements, so which of them
    stands above others is told without a walk over the stack.
    """

    def __init__(self) -> None:
        self.flow = Flow()
        self.stack: list[list] = []
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.lists: list[list] = []
        self.others: list[int] = []  # serials of open elements that are not inline
        self.serial = 0
        self.tables: list[tuple[Table, Flow]] = []
        self.sheet = Sheet()

    # -------------------------------------------------------- elements

    def top(self, tags: Iterable[str]) -> int:
        """The serial of the innermost open element of ``tags``, 0 without one."""
        serial, held = 0, self.open
        for tag in tags:
            if held[tag] and held[tag][-1] > serial:
                serial = held[tag][-1]
        return serial

    def pop_to(self, serial: int) -> None:
        while self.stack and self.stack[-1][8] >= serial:
            self.pop()

    def visible(self) -> bool:
        return not self.stack or not (self.stack[-1][1] or self.stack[-1][2])

    def place(self) -> tuple[bool, bool]:
        """Whether the place is in svg or math, and whether text stands there: of an svg, only that of its text elements does."""
        return self.stack[-1][7] if self.stack else (False, True)

    def start(self, tag: str, attributes: str) -> None:
        if tag in OUTWARD and self.place()[0]:
            while self.pop() not in ("svg", "math"):
                pass
        if tag in ENDS_P and self.open["p"] and self.within("p", P_FENCE):
            self.end("p")
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            old = self.top(closes)
            if old and old > self.top(stops):
                self.pop_to(old)
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            if not self.open["table"]:
                return
            self.table_part(tag)
        if tag in VOID:
            if self.visible():
                if tag == "br":
                    self.flow.newline()
                elif tag == "hr":
                    self.flow.block(1)
            return
        within, drawn = self.place()
        gone = bool(self.stack and self.stack[-1][1]) or tag in NEVER or within and tag in UNDRAWN
        unseen = bool(self.stack and self.stack[-1][2])
        has: dict[str, str] = {}
        if attributes and (self.sheet.many or tag in ("td", "th", "ol", "li", "details", "dialog") or "hidden" in attributes.lower() or "style" in attributes.lower()):
            has = attributes_of(attributes)
        bits, rules = self.sheet.fit(tag, has, self.stack[-1][6] if self.stack else (0, 0)) if self.sheet.many else ((0, 0), [])
        if rules or "style" in has:
            look = Sheet.look(rules, has.get("style", ""))
            gone = gone or look.get("display") == "none"
            if look.get("visibility") in ("hidden", "collapse", "visible"):
                unseen = look["visibility"] != "visible"
        gone = gone or "hidden" in has
        if tag == "dialog" and "open" not in has:
            gone = True
        if self.stack and self.stack[-1][0] == "details" and self.stack[-1][3] == "closed" and tag != "summary":
            gone = True
        undo: object = None
        flow = self.flow
        if not gone:  # unseen tables and cells keep their place
            if tag == "table":
                if not unseen:
                    flow.block(1)
                self.tables.append((Table(), flow))
                undo = "table"
            elif tag == "tr":
                self.tables[-1][0].rows.append([])
            elif tag in ("td", "th"):
                span = [int(has[k]) if has.get(k, "").isdecimal() and has[k].isascii() and len(has[k]) < 6 else 1 for k in ("colspan", "rowspan")]
                undo = (flow, min(max(span[0], 1), 1000), max(span[1], 1))
                self.flow = Flow()
        if not (gone or unseen):
            if (tag in BLOCK or tag == "tr") and tag != "table" or tag == "text" and within:
                inner = self.open["li"] and tag in ("ul", "ol", "menu", "dir")
                flow.block(1 if tag in SPACED and not inner else 0)
            if tag in ("ul", "ol", "menu", "dir"):
                undo = flow.pad
                try:
                    self.number = int(has.get("start", "1"))
                except ValueError:
                    self.number = 1
            elif tag == "li":
                undo = flow.pad
                owner = self.lists[-1] if self.lists else None
                mark = "- "
                if owner is not None and owner[0] == "ol":
                    if re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", has.get("value", "")):
                        owner[4] = int(has["value"])
                    mark = f"{owner[4]}. "
                    owner[4] += 1
                flow.mark = (flow.pad if flow.mark is None else flow.mark) + mark
                flow.pad += " " * len(mark)
            elif tag in ("dd", "blockquote"):
                undo = flow.pad
                flow.pad += "  "
            elif tag in ("pre", "listing", "xmp", "textarea", "plaintext"):
                flow.pre += 1
                undo = "pre"
        if tag == "details" and "open" not in has:
            undo = "closed"
        place = (within, drawn)
        if tag in ("svg", "math"):
            place = (True, drawn and tag == "math")
        elif within:
            place = (tag not in INWARD, drawn or tag in ("text", "foreignobject"))
        self.serial += 1
        self.stack.append([tag, gone, unseen, undo, getattr(self, "number", 1) if tag in ("ul", "ol", "menu", "dir") else 0, attributes, bits, place, self.serial])
        self.open[tag].append(self.serial)
        if tag not in INLINE:
            self.others.append(self.serial)
        if tag in ("ul", "ol", "menu", "dir"):
            self.lists.append(self.stack[-1])
        if (within or tag in ("svg", "math")) and attributes.endswith("/") and not _UNQUOTED.search(attributes):
            self.pop()

    def table_part(self, tag: str) -> None:
        """Ends the part before this one, and starts the rows and bodies a page leaves out."""
        closes = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr", "caption"}}.get(tag, {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"})
        table = self.top(("table",))
        inside = [held[k] for t in closes if (held := self.open.get(t)) and (k := bisect(held, table)) < len(held)]
        if inside:
            self.pop_to(min(inside))
        if tag in ("td", "th") and self.top(("tr",)) < table:
            self.start("tr", "")

    def within(self, tag: str, fence: frozenset[str] | set[str]) -> bool:
        held = self.open[tag]
        return bool(held) and held[-1] >= self.top(fence)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        if tag == "p" and not self.within("p", FENCE) and self.visible():
            self.flow.block(1)
        if not self.open[tag]:
            return
        fence = FENCE if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"html"}
        if tag in ("tr", "tbody", "thead", "tfoot"):
            fence = {"table"}
        if not self.within(tag, fence):
            return
        if tag in INLINE:  # blocks inside it stay open
            own = self.open[tag][-1]
            if self.others and self.others[-1] > own:
                k = bisect_left(self.stack, own, key=lambda e: e[8])
                if not (self.stack[k][1] or self.stack[k][2]):
                    del self.stack[k]
                    self.open[tag].pop()
                return
        while self.pop() != tag:
            pass

    def pop(self) -> str:
        tag, gone, unseen, undo, *_, place, _ = self.stack.pop()
        self.open[tag].pop()
        if tag not in INLINE:
            self.others.pop()
        if tag in ("ul", "ol", "menu", "dir"):
            self.lists.pop()
        if gone:
            return tag
        if tag in ("td", "th"):
            parent, across, down = undo
            lines = self.flow.done()
            self.flow = parent
            self.tables[-1][0].rows[-1].append((lines, across, down))
            return tag
        flow = self.flow
        if undo == "table":
            table, flow = self.tables.pop()
            self.flow = flow
            lines = table.lines()
            if lines.all or not unseen:
                flow.block(1)
            flow.take(lines)
            if lines.all and unseen:
                flow.block(1)
        if unseen:
            return tag
        if tag == "text" and place[0]:
            flow.block()
        if tag in BLOCK:
            flow.block(1 if tag in SPACED and not (self.open["li"] and tag in ("ul", "ol", "menu", "dir")) else 0)
        if undo == "pre":
            flow.pre -= 1
        elif tag in ("li", "ul", "ol", "menu", "dir", "dd", "blockquote"):
            flow.pad, flow.mark = undo, None
        return tag

    # ------------------------------------------------------------ text

    def text(self, data: str) -> None:
        if not data or not self.visible() or not self.place()[1]:
            return
        if self.stack and self.stack[-1][0] == "details" and self.stack[-1][3] == "closed":
            return
        if "&" in data:
            data = html.unescape(data)
        flow = self.flow
        if self.stack and self.stack[-1][0] in ("table", "tr", "tbody", "thead", "tfoot"):
            if data.isspace():
                return
            flow = self.tables[-1][1]  # text between cells stands before the table
        flow.text(data.replace("\xa0", " ") if not flow.pre else data)

    def styled(self, sheet: str) -> None:
        """Remembers the rules of a sheet, which hold from here on."""
        if self.sheet.add(sheet):
            bits = (0, 0)
            for entry in self.stack:  # what is open may stand in a selector
                bits = entry[6] = self.sheet.fit(entry[0], attributes_of(entry[5]), bits)[0]

    def read(self, page: str) -> str:
        at, n = 0, len(page)
        while at < n:
            to = page.find("<", at)
            if to < 0:
                self.text(page[at:])
                break
            if to > at:
                self.text(page[at:to])
            if page.startswith("<!--", to):
                to = page.find("-->", to + 4)
                at = n if to < 0 else to + 3
                continue
            if page.startswith(("<!", "<?"), to):
                to = page.find(">", to)
                at = n if to < 0 else to + 1
                continue
            m = _TAG.match(page, to)
            if m is None:
                if page[to + 1 : to + 2].isalpha() or page[to + 1 : to + 2] == "/" and page[to + 2 : to + 3].isalpha():
                    break  # a tag that the page's end cuts off takes the rest of the page
                self.text("<")
                at = to + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag == "plaintext":
                self.text(page[at:])
                break
            if tag in ("pre", "listing", "textarea"):  # a line feed right after the tag is no text
                at += 2 if page.startswith("\r\n", at) else page.startswith("\n", at)
            if tag in RAW and self.stack[-1][0] == tag and (tag in ("script", "style") or not self.place()[0]):
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                to = close.start() if close else n
                if tag == "style":
                    if on_screen(attributes_of(m[3]).get("media", "")):
                        self.styled(page[at:to])
                else:
                    self.text(page[at:to])
                at = to
        while self.stack:
            self.pop()
        return "\n".join(self.flow.done().all)


def render(page: str) -> str:
    return Page().read(page)


def visible_text(pages: Column) -> Column:
    """The visible text of each whole page; null for null, empty for a page without any."""

    @arrow_udf("string")
    def rendered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str | None] = []
            for part in slices([pa.record_batch([batch], ["page"])], "page"):
                out += [None if x is None else render(x) for x in part.column(0).to_pylist()]
            yield pa.array(out, pa.string())

    return rendered(pages)


def extract(pages: DataFrame, page: str = "html", to: str = "rendered") -> DataFrame:
    """``pages`` with the visible text of each; all rows and columns stay, one already named ``to`` is replaced.

    Malformed pages are read as browsers do: a tag that never ends takes the
    rest, end tags without a start are dropped. Of style sheets in the page,
    display and visibility are read, for a screen of unknown size: selectors of
    tags, classes, ids and * joined by blanks or >, from where the sheet stands
    on; @media that asks for more than a screen, @container, rules inside rules,
    other selectors and linked sheets are not. Repeated rows are rendered each
    and an empty table gives an empty one.
    """
    return pages.withColumn(to, visible_text(F.col(page)))
