"""Markdown into the tree: CommonMark blocks and inlines, GFM tables and strikethrough, directives and kept fragments.

HTML blocks are not recognised: such lines are paragraphs, whose tags are read as inline HTML.
"""

from __future__ import annotations

import html
import re
import unicodedata

from .fragments import LINK_SCHEME, marks
from .options import Options
from .tree import Node, ParseError, text

# --- captures before the block structure --------------------------------------------------------------------

_SLOT = "\x01{}\x01"
_SLOT_LINE = re.compile("^\x01(\\d+)\x01$")
_OPEN = re.compile(r"^:::\s+([a-zA-Z][a-zA-Z0-9_-]*)(.*)$")
_CLOSE = re.compile(r"^:::\s*$")
_PARAM = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)\s*=\s*"((?:\\.|[^"\\])*)"')
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})(.*)$")
_CAPTURED = frozenset("`~<:")


class MarkdownReader:
    def __init__(self, options: Options):
        self.options = options
        self.marks = marks(options.marker)
        self.warnings: list[str] = []
        self.slots: list = []
        self.payloads: dict[str, str] = {}
        self.origin: dict[str, str] = {}
        self.references: dict[str, tuple[str, str | None]] = {}

    def document(self, source: str) -> list[Node]:
        source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "\ufffd").replace("\x01", "\ufffd")
        source = self.marks.without_notice(source)
        self.payloads = self.marks.payloads(source)
        source, self.origin = self.marks.without_assets(self.marks.without_payloads(source))
        out, at = [], 0
        for m in self.marks.blocks(source):
            out += [source[at : m.start()], "\n\n", self.slot(Node("opaque", text=m["body"], attrs={"opaque_id": m["id"]})), "\n\n"]
            at = m.end()
        lines = self.captured(("".join(out) + source[at:]).split("\n"))
        return self.blocks(lines)

    def slot(self, what) -> str:
        self.slots.append(what)
        return _SLOT.format(len(self.slots) - 1)

    def captured(self, lines: list[str]) -> list[str]:
        """Lines outside code fences with directives and comments to keep replaced by slots."""
        prefixes = self.options.kept_prefixes()
        comment = re.compile(rf"^[ \t]*<!--\s*(?:{prefixes})") if prefixes else None
        out: list[str] = []
        i, fence = 0, None
        while i < len(lines):
            line = lines[i]
            if line.lstrip()[:1] not in _CAPTURED:
                out.append(line)
                i += 1
                continue
            m = _FENCE.match(line)
            if fence is not None:
                if m and m[2][0] == fence[0] and len(m[2]) >= len(fence):
                    fence = None
            elif m:
                fence = m[2]
            elif comment and comment.match(line) and (end := next((j for j in range(i, len(lines)) if "-->" in lines[j]), None)) is not None:
                kept = "\n".join(lines[i : end + 1])
                out += ["", self.slot(Node("passthrough", text=kept[: kept.rfind("-->") + 3])), ""]
                i = end + 1
                continue
            elif m := _OPEN.match(line.strip()):
                end = next((j for j in range(i + 1, len(lines)) if _CLOSE.match(lines[j].strip())), len(lines))
                params = [(k, v.replace('\\"', '"').replace("\\\\", "\\")) for k, v in _PARAM.findall(m[2])]
                out += ["", self.slot((Node("directive", attrs={"name": m[1]}, params=params), lines[i + 1 : end])), ""]
                i = end + 1
                continue
            out.append(line)
            i += 1
        return out

    def from_slot(self, number: int) -> Node:
        what = self.slots[number]
        if isinstance(what, Node):
            return what
        node, body = what
        node.kids = self.blocks(body)
        if node.kids:
            node.attrs["has_body"] = "true"
        return node

    # --- blocks ---------------------------------------------------------------------------------------------

    def blocks(self, lines: list[str]) -> list[Node]:
        raw = BlockScanner(self).scan(lines)
        return [self.finished(b) for b in raw]

    def finished(self, b: Node) -> Node:
        """Inline content of leaf blocks is read when all reference definitions are known."""
        if b.kind in ("paragraph", "heading") and b.text is not None:
            slot = _SLOT_LINE.match(b.text) if b.kind == "paragraph" else None
            if slot:
                return self.from_slot(int(slot[1]))
            return Node(b.kind, self.inline(b.text), level=b.level)
        if b.kind == "table":
            return self.table(b)
        b.kids = [self.finished(k) for k in b.kids]
        return b

    def table(self, b: Node) -> Node:
        """Rows of cells; `<` and `^` cells widen the cell to the left or above."""
        header, _, *body = b.text.split("\n")
        width = len(split_row(header))
        rows: list[list[Node]] = []
        for number, line in enumerate([header, *body]):
            cells = split_row(line)[:width]
            cells += [""] * (width - len(cells))
            row: list[Node] = []
            for c in cells:
                kids = self.inline(c)
                mark = kids[0].text.strip() if len(kids) == 1 and kids[0].kind == "text" else None
                if mark == "<" and row:
                    row[-1].attrs["colspan"] = str(row[-1].number("colspan") + 1)
                else:
                    row.append(Node("cell", kids, attrs={"type": "data" if number else "header"} | ({"mark": "^"} if mark == "^" else {})))
            rows.append(row)
        for y, row in enumerate(rows):
            for cell in reversed([c for c in row if c.get("mark")]):
                x = column(row, cell)
                for above in reversed(rows[:y]):
                    owner = next((c for c in above if column(above, c) == x and not c.get("mark")), None)
                    if owner is not None:
                        owner.attrs["rowspan"] = str(owner.number("rowspan") + 1)
                        break
                del row[next(i for i, c in enumerate(row) if c is cell)]
        out = [Node("row", row) for row in rows]
        out[0].attrs["header"] = "true"
        return Node("table", out)

    # --- inlines --------------------------------------------------------------------------------------------

    def inline(self, source: str) -> list[Node]:
        return [text(source)] if _PLAIN.fullmatch(source) else self.paired(InlineScanner(self, source).scan())

    def paired(self, nodes: list[Node]) -> list[Node]:
        out, at = self._paired(nodes, 0, None)
        return out

    def _paired(self, nodes: list[Node], at: int, until: str | None) -> tuple[list[Node], int]:
        """Nodes with HTML tags paired; an open tag without its end takes all that follows."""
        out: list[Node] = []
        while at < len(nodes):
            n = nodes[at]
            at += 1
            if n.kind != "html":
                n.kids = self.paired(n.kids) if n.kids else n.kids
                if n.kind == "text" and out and out[-1].kind == "text":
                    out[-1].text += n.text
                else:
                    out.append(n)
                continue
            kind, tag = tag_of(n.text)
            if kind == "close" and tag == until:
                return out, at
            if kind == "open" and tag in HTML_NODES:
                inner, at = self._paired(nodes, at, tag)
                out.append(Node(HTML_NODES[tag], inner))
            elif kind == "self" and tag == "br":
                out.append(Node("hardbreak"))
            elif kind == "open" and tag == "span" and (color := _SPAN_COLOR.search(n.text)):
                inner, at = self._paired(nodes, at, "span")
                out.append(Node("color", inner, attrs={"color": color[1].strip()}))
            elif kind:
                self.warnings.append(f"the tag <{tag}> has no form in storage pages and is left out")
            else:
                self.warnings.append("an inline tag without its partner is left out")
        return out, at

    def link(self, url: str, title: str | None, kids: list[Node]) -> Node:
        if url.startswith(f"{LINK_SCHEME}op-"):
            ident = url[len(LINK_SCHEME) :]
            if ident in self.payloads:
                shown = "".join([k.text for k in kids if k.kind == "text"])
                return Node("inline_opaque", text=self.payloads[ident], attrs={"opaque_id": ident, "label": shown})
        return Node("link", kids, attrs={"url": url} | ({"title": title} if title else {}))

    def image(self, url: str, title: str | None, kids: list[Node]) -> Node:
        src, width, height = self.marks.unsized(url)
        origin = self.origin.get(url, self.origin.get(src) if src != url else None)
        if origin is not None:
            src = self.marks.unsized(origin)[0]
        alt = "".join([k.text for k in kids if k.kind == "text"])
        size = {k: str(v) for k, v in (("width", width), ("height", height)) if v is not None}
        return Node("image", attrs={"src": src, "alt": alt} | ({"title": title} if title else {}) | size)


def column(row: list[Node], cell: Node) -> int:
    x = 0
    for c in row:
        if c is cell:
            return x
        x += c.number("colspan")
    return x


def split_row(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    if line.endswith("|") and not re.search(r"(?<!\\)(?:\\\\)*\\\|$", line):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


# --- block structure ----------------------------------------------------------------------------------------

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_HR = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})$")
_BULLET = re.compile(r"^( {0,3})([-+*])(?=[ \t]|$)")
_NUMBER = re.compile(r"^( {0,3})(\d{1,9})([.)])(?=[ \t]|$)")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}>[ ]?")
_SIGNED = frozenset("#-_*>`~+")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r'^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]+("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)')


def expand(line: str) -> str:
    """Leading tabs as spaces."""
    if "\t" not in line or "\t" not in line[: len(line) - len(line.lstrip(" \t"))]:
        return line
    width, i = 0, 0
    while i < len(line) and line[i] in " \t":
        width += 4 - width % 4 if line[i] == "\t" else 1
        i += 1
    return " " * width + line[i:]


def signed(line: str) -> bool:
    """Whether the first character can begin a heading, rule, quotation, fence or list item."""
    c = line.lstrip(" ")[:1]
    return c in _SIGNED or c.isdecimal()


class BlockScanner:
    """Reads a container's lines; nested containers are scanned from the lines that belong to them."""

    def __init__(self, reader: MarkdownReader):
        self.reader = reader

    def scan(self, lines: list[str]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(lines):
            line = expand(lines[i])
            if not line.strip():
                i += 1
            elif line.startswith("    "):
                i = self.indented(lines, i, out)
            elif not signed(line):
                i = self.table(lines, i, out) if i + 1 < len(lines) and "|" in line and self.is_table(line, lines[i + 1]) else self.paragraph(lines, i, out)
            elif (m := _FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
                i = self.fenced(lines, i, m, out)
            elif m := _ATX.match(line):
                out.append(Node("heading", text=(m[2] or "").strip() if not re.fullmatch("#+", m[2] or "") else "", level=len(m[1])))
                i += 1
            elif _HR.match(line):
                out.append(Node("hr"))
                i += 1
            elif _QUOTE.match(line):
                i = self.quote(lines, i, out)
            elif _BULLET.match(line) or _NUMBER.match(line):
                i = self.list(lines, i, out)
            elif i + 1 < len(lines) and "|" in line and self.is_table(line, lines[i + 1]):
                i = self.table(lines, i, out)
            else:
                i = self.paragraph(lines, i, out)
        return out

    def indented(self, lines, i, out) -> int:
        body = []
        while i < len(lines) and (not lines[i].strip() or expand(lines[i]).startswith("    ")):
            body.append(expand(lines[i])[4:])
            i += 1
        while body and not body[-1].strip():
            body.pop()
        out.append(Node("code_block", text="\n".join(body) + "\n"))
        return i

    def fenced(self, lines, i, m, out) -> int:
        indent, fence = len(m[1]), m[2]
        language = unescaped(m[3].strip()).split(" ", 1)[0]
        close = re.compile(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
        body = []
        i += 1
        while i < len(lines) and not close.match(lines[i]):
            line = lines[i]
            body.append(line[min(indent, len(line) - len(line.lstrip(" "))) :])
            i += 1
        out.append(Node("code_block", text="".join([b + "\n" for b in body]), attrs={"language": language} if language else {}))
        return i + 1

    def starts_block(self, line: str, *, lazy: bool = False) -> bool:
        """Whether the line would end a paragraph before it."""
        line = expand(line)
        if not signed(line):
            return False
        m = _FENCE.match(line)
        if _ATX.match(line) or _HR.match(line) or _QUOTE.match(line) or m and not (m[2][0] == "`" and "`" in m[3]):
            return True
        bullet, number = _BULLET.match(line), _NUMBER.match(line)
        if bullet:
            return bool(line[bullet.end() :].strip())
        return bool(number and number[2] == "1" and line[number.end() :].strip())

    def quote(self, lines, i, out) -> int:
        body: list[str] = []
        while i < len(lines):
            line = expand(lines[i])
            if m := _QUOTE.match(line):
                body.append(line[m.end() :])
            elif not line.strip() or self.starts_block(line) or not self.open_paragraph(body):
                break
            else:
                body.append(line.lstrip())
            i += 1
        out.append(Node("blockquote", self.scan(body)))
        return i

    def open_paragraph(self, body: list[str]) -> bool:
        """Whether the last line of a container can be continued by a lazy line."""
        if not body or not body[-1].strip():
            return False
        last = body[-1]
        while m := _QUOTE.match(last) or _BULLET.match(last) or _NUMBER.match(last):
            last = last[m.end() :].lstrip(" ") if last[m.end() :].strip() else ""
        fences = [x for x in body if _FENCE.match(x)]
        return bool(last.strip()) and not _ATX.match(last) and not _HR.match(last) and len(fences) % 2 == 0 and not (last.startswith("    ") and len(body) == 1)

    def list(self, lines, i, out) -> int:
        items: list[Node] = []
        first = _BULLET.match(expand(lines[i])) or _NUMBER.match(expand(lines[i]))
        sign = first[2] if first.re is _BULLET else first[3]
        while i < len(lines):
            line = expand(lines[i])
            m = _BULLET.match(line) or _NUMBER.match(line)
            if not m or _HR.match(line) or (m[2] if m.re is _BULLET else m[3]) != sign or m.re is not first.re:
                break
            rest = expand(line[m.end() :].replace("\t", "    ", 1)) if "\t" in line[m.end() : m.end() + 1] else line[m.end() :]
            pad = len(rest) - len(rest.lstrip(" "))
            pad = 1 if pad > 4 or not rest.strip() else pad
            indent = m.end() + pad
            inside = " " * indent
            body = [rest[pad:] if rest.strip() else ""]
            i += 1
            while i < len(lines):
                line = expand(lines[i])
                if not line.strip():
                    if len(body) == 1 and not body[0]:
                        break
                    following = next((lines[k] for k in range(i + 1, len(lines)) if lines[k].strip()), None)
                    if following is None or not expand(following).startswith(inside):
                        break
                    body.append("")
                elif line.startswith(inside):
                    body.append(line[indent:])
                elif (_BULLET.match(line) or _NUMBER.match(line)) or self.starts_block(line) or not self.open_paragraph(body):
                    break
                else:
                    body.append(line.lstrip())
                i += 1
            items.append(Node("list_item", self.scan(body)))
            j = i
            while j < len(lines) and not lines[j].strip():
                j += 1
            if j > i and j < len(lines):
                again = _BULLET.match(expand(lines[j])) or _NUMBER.match(expand(lines[j]))
                if again and not _HR.match(expand(lines[j])):
                    i = j
                    continue
                break
        attrs = {"type": "bullet"} if first.re is _BULLET else {"type": "ordered"} | ({"start": str(int(first[2]))} if int(first[2]) != 1 else {})
        out.append(Node("list", items, attrs=attrs))
        return i

    def is_table(self, header: str, delimiter: str) -> bool:
        return bool(_DELIMITER.match(delimiter)) and "|" in delimiter and len(split_row(header)) == len(split_row(delimiter))

    def table(self, lines, i, out) -> int:
        start = i
        i += 2
        while i < len(lines) and lines[i].strip() and "|" in lines[i] and not self.starts_block(lines[i]):
            i += 1
        out.append(Node("table", text="\n".join(lines[start:i])))
        return i

    def paragraph(self, lines, i, out) -> int:
        body: list[str] = []
        while i < len(lines):
            line = expand(lines[i])
            if body:
                if (m := _SETEXT.match(line)) and not _SLOT_LINE.match(body[-1]):
                    rest = self.definitions("\n".join(body))
                    if rest.strip():
                        out.append(Node("heading", text=rest.strip(), level=1 if m[1][0] == "=" else 2))
                        return i + 1
                if not line.strip() or self.starts_block(line):
                    break
                if "|" in line and i + 1 < len(lines) and self.is_table(line, lines[i + 1]):
                    break
            body.append(line.lstrip())
            i += 1
        rest = self.definitions("\n".join(body))
        if rest.strip():
            out.append(Node("paragraph", text=rest.rstrip()))
        return i

    def definitions(self, source: str) -> str:
        """What is left of a paragraph after the reference definitions it begins with."""
        while m := _DEFINITION.match(source):
            url = m[2][1:-1] if m[2].startswith("<") else m[2]
            self.reader.references.setdefault(folded(m[1]), (unescaped(url), unescaped(m[3][1:-1]) if m[3] else None))
            source = source[m.end() :]
        return source


def folded(name: str) -> str:
    return " ".join(name.split()).casefold()


# --- inlines ------------------------------------------------------------------------------------------------

# HTML tags that stand for a node.
HTML_NODES = {
    "strong": "strong", "b": "strong", "em": "em", "i": "em", "del": "del", "s": "del", "sub": "sub", "sup": "sup",
    "ins": "ins", "u": "ins", "cite": "cite",
}
_SPAN_COLOR = re.compile(r'style="[^"]*color:\s*([^;"\']+)')
_ESCAPABLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_URI = re.compile(r"<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*)>")
_MAIL = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9.-]*[a-zA-Z0-9])?)>")
_HTML = re.compile(
    r"<[a-zA-Z][a-zA-Z0-9-]*(?:\s+[a-zA-Z_:][a-zA-Z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>"
    r"|</[a-zA-Z][a-zA-Z0-9-]*\s*>|<!--.*?-->|<\?.*?\?>|<![A-Z]+\s[^>]*>|<!\[CDATA\[.*?\]\]>",
    re.S,
)
_TAG_OPEN = re.compile(r"^<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^>]*)?>$")
_TAG_CLOSE = re.compile(r"^</([a-zA-Z][a-zA-Z0-9]*)\s*>$")
_TAG_SELF = re.compile(r"^<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^>]*)?/?\s*>$")
_TICKS = re.compile("`+")
_PLAIN = re.compile(r"(?:[^\\`*_~\[\]!<&\n]++|!(?!\[)|&(?![#a-zA-Z]))++")
_PIECE = re.compile(_PLAIN.pattern[:-3] + r"|\\[!-/:-@\[-`{-~])++")
_ESCAPED = re.compile(r"\\(.)")
_TAIL = re.compile(r'\(\s*(?:(<(?:[^<>\n\\]|\\.)*>)|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.|\([^\s()\\]*\))*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\([^\s()\\]*\))*\))*))?(?:\s+("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|\((?:[^()\\]|\\.)*\)))?\s*\)')


def tag_of(source: str) -> tuple[str, str] | tuple[None, None]:
    source = source.strip()
    if m := _TAG_CLOSE.match(source):
        return "close", m[1].lower()
    if source.endswith("/>") or source.lower() in ("<br>", "<hr>"):
        m = _TAG_SELF.match(source)
        return ("self", m[1].lower()) if m else (None, None)
    m = _TAG_OPEN.match(source)
    return ("open", m[1].lower()) if m else (None, None)


def unescaped(s: str) -> str:
    s = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s) if "\\" in s else s
    return _ENTITY.sub(lambda m: html.unescape(m[0]), s) if "&" in s else s


def is_punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


class InlineScanner:
    """CommonMark's delimiter algorithm over one run of inline source."""

    def __init__(self, reader: MarkdownReader, source: str):
        self.reader, self.source = reader, source
        self.nodes: list[Node | None] = []
        self.delimiters: list[dict] = []
        self.brackets: list[dict] = []
        self.missing_ticks: set[int] = set()

    def add(self, node: Node) -> None:
        self.nodes.append(node)

    def scan(self) -> list[Node]:
        s, i = self.source, 0
        while i < len(s):
            if m := _PIECE.match(s, i):
                self.add(text(_ESCAPED.sub(r"\1", m[0]) if "\\" in m[0] else m[0]))
                i = m.end()
                continue
            i = self.special(s, i)
        self.emphasis(0)
        return merged(self.nodes)

    def special(self, s: str, i: int) -> int:
        c = s[i]
        if c == "\\":
            if s[i + 1 : i + 2] == "\n":
                self.add(Node("hardbreak"))
                return self.skip(s, i + 2)
            if i + 1 < len(s) and s[i + 1] in _ESCAPABLE:
                self.add(text(s[i + 1]))
                return i + 2
        elif c == "\n":
            last = self.nodes[-1] if self.nodes and self.nodes[-1].kind == "text" else None
            hard = last is not None and last.text.endswith("  ")
            if last is not None:
                last.text = last.text.rstrip(" ")
            self.add(Node("hardbreak" if hard else "softbreak"))
            return self.skip(s, i + 1)
        elif c == "`":
            return self.code(s, i)
        elif c == "<":
            for pattern, kind in ((_URI, "uri"), (_MAIL, "mail"), (_HTML, "html")):
                if m := pattern.match(s, i):
                    self.add(Node("html", text=m[0]) if kind == "html" else Node("link", [text(m[1])], attrs={"url": m[1] if kind == "uri" else f"mailto:{m[1]}"}))
                    return m.end()
        elif c == "&":
            if m := _ENTITY.match(s, i):
                self.add(text(html.unescape(m[0])))
                return m.end()
        elif c == "[" or c == "!" and s[i + 1 : i + 2] == "[":
            width = 1 if c == "[" else 2
            self.brackets.append({"at": len(self.nodes), "image": width == 2, "source": i + width, "delims": len(self.delimiters), "live": True})
            self.add(text(s[i : i + width]))
            return i + width
        elif c == "]":
            return self.close(s, i)
        elif c in "*_~":
            return self.delimiter(s, i)
        self.add(text(c))
        return i + 1

    def skip(self, s: str, i: int) -> int:
        while i < len(s) and s[i] == " ":
            i += 1
        return i

    def code(self, s: str, i: int) -> int:
        run = _TICKS.match(s, i)
        size = run.end() - i
        if size not in self.missing_ticks:
            for m in _TICKS.finditer(s, run.end()):
                if m.end() - m.start() == size:
                    inner = s[run.end() : m.start()].replace("\n", " ")
                    if len(inner) > 1 and inner[0] == inner[-1] == " " and inner.strip(" "):
                        inner = inner[1:-1]
                    self.add(Node("code", text=inner))
                    return m.end()
            self.missing_ticks.add(size)
        self.add(text(run[0]))
        return run.end()

    def delimiter(self, s: str, i: int) -> int:
        c, j = s[i], i
        while j < len(s) and s[j] == c:
            j += 1
        before, after = s[i - 1] if i else " ", s[j] if j < len(s) else " "
        left = not after.isspace() and (not is_punctuation(after) or before.isspace() or is_punctuation(before))
        right = not before.isspace() and (not is_punctuation(before) or after.isspace() or is_punctuation(after))
        if c == "_":
            opens, closes = left and (not right or is_punctuation(before)), right and (not left or is_punctuation(after))
        else:
            opens, closes = left, right
        if c != "~" or j - i == 2:
            self.delimiters.append({"at": len(self.nodes), "sign": c, "n": j - i, "was": j - i, "opens": opens, "closes": closes})
        self.add(text(s[i:j]))
        return j

    def close(self, s: str, i: int) -> int:
        if not self.brackets:
            self.add(text("]"))
            return i + 1
        b = self.brackets.pop()
        target = self.target(s, i, b) if b["live"] else None
        if target is None:
            self.add(text("]"))
            return i + 1
        url, title, end = target
        self.emphasis(b["delims"])
        kids = self.reader.paired(merged(self.nodes[b["at"] + 1 :]))
        del self.nodes[b["at"] :]
        self.add(self.reader.image(url, title, kids) if b["image"] else self.reader.link(url, title, kids))
        if not b["image"]:
            for other in self.brackets:
                other["live"] = other["live"] and other["image"]
        return end

    def target(self, s: str, i: int, b: dict) -> tuple[str, str | None, int] | None:
        if m := _TAIL.match(s, i + 1):
            url = m[1][1:-1] if m[1] else m[2] or ""
            return unescaped(url), unescaped(m[3][1:-1]) if m[3] else None, m.end()
        name, end = s[b["source"] : i], i + 1
        if m := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(s, i + 1):
            name, end = m[1] or name, m.end()
        found = self.reader.references.get(folded(name))
        return (*found, end) if found else None

    def emphasis(self, bottom: int) -> None:
        """Pairs the delimiters above `bottom`."""
        d, c = self.delimiters, bottom
        least: dict[tuple, int] = {}
        while c < len(d):
            closer = d[c]
            if not closer["closes"] or not closer["n"]:
                c += 1
                continue
            key = (closer["sign"], closer["opens"], closer["was"] % 3)
            o = c - 1
            while o >= max(bottom, least.get(key, bottom)):
                opener = d[o]
                odd = (opener["closes"] or closer["opens"]) and (opener["was"] + closer["was"]) % 3 == 0 and (opener["was"] % 3 or closer["was"] % 3)
                if opener["sign"] == closer["sign"] and opener["opens"] and opener["n"] and (closer["sign"] == "~" or not odd):
                    break
                o -= 1
            else:
                least[key] = c
                c += 1
                continue
            opener = d[o]
            use = 2 if closer["sign"] == "~" or opener["n"] >= 2 and closer["n"] >= 2 else 1
            kind = "del" if closer["sign"] == "~" else "strong" if use == 2 else "em"
            start, end = opener["at"], closer["at"]
            kids = merged(self.nodes[start + 1 : end])
            self.nodes[start + 1 : end] = [Node(kind, kids)] + [None] * (end - start - 2) if end - start > 1 else []
            for x in d[o + 1 : c]:
                x["n"] = 0
            opener["n"] -= use
            closer["n"] -= use
            self.nodes[start].text = opener["sign"] * opener["n"]
            self.nodes[end].text = closer["sign"] * closer["n"]
            if not closer["n"]:
                c += 1
        del d[bottom:]


def merged(nodes: list[Node | None]) -> list[Node]:
    """Neighbouring texts as one; empty ones left out."""
    out: list[Node] = []
    for n in nodes:
        if n is None or n.kind == "text" and not n.text:
            continue
        if n.kind == "text" and out and out[-1].kind == "text":
            out[-1].text += n.text
        else:
            out.append(n)
    return out


def parse_markdown(source: str, options: Options | None = None) -> tuple[list[Node], list[str]]:
    reader = MarkdownReader(options or Options())
    try:
        return reader.document(source), reader.warnings
    except RecursionError as ex:
        raise ParseError("markdown is nested too deeply") from ex
