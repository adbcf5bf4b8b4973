"""The tree as canonical Markdown."""

from __future__ import annotations

import re

from .fragments import marks, write_link
from .options import Options
from .tree import Node, walk

_SPECIAL = re.compile(r"([\\`*_\[\]|])")
_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
_TAGS = {"sub": "sub", "sup": "sup", "ins": "ins", "cite": "cite"}
_SIGNS = {"em": ("*", "em"), "strong": ("**", "strong"), "del": ("~~", "del")}


def escape(s: str) -> str:
    return _SPECIAL.sub(r"\\\1", s)


def quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"')


def first_sign(n: Node) -> str:
    """The character that a node's Markdown begins with, as far as a neighbour's flank is concerned."""
    if n.kind == "text":
        return n.text[:1]
    return {"softbreak": " ", "hardbreak": " ", "link": "[", "image": "!", "code": "`", "strong": "*", "em": "*", "del": "~"}.get(n.kind, "")


class MarkdownWriter:
    def __init__(self, options: Options):
        self.options = options
        self.marks = marks(options.marker)

    def inline(self, nodes: list[Node]) -> str:
        out: list[str] = []
        before = ""
        for i, n in enumerate(nodes):
            after = first_sign(nodes[i + 1]) if i + 1 < len(nodes) else ""
            piece = self.one_inline(n, before, after)
            out.append(piece)
            before = piece[-1:] or before
        return "".join(out)

    def one_inline(self, n: Node, before: str, after: str) -> str:
        kind = n.kind
        if kind == "text":
            return escape(n.text)
        if kind == "softbreak":
            return "\n"
        if kind == "hardbreak":
            return "  \n"
        if kind in _SIGNS:
            inner, (sign, tag) = self.inline(n.kids), _SIGNS[kind]
            tight = inner and not inner[0].isspace() and not inner[-1].isspace()
            # delimiters between letters would not be read back
            return f"<{tag}>{inner}</{tag}>" if tight and (before.isalnum() or after.isalnum()) else f"{sign}{inner}{sign}"
        if kind in _TAGS:
            return f"<{kind}>{self.inline(n.kids)}</{kind}>"
        if kind == "color":
            return f'<span style="color:{n.get("color")}">{self.inline(n.kids)}</span>'
        if kind == "code":
            return code_span(n.text)
        if kind == "link":
            title = f' "{quoted(n.get("title"))}"' if n.get("title") else ""
            return f"[{self.inline(n.kids) or n.get('url')}]({n.get('url')}{title})"
        if kind == "image":
            return self.image(n)
        if kind == "inline_opaque":
            return write_link(n.get("label"), n.get("opaque_id"))
        raise TypeError(f"unexpected inline node: {kind}")

    def image(self, n: Node) -> str:
        src = n.get("src") or ""
        size = [int(n.get(k)) if n.get(k) is not None else None for k in ("width", "height")]
        title = f' "{quoted(n.get("title"))}"' if n.get("title") else ""
        out = f"![{(n.get('alt') or '').replace(']', chr(92) + ']')}]({self.marks.sized(src, *size)}{title})"
        return out if _SCHEME.match(src) else out + self.marks.write_asset(src)

    def blocks(self, nodes: list[Node]) -> str:
        return "\n\n".join([self.block(n) for n in nodes])

    def block(self, n: Node) -> str:
        kind = n.kind
        if kind == "heading":
            return "#" * max(1, min(6, n.level)) + " " + self.inline(n.kids).strip()
        if kind == "paragraph":
            return self.inline(n.kids).strip("\n")
        if kind == "code_block":
            body, fence = n.text or "", self.options.fence
            if fence in body:
                fence = "`" * (body.count("`") + 3)
            body = body.rstrip("\n")
            return f"{fence}{n.get('language') or ''}\n{body}\n{fence}"
        if kind == "blockquote":
            return "\n".join([f"> {line}" if line else ">" for line in self.blocks(n.kids).split("\n")])
        if kind == "list":
            return self.list(n, "")
        if kind == "list_item":
            return self.list(Node("list", [n], attrs={"type": "bullet"}), "")
        if kind == "hr":
            return "---"
        if kind == "table":
            return self.table(n)
        if kind == "directive":
            params = "".join([f' {k}="{quoted(v)}"' for k, v in n.params])
            body = self.blocks(n.kids) + "\n" if n.kids or n.get("has_body") else ""
            return f"::: {n.get('name')}{params}\n{body}:::"
        if kind == "opaque":
            return self.marks.write_block(n.text, n.get("opaque_id"))
        if kind == "passthrough":
            return n.text
        raise TypeError(f"unexpected block node: {kind}")

    def list(self, n: Node, indent: str) -> str:
        lines = []
        for i, item in enumerate(n.kids):
            sign = f"{n.number('start') + i}. " if n.get("type") == "ordered" else f"{self.options.bullet} "
            deep = indent + " " * len(sign)
            first, *rest = self.item(item, deep).split("\n")
            lines.append(indent + sign + first)
            lines += [line if not line or line.startswith(deep) else deep + line for line in rest]
        return "\n".join(lines)

    def item(self, n: Node, deep: str) -> str:
        out = []
        for i, k in enumerate(n.kids):
            if i:
                out.append("\n" if k.kind == "list" and n.kids[i - 1].kind in ("paragraph", "list") else "\n\n")
            if k.kind == "list":
                out.append(self.list(k, deep))
            elif k.kind == "paragraph":
                out.append(self.inline(k.kids).strip("\n"))
            else:
                out.append("\n".join([deep + line if line else line for line in self.block(k).split("\n")]).lstrip(" "))
        return "".join(out)

    def table(self, n: Node) -> str:
        grid = spread(n.kids)
        if not grid:
            return ""

        def line(row) -> str:
            cells = [c if isinstance(c, str) else self.inline(c.kids).strip().replace("  \n", "<br>").replace("\n", "<br>") for c in row]
            return "| " + " | ".join(cells) + " |"

        header = [r for r in n.kids if r.get("header")]
        tall = max([c.number("rowspan") for c in header[0].kids], default=1) if header else 0
        wide = len(grid[0])
        top = [line(r) for r in grid[:tall]] if header else [line([""] * wide)]
        return "\n".join([*top, line(["---"] * wide), *[line(r) for r in grid[tall:]]])


def code_span(content: str) -> str:
    if "`" not in content:
        return f"`{content}`"
    fence = "`" * (max(map(len, re.findall("`+", content))) + 1)
    return fence + " " * content.startswith("`") + content + " " * content.endswith("`") + fence


def spread(rows: list[Node]) -> list[list]:
    """Rows of equal width: a cell where it begins, `<` to its right, `^` below it, empty text where nothing is."""
    placed: list[dict[int, object]] = [{} for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for cell in row.kids:
            while x in placed[y]:
                x += 1
            wide, tall = cell.number("colspan"), cell.number("rowspan")
            for dx in range(wide):
                placed[y][x + dx] = "<" if dx else cell
                for below in placed[y + 1 : y + tall]:
                    below.setdefault(x + dx, "^")
            x += wide
    width = max([max(p, default=-1) + 1 for p in placed], default=0)
    return [[p.get(x, "") for x in range(width)] for p in placed] if width else []


def render_markdown(nodes: list[Node], options: Options | None = None) -> str:
    options = options or Options()
    writer = MarkdownWriter(options)
    payloads, special = {}, False
    for n in walk(nodes):
        if n.kind == "inline_opaque":
            payloads.setdefault(n.get("opaque_id"), n.text)
        special = special or n.kind in ("inline_opaque", "opaque", "directive")
    parts = [writer.marks.notice, ""] if special else []
    parts.append(writer.blocks(nodes).rstrip("\n"))
    if payloads:
        parts += ["", writer.marks.write_payloads(payloads)]
    return "\n".join(parts).rstrip("\n") + "\n"
