"""Storage XHTML: reading it into the tree and writing the tree as XHTML."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from .fragments import fragment_id
from .macros import DEFAULT_MACROS, MacroRegistry
from .tree import ConversionError, Node, ParseError, text
from .xml import CData, Comment, Element, is_text, lead, not_xml, parse_fragment, write

# Which elements mean what.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = {"blockquote", "div", "hr", "ol", "p", "pre", "table", "tbody", "tfoot", "thead", "tr", "ul", *HEADINGS}
LAYOUT = {"ac:layout", "ac:layout-section", "ac:layout-cell"}
WRAPS = {
    "strong": "strong", "b": "strong", "em": "em", "i": "em", "del": "del", "s": "del", "u": "ins", "ins": "ins",
    "sub": "sub", "sup": "sup", "cite": "cite",
}
DEFAULT_COLOR = re.compile(r"^\s*color\s*:\s*var\(--ds-text[^)]*\)\s*;?\s*$")
SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
_COLOR = re.compile(r"color:\s*([^;\"']+)")
_LANGUAGE = re.compile(r"^language-(.*)$")


# --- reading ------------------------------------------------------------------------------------------------


class StorageReader:
    def __init__(self, macros: MacroRegistry = DEFAULT_MACROS):
        self.macros = macros
        self.warnings: list[str] = []

    def blocks(self, kids: list) -> list[Node]:
        out: list[Node] = []
        for k in runs(kids):
            if is_text(k):
                if k.strip():
                    out.append(Node("paragraph", [text(str(k))]))
            elif k.tag in LAYOUT:
                out += self.blocks(k.kids)
            else:
                out += self.block(k)
        return out

    def block(self, el: Element) -> list[Node]:
        tag = el.tag
        if tag in HEADINGS:
            return [Node("heading", self.inline(el.kids), level=int(tag[1]))]
        if tag == "p":
            return self.paragraph(el)
        if tag in ("ul", "ol"):
            return [self.list(el)]
        if tag == "li":
            return [Node("list", [Node("list_item", self.blocks(el.kids))], attrs={"type": "bullet"})]
        if tag == "blockquote":
            return [Node("blockquote", self.blocks(el.kids))]
        if tag == "hr":
            return [Node("hr")]
        if tag == "pre":
            return self.pre(el)
        if tag == "table":
            return [self.table(el)]
        if tag == "div":
            inside = self.blocks(el.kids)
            return inside if len(inside) < 2 else [opaque(el)]
        if tag == "ac:image":
            return [Node("paragraph", [image(el)])]
        if tag == "ac:structured-macro":
            return [self.macro(el)]
        return [opaque(el)]

    def paragraph(self, el: Element) -> list[Node]:
        kids = self.inline(el.kids)
        seen = any(n.kind not in ("softbreak", "hardbreak") and (n.kind != "text" or n.text.strip()) for n in kids)
        return [Node("paragraph", kids)] if seen else []

    def inline(self, kids: list) -> list[Node]:
        out: list[Node] = []
        for k in runs(kids):
            if is_text(k):
                out.append(text(str(k)))
            elif plain_span(k):
                for inner in runs(k.kids):
                    out += [text(str(inner))] if is_text(inner) else self.one_inline(inner)
            else:
                out += self.one_inline(k)
        return out

    def one_inline(self, el: Element) -> list[Node]:
        tag = el.tag
        if tag == "ac:image":
            return [image(el)]
        if tag in WRAPS:
            return [Node(WRAPS[tag], self.inline(el.kids))]
        if tag == "code":
            return [Node("code", text=el.all_text())]
        if tag == "br":
            return [Node("hardbreak")]
        if tag == "a":
            return [Node("link", self.inline(el.kids), attrs=given(url=el.get("href") or "", title=el.get("title")))]
        if tag == "img":
            return [Node("image", attrs=given(src=el.get("src") or "", alt=el.get("alt") or "", title=el.get("title")))]
        if tag == "span":
            if color := _COLOR.search(el.get("style") or ""):
                return [Node("color", self.inline(el.kids), attrs={"color": color[1].strip()})]
            self.warnings.append("inline <span> with unknown attributes stripped")
            return self.inline(el.kids)
        xml = write(el)
        return [Node("inline_opaque", text=xml, attrs={"opaque_id": fragment_id(xml), "label": label(el)})]

    def list(self, el: Element) -> Node:
        attrs = {"type": "bullet" if el.tag == "ul" else "ordered"}
        if (start := el.get("start")) and start.isdigit() and int(start) != 1:
            attrs["start"] = str(int(start))
        return Node("list", [self.item(k) for k in el.elements() if k.local == "li"], attrs=attrs)

    def item(self, el: Element) -> Node:
        out, line = [], []

        def close() -> None:
            if line:
                out.append(Node("paragraph", list(line)))
                line.clear()

        for k in runs(el.kids):
            if is_text(k):
                if k.strip():
                    line.append(text(str(k)))
            elif k.local in ("ul", "ol"):
                close()
                out.append(self.list(k))
            elif k.local in BLOCKS or k.tag == "ac:structured-macro":
                close()
                out.extend(self.block(k))
            else:
                line.extend(self.one_inline(k))
        close()
        return Node("list_item", out)

    def pre(self, el: Element) -> list[Node]:
        inner = el.elements()[0] if len(el.elements()) == 1 and el.elements()[0].local == "code" else el
        if any(d.local != "br" for d in inner.below()):
            return [opaque(el)]
        body = inner.text_with_breaks()
        if not body.strip():
            return []
        named = _LANGUAGE.match(inner.get("class") or "")
        return [Node("code_block", text=body, attrs=given(language=named[1] if named else None))]

    def cell(self, el: Element) -> Node:
        kind = "header" if el.local == "th" else "data"
        attrs = {"type": kind} | {k: str(n) for k in ("colspan", "rowspan") if (n := span(el.get(k))) > 1}
        flat = unwrapped(el.kids)
        if not any(isinstance(k, Element) and k.local == "p" for k in flat):
            return Node("cell", self.inline(el.kids), attrs=attrs)
        out = [text(lead(el.kids))] if lead(el.kids).strip() else []
        after_p = False
        for k in flat:
            if is_text(k):
                if k.strip():
                    out += [Node("hardbreak"), text(str(k))] if after_p else [text(str(k))]
            elif k.local == "p":
                inside = self.inline(k.kids)
                out += [Node("hardbreak"), *inside] if out and inside else inside
            else:
                out += self.one_inline(k)
            after_p = isinstance(k, Element) and k.local == "p"
        return Node("cell", out, attrs=attrs)

    def table(self, el: Element) -> Node:
        header: Node | None = None
        body: list[Node] = []

        def row(tr: Element) -> Node:
            return Node("row", [self.cell(c) for c in tr.elements() if c.local in ("td", "th")])

        for part in el.elements():
            if part.local not in ("thead", "tbody", "tfoot", "tr"):
                continue
            for tr in [part] if part.local == "tr" else [k for k in part.elements() if k.local == "tr"]:
                made = row(tr)
                titles = bool(made.kids) and all(c.get("type") == "header" for c in made.kids)
                if header is None and (part.local == "thead" or part.local in ("tbody", "tr") and titles):
                    header = made
                else:
                    body.append(made)
        if header is None and body:
            header = body.pop(0)
        if header is not None:
            header.attrs["header"] = "true"
        return Node("table", [*([header] if header else []), *body])

    def macro(self, el: Element) -> Node:
        name = el.get("ac:name") or ""
        if name == "code":
            language = body = None
            for k in el.elements():
                if k.local == "parameter" and k.get("ac:name") == "language":
                    language = k.lead().strip() or None
                elif k.local == "plain-text-body":
                    body = k.lead()
            return Node("code_block", text=body or "", attrs=given(language=None if language in ("none", "text") else language))
        known = self.macros.by_name(name)
        if known is None:
            return opaque(el)
        if known.read is not None:
            made = known.read(el, self.blocks)
            return opaque(el) if made is None else made
        node = Node("directive", attrs={"name": known.directive})
        for k in el.elements():
            if k.local == "parameter" and k.get("ac:name"):
                node.params.append((k.get("ac:name"), k.lead().strip()))
            elif k.local == "rich-text-body" and known.rich:
                node.kids = self.blocks(k.kids)
        if known.rich:
            node.attrs["has_body"] = "true"
        return node


def given(**values: str | None) -> dict[str, str]:
    return {k: v for k, v in values.items() if v is not None}


def runs(kids: list) -> list:
    """Children without comments, neighbouring texts joined, empty ones left out."""
    out: list = []
    for k in kids:
        if isinstance(k, Comment) or k == "":
            continue
        if is_text(k) and out and is_text(out[-1]):
            out[-1] = out[-1] + k
        else:
            out.append(str(k) if is_text(k) else k)
    return out


def plain_span(el: Element) -> bool:
    if el.local != "span" or any(a != "style" for a in el.attrs):
        return False
    return "style" not in el.attrs or bool(DEFAULT_COLOR.match(el.attrs["style"]))


def span(value: str | None) -> int:
    try:
        return max(1, int(value or 1))
    except ValueError:
        return 1


def unwrapped(kids: list) -> list:
    """What a cell holds, with `div` wrappers removed; the text before its first child is left out."""
    out: list = []
    begun = False
    for k in runs(kids):
        if is_text(k):
            if begun:
                out.append(k)
            continue
        begun = True
        if k.tag == "div":
            inside = unwrapped(k.kids)
            if not k.elements() and lead(k.kids).strip():
                inside = [Element("p", kids=[lead(k.kids)])]
            out += inside
            begun = False  # what follows a wrapper is not shown
        else:
            out.append(k)
    return out


def opaque(el: Element) -> Node:
    xml = write(el)
    return Node("opaque", text=xml, attrs={"opaque_id": fragment_id(xml)})


def image(el: Element) -> Node:
    src = ""
    for k in el.elements():
        if k.tag == "ri:attachment":
            src = k.get("ri:filename") or ""
        elif k.tag == "ri:url":
            src = k.get("ri:value") or ""
    size = {k: str(int(v)) for k in ("width", "height") if re.fullmatch(r"\s*[+-]?\d+\s*", v := el.get(f"ac:{k}") or "")}
    return Node("image", attrs=given(src=src, alt=el.get("ac:alt") or "", title=el.get("ac:title")) | size)


def label(el: Element) -> str:
    """A short hint for readers; the hash is what counts."""
    if el.tag == "ac:structured-macro":
        name = el.get("ac:name") or "macro"
        for k in el.elements():
            if k.local == "parameter" and k.get("ac:name") == "key" and k.lead():
                return f"{name}:{k.lead().strip()}"
        return f"cfx:{name}"
    if el.tag == "ac:link":
        for k in el.elements():
            if k.local == "user":
                return f"@user-{k.get('ri:userkey')[:8]}" if k.get("ri:userkey") else "@user"
            if k.local == "page":
                return f"→{k.get('ri:content-title') or 'page'}"
            if k.local == "attachment":
                return f"📎{k.get('ri:filename') or 'attachment'}"
        return "cfx:link"
    return "image" if el.tag == "ac:image" else f"cfx:{el.local}"


def parse_storage(source: str, macros: MacroRegistry = DEFAULT_MACROS) -> tuple[list[Node], list[str]]:
    reader = StorageReader(macros)
    return reader.blocks(parse_fragment(source).kids), reader.warnings


# --- writing ------------------------------------------------------------------------------------------------


class StorageWriter:
    def __init__(self, macros: MacroRegistry = DEFAULT_MACROS):
        self.macros = macros
        self.warnings: list[str] = []
        self.attachments: list[str] = []

    def inline(self, nodes: list[Node]) -> list:
        return [self.one_inline(n) for n in nodes]

    def one_inline(self, n: Node):
        if n.kind == "text":
            return n.text
        if n.kind == "softbreak":
            return "\n"
        if n.kind == "hardbreak":
            return Element("br")
        if n.kind == "code":
            return Element("code", kids=[n.text])
        if n.kind in ("strong", "em", "del", "sub", "sup", "ins", "cite"):
            return Element(n.kind, kids=self.inline(n.kids))
        if n.kind == "color":
            return Element("span", {"style": f"color:{n.get('color')}"}, self.inline(n.kids))
        if n.kind == "link":
            return Element("a", {"href": n.get("url") or ""} | ({"title": n.get("title")} if n.get("title") else {}), self.inline(n.kids))
        if n.kind == "image":
            return self.image(n)
        if n.kind == "inline_opaque":
            return restored(n)[0]
        raise ConversionError(f"unexpected inline node: {n.kind}")

    def image(self, n: Node) -> Element:
        attrs = {f"ac:{k}": v for k in ("alt", "title", "width", "height") if (v := n.get(k))}
        src = n.get("src") or ""
        if SCHEME.match(src):
            return Element("ac:image", attrs, [Element("ri:url", {"ri:value": src})])
        if src not in self.attachments:
            self.attachments.append(src)
        return Element("ac:image", attrs, [Element("ri:attachment", {"ri:filename": PurePosixPath(src).name or src})])

    def blocks(self, nodes: list[Node]) -> list[Element]:
        return [el for n in nodes if (el := self.block(n)) is not None]

    def block(self, n: Node) -> Element | None:
        if n.kind == "heading":
            return Element(f"h{max(1, min(6, n.level))}", kids=self.inline(n.kids))
        if n.kind == "paragraph":
            return Element("p", kids=self.inline(n.kids))
        if n.kind == "code_block":
            language = [("language", n.get("language"))] if n.get("language") else []
            return macro("code", language, Element("ac:plain-text-body", kids=[CData((n.text or "").rstrip("\n"))]))
        if n.kind == "blockquote":
            return Element("blockquote", kids=self.blocks(n.kids))
        if n.kind == "list":
            ordered = n.get("type") == "ordered"
            start = n.number("start")
            return Element("ol" if ordered else "ul", {"start": str(start)} if ordered and start != 1 else {}, [self.item(k) for k in n.kids])
        if n.kind == "list_item":
            return self.item(n)
        if n.kind == "hr":
            return Element("hr")
        if n.kind == "table":
            return self.table(n)
        if n.kind == "directive":
            return self.directive(n)
        if n.kind == "opaque":
            found = restored(n, whole=True)
            return found[0] if len([k for k in found if isinstance(k, Element)]) == 1 else Element("div", kids=found)
        if n.kind == "passthrough":
            return None
        raise ConversionError(f"unexpected block node: {n.kind}")

    def item(self, n: Node) -> Element:
        tight = len(n.kids) < 2 or n.kids[0].kind == "paragraph" and all(k.kind == "list" for k in n.kids[1:])
        if tight and n.kids and n.kids[0].kind == "paragraph":
            return Element("li", kids=[*self.inline(n.kids[0].kids), *self.blocks(n.kids[1:])])
        return Element("li", kids=self.blocks(n.kids))

    def table(self, n: Node) -> Element:
        def row(r: Node, tag: str | None = None) -> Element:
            return Element("tr", kids=[
                Element(tag or ("th" if c.get("type") == "header" else "td"), {k: c.get(k) for k in ("colspan", "rowspan") if c.number(k) > 1}, self.inline(c.kids))
                for c in r.kids
            ])

        head = [row(r, "th") for r in n.kids if r.get("header")]
        return Element("table", kids=[*([Element("thead", kids=head)] if head else []), Element("tbody", kids=[row(r) for r in n.kids if not r.get("header")])])

    def directive(self, n: Node) -> Element:
        known = self.macros.by_directive(n.get("name") or "")
        if known is None:
            raise ConversionError(f"no macro handler registered for directive {n.get('name')!r}")
        if known.write is not None:
            return known.write(n, self.blocks)
        if n.kids and not known.rich:
            self.blocks(n.kids)
            self.warnings.append(f"directive '::: {n.get('name')}' ignores body content; move values to header parameters (e.g. ``::: {n.get('name')} key=\"...\"``).")
        return macro(known.name, n.params, Element("ac:rich-text-body", kids=self.blocks(n.kids)) if known.rich else None)


def macro(name: str, params: list[tuple[str, str]], body: Element | None) -> Element:
    kids = [Element("ac:parameter", {"ac:name": k}, [v]) for k, v in params]
    return Element("ac:structured-macro", {"ac:name": name, "ac:schema-version": "1"}, [*kids, *([body] if body is not None else [])])


def restored(n: Node, *, whole: bool = False) -> list:
    """The elements of a kept fragment; with `whole` also the text after each."""
    what = f"{'opaque block' if whole else 'inline opaque'} {n.get('opaque_id')!r}"
    if "<!DOCTYPE" in n.text or "<!ENTITY" in n.text:
        raise ConversionError(f"{what} contains a DOCTYPE/ENTITY declaration")
    try:
        kids = parse_fragment(n.text, named=False).kids
    except ParseError as ex:
        raise ConversionError(f"{what} contains malformed XML: {ex}") from ex
    found = [k for k in kids if isinstance(k, Element)]
    if not found:
        raise ConversionError(f"{what} is empty")
    return kids[kids.index(found[0]) :] if whole and len(found) > 1 else found[:1]


def render_storage(nodes: list[Node], macros: MacroRegistry = DEFAULT_MACROS) -> tuple[str, list[str], list[str]]:
    """XHTML, local files it refers to, warnings."""
    writer = StorageWriter(macros)
    xhtml = "".join(write(el) for el in writer.blocks(nodes))
    if not_xml(xhtml):
        raise ConversionError("the document holds a character that XML does not allow")
    return xhtml, writer.attachments, writer.warnings
