"""A small XML tree of mixed content that keeps prefixes, CDATA and comments; no DTD, no entities of its own."""

from __future__ import annotations

import html
import re
from xml.parsers import expat

from .tree import ParseError

_GUARD = re.compile(r"<!(DOCTYPE|ENTITY)\b", re.I)
_CDATA = re.compile(r"(<!\[CDATA\[.*?\]\]>)", re.S)
_NAMED = re.compile(r"&([a-zA-Z][a-zA-Z0-9]{1,31});")
_KEPT = {"amp", "lt", "gt", "quot", "apos"}
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


class CData(str):
    pass


class Comment(str):
    pass


class Element:
    __slots__ = ("attrs", "kids", "paired", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, kids: list | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, kids if kids is not None else []
        self.paired = False  # read as <x></x>, and not as <x/>

    @property
    def local(self) -> str:
        return self.tag.rpartition(":")[2] if ":" in self.tag else self.tag

    @property
    def prefix(self) -> str:
        return self.tag.rpartition(":")[0]

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def elements(self) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element)]

    def lead(self) -> str:
        """Text before the first child."""
        return lead(self.kids)

    def all_text(self) -> str:
        return "".join(k.all_text() if isinstance(k, Element) else "" if isinstance(k, Comment) else k for k in self.kids)

    def text_with_breaks(self) -> str:
        """All text, with line breaks for `br`."""
        out = []
        for k in self.kids:
            if isinstance(k, Element):
                out.append("\n" if k.local == "br" else k.text_with_breaks())
            elif not isinstance(k, Comment):
                out.append(k)
        return "".join(out)

    def below(self):
        """All elements inside, parents first."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Element)]
        while todo:
            el = todo.pop()
            yield el
            if el.kids:
                todo.extend([k for k in reversed(el.kids) if isinstance(k, Element)])


def is_text(k) -> bool:
    return isinstance(k, str) and not isinstance(k, Comment)


def lead(kids: list) -> str:
    out = []
    for k in kids:
        if not is_text(k):
            break
        out.append(k)
    return "".join(out)


def decode_named(source: str) -> str:
    """HTML's named characters, but for those of XML and inside CDATA."""

    def one(m: re.Match) -> str:
        return m[0] if m[1] in _KEPT else html.unescape(m[0])

    return "".join(p if p.startswith("<![CDATA[") else _NAMED.sub(one, p) for p in _CDATA.split(source)) if "&" in source else source


def parse_fragment(source: str, *, named: bool = True) -> Element:
    """The root of a fragment. DOCTYPE and ENTITY are refused wherever they stand."""
    if _GUARD.search(source):
        raise ParseError("storage input may not contain DOCTYPE or ENTITY declarations")
    root = Element("root")
    stack, spaces, in_cdata = [root], [{"ac", "ri", "xml"}], [False]

    def add(text: str) -> None:
        kids, kind = stack[-1].kids, CData if in_cdata[0] else str
        if kids and type(kids[-1]) is kind:
            kids[-1] = kind(kids[-1] + text)
        else:
            kids.append(kind(text))

    def start(tag: str, flat: list) -> None:
        known, attrs = spaces[-1], {}
        if flat:
            attrs = dict(zip(flat[::2], flat[1::2], strict=True))
            known = known | {a[6:] for a in attrs if a.startswith("xmlns:")}
        for name in (tag, *attrs):
            if ":" in name and not name.startswith("xmlns:") and name.split(":", 1)[0] not in known:
                raise ParseError(f"storage XML is not well-formed: undeclared prefix in {name}")
        el = Element(tag, {a: v for a, v in attrs.items() if a != "xmlns" and not a.startswith("xmlns:")} if flat else None)
        if len(stack) > 1 or tag != "__root__":
            stack[-1].kids.append(el)
            stack.append(el)
        spaces.append(known)

    def end(tag: str) -> None:
        spaces.pop()
        if len(stack) > 1:
            el = stack.pop()
            if not el.kids:
                at = p.CurrentByteIndex
                el.paired = data[at : at + 2] == b"</" and data[at - 2 : at] != b"/>"

    def cdata(on: bool) -> None:
        in_cdata[0] = on
        if on:
            stack[-1].kids.append(CData(""))

    p = expat.ParserCreate()
    p.ordered_attributes, p.buffer_text = True, True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, add
    p.StartCdataSectionHandler, p.EndCdataSectionHandler = lambda: cdata(True), lambda: cdata(False)
    p.CommentHandler = lambda data: stack[-1].kids.append(Comment(data))
    try:
        data = f"<__root__>{decode_named(source) if named else source}</__root__>".encode()
        p.Parse(data, True)
    except expat.ExpatError as ex:
        raise ParseError(f"storage XML is not well-formed: {ex}") from ex
    except UnicodeEncodeError as ex:
        raise ParseError("storage XML is not well-formed: lone surrogate") from ex
    return root


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def escape_attr(s: str) -> str:
    return escape_text(s).replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;")


def write(el: Element) -> str:
    """The element as XML, attributes in their order, without tail; an empty one with the tags that it was read with."""
    out: list[str] = []
    _write(el, out)
    return "".join(out)


def _write(el: Element, out: list[str]) -> None:
    out.append("<" + el.tag + "".join([f' {a}="{escape_attr(v)}"' for a, v in el.attrs.items()]))
    if not el.kids:
        out.append(f"></{el.tag}>" if el.paired else "/>")
        return
    out.append(">")
    for k in el.kids:
        if isinstance(k, Element):
            _write(k, out)
        elif isinstance(k, CData):
            out.append("<![CDATA[" + k.replace("]]>", "]]]]><![CDATA[>") + "]]>")
        elif isinstance(k, Comment):
            out.append(f"<!--{k}-->")
        else:
            out.append(escape_text(k))
    out.append(f"</{el.tag}>")


def not_xml(s: str) -> bool:
    return _NOT_XML.search(s) is not None
