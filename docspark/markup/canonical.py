"""Canonical storage XHTML: what is left of a fragment when all that does not count is taken away.

The rules run once each, in the order of RULES; every rule takes the root and changes the tree in place. A page is spared the
rules that are about tags it does not have.
"""

from __future__ import annotations

import re

from .storage import DEFAULT_COLOR, HEADINGS
from .xml import CData, Comment, Element, escape_text, is_text, lead, parse_fragment

# Attributes, styles and classes that change nothing in the content.
VOLATILE = {
    "ac:macro-id", "ac:local-id", "ac:schema-version", "ac:thumbnail", "ac:border", "ac:align", "ac:class",
    "ri:version-at-save", "data-uuid", "data-macro-id", "data-highlight-colour", "data-highlight-color",
}
TABLE_TAGS = {"table", "thead", "tbody", "tfoot", "tr", "th", "td", "col", "colgroup"}
TABLE_ATTRS = {"title", "scope"}
STYLES = {
    "text-align", "text-align-last", "list-style-type", "list-style-position", "list-style-image", "vertical-align",
    "padding", "padding-top", "padding-right", "padding-bottom", "padding-left", "margin", "margin-top",
    "margin-right", "margin-bottom", "margin-left", "font-weight", "font-style", "font-size", "font-family",
    "line-height", "letter-spacing", "white-space", "border", "border-top", "border-right", "border-bottom",
    "border-left", "border-color", "border-style", "border-width",
}
TABLE_STYLES = {"width", "min-width", "max-width", "height", "background-color"}
CLASSES = {"wrapped", "fixed-width", "relative-table", "auto-cursor-target", "ui-provider", "code-line"}
CLASS_PREFIXES = ("highlight-", "confluence", "has-list-", "internal-link", "external-link", "is-unresolved")
CODE_PARAMS = {"linenumbers", "firstline", "collapse", "theme", "title"}
FLOWING = {
    "a", "b", "blockquote", "code", "del", "div", "em", *HEADINGS, "i", "li", "p", "s", "span", "strong", "sub",
    "sup", "td", "th", "u",
}
TRIMMED = {"td", "th", "p", *HEADINGS}
BLOCKS = {
    "blockquote", "div", *HEADINGS, "hr", "li", "ol", "p", "pre", "table", "tbody", "td", "th", "thead", "tfoot", "tr", "ul",
    "ac:structured-macro", "ac:layout", "ac:layout-section", "ac:layout-cell",
}
CONTAINERS = {
    "blockquote", "div", "li", "ol", "table", "tbody", "tfoot", "thead", "tr", "ul", "root",
    "ac:rich-text-body", "ac:layout", "ac:layout-section", "ac:layout-cell",
}

# --- mixed content ------------------------------------------------------------------------------------------


def joined(kids: list) -> list:
    """Neighbouring texts as one, empty ones gone."""
    if len(kids) < 2:
        return [k for k in kids if k or not is_text(k)]
    out: list = []
    for k in kids:
        if is_text(k):
            if not k:
                continue
            if out and is_text(out[-1]):
                out[-1] = str(out[-1]) + str(k)
                continue
        out.append(k)
    return out


def tail(kids: list, i: int) -> str:
    """Text between child i and the next child."""
    return lead(kids[i + 1 :])


def without(kids: list, gone) -> list:
    """The children without those elements that `gone` names, and without the text that follows them."""
    out: list = []
    skipping = False
    for k in kids:
        if is_text(k):
            if not skipping:
                out.append(k)
            continue
        skipping = isinstance(k, Element) and gone(k)
        if not skipping:
            out.append(k)
    return joined(out)


def every(root: Element, *tags: str) -> list[Element]:
    return [e for e in root.below() if not tags or e.local in tags]


def children(el: Element) -> list:
    """Elements and comments."""
    return [k for k in el.kids if not is_text(k)]


def blank(s: str) -> bool:
    return not s.strip()


# --- rules --------------------------------------------------------------------------------------------------


def is_cosmetic(style: str, tag: str) -> bool:
    """Whether all declarations only say how things look: layout, sizes of tables, the default colour."""
    layout = STYLES | TABLE_STYLES if tag in TABLE_TAGS else STYLES
    declarations = [(d, d.split(":")[0].strip().lower()) for d in map(str.strip, style.split(";")) if d]
    return all(":" in d and (bool(DEFAULT_COLOR.match(d)) if name == "color" else name in layout) for d, name in declarations)


def scrub_attributes(root: Element) -> None:
    for el in root.below():
        keep = {}
        for name, value in el.attrs.items():
            if name in VOLATILE or name in TABLE_ATTRS and el.local in TABLE_TAGS or name in ("class", "title") and not value:
                continue
            if name == "style" and value and is_cosmetic(value, el.local):
                continue
            if name == "class":
                value = "" if el.local == "a" else " ".join(c for c in value.split() if c not in CLASSES and not c.startswith(CLASS_PREFIXES))
                if not value:
                    continue
            keep[name] = value
        el.attrs = keep


def drop_columns(root: Element) -> None:
    for el in [root, *every(root)]:
        el.kids = without(el.kids, lambda k: k.local in ("col", "colgroup"))


def unwrap_spans(root: Element) -> None:
    def inside(kids: list) -> list:
        out: list = []
        for k in kids:
            if isinstance(k, Element):
                k.kids = inside(k.kids)
                out += k.kids if k.tag == "span" and not set(k.attrs) - {"style", "class"} else [k]
            else:
                out.append(k)
        return joined(out)

    root.kids = inside(root.kids)


def collapsed(s: str) -> str:
    """The text with a blank for each run of white space."""
    words = " ".join(s.split())
    if not words:
        return " " if s else s
    return f"{' ' if s[0].isspace() else ''}{words}{' ' if s[-1].isspace() else ''}"


def collapse_space(root: Element) -> None:
    def visit(el: Element, in_pre: bool) -> None:
        for i, k in enumerate(el.kids):
            if isinstance(k, Element):
                visit(k, in_pre or el.local == "pre")
            elif is_text(k) and not in_pre and el.tag in FLOWING:
                el.kids[i] = collapsed(k)

    visit(root, False)


def pre_to_macro(root: Element) -> None:
    for el in [root, *every(root)]:
        for i, k in enumerate(el.kids):
            if isinstance(k, Element) and k.local == "pre":
                inner = children(k)[0] if len(children(k)) == 1 and isinstance(children(k)[0], Element) and children(k)[0].local == "code" else k
                body = inner.text_with_breaks().rstrip()
                if not body or any(isinstance(x, Comment) or isinstance(x, Element) and x.local != "br" for e in [inner, *inner.below()] for x in e.kids):
                    continue
                named = re.match(r"^language-(.*)$", inner.get("class") or "")
                language = [Element("ac:parameter", {"ac:name": "language"}, [named[1]])] if named and named[1] else []
                el.kids[i] = Element("ac:structured-macro", {"ac:name": "code"}, [*language, Element("ac:plain-text-body", kids=[CData(body)])])


def drop_code_params(root: Element) -> None:
    for el in root.below():
        if el.tag == "ac:structured-macro" and el.get("ac:name") == "code":
            el.kids = without(el.kids, lambda k: k.local == "parameter" and k.get("ac:name") in CODE_PARAMS)


def trim_code(root: Element) -> None:
    for el in root.below():
        if el.tag == "ac:plain-text-body" and el.lead():
            first = el.lead().rstrip("\n")
            el.kids = joined([CData(first), *el.kids[count_lead(el.kids) :]])


def count_lead(kids: list) -> int:
    return next((i for i, k in enumerate(kids) if not is_text(k)), len(kids))


def plain_pipes(root: Element) -> None:
    for el in every(root, "code"):
        n = count_lead(el.kids)
        el.kids = joined([el.lead().replace("\\|", "|"), *el.kids[n:]])


def split_headings(root: Element) -> None:
    for el in [root, *every(root)]:
        out: list = []
        for k in el.kids:
            out.append(k)
            if isinstance(k, Element) and k.local in HEADINGS:
                at = next((i for i, x in enumerate(k.kids) if isinstance(x, Element) and x.local == "br"), None)
                if at is not None:
                    out.append(Element("p", kids=k.kids[at + 1 :]))
                    k.kids = k.kids[:at]
        el.kids = out


def promote_header(root: Element) -> None:
    for table in every(root, "table"):
        parts = table.elements()
        body = next((k for k in parts if k.local == "tbody"), None)
        if body is None or any(k.local == "thead" for k in parts):
            continue
        first = next((k for k in body.elements() if k.local == "tr"), None)
        if first is None:
            continue
        for cell in first.elements():
            if cell.local == "td":
                cell.tag = "th"
        at = body.kids.index(first)
        n = count_lead(body.kids[at + 1 :])
        head = Element("thead", kids=body.kids[at : at + 1 + n])
        body.kids = joined(body.kids[:at] + body.kids[at + 1 + n :])
        table.kids.insert(table.kids.index(body), head)


def unwrap_divs(root: Element) -> None:
    for cell in every(root, "td", "th"):
        while any(k.local == "div" for k in cell.elements()):
            cell.kids = joined([x for k in cell.kids for x in (k.kids if isinstance(k, Element) and k.local == "div" else [k])])


def flatten_cells(root: Element) -> None:
    """Paragraphs of a cell as lines."""
    for cell in every(root, "td", "th"):
        if not any(k.local == "p" for k in cell.elements()):
            continue
        out: list = [cell.lead()] if not blank(cell.lead()) else []
        seen = False
        for i, k in enumerate(cell.kids):
            if not isinstance(k, Element):
                continue
            after = tail(cell.kids, i)
            if k.local == "p":
                out += ([Element("br")] if seen else []) + k.kids + ([] if blank(after) else [Element("br"), after])
                seen = True
            else:
                out += [k, after]
        cell.kids = joined(out)


def flatten_items(root: Element) -> None:
    """A paragraph that a list item begins with, if only blocks follow, is the item's own text."""

    def opened(li: Element, alone: bool) -> None:
        kids = children(li)
        first = kids[0] if kids else None
        if not isinstance(first, Element) or first.local != "p" or not blank(li.lead()):
            return
        if alone and len(kids) != 1 or not blank(tail(li.kids, li.kids.index(first))):
            return
        if not alone and not all(isinstance(k, Element) and k.tag in BLOCKS for k in kids[1:]):
            return
        at = li.kids.index(first)
        rest = li.kids[at + 1 :]
        li.kids = joined(first.kids + rest[count_lead(rest) :])

    for alone in (True, False):
        for li in every(root, "li"):
            opened(li, alone)


def strip_trailing_breaks(root: Element) -> None:
    for el in root.below():
        if el.local in TRIMMED:
            while kids := children(el):
                last = kids[-1]
                at = max(i for i, k in enumerate(el.kids) if k is last)
                if not isinstance(last, Element) or last.local != "br" or not blank(tail(el.kids, at)):
                    break
                el.kids = el.kids[:at]


def trim_ends(root: Element) -> None:
    for el in root.below():
        if el.local in TRIMMED and el.kids:
            if is_text(el.kids[0]):
                el.kids[0] = el.kids[0].lstrip()
            if is_text(el.kids[-1]):
                el.kids[-1] = el.kids[-1].rstrip()
            el.kids = joined(el.kids)


def only_breaks(el: Element) -> bool:
    return all(blank(k) if is_text(k) else isinstance(k, Element) and k.local == "br" for k in el.kids)


def drop_empty_paragraphs(root: Element) -> None:
    for el in [root, *every(root)]:
        el.kids = without(el.kids, lambda k: k.local == "p" and only_breaks(k))


def drop_empty_pre(root: Element) -> None:
    for el in [root, *every(root)]:
        el.kids = without(el.kids, lambda k: k.local == "pre" and blank(k.all_text()))


def trim_rows(root: Element) -> None:
    for row in every(root, "tr"):
        cells = [k for k in row.elements() if k.local in ("td", "th")]
        gone = set()
        while cells and only_breaks(cells[-1]):
            gone.add(id(cells.pop()))
        row.kids = without(row.kids, lambda k, gone=gone: id(k) in gone)


def drop_lone_breaks(root: Element) -> None:
    for el in [root, *every(root)]:
        kids = children(el)
        if len(kids) == 1 and isinstance(kids[0], Element) and kids[0].local == "br" and only_breaks(el):
            el.kids = [k for k in el.kids[: el.kids.index(kids[0])]]


def strip_block_space(root: Element) -> None:
    """No white space between blocks, nor at the end of text before one."""
    for el in [root, *every(root)]:
        kids = children(el)
        if el.tag not in CONTAINERS:
            if not kids and blank(el.lead()):
                el.kids = []
            continue
        out: list = []
        for i, k in enumerate(el.kids):
            if is_text(k):
                following = next((x for x in el.kids[i + 1 :] if not is_text(x)), None)
                is_block = isinstance(following, Element) and following.tag in BLOCKS
                leading = not any(not is_text(x) for x in el.kids[:i])
                if is_block or following is None and (not leading or blank(k)):
                    k = "" if blank(k) else k.rstrip()
            out.append(k)
        el.kids = joined(out)


RULES = [
    scrub_attributes, drop_columns, unwrap_spans, collapse_space, pre_to_macro, drop_code_params, trim_code, plain_pipes,
    split_headings, promote_header, unwrap_divs, flatten_cells, flatten_items, strip_trailing_breaks, trim_ends,
    drop_empty_paragraphs, drop_empty_pre, trim_rows, drop_lone_breaks, strip_block_space,
]


#: What a rule is about: it does nothing on a page that lacks any of these, where a set stands for one of its tags. `drop_columns`
#: also joins the texts that the reader left apart, so it is never spared.
ABOUT = {
    unwrap_spans: [{"span"}], pre_to_macro: [{"pre"}], drop_code_params: [{"structured-macro"}, {"parameter"}], trim_code: [{"plain-text-body"}],
    plain_pipes: [{"code"}], split_headings: [set(HEADINGS), {"br"}], promote_header: [{"table"}, {"tbody"}], unwrap_divs: [{"td", "th"}, {"div"}],
    flatten_cells: [{"td", "th"}, {"p"}], flatten_items: [{"li"}, {"p"}], strip_trailing_breaks: [{"br"}], drop_empty_paragraphs: [{"p"}],
    drop_empty_pre: [{"pre"}], trim_rows: [{"tr"}], drop_lone_breaks: [{"br"}],
}
#: Tags that rules make of others.
MADE = {"pre": {"structured-macro", "parameter", "plain-text-body"}, "br": {"p"}, "p": {"br"}, "td": {"th"}, "tbody": {"thead"}}


def rules_for(root: Element) -> list:
    """The rules that can change the page, in order."""
    there = {e.local for e in root.below()}
    for tag, made in MADE.items():
        if tag in there:
            there = there | made
    return [r for r in RULES if all(tags & there for tags in ABOUT.get(r, ()))]


def _attr(value: str) -> str:
    value = value.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    return value.replace("\t", "&#x9;").replace("\n", "&#xA;").replace("\r", "&#xD;")


def c14n(el: Element) -> str:
    """Attributes sorted, plain ones first; no empty-element tags, CDATA or comments."""
    attrs = sorted(el.attrs.items(), key=lambda a: a[0].rpartition(":")[::2])
    inside = "".join([c14n(k) if isinstance(k, Element) else "" if isinstance(k, Comment) else escape_text(k).replace("&#13;", "&#xD;") for k in el.kids])
    return f"<{el.tag}{''.join([f' {a}={chr(34)}{_attr(v)}{chr(34)}' for a, v in attrs])}>{inside}</{el.tag}>"


def canonical_storage(source: str) -> str:
    root = parse_fragment(source)
    root.kids = joined(root.kids)
    for rule in rules_for(root):
        rule(root)
    return "".join([c14n(k) for k in root.elements()])


def traced_storage(source: str) -> tuple[str, list[tuple[str, int]]]:
    """The canonical form, and which rules changed the page: each with the number of characters that it took away (below
    0 if it added some). Writes the tree after every rule, so it costs more than the form alone."""
    root = parse_fragment(source)
    root.kids = joined(root.kids)
    shown, out = c14n(root), []
    for rule in RULES:
        rule(root)
        now = c14n(root)
        if now != shown:
            out.append((rule.__name__, len(shown) - len(now)))
        shown = now
    return "".join([c14n(k) for k in root.elements()]), out
