"""String steps of the converters as built-in expressions, which stay in the JVM and in generated code.

Patterns are possessive where a plain repetition could overflow the JVM's stack on long texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..markup.assets import PACKED, media_types
from ..markup.fragments import FENCE_INFO, LINK_SCHEME
from ..markup.jira import PROMOTIONS
from ..markup.options import Options

MARKER = Options().marker
CDATA = r"(?s)<!\[CDATA\[.*?\]\]>"

def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _java(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", s)


def all_of(source: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(source), F.lit(pattern), F.lit(group))


# --- sources ------------------------------------------------------------------------------------------------


def input_format(source: Column | str) -> Column:
    """`xhtml` or `markdown`, by how the text begins."""
    start = F.regexp_replace(_c(source), r"^\s+", "")
    return F.when(start.rlike(r"^<(\?xml|!DOCTYPE|ac:|ri:)") | start.rlike(r"^<[^>]*\bxmlns"), "xhtml").otherwise("markdown")


def attachment_files(xhtml: Column | str) -> Column:
    """Names of attached files in the order of the source, each once; CDATA left out."""
    return F.array_distinct(all_of(F.regexp_replace(_c(xhtml), CDATA, ""), 'ri:filename="([^"]*)"', 1))


def is_refused(xhtml: Column | str) -> Column:
    """Whether the text holds a DOCTYPE or ENTITY declaration, which no parser here accepts."""
    return _c(xhtml).rlike(r"(?i)<!(DOCTYPE|ENTITY)\b")


def strip_comments(source: Column | str, prefixes: tuple[str, ...], marker: str = MARKER) -> Column:
    """The text without comments that begin with a prefix, with blanks and one line break after each."""
    kept = Options(keep_comments=tuple(prefixes), marker=marker).keep_comments
    own = [_java(p) for p in kept if p and not p.startswith(f"{marker}:")]
    return F.regexp_replace(_c(source), rf"(?s)<!--\s*(?:{'|'.join(own)}).*?-->[ \t]*\n?", "") if own else _c(source)


# --- Markdown -----------------------------------------------------------------------------------------------


def escape_markdown(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"([\\`*_\[\]|])", r"\\$1")


def directive_params(head: Column | str) -> Column:
    """`key="value"` pairs in order, as an array of (k, v)."""
    pattern = r'([a-zA-Z][a-zA-Z0-9_-]*)\s*=\s*"((?:[^"\\]++|\\.)*+)"'
    pairs = F.arrays_zip(all_of(head, pattern, 1).alias("k"), all_of(head, pattern, 2).alias("v"))
    return F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.replace(F.replace(p["v"], F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")).alias("v")))


def is_local_file(src: Column | str) -> Column:
    """Whether an image's address has no scheme, and so names an attached file."""
    return ~_c(src).rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")


def image_size(url: Column | str, marker: str = MARKER) -> Column:
    """(src, width, height) of an address that carries the size in its fragment."""
    pattern = rf"{_java(marker)}:([wh]=\d+(?:,[wh]=\d+)*)"
    dims = F.regexp_extract(_c(url), pattern, 1)

    def number(key: str) -> Column:
        found = all_of(dims, rf"{key}=(\d+)", 1)
        return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int"))

    src = F.when(dims == "", _c(url)).otherwise(F.regexp_replace(F.regexp_replace(_c(url), rf"[#&]?{pattern}", ""), "[#&]+$", ""))
    return F.struct(src.alias("src"), number("w").alias("width"), number("h").alias("height"))


# --- fragments ----------------------------------------------------------------------------------------------


def fragment_id(xml: Column | str) -> Column:
    return F.concat(F.lit("op-"), F.substring(F.sha2(F.encode(_c(xml), "UTF-8"), 256), 1, 8))


def write_fragment(xml: Column | str, marker: str = MARKER) -> Column:
    body = F.regexp_replace(_c(xml), r"\n+\z", "")
    return F.concat(F.lit(f'<!-- {marker}:opaque id="'), fragment_id(xml), F.lit(f'" -->\n```{FENCE_INFO}\n'), body, F.lit(f"\n```\n<!-- /{marker}:opaque -->"))


def authentic_blocks(markdown: Column | str, marker: str = MARKER) -> Column:
    """Marked blocks whose id is the hash of their body, as an array of (id, xml)."""
    m = _java(marker)
    pattern = rf'(?s)<!--\s*{m}:opaque\s+id="([a-zA-Z0-9_-]+)"\s*-->\s*\n```{FENCE_INFO}\s*\n(.*?)\n```\s*\n<!--\s*/{m}:opaque\s*-->'
    return _authentic(_c(markdown), pattern)


def without_blocks(markdown: Column | str, marker: str = MARKER) -> Column:
    """The text with its authentic blocks taken out, each between two empty lines; forged ones stay."""
    shown = F.transform(authentic_blocks(markdown, marker), lambda b: F.concat(F.lit(f'<!-- {marker}:opaque id="'), b["id"], F.lit(f'" -->\n```{FENCE_INFO}\n'), b["xml"], F.lit(f"\n```\n<!-- /{marker}:opaque -->")))
    return F.aggregate(shown, _c(markdown), lambda text, block: F.replace(text, block, F.lit("\n\n\n\n")))


def _authentic(source: Column, pattern: str) -> Column:
    pairs = F.arrays_zip(all_of(source, pattern, 1).alias("id"), all_of(source, pattern, 2).alias("xml"))
    return F.filter(pairs, lambda p: p["id"] == fragment_id(p["xml"]))


def payload_entries(markdown: Column | str, marker: str = MARKER) -> Column:
    """Authentic entries of the first payload section, as an array of (id, xml)."""
    m = _java(marker)
    section = F.regexp_extract(_c(markdown), rf"(?s)<!-- {m}:payloads -->(.*?)<!-- /{m}:payloads -->", 1)
    return _authentic(section, r"(?s)<!--\s*(op-[a-f0-9]+)\s*\n(.*?)\n-->")


def write_payloads(entries: Column | str, marker: str = MARKER) -> Column:
    """The payload section of an array of (id, xml); empty for none."""
    lines = F.transform(_c(entries), lambda e: F.concat(F.lit("<!-- "), e["id"], F.lit("\n"), e["xml"], F.lit("\n-->")))
    whole = F.concat(F.lit(f"<!-- {marker}:payloads -->\n"), F.array_join(lines, "\n"), F.lit(f"\n<!-- /{marker}:payloads -->"))
    return F.when(F.size(_c(entries)) > 0, whole).otherwise("")


def strip_payloads(markdown: Column | str, marker: str = MARKER) -> Column:
    m = _java(marker)
    return F.regexp_replace(_c(markdown), rf"(?s)<!-- {m}:payloads -->.*?<!-- /{m}:payloads -->", "")


def strip_notice(markdown: Column | str, marker: str = MARKER) -> Column:
    """The text without a leading notice, and without leading line breaks."""
    return F.regexp_replace(F.regexp_replace(_c(markdown), rf"(?s)\A<!--\s*{_java(marker)}:notice\b.*?-->\n?", ""), r"\A\n+", "")


def write_fragment_link(label: Column | str, xml: Column | str) -> Column:
    return F.concat(F.lit("["), _c(label), F.lit(f"]({LINK_SCHEME}"), fragment_id(xml), F.lit(")"))


def inline_fragments(markdown: Column | str) -> Column:
    """References to payloads, as an array of (label, id)."""
    pattern = rf"\[([^\]]*)\]\({LINK_SCHEME}(op-[a-f0-9]+)\)"
    return F.arrays_zip(all_of(markdown, pattern, 1).alias("label"), all_of(markdown, pattern, 2).alias("id"))


# --- assets -------------------------------------------------------------------------------------------------


def asset_pattern(marker: str = MARKER) -> str:
    return rf'<!--\s*{_java(marker)}:asset\s+src="([^"]*)"\s*-->'


def asset_markers(markdown: Column | str, marker: str = MARKER) -> Column:
    """Original file names of all asset markers, in order."""
    return all_of(markdown, asset_pattern(marker), 1)


def write_asset_marker(src: Column | str, marker: str = MARKER) -> Column:
    return F.concat(F.lit(f'<!-- {marker}:asset src="'), F.replace(_c(src), F.lit('"'), F.lit("%22")), F.lit('" -->'))


def filename_problem(name: Column | str) -> Column:
    """Why a file name must not be written to; null if it may."""
    n = _c(name)
    return (
        F.when(n.isNull() | (n == ""), "empty filename")
        .when(n.contains("\x00"), "NUL byte")
        .when(n.contains("\\"), "backslash")
        .when(n.contains(":"), "colon")
        .when(n.startswith("/"), "absolute path")
        .when(n.rlike(r"(^|/)\.\.(/|$)"), "parent directory segment")
    )


def data_uri(name: Column | str, data: Column | str) -> Column:
    """The bytes as a data URI; Spark breaks base64 into lines, which are joined again."""
    base = F.element_at(F.split(_c(name), "/"), -1)
    for packed in PACKED:
        base = F.regexp_replace(base, rf"\.{packed}\z", "")
    extension = F.lower(F.regexp_extract(base, r"\.([^.]*)\z", 1))
    media = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in media_types().items() for x in pair]), extension), F.lit("application/octet-stream"))
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(_c(data)), r"[\r\n]", ""))


# --- Jira wiki ----------------------------------------------------------------------------------------------


def escape_jira(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"([*_{\[\]|~+^])", r"\\$1")


def unescape_jira(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?s)\\(.)", "$1")


def heading_level(level: Column | str, promotion: str = "confluence") -> Column:
    """The level that a heading gets in wiki text."""
    table = PROMOTIONS[promotion]
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), _c(level).cast("int"))


def macro_params(source: Column | str) -> Column:
    """`a=b|c` as an array of (k, v); a bare word has the key `value`."""
    s = _c(source)
    pairs = F.filter(F.transform(F.split(s, r"\|"), lambda p: F.trim(p)), lambda p: p != "")

    def pair(p: Column) -> Column:
        keyed = F.instr(p, "=") > 0
        return F.struct(
            F.when(keyed, F.trim(F.substring_index(p, "=", 1))).otherwise("value").alias("k"),
            F.when(keyed, F.trim(F.regexp_replace(p, r"(?s)\A[^=]*=", ""))).otherwise(p).alias("v"),
        )

    return F.transform(pairs, pair)
