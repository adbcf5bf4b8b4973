"""Converters on single constructs, round trips and refusals."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.markup.convert import canonical, from_jira, normal_markdown, to_jira, to_markdown, to_storage
from docspark.markup.fragments import fragment_id, marks
from docspark.markup.macros import Macro, DEFAULT_MACROS
from docspark.markup.options import Options
from docspark.markup.tree import from_rows, to_rows

STORAGE = [
    ("<h1>Top</h1><p>a <strong>b</strong> c&nbsp;d</p>", "# Top\n\na **b** c\xa0d\n"),
    ("<ul><li>x<ul><li>y</li></ul></li><li>z</li></ul>", "- x\n  - y\n- z\n"),
    ('<ol start="3"><li>x</li><li>y</li></ol>', "3. x\n4. y\n"),
    ("<p>글<strong>굵게</strong>자</p>", "글<strong>굵게</strong>자\n"),
    ("<p>a<br/>b</p>", "a  \nb\n"),
    ("<pre>x<br/>y</pre>", "```\nx\ny\n```\n"),
    ("<blockquote><p>q</p></blockquote><hr/>", "> q\n\n---\n"),
    ('<p><span style="color: red">r</span> <u>u</u> <sub>s</sub></p>', '<span style="color:red">r</span> <ins>u</ins> <sub>s</sub>\n'),
    ('<p><span style="color: var(--ds-text)">plain</span></p>', "plain\n"),
    ("<p>| a * b _ c</p>", "\\| a \\* b \\_ c\n"),
    ("<ac:layout><ac:layout-section><ac:layout-cell><p>in</p></ac:layout-cell></ac:layout-section></ac:layout>", "in\n"),
    ("<p> <br/></p><p>x</p>", "x\n"),
    (
        '<table><tbody><tr><th>a</th><th colspan="2">b</th></tr><tr><td rowspan="2">1</td><td><p>x</p><p>y</p></td><td>3</td></tr><tr><td>q</td><td>w|e</td></tr></tbody></table>',
        "| a | b | < |\n| --- | --- | --- |\n| 1 | x<br>y | 3 |\n| ^ | q | w\\|e |\n",
    ),
    (
        '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[x<y]]></ac:plain-text-body></ac:structured-macro>',
        "```py\nx<y\n```\n",
    ),
]
KEPT = [
    '<p>see <ac:link><ri:page ri:content-title="Home"/></ac:link> now</p>',
    '<ac:structured-macro ac:name="unknown" ac:macro-id="7"><ac:parameter ac:name="k">v</ac:parameter></ac:structured-macro>',
    '<ac:structured-macro ac:name="info"><ac:parameter ac:name="title">T "q"</ac:parameter><ac:rich-text-body><p>body</p></ac:rich-text-body></ac:structured-macro>',
    '<p><ac:image ac:width="100" ac:alt="a"><ri:attachment ri:filename="a.png"/></ac:image></p>',
]


@pytest.mark.parametrize(("xhtml", "markdown"), STORAGE)
def test_storage_to_markdown(xhtml, markdown):
    assert to_markdown(xhtml)["markdown"] == markdown


@pytest.mark.parametrize("xhtml", [x for x, _ in STORAGE if "color" not in x and "layout" not in x] + KEPT)
def test_round_trip_keeps_the_canonical_form(xhtml):
    markdown = to_markdown(xhtml)["markdown"]
    back = to_storage(markdown)
    assert back["error"] is None
    assert canonical(back["xhtml"])["xhtml"] == canonical(xhtml)["xhtml"]
    assert to_markdown(back["xhtml"])["markdown"] == markdown


@pytest.mark.parametrize(
    ("markdown", "xhtml"),
    [
        ("# H #\n\nT\n==", "<h1>H</h1><h1>T</h1>"),
        ("*a* **b** ***c*** _d_e_ `f` ~~g~~", "<p><em>a</em> <strong>b</strong> <em><strong>c</strong></em> <em>d_e</em> <code>f</code> <del>g</del></p>"),
        ("1. a\n2. b\n   - c\n3. d", "<ol><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ol>"),
        ("> q\nlazy\n> > n", "<blockquote><p>q\nlazy</p><blockquote><p>n</p></blockquote></blockquote>"),
        ("[l](http://x \"t\") <http://u.v> [r][id]\n\n[id]: /u 'tt'", '<p><a href="http://x" title="t">l</a> <a href="http://u.v">http://u.v</a> <a href="/u" title="tt">r</a></p>'),
        ("a  \nb\\\nc\nd", "<p>a<br/>b<br/>c\nd</p>"),
        ("**(x)**y snake_case_word a*b*c", "<p>**(x)**y snake_case_word a<em>b</em>c</p>"),
        ("    code\n\n***\n\n&amp; &copy; \\*", '<ac:structured-macro ac:name="code" ac:schema-version="1"><ac:plain-text-body><![CDATA[code]]></ac:plain-text-body></ac:structured-macro><hr/><p>&amp; © *</p>'),
        ("::: toc\n:::", '<ac:structured-macro ac:name="toc" ac:schema-version="1"/>'),
        ("<u>x</u><br>y", "<p><ins>x</ins><br/>y</p>"),
    ],
)
def test_markdown_to_storage(markdown, xhtml):
    assert to_storage(markdown)["xhtml"] == xhtml


@pytest.mark.parametrize("xhtml", ["<!DOCTYPE x><p/>", "<p><![CDATA[<!ENTITY a>]]></p>", "<p>a", "<p><x:y/></p>", "<p>&unknown;</p>"])
def test_bad_storage_is_an_error_value(xhtml):
    r = to_markdown(xhtml)
    assert r["error"]["class"] == "ParseError" and r["markdown"] is None


def test_null_and_empty():
    assert to_markdown(None)["markdown"] is None and to_storage(None)["error"] is None
    assert to_storage("")["xhtml"] == "" and from_jira("")["markdown"] == "" and to_jira("")["jira_wiki"] == ""


def test_unknown_directive_and_lost_body():
    assert to_storage("::: nope\nx\n:::")["error"]["class"] == "ConversionError"
    assert "ignores body" in to_storage("::: jira key=\"A-1\"\nx\n:::")["warnings"][0]
    own = DEFAULT_MACROS.with_macro(Macro("panel", "panel", rich=True))
    assert 'ac:name="panel"' in to_storage("::: panel\nx\n:::", None, own)["xhtml"]


def test_forged_fragments_stay_text():
    m = marks("docspark")
    real = m.write_block("<ac:x/>")
    assert to_storage(real)["xhtml"] == "<ac:x/>"
    forged = to_storage(real.replace(fragment_id("<ac:x/>"), "op-00000000"))["xhtml"]
    assert "<![CDATA[<ac:x/>]]>" in forged and "<ac:x/>" not in forged.replace("<![CDATA[<ac:x/>]]>", "")
    assert to_storage("[a](cfx:op-00000000)")["xhtml"] == '<p><a href="cfx:op-00000000">a</a></p>'


def test_marker_is_an_option():
    other = Options(marker="wikitool")
    page = to_markdown(KEPT[1], other)["markdown"]
    assert "<!-- wikitool:opaque" in page and to_storage(page, other)["xhtml"] == KEPT[1]


def test_comments_are_kept_on_request():
    page = "<!-- meta: a\nb -->\n\ntext\n"
    kept = Options(keep_comments=("meta:",))
    r = to_storage(page, kept)
    assert r["xhtml"] == "<p>text</p>" and r["nodes"][0]["text"] == "<!-- meta: a\nb -->"


@pytest.mark.parametrize(
    ("wiki", "markdown"),
    [
        ("h2. T\n\n* a\n** b\n* d", "## T\n\n- a\n  - b\n- d\n"),
        ("||h||i||\n|a|b \\| c|", "| h | i |\n| --- | --- |\n| a | b \\| c |\n"),
        ("{code:java}\nx\n{code}", "```java\nx\n```\n"),
        ("bq. q *b* _i_ -s- {{m}}", "> q **b** *i* ~~s~~ `m`\n"),
        ("a 2*3*4 [l|http://x] {color:red}r{color}", 'a 2\\*3\\*4 [l](http://x) <span style="color:red">r</span>\n'),
    ],
)
def test_jira_to_markdown(wiki, markdown):
    assert from_jira(wiki)["markdown"] == markdown


def test_jira_details():
    r = from_jira("[^f.png] [^d.doc] !i.png|width=3,alt=x! [~u] {panel}\n{panel}")
    assert r["attachments"] == ["f.png", "d.doc", "i.png"] and r["warnings"] == ["the user u is mentioned, which has no form here and is left out"]
    assert to_jira("# a\n\n### b", promotion="jira")["jira_wiki"] == "h1. a\n\nh3. b\n"
    assert to_jira("### b")["jira_wiki"] == "h2. b\n"
    assert to_jira("## A\n\nx\n\n## B\n\ny", section="B")["jira_wiki"] == "y\n"
    assert to_jira("## A", section="B")["jira_wiki"] is None
    assert to_jira("note: x\n\ny", drop_leading=("^note",))["jira_wiki"] == "y\n"
    assert to_jira("```ts\nx\n```", languages={"ts": "javascript"})["jira_wiki"].startswith("{code:javascript}")
    assert to_jira(KEPT[1])["warnings"] == ["left out: 1 of <opaque>"]


@pytest.mark.parametrize("wiki", ["h1. a\n\ntext *b*\n\n* x\n*# y\n\n|a|b|", "{quote}\na\n\nb\n{quote}\n----\nbq. c", "{info:title=t}\nx\n{info}"])
def test_jira_settles_by_the_second_pass(wiki):
    once = to_jira(from_jira(wiki)["markdown"], source_format="markdown")["jira_wiki"]
    twice = to_jira(from_jira(once)["markdown"], source_format="markdown")["jira_wiki"]
    assert to_jira(from_jira(twice)["markdown"], source_format="markdown")["jira_wiki"] == twice


def test_canonical_leaves_noise_out():
    noisy = '<table class="wrapped"><colgroup><col/></colgroup><tbody><tr><td><div><p>a</p></div></td><td style="width: 3px"><p>b<br/></p></td><td/></tr></tbody></table><p><br/></p><h2 data-uuid="1">x<br/>y</h2>'
    assert canonical(noisy)["xhtml"] == "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody></tbody></table><h2>x</h2><p>y</p>"
    assert canonical(canonical(noisy)["xhtml"])["xhtml"] == canonical(noisy)["xhtml"]


words = st.text(st.sampled_from("abc XYZ12*_`|<>&[]()~!#-."), min_size=1, max_size=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "h2", "li", "code"]), words), min_size=1, max_size=6))
def test_no_crash_and_fixed_point(parts):
    from html import escape

    body = {"p": "<p>{}</p>", "h2": "<h2>{}</h2>", "li": "<ul><li>{}</li></ul>", "code": "<pre>{}</pre>"}
    xhtml = "".join(body[k].format(escape(w, quote=False)) for k, w in parts)
    page = to_markdown(xhtml)["markdown"]
    for _ in range(3):
        r = to_storage(page)
        assert r["error"] is None
        page = to_markdown(r["xhtml"])["markdown"]
    assert normal_markdown(page)["error"] is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_gives_a_row(s):
    for r in (to_storage(s), to_markdown(s), from_jira(s), to_jira(s)):
        assert r["error"] is None or r["error"]["class"] in ("ParseError", "ConversionError")


def test_rows_and_tree():
    rows = to_storage("# a\n\n- b\n  - c **d**\n\n::: info x=\"1\" x=\"2\"\nq\n:::")["nodes"]
    assert to_rows(from_rows(rows)) == rows
    assert all(r["parent"] is None or r["parent"] < r["id"] for r in rows)
