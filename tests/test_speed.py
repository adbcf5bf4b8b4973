"""Readers and the canonical form do no more than a page needs, with the same results."""

import random
import time

from docspark.markup import canonical, convert
from docspark.markup.jira import JiraReader
from docspark.markup.xml import parse_fragment

TAGS = ["p", "h2", "br", "ul", "li", "table", "tbody", "tr", "td", "th", "div", "span", "pre", "code", "col", "strong", "ac:structured-macro", "ac:plain-text-body", "ac:parameter"]
WORDS = ["x", " ", "  ", "\n", " ", "a\\|b", "<!-- c -->", "<![CDATA[d ]]>", "&amp;", "word word"]


def some_page(rng, depth):
    out = []
    for _ in range(rng.randint(0, 5)):
        tag = rng.choice(TAGS)
        name = rng.choice(["", ' ac:name="code"', ' ac:name="title"', ' style="color: red"'])
        out.append(f"<{tag}{name}>{some_page(rng, depth - 1)}</{tag}>" if depth and rng.random() < 0.6 else rng.choice(WORDS))
    return "".join(out)


def test_spared_rules_would_have_changed_nothing():
    rng, spared = random.Random(3), 0
    for _ in range(3000):
        page = some_page(rng, rng.randint(1, 4))
        root = parse_fragment(page)
        spared += len(canonical.RULES) - len(canonical.rules_for(root))
        root.kids = canonical.joined(root.kids)
        for rule in canonical.RULES:
            rule(root)
        assert canonical.canonical_storage(page) == "".join(canonical.c14n(k) for k in root.elements())
    assert spared > 3000
    plain = canonical.rules_for(parse_fragment("<p>a</p>"))
    assert len(plain) < 10 and canonical.rules_for(parse_fragment("<pre>a</pre>"))[-1] is canonical.strip_block_space


def link_end(s):
    """Where a link that opens at 0 ends, and its first bar, one character after another."""
    depth, bar, j = 0, None, 0
    while j < len(s) and s[j] != "\n":
        if s[j] == "\\":
            j += 2
            continue
        depth += (s[j] == "[") - (s[j] == "]")
        if s[j] == "|" and depth == 1 and bar is None:
            bar = j
        if not depth:
            return j, bar
        j += 1
    return None


def test_wiki_links_end_where_they_did_and_are_read_by_leaps():
    rng = random.Random(4)
    for _ in range(5000):
        s = "[" + "".join(rng.choice(["[", "]", "|", "\\", "\n", "ab", "c"]) for _ in range(rng.randint(0, 9)))
        got, want = JiraReader().link(s, 0), link_end(s)
        assert (got is None) == (want is None) or s[1:2] == "^"
        if got and s[1:2] != "^":
            assert got[1] == want[0] + 1
    label = "[" + "x" * 2_000_000 + "|u]"
    start = time.process_time()
    link_end(label)
    plain = time.process_time() - start
    start = time.process_time()
    assert convert.from_jira(label)["markdown"].endswith("](u)\n")
    assert time.process_time() - start < plain
