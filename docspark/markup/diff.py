"""Edit scripts between two pages in canonical form: which parts stay, move, change, come and go."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict, deque
from collections.abc import Sequence

from .canonical import c14n
from .tree import MarkupError
from .xml import Comment, Element, escape_text, parse_fragment


def parsed(xhtml: str) -> list:
    """The top-level parts of a page."""
    return parse_fragment(xhtml, named=False).kids


def shown(part) -> str:
    """The part as the canonical form writes it."""
    if isinstance(part, Element):
        return c14n(part)
    return f"<!--{part}-->" if isinstance(part, Comment) else escape_text(part).replace("&#13;", "&#xD;")


class Digests:
    """Hashes of subtrees, bottom-up, each worked out once; equal hashes mean equal markup."""

    def __init__(self):
        self.known: dict[int, bytes] = {}

    def of(self, part) -> bytes:
        if not isinstance(part, Element):
            return hashlib.sha256((type(part).__name__ + "\0" + part).encode("utf-8", "surrogatepass")).digest()
        stack = [(part, False)]
        while stack:
            el, ready = stack.pop()
            if id(el) in self.known:
                continue
            if not ready:
                stack.append((el, True))
                stack.extend((k, False) for k in el.elements())
                continue
            made = hashlib.sha256(json.dumps([el.tag, list(el.attrs.items())]).encode())
            for k in el.kids:
                made.update(self.known[id(k)] if isinstance(k, Element) else self.of(k))
            self.known[id(el)] = made.digest()
        return self.known[id(part)]


def _middle(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """A run of equal items in the middle of a shortest script, found from both ends at once in linear memory."""
    n, m = a1 - a0, b1 - b0
    delta, odd = n - m, (n - m) % 2 == 1
    size = n + m + 2
    front, back = [0] * (2 * size + 1), [0] * (2 * size + 1)
    for d in range((n + m + 1) // 2 + 1):
        for k in range(2 * max(0, d - m) - d, d - 2 * max(0, d - n) + 1, 2):
            x = front[size + k + 1] if k == -d or (k != d and front[size + k - 1] < front[size + k + 1]) else front[size + k - 1] + 1
            y = x - k
            began = x
            while x < n and y < m and a[a0 + x] == b[b0 + y]:
                x, y = x + 1, y + 1
            front[size + k] = x
            if odd and abs(delta - k) <= d - 1 and x + back[size + delta - k] >= n:
                return a0 + began, b0 + began - k, a0 + x, b0 + y
        for k in range(2 * max(0, d - m) - d, d - 2 * max(0, d - n) + 1, 2):
            x = back[size + k + 1] if k == -d or (k != d and back[size + k - 1] < back[size + k + 1]) else back[size + k - 1] + 1
            y = x - k
            began = x
            while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                x, y = x + 1, y + 1
            back[size + k] = x
            if not odd and abs(delta - k) <= d and x + front[size + delta - k] >= n:
                return a1 - x, b1 - y, a1 - began, b1 - (began - k)
    raise AssertionError("two finite runs meet")


def longest_common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, ascending.

    Items that the other side lacks are taken out first; then Myers' method, divided in the middle.
    """
    in_a, in_b = set(a), set(b)
    at_a, at_b = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    a, b = [a[i] for i in at_a], [b[j] for j in at_b]
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            x, y, u, v = _middle(a, b, a0, a1, b0, b1)
            out += zip(range(x, u), range(y, v), strict=True)
            todo += [(a0, x, b0, y), (u, a1, v, b1)]
    return sorted((at_a[i], at_b[j]) for i, j in out)


def aligned(old: Sequence, new: Sequence) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Which old place each kept and each moved new item has: (old, new) pairs; all others come or go.

    Kept items are a longest common subsequence; of the rest, equal items are moves, in order.
    """
    kept = longest_common(old, new)
    used_old, used_new = {i for i, _ in kept}, {j for _, j in kept}
    left = defaultdict(deque)
    for i, x in enumerate(old):
        if i not in used_old:
            left[x].append(i)
    moved = [(left[x].popleft(), j) for j, x in enumerate(new) if j not in used_new and left.get(x)]
    return kept, moved


def script(old: list, new: list, digests: Digests | None = None) -> list:
    """What makes the old parts the new ones, as a list in the order of the new parts.

    ["keep", i, n]: n old parts from i on; ["move", i]: an old part from elsewhere; ["insert", markup];
    ["change", i, attributes, script]: an old element of the same tag, with new attributes and its parts by a script of
    their own. Old parts that are not named go.
    """
    digests = digests or Digests()
    kept, moved = aligned([digests.of(p) for p in old], [digests.of(p) for p in new])
    from_old = {j: ("keep", i) for i, j in kept} | {j: ("move", i) for i, j in moved}
    gone = sorted(set(range(len(old))) - {i for i, _ in kept} - {i for i, _ in moved})
    # an element that goes and one of the same tag that comes between the same kept neighbours are one that changes
    edges = [(-1, -1), *kept, (len(old), len(new))]
    for (i0, j0), (i1, j1) in zip(edges, edges[1:], strict=False):
        free = defaultdict(deque)
        for i in range(i0 + 1, i1):
            if isinstance(old[i], Element) and i in gone:
                free[old[i].tag].append(i)
        for j in range(j0 + 1, j1):
            if j not in from_old and isinstance(new[j], Element) and free[new[j].tag]:
                from_old[j] = ("change", free[new[j].tag].popleft())
    out: list = []
    for j, part in enumerate(new):
        how, i = from_old.get(j, ("insert", -1))
        if how == "keep" and out and out[-1][0] == "keep" and out[-1][1] + out[-1][2] == i:
            out[-1][2] += 1
        elif how == "keep":
            out.append(["keep", i, 1])
        elif how == "move":
            out.append(["move", i])
        elif how == "change":
            out.append(["change", i, list(map(list, part.attrs.items())), script(old[i].kids, part.kids, digests)])
        else:
            out.append(["insert", shown(part)])
    return out


def applied(old: list, steps: list) -> list:
    """The parts that a script makes of the old ones."""
    out: list = []
    for step in steps:
        if step[0] == "keep":
            out += old[step[1] : step[1] + step[2]]
        elif step[0] == "move":
            out.append(old[step[1]])
        elif step[0] == "change":
            was = old[step[1]]
            out.append(Element(was.tag, dict(step[2]), applied(was.kids, step[3])))
        else:
            out += parsed(step[1])
    return out


def counts(old: int, steps: list) -> dict[str, int]:
    """Of a script for so many old parts: how many are kept, moved, changed, inserted and deleted."""
    n = Counter({"kept": 0, "moved": 0, "changed": 0, "inserted": 0})
    for s in steps:
        n[{"keep": "kept", "move": "moved", "change": "changed", "insert": "inserted"}[s[0]]] += s[2] if s[0] == "keep" else 1
    return dict(n) | {"deleted": old - n["kept"] - n["moved"] - n["changed"]}


def page_script(old: str, new: str) -> tuple[str, dict[str, int]]:
    """The script as JSON between two canonical pages, and its counts of top-level parts."""
    a = parsed(old)
    steps = script(a, parsed(new))
    return json.dumps(steps, ensure_ascii=False, separators=(",", ":")), counts(len(a), steps)


def patched(old: str, steps: str) -> str:
    """The page that a script makes."""
    try:
        return "".join(map(shown, applied(parsed(old), json.loads(steps))))
    except (ValueError, IndexError, KeyError, TypeError, AttributeError) as ex:
        raise MarkupError(f"the script does not fit the page: {ex}") from ex
