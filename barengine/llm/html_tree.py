"""A small HTML reader for the extraction tasks: one page in, a tree of elements out."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from html import unescape

_TAG = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")

# Names of HTML elements by their role in the standard.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p
pre search section select summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body html caption legend optgroup option td th tr tbody thead tfoot".split())
#: start tag -> open elements that it ends, up to the nearest of the second set
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
        "optgroup": ({"option", "optgroup"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
        "body": ({"head"}, {"html"})}
SCOPE = frozenset("table td th caption html button body article section div".split())


class Element:
    __slots__ = ("tag", "attrs", "items", "parent", "digest", "drop")

    def __init__(self, tag: str, attrs: str, parent: "Element | None"):
        self.tag, self.attrs, self.items, self.parent = tag, attrs, [], parent
        self.digest, self.drop = b"", False

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in _ATTR.finditer(self.attrs):
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return out


class _Open:
    """The open elements of a page, with the depths of each name, so that an end tag costs no walk."""

    def __init__(self, root: Element):
        self.path: list[Element] = [root]
        self.depths: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, e: Element) -> None:
        self.depths.setdefault(e.tag, []).append(len(self.path))
        if e.tag in SCOPE:
            self.scopes.append(len(self.path))
        self.path.append(e)

    def cut(self, depth: int) -> None:
        """Ends the open elements at ``depth`` and below it."""
        while len(self.path) > depth:
            e = self.path.pop()
            self.depths[e.tag].pop()
            if e.tag in SCOPE:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        """An end tag: the nearest open element of the name ends, an inline one only within its scope."""
        depths = self.depths.get(tag)
        if depths and (tag in BLOCK or not self.scopes or self.scopes[-1] <= depths[-1]):
            self.cut(depths[-1])

    def end_outermost(self, names, until) -> None:
        """Ends the outermost open element of ``names`` below the nearest of ``until``."""
        if until is SCOPE:
            floor = self.scopes[-1] if self.scopes else 0
        else:
            floor = max((self.depths[t][-1] for t in until if self.depths.get(t)), default=0)
        found = []
        for t in names:
            depths = self.depths.get(t)
            if depths and depths[-1] > floor:
                found.append(depths[bisect_right(depths, floor)])
        if found:
            self.cut(min(found))


def parse(html: str) -> Element:
    """The page's tree. Unclosed, misplaced and cut off tags are mended as browsers mostly do."""
    root = Element("#root", "", None)
    open_ = _Open(root)
    at, n = 0, len(html)
    while at < n:
        top = open_.path[-1]
        m = _TAG.search(html, at)
        if m is None:
            top.items.append(html[at:])
            break
        if m.start() > at:
            top.items.append(html[at:m.start()])
        at = m.end()
        if m["cdata"] is not None:
            top.items.append(m["cdata"].replace("&", "&amp;"))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            open_.end(tag)
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        if tag in CLOSES_P and open_.depths.get("p"):
            open_.end_outermost(("p",), SCOPE)
        if tag in ENDS:
            open_.end_outermost(*ENDS[tag])
        top = open_.path[-1]
        e = Element(tag, attrs, top)
        top.items.append(e)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            e.items.append(html[at:close.start() if close else n])
            at = close.end() if close else n
            continue
        open_.push(e)
    return root


def walk(root: Element) -> list[Element]:
    """All elements, parents first."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        todo.extend(x for x in reversed(e.items) if isinstance(x, Element))
    return out


def subtree_digest(e: Element) -> bytes:
    """Hash of a subtree: tag, class, id and role, texts with single spaces, and the children's digests."""
    todo = [e]
    while todo:
        x = todo[-1]
        missing = [c for c in x.items if c.__class__ is Element and not c.digest] if not x.digest else ()
        if missing:
            todo.extend(missing)
            continue
        todo.pop()
        if x.digest:
            continue
        h = hashlib.blake2b(x.tag.encode(), digest_size=8)
        if x.attrs:
            a = x.attributes()
            h.update("|".join(a.get(k, "") for k in ("class", "id", "role")).encode("utf-8", "surrogatepass"))
        for c in x.items:
            h.update(c.digest if c.__class__ is Element else " ".join(c.split()).encode("utf-8", "surrogatepass"))
            h.update(b"\0")
        x.digest = h.digest()
    return e.digest


def blocks(roots: list[Element]) -> list[str]:
    """Texts of the blocks under ``roots`` in page order, without dropped elements."""
    out: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            t = " ".join(unescape("".join(held)).replace("\0", " ").split())
            held.clear()
            if t:
                out.append(t)
    for r in roots:
        todo: list = [r]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif not x.drop:
                if x.tag in BLOCK:
                    flush()
                    todo.append(None)
                elif x.tag == "br":
                    held.append(" ")
                todo.extend(reversed(x.items))
        flush()
    return out
