"""HTML as a small tree: markup is tokenised, implied ends are set, scripts and comments left out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

RAW = ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "xmp")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg\b[^>]*+(?<=/)>"  # closed by its own slash
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements that start a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag ends these open elements, up to the nearest of its limits.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
_INLINE_LIMITS = ("td", "th", "table", "li", "div", "section", "article", "main", "body", "html")


@dataclass
class Node:
    """An element, or a text (tag ``#text``) with its content in ``text``."""

    tag: str
    names: str = ""
    children: list[Node] = field(default_factory=list)
    text: str = ""
    hidden: bool = False
    local: bool = False  # a link into the page itself

    @property
    def key(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def attributes(rest: str) -> tuple[str, bool, bool]:
    """Class, id and role as one string without digits; whether the element is hidden, or links into its own page."""
    if not rest.strip(" /\n\t"):
        return "", False, False
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(rest)}
    names = " ".join(found[a] for a in ("class", "id", "role") if found.get(a))
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
    return " ".join(re.sub(r"\d+", "", names).split()), hidden, found.get("href", "").startswith("#")


def parse(html: str) -> Node:
    """The tree of a page; unclosed, crossed and cut-off markup never fails. It may be as deep as the page is long."""
    root = Node("#root")
    stack = [root]

    def add_text(text: str) -> None:
        if text and not text.isspace():
            stack[-1].children.append(Node("#text", text=text))
        elif text and stack[-1].children and stack[-1].children[-1].tag == "#text":
            stack[-1].children[-1].text += " "
        elif text:
            stack[-1].children.append(Node("#text", text=" "))

    def close(tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                del stack[depth:]
                return
            if stack[depth].tag in limits:
                return

    at = 0
    for m in _TOKEN.finditer(html):
        add_text(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "p" or tag not in VOID:
                close((tag,), () if tag in BLOCKS else _INLINE_LIMITS)
            continue
        if tag in BLOCKS:
            close(("p",), ("button", "td", "th", "table", "li", "div", "section", "article", "main"))
        if tag in _ENDS:
            close(*_ENDS[tag])
        names, hidden, local = attributes(m["rest"] or "")
        node = Node(tag, names, hidden=hidden, local=local)
        stack[-1].children.append(node)
        if tag not in VOID and not (m["rest"] or "").rstrip().endswith("/"):
            stack.append(node)
    add_text(html[at:])
    return root
