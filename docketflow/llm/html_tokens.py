"""Pages as streams of block tags and text blocks: tags repaired, references decoded, scripts and comments left out."""

from __future__ import annotations

import html
import re

#: Elements that stand inside a line of text.
INLINE = frozenset(
    (
        "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "nobr", "q", "rp", "rt",
        "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    )
)
#: Elements that say nothing of their content unless they have a name.
BARE = frozenset(("div", "section", "td"))
VOID = frozenset(("area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr"))
#: Elements whose content is no markup, or never shown.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "noembed", "xmp", "svg", "math", "object", "canvas", "select", "audio", "video"))
#: What an element that begins closes, up to the elements in the second place.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
_END_OF_TAG = re.compile(r"[.>!]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_labels: dict[str, tuple] = {}


def label(tag: str, attributes: str) -> str:
    """The name of an element in a wrapper: its tag with its classes, id and role; ``!`` if it is hidden.

    Numbers that may differ from page to page are left out: those at the end of an id, and
    those of three digits or more at the end of a class.
    """
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
    names = [re.sub(r"\d{3,}$", "", w) for key in ("class", "role") for w in found.get(key, "").split()]
    names += [re.sub(r"\d+$", "", w) for w in found.get("id", "").split()]
    kept = sorted({re.sub(r"[.>!#]", "", n).strip("-_") for n in names} - {""})
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    return ".".join([tag, *kept]) + ("!" if hidden else "")


def tag_of(name: str) -> str:
    return _END_OF_TAG.split(name, maxsplit=1)[0]


def label_words(name: str) -> tuple[str, list[list[str]]]:
    """The tag of a label and the lower-case words of each of its names."""
    names = name.rstrip("!").split(".")[1:]
    return tag_of(name), [[w.lower() for w in _WORD.findall(n)] for n in names]


def told_apart(out: list[tuple]) -> list[tuple]:
    """Adds what an element without a name begins with to its label, so that bare parts of a page differ."""
    for i, event in enumerate(out[:-1]):
        if len(event) == 1 and event[0] in BARE and out[i + 1]:
            out[i] = (f"{event[0]}>{tag_of(out[i + 1][0]) if len(out[i + 1]) == 1 else '#'}",)
    return out


def events(page: str, skipped) -> list[tuple]:
    """(label,) where a block element begins, () where it ends, (text, letters in links) for a block of text.

    Elements of an inline tag are part of the text about them; ``skipped(label)``
    says which of them are left out with their text.
    """
    out: list[tuple] = []
    stack: list[str] = []  # open block elements, and inline ones that are skipped
    texts: list[str] = []
    linked: list[str] = []
    link = -1  # elements open where the link began
    dropped = 0  # skipped inline elements that are open

    def flush():
        text = " ".join("".join(texts).split())
        if text:
            out.append((text, len(" ".join("".join(linked).split()))))
        texts.clear()
        linked.clear()

    def close(to: int):
        nonlocal link, dropped
        while len(stack) > to:
            if stack.pop() in INLINE:
                dropped -= 1
            else:
                flush()
                out.append(())
        if link > len(stack):
            link = -1

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not dropped:
            text = html.unescape(text) if "&" in text else text
            texts.append(text)
            if link >= 0:
                linked.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                link = -1
            if tag in stack:
                close(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else n
            at = page.find(">", at) + 1 or n if end else n
            continue
        if tag in INLINE:
            if tag == "a":
                link = len(stack)
            key = m[0]
            if key not in _labels:
                if len(_labels) > 50_000:
                    _labels.clear()
                _labels[key] = label(tag, m[3] or m[6] or "")
            if skipped(_labels[key]) or (dropped and stack[-1] == tag):
                stack.append(tag)
                dropped += 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            texts.append(" ")
            linked.append(" ")
            continue
        if "p" in stack and stack[-1] != "button":
            close(len(stack) - 1 - stack[::-1].index("p"))
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in bounds:
                    break
                if stack[i] in ends:
                    close(i)
                    break
        key = m[0]
        if key not in _labels:
            if len(_labels) > 50_000:
                _labels.clear()
            _labels[key] = label(tag, m[3] or m[6] or "")
        flush()
        stack.append(tag)
        out.append((_labels[key],))
    close(0)
    flush()
    return told_apart(out)
