"""A lenient XML reader: an element tree from whatever is there, and searches in it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from folioscope.functions.text import ENTITIES, unescape_python

_TAG = re.compile(r"<(/?)([A-Za-z_][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
# What stands between these is no element.
_SPANS = [("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<!", ">")]
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


class XmlError(ValueError):
    pass


@dataclass(slots=True)
class Node:
    """An element (``name``) with attributes and children, or text (``name`` empty). Once searched by name, what is below it stays as it is."""

    name: str = ""
    text: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    _named: dict[str, list[Node]] | None = field(default=None, init=False, repr=False, compare=False)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo += reversed(x.children)

    def search(self, name: str | None = None, attribute: str | None = None, value: str | None = None, where: Callable[[Node], bool] | None = None) -> list[Node]:
        """Elements below this one, in document order: by name, by an attribute's presence or value, by a test."""
        if self._named is None:
            self._named = {}
            todo = self.children[::-1]
            while todo:
                x = todo.pop()
                if x.children:
                    todo += x.children[::-1]
                if x.name:
                    self._named.setdefault(x.name, []).append(x)
        if name is None:
            found = [x for x in self.walk() if x.name and x is not self]
        else:
            found = self._named.get(name, [])
        if attribute is not None:
            found = [x for x in found if attribute in x.attributes and (value is None or x.attributes[attribute] == value)]
        return [x for x in found if where is None or where(x)]

    def contents(self) -> list[str]:
        if not self.name:
            return [x.text for x in self.walk() if not x.name]
        found, todo = [], self.children[::-1]
        while todo:
            x = todo.pop()
            if not x.name:
                found.append(x.text)
            if x.children:
                todo += x.children[::-1]
        return found

    def content(self) -> str:
        return "".join(self.contents())


def _tokens(text: str):
    """(start, end, character data or None, match of a tag or None) of what isn't text, in one pass: a mark whose end is nowhere ahead is passed over for good."""
    at, last = 0, {end: text.rfind(end) for _, end in _SPANS}
    while (a := text.find("<", at)) >= 0:
        for begin, end in _SPANS if text[a + 1 : a + 2] in ("!", "?") else ():
            if text.startswith(begin, a) and last[end] >= a + len(begin):
                at = text.find(end, a + len(begin)) + len(end)
                yield a, at, text[a + len(begin) : at - len(end)] if end == "]]>" else None, None
                break
        else:
            m = _TAG.match(text, a) if last[">"] > a else None
            at = m.end() if m else a + 1
            if m:
                yield a, at, None, m


def parse(text: str, strict: bool = True) -> Node:
    """Tree of a document. An end without a beginning is passed over if not ``strict``; an element that never ends, too."""
    root = Node("#document")
    open_, at = [root], 0
    for start, stop, cdata, m in _tokens(text):
        if start > at and (between := text[at:start]).strip():
            if strict and "<" in between:
                raise XmlError(f"stray < before place {start}")
            open_[-1].children.append(Node(text=unescape_python(between)))
        at = stop
        if cdata is not None:
            open_[-1].children.append(Node(text=cdata))
        if m is None:
            continue
        ends, name, rest, empty = m.groups()
        if not ends:
            node = Node(name, attributes={k: unescape_python(a or b) for k, a, b in _ATTRIBUTE.findall(rest)} if rest else {})
            open_[-1].children.append(node)
            if not empty:
                open_.append(node)
        elif open_[-1].name == name:
            open_.pop()
        elif strict:
            raise XmlError(f"{name} ends where {open_[-1].name} is open")
        elif any(x.name == name for x in open_[1:]):
            while open_.pop().name != name:
                pass
    if text[at:].strip():
        open_[-1].children.append(Node(text=unescape_python(text[at:])))
    if strict and (len(open_) > 1 or not any(x.name for x in root.children)):
        raise XmlError("the document breaks off")
    return root


def _escaped(text: str) -> str:
    for char, entity in ENTITIES:
        text = text.replace(char, entity)
    return text


def write(node: Node) -> str:
    """A tree as XML, with the five entities; however deep it is."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.name:
            out.append(_escaped(x.text))
        elif x.name == "#document":
            todo += reversed(x.children)
        else:
            attributes = "".join(f' {k}="{_escaped(v)}"' for k, v in x.attributes.items())
            held = any(y.name or y.text for y in x.children)
            out.append(f"<{x.name}{attributes}>" if held else f"<{x.name}{attributes}/>")
            if held:
                todo += [f"</{x.name}>", *reversed(x.children)]
    return "".join(out)
