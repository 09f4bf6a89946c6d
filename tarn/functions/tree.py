"""Element trees to markup text. Trees are JSON; strings in and out, so they run in Arrow batches.

An element is {"tag", "attributes": {name: text or null}, "children": [...]}, a text {"text": text}. {"unresolved": true} in place of an
attribute's value or a text stands for what couldn't be recovered: it is left out, and a comment says so where it was.
"""

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

# Attributes that bind events, and those that keep a block from being folded.
EVENT = re.compile(r"(?:(?:capture-)?(?:bind|catch)|mut-bind)(?::?[A-Za-z][\w-]*)", re.I)
CONDITIONS, LOOPS = {"wx:if", "wx:else", "wx:elif"}, {"wx:for", "wx:if"}
INDENT = " " * 4


class Piece(NamedTuple):
    before: str
    body: str
    after: str
    text: bool = False


def _unresolved(value: object) -> bool:
    return isinstance(value, dict) and value.get("unresolved") is True


def folded(node: dict) -> list[dict]:
    """The node without blocks that add nothing: a block of one element gives it its attributes, a block without any its children."""
    if "tag" not in node:
        return [node]
    attributes, children = node.get("attributes") or {}, node.get("children") or []
    if node["tag"] == "block":
        only = children[0] if len(children) == 1 else None
        if only and "tag" in only:
            inner = only.get("attributes") or {}
            # a loop and a condition on one tag would mean a condition inside the loop
            if not attributes.keys() & inner.keys() and not (LOOPS & inner.keys() and CONDITIONS & attributes.keys()):
                return folded({**only, "attributes": {**inner, **attributes}})
        elif not attributes:
            return [x for child in children for x in folded(child)]
    return [{**node, "attributes": attributes, "children": [x for child in children for x in folded(child)]}]


def _pieces(node: dict, depth: int, marker: str, lost: dict) -> Iterator[Piece]:
    if "tag" not in node:
        value = node.get("text")
        if value is None or _unresolved(value):
            lost["text"] += 1
            yield Piece("", marker.format("text"), "")
        else:
            yield Piece("", str(value), "", True)
        return
    pad, names = INDENT * depth, [k for k, v in node["attributes"].items() if _unresolved(v)]
    for name in names:
        lost["attributes"][name] = lost["attributes"].get(name, 0) + 1
    if names:
        yield Piece(pad, marker.format("attributes"), "\n")
    shown = "".join(f" {k}" if v is None else ' {}="{}"'.format(k, str(v).replace('"', '\\"')) for k, v in node["attributes"].items() if k not in names)
    head, end = f"<{node['tag']}{shown}>", f"</{node['tag']}>"
    if not node["children"]:
        yield Piece(pad, head + end, "\n")
        return
    yield Piece(pad, head, "\n")
    for child in node["children"]:
        yield from _pieces(child, depth + 1, marker, lost)
    yield Piece(pad, end, "\n")


def markup(source: str, marker: str) -> dict | None:
    """The text of a list of trees, and how much of it is missing; null if it isn't such a list. marker is a comment with {} for its kind.

    White space that only lays the text out is left away next to text nodes, where it would show.
    """
    try:
        roots = json.loads(source)
    except ValueError:
        return None
    if not isinstance(roots, list) or not all(isinstance(r, dict) for r in roots):
        return None
    lost: dict = {"text": 0, "attributes": {}}
    pieces = [p for root in roots for node in folded(root) for p in _pieces(node, 0, marker, lost)]
    out = []
    for last, piece, following in zip([None, *pieces], pieces, [*pieces[1:], None], strict=False):
        before = "" if last and last.text else piece.before
        after = "" if following and following.text else piece.after
        out.append(piece.body if piece.text else before + piece.body + after)
    events = sum(n for name, n in lost["attributes"].items() if EVENT.fullmatch(name))
    return {"text": "".join(out), "lost_texts": lost["text"], "lost_attributes": sum(lost["attributes"].values()), "lost_events": events}
