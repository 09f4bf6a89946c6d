import json

from tarn.functions import tree

MARKER = "<!-- own: {} -->"
LOST = {"unresolved": True}


def el(tag, *children, **attributes):
    return {"tag": tag, "attributes": {k.replace("_", ":"): v for k, v in attributes.items()}, "children": list(children)}


def shown(*roots):
    return tree.markup(json.dumps(roots), MARKER)


def test_layout():
    assert shown(el("view", el("a"), el("b", {"text": " x "}, el("i")), k='say "y"', hidden=None))["text"] == '<view k="say \\"y\\"" hidden>\n    <a></a>\n    <b> x <i></i>\n    </b>\n</view>\n'
    assert shown({"text": "a"}, {"text": "b"}, el("i"), {"text": "c"})["text"] == "ab<i></i>c"
    assert shown()["text"] == "" and tree.markup("{", MARKER) is None and tree.markup("{}", MARKER) is None


def test_blocks():
    assert shown(el("block", el("a", k="1"), wx_if="c"))["text"] == '<a k="1" wx:if="c"></a>\n'
    assert shown(el("block", el("a", wx_if="d"), wx_if="c"))["text"].count("wx:if") == 2
    assert shown(el("block", el("a", wx_for="d"), wx_else=None))["text"].startswith("<block wx:else>")
    assert shown(el("block", el("a"), el("b")))["text"] == "<a></a>\n<b></b>\n"
    assert shown(el("block", {"text": "t"}))["text"] == "t"
    assert shown(el("block", el("block", el("a"), x="1"), y="2"))["text"] == '<a x="1" y="2"></a>\n'


def test_what_is_missing():
    got = shown(el("v", {"text": LOST}, {"text": None}, el("a", bindtap=LOST, src=LOST, ok="1")))
    assert got["text"] == '<v>\n<!-- own: text --><!-- own: text -->    <!-- own: attributes -->\n    <a ok="1"></a>\n</v>\n'
    assert (got["lost_texts"], got["lost_attributes"], got["lost_events"]) == (2, 2, 1)
