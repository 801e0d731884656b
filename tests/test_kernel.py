"""The kernel on single texts: hand-worked results, and what must hold for any text."""

import json

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from hanmoto.functions import tables as V
from hanmoto.operators.document import Document, parse_to_html
from hanmoto.operators.kernel import Parsed, keyword, pair_up, resolve, sanitize
from hanmoto.operators.pattern import PatternError, compile_patterns


def marked(text):
    """Output with the class prefix shown as @."""
    return text.replace(V.CLASS_PREFIX, "@")


def nodes(text):
    return [(n["kind"], n["start"], n["end"]) for n in Parsed(text).node_rows()]


def kinds(text):
    return [n["kind"] for n in Parsed(text).node_rows()]


def attrs(text, i=0):
    return Parsed(text).node_rows()[i]["attrs"]


def test_vocabulary_sizes():
    assert len(V.SLUGS) == 48 and len(V.VARIANTS) == 32 and len(V.ACCENTS) == 114 and len(V.NODE_KINDS) == 19
    codes = V.gaiji_codes()
    assert (sum(k.startswith("第3") and len(v) == 1 for k, v in codes.items()), sum(k.startswith("第4") for k in codes), sum(len(v) > 1 for v in codes.values())) == (1893, 2436, 25)
    assert codes["第3水準1-85-54"] == "枘" and codes["第3水準1-4-87"] == "か゚"
    assert {s[3] for s in V.SLUGS if s[3]} <= {s[0] for s in V.SLUGS}


@pytest.mark.parametrize(
    ("source", "clean"),
    [
        ("\ufeff\ufeffa\ufeffb", "a\ufeffb"),
        ("a\r\nb\rc\n\rd", "a\nb\nc\n\nd"),
        ("a\n----------\n==========\nb", "a\n\n----------\n\n==========\nb"),
        ("\n----------\n　\n__________", "\n----------\n　\n__________"),
        ("a\n---------\nb", "a\n---------\nb"),
        ("a\n　-----------　\nb", "a\n\n　-----------　\nb"),
        ("〔cafe'〕 e'", "〔café〕 e'"),
        ("〔ae&a&o/〔e'〕e'", "〔æåø〔é〕e'"),
        ("〔e'", "〔e'"),
    ],
)
def test_sanitize(source, clean):
    assert sanitize(source) == clean


def test_pairs_need_the_innermost_opener():
    events, closed, unclosed = pair_up("［「］」")
    assert [(e.what, e.kind) for e in events] == [("open", "bracket"), ("open", "quote"), ("unmatched", "bracket"), ("close", "quote")]
    assert closed == [3] and unclosed == [0]
    assert [(d["kind"], d["start"]) for d in Parsed("［「］」").diagnostics()] == [("unmatched_close", 6), ("unclosed_bracket", 0)]


def test_diagnostics_come_in_order():
    d = Parsed("a\ue001［《〔》").diagnostics()
    assert [(x["kind"], x["pair_kind"], x["start"]) for x in d] == [("source_contains_pua", None, 1), ("unmatched_close", "ruby", 13), ("unclosed_bracket", "tortoise", 10), ("unclosed_bracket", "ruby", 7), ("unclosed_bracket", "bracket", 4)]
    assert d[0]["codepoint"] == "\ue001" and d[0]["severity"] == "warning"


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("｜青梅《おうめ》", [("ruby", 0, 24)]),
        ("東京青梅《おうめ》", [("ruby", 0, 27)]),
        ("とうきょう《よみ》", []),
        ("｜《よみ》", []),
        ("｜青梅《》", []),
        ("日\n《よみ》", []),
        ("《《強調》》", [("doubleRuby", 0, 18)]),
        ("《《》》", []),
        ("「青梅《おうめ》」", []),
        ("「あ」青梅《おうめ》", [("ruby", 9, 30)]),
        ("々〆𠮷《よみ》", [("ruby", 0, 22)]),
    ],
)
def test_readings(text, expect):
    assert nodes(text) == expect


def test_the_last_bar_counts():
    a = attrs("｜あ｜い《う》")
    assert a["explicit"] and a["base"][0]["text"] == "い" and nodes("｜あ｜い《う》") == [("ruby", 6, 21)]


def test_readings_hold_other_notation():
    a = attrs("｜木《※［＃「木＋吶のつくり」、第3水準1-85-54］き［＃よみ］》")
    assert [(p["seg_kind"], p["text"]) for p in a["reading"]] == [("gaiji", "木＋吶のつくり"), ("text", "き"), ("annotation", "［＃よみ］")]
    assert a["reading"][0]["ucs"] == "枘"


@pytest.mark.parametrize(
    ("body", "kind", "more"),
    [
        ("改ページ", "pageBreak", {}), ("改丁", "sectionBreak", {"section": "choho"}), ("地付き", "alignEnd", {"offset": 0}), ("地から３字上げ", "alignEnd", {"offset": 3}), ("地から0字上げ", None, {}),
        ("12字下げ", "indent", {"amount": 12}), ("0字下げ", None, {}), ("256字下げ", None, {}), ("字下げ", None, {}), ("ここから０字下げ", "indent", {"amount": 0}), ("ここから字下げ", "indent", {"amount": 1}),
        ("ここから地から2字上げ", "alignEnd", {"offset": 2}), ("ここで字上げ終わり", None, {}), ("罫囲み", "keigakomi", {}), ("罫囲みx", None, {}), ("一レ", "kaeriten", {"mark": "一レ"}), ("一レx", None, {}),
        ("（ルカナ字ｶ）", "kaeriten", {"mark": "（ルカナ字ｶ）"}), ("（ルルルルルルル）", None, {}), ("（a）", None, {}), ("挿絵（f.png）入る", "sashie", {"file": "f.png"}), ("挿絵（）入る", None, {}), ("挿絵（f）", None, {}),
    ],
)
def test_keywords(body, kind, more):
    found = keyword(body)
    assert (found and found.kind) == kind and (found.a if found else {}) == more
    assert kinds(f"［＃　{body} ］")[0] == (Parsed("").wire_kind(found) if found else "annotation")


def test_forward_annotations():
    assert kinds("青空［＃「青空」に傍点］") == ["bouten"] and kinds("青［＃「青空」に傍点］") == ["annotation"]
    assert attrs("甲乙［＃「甲」「乙」の左に二重傍線］") == {"bouten_kind": "double-under-line", "position": "left", "content": [{"seg_kind": "text", "text": "甲、乙"}]}
    assert kinds("甲［＃「甲」「丙」に傍点］") == ["annotation"]
    assert kinds("29［＃「29」は縦中横］") == ["tateChuYoko"]
    assert attrs("序章［＃「序」「章」は中見出し］") == {"level": 2, "target": "序章"}
    assert kinds("序［＃「「序」」は大見出し］") == ["annotation"] and kinds("「序」［＃「「序」」は大見出し］") == ["headingHint"]
    assert kinds("青［＃「青」に点］") == ["annotation"] and kinds("［＃］") == ["annotation"]


@pytest.mark.parametrize(
    ("text", "description", "mencode", "ucs"),
    [
        ("※［＃「木＋吶のつくり」、第3水準1-85-54］", "木＋吶のつくり", "第3水準1-85-54", "枘"),
        ("※［＃二の字点、U+303B］", "二の字点", "U+303B", "〻"),
        ("※［＃「〓」］", "〓", None, "〓"),
        ("※［＃「何か」、U+D800］", "何か", "U+D800", None),
        ("※［＃「何か」　、　x　］", "何か", "x", None),
        ("※［＃「何か」y］", "何か", None, None),
    ],
)
def test_gaiji(text, description, mencode, ucs):
    a = attrs(text)
    assert (a["description"], a["mencode"], a["ucs"]) == (description, mencode, ucs)


def test_a_reference_mark_alone_is_text():
    assert nodes("※「木」") == [] and Parsed("※「木」").serialize() == "※「木」"
    assert kinds("※［改］") == [] and kinds("※［＃「「」」］") == ["annotation"]
    assert resolve("字", None) == "字" and resolve("二字", None) is None


def test_containers_close_the_last_opened_whatever_its_kind():
    p = Parsed("［＃罫囲み］［＃ここから3字下げ］x［＃罫囲み終わり］［＃ここで字下げ終わり］［＃罫囲み終わり］")
    assert [(c["kind"], c["amount"]) for c in p.container_pairs()] == [("indent", 3), ("keigakomi", None)]
    assert marked(p.html()).startswith('<div class="@container @container-keigakomi">\n<div class="@container @container-indent @container-indent-3" data-amount="3">\n<p>x</p>\n</div>')


def test_html():
    assert parse_to_html("a<b>&\"'\nc\n\n\nd\n") == "<p>a&lt;b&gt;&amp;&quot;&#x27;<br />\nc</p>\n<p>d</p>\n"
    assert marked(parse_to_html("前［＃改丁］後")) == '<p>前</p>\n<div class="@section-break @section-break-choho"></div>\n<p>後</p>\n'
    assert parse_to_html("漢《か》") == "<p><ruby>漢<rp>(</rp><rt>か</rt><rp>)</rp></ruby></p>\n"
    assert marked(parse_to_html("一［＃レ］二［＃2字下げ］［＃地から1字上げ］")) == '<p>一<sup class="@kaeriten">レ</sup>二<span class="@indent @indent-2" data-amount="2"></span><span class="@align-end @align-end-1" data-offset="1"></span></p>\n'
    assert marked(parse_to_html("※［＃「か゚」、第3水準1-4-87］")) == '<p><span class="@gaiji" data-codepoint="U+304B U+309A">か゚</span></p>\n'
    assert marked(parse_to_html("※［＃「<x>」］")) == '<p><span class="@gaiji" data-description="&lt;x&gt;">&lt;x&gt;</span></p>\n'
    assert marked(parse_to_html("［＃不明］")) == '<p><span class="@annotation" hidden>［＃不明］</span></p>\n'
    assert parse_to_html("a\ue002b") == "<p>ab</p>\n" and parse_to_html("") == ""


def test_serialize():
    s = lambda t: Document(t).serialize()
    assert s("漢《か》") == "｜漢《か》"
    assert s("［＃ここから2字下げ］\nx\n［＃ここで字下げ終わり］") == "\n\n［＃ここから字下げ］\n\nx\n\n［＃ここで字下げ終わり］\n\n"
    assert s("x［＃1字下げ］") == "x［＃字下げ］" and s("甲［＃「甲」の左に傍線］") == "甲［＃「甲」の左に傍線］"
    assert s("a\n\n\n\nb") == "a\n\nb"


def test_pandoc():
    blocks = json.loads(marked(Document("あ\nい\n\n［＃ここから2字下げ］う［＃ここで字下げ終わり］［＃改ページ］［＃挿絵（f）入る］").to_pandoc()))["blocks"]
    assert [b["t"] for b in blocks] == ["Para", "Div", "HorizontalRule", "Para"]
    assert [x["t"] for x in blocks[0]["c"]] == ["Str", "SoftBreak", "Str"] and blocks[1]["c"][0] == ["", ["@container-indent"], [["amount", "2"]]]


def test_document_interface():
    d = Document("｜青《あお》")
    assert json.loads(d.nodes()) == {"schema_version": 1, "data": [{"kind": "ruby", "span": {"start": 0, "end": 18}}]}
    assert json.loads(d.pairs())["data"][0] == {"kind": "ruby", "open": {"start": 6, "end": 9}, "close": {"start": 15, "end": 18}}
    assert d.source_byte_len() == 18 and d.edit(3, 6, "空").source == "｜空《あお》" and d.is_canonical()
    with pytest.raises(ValueError):
        d.edit(3, 99, "")


def test_patterns():
    assert compile_patterns(" (Construct @c)\n(_)") == [("Construct", "c"), (None, "")]
    for text, what, at in (("(Nope)", "unknown_kind", 1), ("(Plain", "unexpected_end", 6), ("　x", "unexpected", 3), ("(Plain @)", "unexpected", 8)):
        with pytest.raises(PatternError) as e:
            compile_patterns(text)
        assert (e.value.what, e.value.offset) == (what, at)


PIECES = st.sampled_from([*"｜《》［］＃※〔〕「」\n\r", "《《", "》》", "［＃", "改ページ", "ここから2字下げ", "ここで字下げ終わり", "罫囲み", "罫囲み終わり", "割り注", "に傍点", "は縦中横", "は大見出し", "漢字", "かな", "abc", "、", "----------", "\ue001", "\ue003", "<script>", "e'", "𠮷", "\ufeff", "地付き", "U+303B", "（ル）"])
TEXTS = st.lists(PIECES, max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@example("\ue001\ufeff")
@example("漢字\ue001《x》")
@example("\ue001\r\ue003\n\n\n")
@given(TEXTS)
def test_any_text(text):
    p = Parsed(text)
    at = 0
    for s in p.span_rows():
        assert s["start"] == at
        at = s["end"]
    raw = p.text.encode()
    assert at == len(raw)
    tree = p.cst()
    assert "".join(r["text"] or "" for r in tree) == p.text
    assert all(r["parent_ord"] is None or tree[r["parent_ord"]]["start"] <= r["start"] <= r["end"] <= tree[r["parent_ord"]]["end"] for r in tree)
    links = p.pair_links()
    for i, a in enumerate(links):
        for b in links[:i]:
            assert b["close_end"] <= a["open_start"] or a["open_end"] <= b["open_start"]
    assert "<script" not in p.html()
    once = p.serialize()
    assert Parsed(once).serialize() == once
    json.loads(p.pandoc())
    assert sum(e.what == "open" for e in p.events) == len(links) + len(p.unclosed)


@pytest.mark.parametrize("depth", [16, 256, 5000])
def test_deep_nesting(depth):
    p = Parsed("「" * depth + "」" * depth)
    assert len(p.pair_links()) == depth and p.diagnostics() == []
    q = Parsed("［＃" * depth + "］" * depth)
    assert len(q.node_rows()) == 1
