"""Documents with the outputs that must come of them, in all six forms. ``@class-`` and ``@element_`` stand for the prefixes of the output."""

# Case, level, source, HTML, canonical source, nodes, pairs, diagnostics, container pairs.
FIXED_CASES = [
    (
        'align_end_container',
        'should',
        '［＃ここから地から3字上げ］\n寄付者名簿。\n［＃ここで字上げ終わり］\n',
        '<div class="@class-container @class-container-align-end" data-offset="3">\n<p>寄付者名簿。<br />\n<span class="@class-annotation" hidden>［＃ここで字上げ終わり］</span></p>\n',
        '\n\n［＃ここから地付き］\n\n寄付者名簿。\n［＃ここで字上げ終わり］\n',
        '{"schema_version":1,"data":[{"kind":"containerOpen","span":{"start":0,"end":40}},{"kind":"annotation","span":{"start":60,"end":96}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":0,"end":3},"close":{"start":37,"end":40}},{"kind":"bracket","open":{"start":60,"end":63},"close":{"start":93,"end":96}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'annotation',
        'must',
        'text［＃任意のメモ］more\n',
        '<p>text<span class="@class-annotation" hidden>［＃任意のメモ］</span>more</p>\n',
        'text［＃任意のメモ］more\n',
        '{"schema_version":1,"data":[{"kind":"annotation","span":{"start":4,"end":28}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":4,"end":7},"close":{"start":25,"end":28}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'bouten',
        'must',
        '青空［＃「青空」に傍点］を見上げる。\n',
        '<p>青空<em class="@class-bouten @class-bouten-goma @class-bouten-right">青空</em>を見上げる。</p>\n',
        '青空［＃「青空」に傍点］を見上げる。\n',
        '{"schema_version":1,"data":[{"kind":"bouten","span":{"start":6,"end":36}}]}',
        '{"schema_version":1,"data":[{"kind":"quote","open":{"start":12,"end":15},"close":{"start":21,"end":24}},{"kind":"bracket","open":{"start":6,"end":9},"close":{"start":33,"end":36}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'double_ruby',
        'must',
        '《《重要》》な記述。\n',
        '<p><span class="@class-double-ruby">≪重要≫</span>な記述。</p>\n',
        '《《重要》》な記述。\n',
        '{"schema_version":1,"data":[{"kind":"doubleRuby","span":{"start":0,"end":18}}]}',
        '{"schema_version":1,"data":[{"kind":"doubleRuby","open":{"start":0,"end":6},"close":{"start":12,"end":18}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'gaiji',
        'must',
        '珍しき木※［＃「木＋吶のつくり」、第3水準1-85-54］が立つ。\n',
        '<p>珍しき木<span class="@class-gaiji" data-codepoint="U+6798">枘</span>が立つ。</p>\n',
        '珍しき木※［＃「木＋吶のつくり」、第3水準1-85-54］が立つ。\n',
        '{"schema_version":1,"data":[{"kind":"gaiji","span":{"start":12,"end":71}}]}',
        '{"schema_version":1,"data":[{"kind":"quote","open":{"start":21,"end":24},"close":{"start":45,"end":48}},{"kind":"bracket","open":{"start":15,"end":18},"close":{"start":68,"end":71}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'heading',
        'must',
        '［＃見出し］序章［＃見出し終わり］\n',
        '<p><span class="@class-annotation" hidden>［＃見出し］</span>序章<span class="@class-annotation" hidden>［＃見出し終わり］</span></p>\n',
        '［＃見出し］序章［＃見出し終わり］\n',
        '{"schema_version":1,"data":[{"kind":"annotation","span":{"start":0,"end":18}},{"kind":"annotation","span":{"start":24,"end":51}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":0,"end":3},"close":{"start":15,"end":18}},{"kind":"bracket","open":{"start":24,"end":27},"close":{"start":48,"end":51}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'heading_hint',
        'should',
        '序章\n［＃「序章」は中見出し］\n',
        '<p>序章<br />\n<!-- @element_heading_hint --></p>\n',
        '序章\n［＃「序章」は中見出し］\n',
        '{"schema_version":1,"data":[{"kind":"headingHint","span":{"start":7,"end":43}}]}',
        '{"schema_version":1,"data":[{"kind":"quote","open":{"start":13,"end":16},"close":{"start":22,"end":25}},{"kind":"bracket","open":{"start":7,"end":10},"close":{"start":40,"end":43}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'indent_container',
        'must',
        '本文。\n［＃ここから2字下げ］\n段落の中身。\n別の行。\n［＃ここで字下げ終わり］\n通常段落。\n',
        '<p>本文。</p>\n<div class="@class-container @class-container-indent @class-container-indent-2" data-amount="2">\n<p>段落の中身。<br />\n別の行。</p>\n</div>\n<p>通常段落。</p>\n',
        '本文。\n\n［＃ここから字下げ］\n\n段落の中身。\n別の行。\n\n［＃ここで字下げ終わり］\n\n通常段落。\n',
        '{"schema_version":1,"data":[{"kind":"containerOpen","span":{"start":10,"end":41}},{"kind":"containerClose","span":{"start":74,"end":110}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":10,"end":13},"close":{"start":38,"end":41}},{"kind":"bracket","open":{"start":74,"end":77},"close":{"start":107,"end":110}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[{"kind":"indent","open":{"offset":12},"close":{"offset":52}}]}',
    ),
    (
        'kaeriten',
        'should',
        '読［＃返り点 一・二］本\n',
        '<p>読<span class="@class-annotation" hidden>［＃返り点 一・二］</span>本</p>\n',
        '読［＃返り点 一・二］本\n',
        '{"schema_version":1,"data":[{"kind":"annotation","span":{"start":3,"end":31}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":3,"end":6},"close":{"start":28,"end":31}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'keigakomi_container',
        'must',
        '［＃罫囲み］\n本文一行目。\n本文二行目。\n［＃罫囲み終わり］\n',
        '<div class="@class-container @class-container-keigakomi">\n<p>本文一行目。<br />\n本文二行目。</p>\n</div>',
        '\n\n［＃罫囲み］\n\n本文一行目。\n本文二行目。\n\n［＃罫囲み終わり］\n\n',
        '{"schema_version":1,"data":[{"kind":"containerOpen","span":{"start":0,"end":18}},{"kind":"containerClose","span":{"start":57,"end":84}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":0,"end":3},"close":{"start":15,"end":18}},{"kind":"bracket","open":{"start":57,"end":60},"close":{"start":81,"end":84}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[{"kind":"keigakomi","open":{"offset":2},"close":{"offset":48}}]}',
    ),
    (
        'mixed_ruby_bouten',
        'must',
        '｜青梅《おうめ》には［＃「青梅」に傍点］という街道がある。\n',
        '<p><ruby>青梅<rp>(</rp><rt>おうめ</rt><rp>)</rp></ruby>には<em class="@class-bouten @class-bouten-goma @class-bouten-right">青梅</em>という街道がある。</p>\n',
        '｜青梅《おうめ》には［＃「青梅」に傍点］という街道がある。\n',
        '{"schema_version":1,"data":[{"kind":"ruby","span":{"start":0,"end":24}},{"kind":"bouten","span":{"start":30,"end":60}}]}',
        '{"schema_version":1,"data":[{"kind":"ruby","open":{"start":9,"end":12},"close":{"start":21,"end":24}},{"kind":"quote","open":{"start":36,"end":39},"close":{"start":45,"end":48}},{"kind":"bracket","open":{"start":30,"end":33},"close":{"start":57,"end":60}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'nested_containers',
        'should',
        '［＃ここから2字下げ］\n外側の段落。\n［＃ここから3字下げ］\n内側の段落。\n［＃ここで字下げ終わり］\n外側に戻る。\n［＃ここで字下げ終わり］\n',
        '<div class="@class-container @class-container-indent @class-container-indent-2" data-amount="2">\n<p>外側の段落。</p>\n<div class="@class-container @class-container-indent @class-container-indent-3" data-amount="3">\n<p>内側の段落。</p>\n</div>\n<p>外側に戻る。</p>\n</div>',
        '\n\n［＃ここから字下げ］\n\n外側の段落。\n\n［＃ここから字下げ］\n\n内側の段落。\n\n［＃ここで字下げ終わり］\n\n外側に戻る。\n\n［＃ここで字下げ終わり］\n\n',
        '{"schema_version":1,"data":[{"kind":"containerOpen","span":{"start":0,"end":31}},{"kind":"containerOpen","span":{"start":51,"end":82}},{"kind":"containerClose","span":{"start":102,"end":138}},{"kind":"containerClose","span":{"start":158,"end":194}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":0,"end":3},"close":{"start":28,"end":31}},{"kind":"bracket","open":{"start":51,"end":54},"close":{"start":79,"end":82}},{"kind":"bracket","open":{"start":102,"end":105},"close":{"start":135,"end":138}},{"kind":"bracket","open":{"start":158,"end":161},"close":{"start":191,"end":194}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[{"kind":"indent","open":{"offset":29},"close":{"offset":56}},{"kind":"indent","open":{"offset":2},"close":{"offset":83}}]}',
    ),
    (
        'page_break',
        'must',
        '第一章\n本文。\n［＃改ページ］\n第二章\n',
        '<p>第一章<br />\n本文。</p>\n<div class="@class-page-break"></div>\n<p>第二章</p>\n',
        '第一章\n本文。\n\n［＃改ページ］\n\n第二章\n',
        '{"schema_version":1,"data":[{"kind":"pageBreak","span":{"start":20,"end":41}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":20,"end":23},"close":{"start":38,"end":41}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'pageful',
        'may',
        '明治の頃｜青梅《おうめ》街道沿いに、※［＃「木＋吶のつくり」、第3水準1-85-54］なる珍しき木が立つ。［＃ここから2字下げ］その下で人々は語らひ。［＃ここで字下げ終わり］［＃改ページ］\n',
        '<p>明治の頃<ruby>青梅<rp>(</rp><rt>おうめ</rt><rp>)</rp></ruby>街道沿いに、<span class="@class-gaiji" data-codepoint="U+6798">枘</span>なる珍しき木が立つ。</p>\n<div class="@class-container @class-container-indent @class-container-indent-2" data-amount="2">\n<p>その下で人々は語らひ。</p>\n</div>\n<div class="@class-page-break"></div>',
        '明治の頃｜青梅《おうめ》街道沿いに、※［＃「木＋吶のつくり」、第3水準1-85-54］なる珍しき木が立つ。\n\n［＃ここから字下げ］\n\nその下で人々は語らひ。\n\n［＃ここで字下げ終わり］\n\n［＃改ページ］\n\n',
        '{"schema_version":1,"data":[{"kind":"ruby","span":{"start":12,"end":36}},{"kind":"gaiji","span":{"start":54,"end":113}},{"kind":"containerOpen","span":{"start":143,"end":174}},{"kind":"containerClose","span":{"start":207,"end":243}},{"kind":"pageBreak","span":{"start":243,"end":264}}]}',
        '{"schema_version":1,"data":[{"kind":"ruby","open":{"start":21,"end":24},"close":{"start":33,"end":36}},{"kind":"quote","open":{"start":63,"end":66},"close":{"start":87,"end":90}},{"kind":"bracket","open":{"start":57,"end":60},"close":{"start":110,"end":113}},{"kind":"bracket","open":{"start":143,"end":146},"close":{"start":171,"end":174}},{"kind":"bracket","open":{"start":207,"end":210},"close":{"start":240,"end":243}},{"kind":"bracket","open":{"start":243,"end":246},"close":{"start":261,"end":264}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[{"kind":"indent","open":{"offset":68},"close":{"offset":108}}]}',
    ),
    (
        'plain_text',
        'must',
        'こんにちは、世界。\n',
        '<p>こんにちは、世界。</p>\n',
        'こんにちは、世界。\n',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'pua_collision',
        'must',
        'abc\ue001def\n',
        '<p>abcdef</p>\n',
        'abcdef\n',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[{"kind":"source_contains_pua","severity":"warning","source":"source","span":{"start":3,"end":6},"codepoint":"\ue001"}]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'ruby_explicit',
        'must',
        '明治の頃｜青梅《おうめ》街道沿いに。\n',
        '<p>明治の頃<ruby>青梅<rp>(</rp><rt>おうめ</rt><rp>)</rp></ruby>街道沿いに。</p>\n',
        '明治の頃｜青梅《おうめ》街道沿いに。\n',
        '{"schema_version":1,"data":[{"kind":"ruby","span":{"start":12,"end":36}}]}',
        '{"schema_version":1,"data":[{"kind":"ruby","open":{"start":21,"end":24},"close":{"start":33,"end":36}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'ruby_implicit',
        'must',
        '青梅《おうめ》という地名。\n',
        '<p><ruby>青梅<rp>(</rp><rt>おうめ</rt><rp>)</rp></ruby>という地名。</p>\n',
        '｜青梅《おうめ》という地名。\n',
        '{"schema_version":1,"data":[{"kind":"ruby","span":{"start":0,"end":21}}]}',
        '{"schema_version":1,"data":[{"kind":"ruby","open":{"start":6,"end":9},"close":{"start":18,"end":21}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'sashie',
        'must',
        'ある日、［＃挿絵（cover.png）入る］その地に至る。\n',
        '<p>ある日、</p>\n<!-- @element_sashie -->\n<p>その地に至る。</p>\n',
        'ある日、\n\n［＃挿絵（cover.png）入る］\n\nその地に至る。\n',
        '{"schema_version":1,"data":[{"kind":"sashie","span":{"start":12,"end":48}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":12,"end":15},"close":{"start":45,"end":48}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'section_break',
        'must',
        '前章。\n［＃改丁］\n次章。\n',
        '<p>前章。</p>\n<div class="@class-section-break @class-section-break-choho"></div>\n<p>次章。</p>\n',
        '前章。\n\n［＃改丁］\n\n次章。\n',
        '{"schema_version":1,"data":[{"kind":"sectionBreak","span":{"start":10,"end":25}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":10,"end":13},"close":{"start":22,"end":25}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'tate_chu_yoko',
        'must',
        '昭和［＃「12」は縦中横］年\n',
        '<p>昭和<span class="@class-annotation" hidden>［＃「12」は縦中横］</span>年</p>\n',
        '昭和［＃「12」は縦中横］年\n',
        '{"schema_version":1,"data":[{"kind":"annotation","span":{"start":6,"end":35}}]}',
        '{"schema_version":1,"data":[{"kind":"quote","open":{"start":12,"end":15},"close":{"start":17,"end":20}},{"kind":"bracket","open":{"start":6,"end":9},"close":{"start":32,"end":35}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'unclosed_bracket',
        'must',
        '｜青梅《おうめ\n',
        '<p>｜青梅《おうめ</p>\n',
        '｜青梅《おうめ\n',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[{"kind":"unclosed_bracket","severity":"error","source":"source","span":{"start":9,"end":12}}]}',
        '{"schema_version":1,"data":[]}',
    ),
    (
        'warichu_inline',
        'must',
        '［＃割り注］上の段／下の段［＃割り注終わり］\n',
        '<p><span class="@class-warichu">上の段／下の段</span></p>\n',
        '［＃割り注］上の段／下の段［＃割り注終わり］\n',
        '{"schema_version":1,"data":[{"kind":"annotation","span":{"start":0,"end":18}},{"kind":"annotation","span":{"start":39,"end":66}}]}',
        '{"schema_version":1,"data":[{"kind":"bracket","open":{"start":0,"end":3},"close":{"start":15,"end":18}},{"kind":"bracket","open":{"start":39,"end":42},"close":{"start":63,"end":66}}]}',
        '{"schema_version":1,"data":[]}',
        '{"schema_version":1,"data":[]}',
    ),
]
