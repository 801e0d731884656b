"""Fixed vocabulary of the notation, as plain values, and the same as small DataFrames for joins."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# White space of Unicode, as trimming uses it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

# Trigger characters. Doubled angle brackets count as one.
TRIGGERS = {
    "｜": "bar", "《": "rubyOpen", "》": "rubyClose", "［": "bracketOpen", "］": "bracketClose", "＃": "hash", "※": "refMark",
    "〔": "tortoiseOpen", "〕": "tortoiseClose", "「": "quoteOpen", "」": "quoteClose", "《《": "doubleRubyOpen", "》》": "doubleRubyClose",
}
OPENERS = {"［": "bracket", "《": "ruby", "《《": "doubleRuby", "〔": "tortoise", "「": "quote"}
CLOSERS = {"］": "bracket", "》": "ruby", "》》": "doubleRuby", "〕": "tortoise", "」": "quote"}

# Private-use characters that stand for nodes in normalised text.
SENTINELS = {"inline": "\ue001", "blockLeaf": "\ue002", "blockOpen": "\ue003", "blockClose": "\ue004"}

# Prefix of class and element names in the output. Projections take another one where a caller needs it.
CLASS_PREFIX = "notation-"
ELEMENT_PREFIX = "notation_"
# Element names.
ELEMENTS = {
    "ruby": "ruby", "bouten": "bouten", "tateChuYoko": "tcy", "gaiji": "gaiji", "indent": "indent", "alignEnd": "align_end",
    "warichu": "warichu", "keigakomi": "keigakomi", "pageBreak": "page_break", "sectionBreak": "section_break", "heading": "heading",
    "headingHint": "heading_hint", "sashie": "sashie", "kaeriten": "kaeriten", "annotation": "annotation", "doubleRuby": "double_ruby",
    "container": "container",
}
NODE_KINDS = [*ELEMENTS, "containerOpen", "containerClose"]
# Kinds that stand where a paragraph does, and those of them that hold running text.
BLOCK_KINDS = ["indent", "alignEnd", "warichu", "keigakomi", "pageBreak", "sectionBreak", "heading", "sashie", "container"]
HOLDER_KINDS = ["heading", "alignEnd", "warichu", "keigakomi", "indent"]
PAIR_KINDS = ["bracket", "ruby", "doubleRuby", "tortoise", "quote"]
SEVERITIES = ["error", "warning", "note"]
DIAGNOSTICS = ["source_contains_pua", "unclosed_bracket", "unmatched_close"]
CONTAINER_KINDS = ["indent", "warichu", "keigakomi", "alignEnd"]

# Emphasis keywords with their names in HTML and in Pandoc output.
BOUTEN = {
    "傍点": ("goma", "goma"), "白ゴマ傍点": ("white-sesame", "white-sesame"), "丸傍点": ("circle", "circle"),
    "白丸傍点": ("white-circle", "white-circle"), "二重丸傍点": ("double-circle", "double-circle"), "蛇の目傍点": ("janome", "janome"),
    "ばつ傍点": ("cross", "cross"), "白三角傍点": ("white-triangle", "white-triangle"), "波線": ("wavy-line", "wavy-line"),
    "傍線": ("under-line", "underline"), "二重傍線": ("double-under-line", "double-underline"),
}
SECTIONS = {"改丁": "choho", "改段": "dan", "改見開き": "spread"}
HEADINGS = {"大見出し": 1, "中見出し": 2, "小見出し": 3}
KAERITEN = ["一", "二", "三", "四", "上", "中", "下", "甲", "乙", "丙", "丁", "レ", "一レ", "二レ", "三レ", "上レ", "中レ", "下レ"]

# Fixed values: (canonical slug, family, takes a parameter, partner).
SLUGS = [
    ("改ページ", "PageBreak", False, None), ("改丁", "Section", False, None), ("改段", "Section", False, None), ("改見開き", "Section", False, None),
    ("ここから字下げ", "BlockContainerOpen", False, "ここで字下げ終わり"), ("ここから{N}字下げ", "BlockContainerOpen", True, "ここで字下げ終わり"),
    ("ここで字下げ終わり", "BlockContainerClose", False, "ここから字下げ"), ("ここから地付き", "BlockContainerOpen", False, "ここで地付き終わり"),
    ("ここから地から{N}字上げ", "BlockContainerOpen", True, "ここで地付き終わり"), ("ここで地付き終わり", "BlockContainerClose", False, "ここから地付き"),
    ("罫囲み", "Keigakomi", False, "罫囲み終わり"), ("罫囲み終わり", "Keigakomi", False, "罫囲み"),
    ("割り注", "Warichu", False, "割り注終わり"), ("割り注終わり", "Warichu", False, "割り注"),
    ("地付き", "LeafAlign", False, None), ("地から{N}字上げ", "LeafAlign", True, None), ("{N}字下げ", "LeafAlign", True, None),
    *[(k, "Bouten", False, None) for k in BOUTEN],
    ("挿絵（{path}）入る", "Sashie", True, None), ("縦中横", "TateChuYoko", False, None),
    *[(k, "KaeritenSingle" if len(k) == 1 else "KaeritenCompound", False, None) for k in KAERITEN],
]
# Fixed values: (variant, canonical slug).
VARIANTS = [
    ("ぼうてん", "傍点"), ("にぼうてん", "傍点"), ("しろぼうてん", "白ゴマ傍点"), ("しろごまぼうてん", "白ゴマ傍点"), ("まるぼうてん", "丸傍点"), ("にまるぼうてん", "丸傍点"),
    ("しろまるぼうてん", "白丸傍点"), ("にしろまるぼうてん", "白丸傍点"), ("にじゅうまるぼうてん", "二重丸傍点"), ("じゃのめぼうてん", "蛇の目傍点"), ("ばつぼうてん", "ばつ傍点"),
    ("しろさんかくぼうてん", "白三角傍点"), ("はせん", "波線"), ("ぼうせん", "傍線"), ("にじゅうぼうせん", "二重傍線"), ("かいぺーじ", "改ページ"), ("ページかえ", "改ページ"),
    ("かいちょう", "改丁"), ("かいだん", "改段"), ("かいみひらき", "改見開き"), ("ここからじさげ", "ここから字下げ"), ("ここでじさげおわり", "ここで字下げ終わり"),
    ("ここからじつき", "ここから地付き"), ("ここでじつきおわり", "ここで地付き終わり"), ("じつき", "地付き"), ("たてちゅうよこ", "縦中横"), ("たて中横", "縦中横"),
    ("そうにゅうえ", "挿絵（{path}）入る"), ("けいがこみ", "罫囲み"), ("けいがこみおわり", "罫囲み終わり"), ("わりちゅう", "割り注"), ("わりちゅうおわり", "割り注終わり"),
]

# Accent digraphs, a letter and its mark. Ligatures come first.
ACCENTS = {
    "ae&": "æ", "AE&": "Æ", "oe&": "œ", "OE&": "Œ", "a`": "à", "e`": "è", "i`": "ì", "n`": "ǹ", "o`": "ò", "u`": "ù",
    "A`": "À", "E`": "È", "I`": "Ì", "N`": "Ǹ", "O`": "Ò", "U`": "Ù", "a'": "á", "c'": "ć", "e'": "é", "i'": "í",
    "l'": "ĺ", "m'": "ḿ", "n'": "ń", "o'": "ó", "r'": "ŕ", "s'": "ś", "u'": "ú", "y'": "ý", "z'": "ź", "A'": "Á",
    "C'": "Ć", "E'": "É", "I'": "Í", "L'": "Ĺ", "M'": "Ḿ", "N'": "Ń", "O'": "Ó", "R'": "Ŕ", "S'": "Ś", "U'": "Ú",
    "Y'": "Ý", "Z'": "Ź", "a^": "â", "c^": "ĉ", "e^": "ê", "g^": "ĝ", "h^": "ĥ", "i^": "î", "j^": "ĵ", "o^": "ô",
    "s^": "ŝ", "u^": "û", "A^": "Â", "C^": "Ĉ", "E^": "Ê", "G^": "Ĝ", "H^": "Ĥ", "I^": "Î", "J^": "Ĵ", "O^": "Ô",
    "S^": "Ŝ", "U^": "Û", "a~": "ã", "e~": "ẽ", "i~": "ĩ", "n~": "ñ", "o~": "õ", "u~": "ũ", "A~": "Ã", "E~": "Ẽ",
    "I~": "Ĩ", "N~": "Ñ", "O~": "Õ", "U~": "Ũ", "a:": "ä", "e:": "ë", "i:": "ï", "o:": "ö", "u:": "ü", "y:": "ÿ",
    "A:": "Ä", "E:": "Ë", "I:": "Ï", "O:": "Ö", "U:": "Ü", "s&": "ß", "a&": "å", "u&": "ů", "A&": "Å", "U&": "Ů",
    "a_": "ā", "e_": "ē", "i_": "ī", "o_": "ō", "u_": "ū", "A_": "Ā", "E_": "Ē", "I_": "Ī", "O_": "Ō", "U_": "Ū",
    "c,": "ç", "s,": "ş", "t,": "ţ", "C,": "Ç", "S,": "Ş", "T,": "Ţ", "d/": "đ", "h/": "ħ", "i/": "ɨ", "l/": "ł",
    "o/": "ø", "D/": "Đ", "L/": "Ł", "O/": "Ø",
}
ACCENT_MARKERS = "'`^:~&,/_"

# Out-of-set descriptions that name their own character.
GAIJI_DESCRIPTIONS = {"〓": "〓", "〻": "〻"}


@lru_cache(maxsize=1)
def gaiji_codes() -> dict[str, str]:
    """Code-table references to characters, from the codec: cells of JIS X 0213 that JIS X 0208 lacks."""
    out = {}
    for plane, lead, rows in ((1, b"", range(1, 95)), (2, b"\x8f", [1, 3, 4, 5, 8, *range(12, 16), *range(78, 95)])):
        for row in rows:
            for cell in range(1, 95):
                raw = lead + bytes((0xA0 + row, 0xA0 + cell))
                try:
                    char = raw.decode("euc_jis_2004")
                except UnicodeDecodeError:
                    continue
                if plane == 1:
                    try:
                        raw.decode("euc_jp")
                        continue
                    except UnicodeDecodeError:
                        pass
                out[f"第{plane + 2}水準{plane}-{row}-{cell}"] = char
    return out


def table(spark: SparkSession, name: str) -> DataFrame:
    """A vocabulary table: triggers, pairs, sentinels, slugs, variants, accents, kinds, bouten, gaiji."""
    rows, schema = {
        "triggers": ([(c, k, len(c.encode())) for c, k in TRIGGERS.items()], "trigger string, kind string, byte_len int"),
        "pairs": ([(k, o, next(c for c, x in CLOSERS.items() if x == k)) for o, k in OPENERS.items()], "kind string, open string, close string"),
        "sentinels": ([(k, c) for k, c in SENTINELS.items()], "kind string, char string"),
        "slugs": ([(*x,) for x in SLUGS], "canonical string, family string, accepts_param boolean, partner string"),
        "variants": (VARIANTS, "variant string, canonical string"),
        "accents": (list(ACCENTS.items()), "digraph string, letter string"),
        "kinds": ([(k, ELEMENT_PREFIX + ELEMENTS.get(k, "container")) for k in NODE_KINDS], "kind string, element string"),
        "bouten": ([(k, *v) for k, v in BOUTEN.items()], "keyword string, html string, pandoc string"),
        "gaiji": (list(gaiji_codes().items()), "mencode string, ucs string"),
    }[name]
    return spark.createDataFrame(rows, schema)
