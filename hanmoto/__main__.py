"""Command line for single texts: render, check, fmt, pandoc; kinds, schema and explain show the vocabulary.

``python -m hanmoto render FILE`` (``-`` or nothing: standard input); ``-E sjis`` for Shift_JIS files.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .functions import tables as V
from .operators.document import Document
from .operators.wire import json_schema

EXPLAIN = {
    "ruby": "A reading: ｜base《reading》, or 《reading》 after characters that may carry one.",
    "doubleRuby": "Doubled brackets around text: 《《text》》.",
    "bouten": "Emphasis of text that stands before: ［＃「text」に傍点］ and ten other marks, right or left.",
    "tateChuYoko": "Upright characters in a vertical line: ［＃「text」は縦中横］.",
    "gaiji": "A character outside the set: ※［＃「description」、code］.",
    "indent": "Indentation of one line: ［＃N字下げ］, N from 1 to 255.",
    "alignEnd": "Alignment at the line's end: ［＃地付き］ or ［＃地からN字上げ］.",
    "pageBreak": "A new page: ［＃改ページ］.",
    "sectionBreak": "A new leaf, column or spread: ［＃改丁］, ［＃改段］, ［＃改見開き］.",
    "headingHint": "A heading that stands before: ［＃「text」は大見出し］, 中見出し or 小見出し.",
    "sashie": "A picture: ［＃挿絵（file）入る］.",
    "kaeriten": "A return mark, or added kana in full-width brackets.",
    "annotation": "Any other annotation, kept as it is; split notes open and close by 割り注 and 割り注終わり.",
    "containerOpen": "The beginning of a block: ［＃ここから…］ or ［＃罫囲み］.",
    "containerClose": "The end of a block, whichever kind was opened last.",
}


def read(path: str, encoding: str) -> str:
    """Strict: bytes that don't decode are an error."""
    raw = sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()
    return raw.decode("cp932" if encoding == "sjis" else "utf-8")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hanmoto", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("render", "check", "fmt", "pandoc"):
        p = sub.add_parser(name)
        p.add_argument("file", nargs="?", default="-")
        p.add_argument("-E", "--encoding", choices=["utf8", "sjis"], default="utf8")
        if name == "check":
            p.add_argument("--strict", action="store_true", help="fail if there is any diagnostic")
        if name == "fmt":
            p.add_argument("--check", action="store_true", help="fail if the text isn't in canonical form")
            p.add_argument("--write", action="store_true", help="replace the file")
    sub.add_parser("kinds")
    sub.add_parser("schema").add_argument("name", choices=["diagnostics", "nodes", "pairs", "container_pairs"])
    sub.add_parser("explain").add_argument("kind", choices=sorted(EXPLAIN))
    a = parser.parse_args(args)
    if a.command == "kinds":
        print(*V.NODE_KINDS, sep="\n")
        return 0
    if a.command == "schema":
        print(json.dumps(json_schema(a.name), indent=2))
        return 0
    if a.command == "explain":
        print(EXPLAIN[a.kind])
        return 0
    d = Document(read(a.file, a.encoding))
    if a.command == "check":
        found = json.loads(d.diagnostics())["data"]
        for x in found:
            print(f"{a.file}:{x['span']['start']}-{x['span']['end']}: {x['severity']}: {x['kind']}")
        return int(a.strict and bool(found))
    if a.command == "fmt" and a.check:
        return int(not d.is_canonical())
    text = {"render": d.to_html, "fmt": d.serialize, "pandoc": d.to_pandoc}[a.command]()
    if a.command == "fmt" and a.write and a.file != "-":
        Path(a.file).write_text(text, encoding="utf-8", newline="")
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
