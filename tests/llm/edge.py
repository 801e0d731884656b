"""Documents that are awkward in every way the operators promise to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, rows long, node long, bits long, size long, key string, row long, kept string, n_words string, part string, _text string"


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(300)
    texts = [
        (1, base, "a"), (1, base, "a"), (2, base, "b"), (3, base.replace(" ", "\n", 40), None), (4, None, "a"), (5, "", "a"), (6, " \t\n\x0b ", None), (None, base, "a"), (None, None, None), (None, prose(40), "b"),
        (7, "x" * 70_000, "b"), (8, prose(30_000), "a"), (9, "word", "b"), (9, prose(50), "b"), (-(2**63), prose(60), "c"), (2**63 - 2, prose(60) + " émile 日本語 \U00020000", "c"),
        (10, "same line here\n" * 40 + prose(30), "a"), (11, "\x00\x1f\x85  odd  marks <|endoftext|> '' \\ �", "c"), (12, base[:400] + prose(40) + base[400:], "b"),
        (2**63 - 1, base[:88], "a"), (None, base[:88] + " x", "b"), (2**63 - 1, base[900:1000], "c"), (None, "<|startoftext|><|endoftext|> and <|ENDOFTEXT|> x<|endoftext|>y 日<|endoftext|>", "a"),
    ]
    texts += [(100 + i, prose(25 + i), "abc"[i % 3]) for i in range(20)]
    return [(i, t, "en", s, None if t is None else len(t), "x", 1, 2, 3, 4, "k", 5, "q", "w", "p", "u") for i, t, s in texts]
