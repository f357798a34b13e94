"""Small tables with everything that goes wrong in large ones."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, `Row` string, counts int, doc string"


def sentence(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def documents(seed=3):
    """Rows of ``DOCUMENTS``; the columns from size on only clash with names used inside."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    texts = [None, "", " \t\n ", "a", "one two three", "É Ça œuvre 汉字 \u2581 sign", "x" * 5000, "a\x0bb\x0cc\rd"]
    texts += [sentence(rng, rng.randrange(60, 200)) for _ in range(70)]
    texts += [passage + " " + sentence(rng, 40) for _ in range(6)] + [sentence(rng, 50) + "\n" + passage for _ in range(4)]
    long = sentence(rng, 6000)
    near = sentence(rng, 900)
    texts += [long, near, near + " and more", near.replace("w1 ", "W1 ", 1)]
    texts += [sentence(rng, 70).replace(" ", "### ") for _ in range(3)]
    texts += ["same line again\n" * 40, "\n".join(["x y", "x y", "", " ", "z"])] + ["exact copy " + passage] * 20
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[5]), (9, texts[9]), (9, texts[9]), (9, "the same id, another text"), (None, passage), (None, None), (-7, passage)]
    langs, sources = ("en", "en", "de", None), ("s1", "s1", "s1", "ß", "Z", None)
    return [
        (d, t, langs[i % 4], sources[i % 6], len(t or ""), i, "row", 1, "doc") for i, (d, t) in enumerate(rows)
    ]


PAGES = "page_id long, url string, html string, host string, rule string"
URLS = [
    None, "", "no scheme", "http://", "http://org", "http://ORG/", "http://Sub.Example.ORG/es/x?q#f", "https://example.org/en/12",
    "https://example.org/en/2", "https://notexample.org/es/", "http://a.com/fr/", "http://com/de/x", "http://a.com/de", "x://É.org/É#/es/",
    "http://a.org?/es/", "http://a.b.c.d.example.org/es/" + "y" * 3000, "http://" + "a." * 500 + "com/de/", "a://b://c.com/fr/",
    "http://example.org\n/es/",
]


def pages():
    rows = [(i, u, "html", "clash", "clash") for i, u in enumerate(URLS)]
    return rows + [rows[6], rows[6], (6, URLS[7], "", "", ""), (None, URLS[6], "", "", "")]


CONVERSATIONS = "conv_id long, turn int, role string, text string, tree string, node int"


def conversations():
    rng = random.Random(5)
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s><s>[INST] \\ [/INST] \\\\"), (1, 2, "user", None), (1, 3, "assistant", ""),
        (2, 0, "assistant", "é汉 [INST"), (2, 0, "assistant", "/INST]<"), (3, 5, None, "no role"), (3, 5, None, "no role"),
        (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (4, 0, "[INST] ", "<s"), (5, 0, "assistant", "long " * 20000),
    ]
    rows += [(6, t, ("user", "assistant")[t % 2], sentence(rng, 5)) for t in range(77)]
    return [(*r, "tree", 1) for r in rows]


EMBEDDINGS = "vec_id long, embedding array<float>, score long, `key` int"


def embeddings():
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 330)] + [rows[50], rows[50], rows[50], rows[7], rows[7]]
    rows += [(350, [0.0] * 16), (400, None), (450, [1.0, None] * 8), (451, [float("nan")] * 16), (452, [float("inf")] * 16)]
    rows += [(500, [-1.0] * 16), (501, [1.0] * 16), (100, rows[3][1])]
    return [(i, v, 0, 0) for i, v in rows]


def wide_embeddings():
    """Vectors of 64 components: clusters, ties and repeats, and rows that take no part."""
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 9]]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 430)] + [rows[50], rows[50], (60, rows[61][1]), (None, rows[5][1]), (None, rows[6][1])]
    rows += [(500, [0.0] * 64), (501, [0.0] * 64), (502, None), (503, [1.0, None] * 32), (504, [float("nan")] * 64)]
    rows += [(505, [float("-inf")] * 64), (506, []), (507, [1.0] * 63), (508, [1.0] * 65), (-1, [-1 / 64] * 64)]
    return [(i, v, 0, 0) for i, v in rows]


TABLES = {
    "documents": (documents, DOCUMENTS), "pages": (pages, PAGES), "conversations": (conversations, CONVERSATIONS),
    "embeddings": (embeddings, EMBEDDINGS),
}
