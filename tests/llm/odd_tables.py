"""Tables with everything that can be odd about them."""

import os

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
# Names that operators use themselves.
CLASHING = [
    "id", "row", "fp", "k1", "k2", "root", "component", "block", "tail", "bounds", "kept", "runs", "found", "pass0",
    "w", "mean", "key", "log_weight", "n_grams", "label", "target", "target_id", "copy", "n", "ids", "decoded", "token_ids",
    "n_removed", "n_lines", "c", "o", "tie", "codes", "learn", "text_1", "first", "last", "mark", "a b.c", "best",
]

PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = "\n".join(f"line {i} of a very long text, number {i * i}" for i in range(20_000))

ODD = {
    "documents": [
        (1, "The quick brown fox jumps over the lazy dog. It was a fine day.", "en", "a", 63),
        (2, None, "en", "a", None),
        (3, "", "fr", None, 0),
        (4, LONG, "en", "b", len(LONG)),
        (5, "Opening.\n" + PASSAGE + "\nClosing.", None, "b", 1),
        (6, "Another opening.\n" + PASSAGE + "\nAnother closing.", "en", "b", 1),
        (7, "The quick brown fox jumps over the lazy dog. It was a fine day.", "en", "c", 63),
        (7, "The quick brown fox jumps over the lazy dog. It was a fine day.", "en", "c", 63),
        (8, "Der schnelle braune Fuchs springt über den faulen Hund. Es war ein schöner Tag.", "de", "c", 80),
        (8, "Another text with the same id.", "en", "c", 3),
        (9, "\n\n \n\t\n", "en", "d", 5),
        (10, "12 34 !! ??", "en", "d", 5),
        (None, "A text without an id, which shares alpha beta gamma delta epsilon zeta eta theta iota kappa with an item.", None, None, None),
        (None, "A text without an id, which shares alpha beta gamma delta epsilon zeta eta theta iota kappa with an item.", None, None, None),
        (11, "Un texte très court sous MIT License, et Apache License; 日本語 😀   fin", "fr", "e", 1),
        (12, "spam*** spam*** spam*** spam*** spam*** spam***", "en", "e", 1),
    ],
    "benchmark": [
        (1, "Alpha beta, gamma: delta epsilon zeta ETA theta iota kappa"),
        (1, "Alpha beta, gamma: delta epsilon zeta ETA theta iota kappa"),
        (2, None),
        (3, ""),
        (4, "fine day"),
        (None, "springt über den faulen Hund"),
    ],
    "labels": [(1, 1, 0), (8, 1, 1), (8, 0, 0), (12, 0, 0), (None, 1, 0), (5, None, None), (6, 1, None), (6, 1, None), (99, 1, 0)],
    "pages": [
        (1, "u", "<html><body><nav><a>Menu</a></nav><article><h1>Title</h1><p>One &amp; two,\n three.</p></article></body></html>"),
        (2, None, None),
        (3, "u", ""),
        (None, "u", "<p>Never closed <b>at all, but a paragraph it is. And another sentence."),
        (1, "u", "<html><body><nav><a>Menu</a></nav><article><h1>Title</h1><p>One &amp; two,\n three.</p></article></body></html>"),
        (4, "u", "<article>" + "<p>A sentence of the article, and one more. Then it ends.</p>" * 3000 + "</article>"),
    ],
    "embeddings": [
        (1, [0.5] * 64, 0),
        (1, [0.5] * 64, 0),
        (None, [-0.5] * 63 + [2.0], None),
        (9, [0.0] * 63 + [1e-9], 1),
    ],
    "conversations": [
        (1, 0, "user", "User: hello there\nAssistant: hi, how can I help?\nUser: not at all"),
        (1, 1, "assistant", None),
        (1, 1, "assistant", ""),
        (1, None, "user", "What is it?"),
        (None, 0, None, "A line of nobody."),
        (None, 0, "tool", "A line of nobody."),
        (2, 0, "system", "<|system|> Be short.\n### Assistant:\nYes. <|im_end|>"),
        (2, 0, "system", "<|system|> Be short.\n### Assistant:\nYes. <|im_end|>"),
        (3, 0, "user", LONG),
    ],
}
