"""Texts that operators must stand."""

LONG = "the " * 30_000 + "x" * 20_000 + "\n" * 2_000 + "ende"
EDGES = [
    (1, "Hello  world, this is é 日本\nline two\n\nline two"),
    (2, None),
    (3, ""),
    (4, "   \t\n "),
    (5, LONG),
    (6, "a"),
    (None, "a row without an id and with words enough to count as a text of some length"),
    (7, "same text here for ties and more words to pass the base rule of ten words\nand a line"),
    (7, "same text here for ties and more words to pass the base rule of ten words\nand a line"),
    (8, "same text here for ties and more words to pass the base rule of ten words\nand a line"),
    (8, "another text of the same id"),
    (9, "<s> </s> <|endoftext|> \u0000 ▁ literal ▁marks 😀😀 don't"),
]
