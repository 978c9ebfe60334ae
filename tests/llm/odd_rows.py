"""Awkward documents: (doc_id, text[, lang, source])."""

#: Null, empty, blank, very long and repeated texts, null ids, sources and languages, ties.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 60_000), (5, "One two three four five six."), (6, "one two three four five six."), (6, "one two three four five six."),
       (None, "one two three four five six."), (7, "é" * 300_000), (8, "a b", None, None), (9, None, None, None), (10, "՘x 1ᛪ0 \U00016ea0 ok")]

#: Texts on which a pattern that backtracks, recurses or starts anew at every letter does not end: long words, domains, runs of digits.
LONG = [(20, "x@a" + ".b" * 50_000), (21, "q" * 1_000_000), (22, "1234 " * 20_000), (23, "a." * 100_000 + "@"), (24, "a" * 50_000 + "@b.c"), (25, "1-" * 50_000), (26, "+1" * 50_000),
        (27, "(" * 50_000), (28, "GB12" + " ABCD" * 20_000), (29, "token=" + "k" * 50_000), (30, "1.2.3." * 20_000)]
