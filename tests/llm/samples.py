"""Constants of the tests in this folder."""

import re

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Null columns, empty and long texts, ties, repeated rows, and columns with names that operators use inside.
ODD = [(None, "a line with a null id and some words in it so that it is long enough", "s"), (1, None, "s"), (2, "", None), (3, " \n\t ", "s"), (4, "word", "s"),
       (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen.", "s"),
       (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen.", "s"),
       (6, "the same row again and again " * 4000, "s"), (7, "x" * 100_000, "s"), (8, "1 " * 20_000, "s"), (9, "\x1c odd\u00a0blanks\u3000and \x85 marks \ud7ff <|endoftext|> 's", "s")]
