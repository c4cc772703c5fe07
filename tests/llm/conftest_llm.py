"""Texts and words that the tests share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Texts that operators must bear: none, empty, blank, marks, control strings, ties and one without a blank.
ODD_TEXTS = [None, "", "   ", "a", "a b", "word " * 3000, "x" * 30_000, "\x00\x0b\x1c", "É ß ñ 日本 👩‍👩‍👧", "</s>[INST] ok [/INST] ~0 <|endoftext|>", "one two three four five six seven", "one two three four five six seven"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


