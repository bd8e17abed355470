"""Small inputs for every operator: odd rows, and texts with known copies."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _h string, score string, _row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(*texts, source="s1", lang="en", start=0):
    return [(start + i, t, lang, source, len(t or ""), 7, "h", "x", "y") for i, t in enumerate(texts)]


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, odd ids."""
    rng = random.Random(5)
    long_text = "\n".join(prose(rng, 40) for _ in range(300))
    rows = rows_of(None, "", " \n\t ", "one", "a b c", "é ü 日本 🙂 ñ", "x" * 5000, long_text, long_text, "same\ntext\nhere\nagain", "same\ntext\nhere\nagain")
    rows += [rows[9], rows[9], (None, "same\ntext\nhere\nagain", None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None), (-5, prose(rng, 80), "", "", 0, None, None, None, None)]
    return rows
