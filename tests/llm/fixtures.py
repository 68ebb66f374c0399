"""Small documents with the cases that every operator defines: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the of and to in is that for it was on with as by at from this be are have river stone cloud market engine garden silver window letter bridge".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    rng = random.Random(7)
    base = sentence(rng, 300)
    passage = sentence(rng, 60)
    out = [None, "", "   \n\t ", "word", "a b", base, base, base + " tail", base.upper()]
    out += [sentence(rng, 20) + " " + passage + "\n" + sentence(rng, 15), passage + " " + sentence(rng, 40), sentence(rng, 10) + "  " + passage]
    out += ["x " * 200, "é漢字 😀 " * 30, "no break  spaces here", "line one\nline one\n\nline two\nline one", "ab" * 700, "z" * 1500 + " end"]
    out += [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    out.append(sentence(rng, 30_000))
    return out


def rows():
    """(doc_id, text, lang, source, n_chars, n_words): n_words clashes with output columns."""
    own = [(i, t, ("en", "fr", None)[i % 3], ("b", "a", None, "c")[i % 4], len(t) if t is not None else None, "clash") for i, t in enumerate(texts())]
    return own + [own[5], own[20], (None, "a null key", "en", "a", 10, "clash")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
