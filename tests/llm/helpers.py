"""Tables of awkward rows, and plain versions of the operators to compare with."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, n long, row_id string, size string, gid string"


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + rng.choice(["", "", "s", "n", "ing"]) for _ in range(n))


def rows(seed=1, n=120):
    """Documents: prose, exact copies, near copies, nulls, empty ones, blanks, one very long text, odd characters."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(5, 120)) + "\n" + prose(rng, 10) for _ in range(n)]
    for i in range(0, n, 7):
        texts.append(texts[i].upper() if i % 2 else texts[i])
    for i in range(0, n, 5):
        own = texts[i].split(" ")
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += [None, None, "", "", " \t\n", "one", "ONE", "Ümläut ÜBER straße", "a\x0bb\x0cc\rd", "\n\n", prose(rng, 30000), "<|endoftext|> x", "  lead and trail  "]
    return [(i, t, ["en", "fr", "de", None][i % 4], ["a", "b", "c", None, "é"][i % 5], len(t or "")) for i, t in enumerate(texts)]


def docs(spark, seed=1, n=120):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(4)


def clashing(spark, found):
    return spark.createDataFrame([(*r, 7, "k", 1, "x", "y", "z") for r in found], CLASH)
