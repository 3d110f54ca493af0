import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, token string, key string, part string, h string"


def frame(spark, rows, extra=True):
    """(doc_id, text, source) rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA).repartition(3)


def brute_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, nulls, empty and long ones, ties and repeated rows."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    out, passage, line = [], text(60), "A common Line that many documents share"
    for i in range(60):
        out.append((i, text(r.randint(1, 150)), f"s{i % 4}"))
    for i in range(60, 75):  # near copies of document 1's new text
        base = out[10][1].split() + text(80).split() if i == 60 else base
        words = list(base)
        for _ in range(i - 60):
            words[r.randrange(len(words))] = "edited"
        out.append((i, " ".join(words), "s0"))
    for i in range(75, 80):
        out.append((i, out[3][1] + ("  \n" if i % 2 else ""), "hot"))
    for i in range(80, 86):
        out.append((i, text(30) + "\n" + line + "\n" + passage + "\n" + text(30) + "\n  " + line.upper(), "hot"))
    out += [(90, None, "s1"), (91, "", None), (92, "  \t\n", "s1"), (93, "one", None), (94, "Größe Ünïcode naïve ЖЗ 東京 " * 3, "s2"), (95, text(9000), "s3"), (96, "x y\u0085z " * 6, "s2")]
    out += [out[5], out[5], (97, "<|endoftext|> it's 42 <|ENDOFTEXT|> end", "s2")]
    return out
