"""Small documents that hold every awkward case, with further columns whose names clash with working ones."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key long, score double, size long, row long, unit string, __h long, times long"
_rng = random.Random(11)
WORDS = ["".join(_rng.choice("abcdefghij") for _ in range(_rng.randrange(2, 8))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts() -> list[str | None]:
    base, rng = prose(120, 1), random.Random(5)
    out: list[str | None] = [None, "", " \t\n ", "one", "one two three", "é ß 漢字 😀 x", "<|endoftext|> is text", prose(4000, 2), "a" * 5000, "x" * 64]
    out += [prose(rng.randrange(5, 200), 100 + i) for i in range(40)]
    out += [base] * 6
    for i in range(14):  # near copies: one to four words changed
        words = base.split()
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = f"changed{i}"
        out.append(" ".join(words))
    passage = prose(60, 3)
    out += [f"{prose(150, 200 + i)} {passage} {prose(150, 300 + i)}" for i in range(12)]
    return out


def documents(spark, extra: bool = True):
    rows = []
    for i, t in enumerate(texts()):
        source = None if i % 11 == 0 else f"s{i % 4}"
        rows.append((None if i % 17 == 3 else i, t, "en", source, None, i, -i, 0.5, 7, i, "u", i, 3))
    rows += [rows[20], rows[20], rows[53]]  # repeated rows
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame if extra else frame.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
