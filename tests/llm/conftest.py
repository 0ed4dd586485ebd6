import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo", "") for c in ("n", "s", "")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]).replace("\n", ".\n") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, shared passages, near copies, nulls, empty and odd ones; the list's index is the doc_id."""
    rng = random.Random(5)
    shared = prose(rng, 60)
    base = [prose(rng, rng.choice([3, 20, 80, 200])) for _ in range(30)]
    out = base[:]
    out += [base[3], base[3], base[7]]  # copies
    out += [base[k] + " " + shared + " " + base[k + 1] for k in range(8)]  # one passage in many texts
    near = base[8].split(" ")
    for k in (5, 9):
        out.append(" ".join(near[:k] + ["changed"] + near[k + 1 :]))
    out += [None, "", "   \n\t ", "x", "É ç ñ ß İ", "a" * 300, "ab " * 400, "  two  spaces\r\nand lines\x1c ", "<|endoftext|> text\x7f", "日本語 テキスト。", "emoji 🙂🙂 end", prose(rng, 3000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """As a table, with columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), i, "r", 0.5, True, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _h int, runs string, score double, kept boolean, _key int").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Repeated rows, ties and null ids."""
    rows = [(1, texts[3]), (1, texts[3]), (2, texts[3]), (2, texts[4]), (None, texts[3]), (None, None), (None, None), (3, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")
