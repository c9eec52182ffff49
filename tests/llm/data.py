"""Small tables with every odd case."""

from __future__ import annotations

import random

SYLLABLES = "the tion er an re nd ha en ed to it ou ea hi is or ti as te et ng of al de se le".split()


def prose(seed: int, words: int) -> str:
    """Made-up text; equal seeds give equal text."""
    draw = random.Random(seed)
    out = ["".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3))) for _ in range(words)]
    return " ".join(w.capitalize() if i % 12 == 0 else w for i, w in enumerate(out))


# Extra columns whose names operators might use themselves.
CLASHING = ["bits", "key", "ids", "position", "rank", "words", "hash", "root", "shard", "block", "lang_pred", "score", "id_", "text_"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *(["x"] * len(CLASHING)))


def odd_rows() -> list[tuple]:
    passage = prose(99, 80)
    return [
        row(1, prose(1, 120)),
        row(2, prose(1, 120)),
        row(3, prose(1, 118) + " other end"),
        row(4, prose(2, 60) + " " + passage + " " + prose(3, 40)),
        row(5, passage + " " + prose(4, 70), "de"),
        row(6, prose(5, 30) + "\n" + passage.replace(" ", "\n"), "de"),
        row(7, None),
        row(8, ""),
        row(9, " \n\t "),
        row(10, "12 34 !! ##"),
        row(11, "word"),
        row(12, "two words"),
        row(13, prose(6, 30_000), "fr"),
        row(14, "x" * 20_000, "fr"),
        row(15, prose(7, 90), None, None),
        row(15, prose(7, 90), None, None),
        row(None, prose(8, 90)),
        row(None, None, None, None),
        row(17, "日本語 テキスト ½ ² 🙂🙂 á <|endoftext|> don't  stop\x1c", "ja"),
        row(18, "loop " * 300),
    ]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
