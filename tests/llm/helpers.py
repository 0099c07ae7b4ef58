"""Small documents with everything that operators must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, least long, chunk long"


def sentence(rng, words):
    return " ".join(rng.choice(("the river bends toward a quiet harbour while ships of many sizes wait for wind and rain "
                                "near stones grass lamps bridges towers gardens markets schools").split()) + rng.choice(["", "", "ly", "er", "x1"]) for _ in range(words))


def documents(seed=3, n=60):
    rng = random.Random(seed)
    shared = [sentence(rng, 14), sentence(rng, 30), "Licensed under the Open Terms, version 2.0"]
    texts = [None, "", " ", "a", "é", "日本語のテキスト", "\n\n", "x" * 49, "x" * 50, "x" * 400, "ab" * 300, "\x00nul\x00", "Und " * 100, "   two  spaces ", "end \t tab nbsp 😀"]
    for i in range(n):
        parts = [sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        texts.append("\n".join(parts))
    texts += texts[20:26] + [t.replace("river", "stream", 1) for t in texts[26:32]] + [sentence(rng, 4000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def frame(spark, rows, parts=3):
    """Documents with further columns whose names operators use themselves."""
    data = [(i, t, "en", "src", None if t is None else len(t), "clash", "clash", 1, 2) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)
