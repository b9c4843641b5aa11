"""Small tables with the cases that every operator must define, and more by a seed."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id int, tag string"


def words(rnd, n):
    return [rnd.choice(("the", "of", "and", "Thre", "inan", "ête", "ölig", "rewh,", "onnd.", "blesting", "stion", "anea", "haer", "tith")) + rnd.choice(("", "a", "er", "ou", "ti", "sh")) for _ in range(n)]


def corpus(seed=7, n=40):
    """(doc_id, text): edge cases, exact and near copies, shared passages, repeats, long words and texts."""
    rnd = random.Random(seed)
    passage = words(rnd, 60)
    texts = [None, "", "   \n\t", "one", "two words", "A b C", "a\x0bb\x0cc\rd", "😀 日本語 ́x", "x" * 5000, "For " * 300, "<|endoftext|> don't 'tis", "same text here", "same  text\nhere", "SAME text here"]
    for i in range(n):
        text = words(rnd, rnd.randrange(20, 400))
        if i % 4 == 0:
            at = rnd.randrange(len(text))
            text[at:at] = passage
        texts.append(" ".join(text))
        if i % 5 == 0:
            texts.append(texts[-1])
            near = list(text)
            near[rnd.randrange(len(near))] = "changed"
            texts.append("\n".join(near))
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    ids = [i for i, _ in rows]
    texts = [t for _, t in rows]
    return list(zip(ids, texts, strict=True)) + [(None, "null id"), (None, texts[20]), (3, "one"), (3, texts[21])]


def frame(spark, rows, parts=3):
    full = [(i, t, "en", "s", 0, "x", 1, "y") for i, t in rows]
    return spark.createDataFrame(full, DDL).repartition(parts)
