"""Quality counts against plain Python on awkward texts."""

import random
import re
from collections import Counter

from tremorline.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def test_counts(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a", "\x1c \x85 x", "a " * 8, "a " * 9, "ab cd " * 30_000, "x" * 300_000, "<|> ## é\U0001f600 $"]
    for _ in range(150):
        vocabulary = ["a", "b", "the", "é#", "c|d"][: rng.randint(1, 5)]
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  ", "\n\n", "\v"]) for _ in range(rng.randint(0, 60))))
    rows = [(i, t, 0, True) for i, t in enumerate(texts)] + [(None, "a", 1, None), (3, "a", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")
    got = quality_rules.judge(docs).select("row.doc_id", "row.text", *quality_rules.COUNTS, "base_failed", "kept")
    seen = 0
    for r in got.collect():
        assert tuple(r)[2:8] == brute(r.text), r.text
        assert not (r.kept and r.base_failed)
        seen += 1
    assert seen == len(rows)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_ordinary_prose_stays_and_junk_goes(spark):
    prose = "It was the best of times, it was the worst of times, and the people in the town of that name had no idea of it at all."
    docs = spark.createDataFrame(
        [(1, prose), (2, " ".join(w + "###" for w in prose.split())), (3, prose[:40]), (4, (prose + "\n") * 5), (5, " | ".join("xq zk vv".split() * 9))],
        "doc_id long, text string",
    )
    assert [r.doc_id for r in quality_rules.keep_good(docs).collect()] == [1]
