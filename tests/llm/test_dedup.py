"""Exact and line deduplication against plain Python on awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from tremorline.llm import exact_dedup, line_dedup

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def test_exact_groups(spark):
    rng = random.Random(1)
    texts = ["", None, "A b", "a B", "É x", "é x", "y" * 200_000, "Y" * 200_000, "z"]
    rows = [(i, rng.choice(texts), "x", "y") for i in range(300)] + [(None, "z", "", ""), (None, "only", "", ""), (7, "q", "", ""), (7, "q", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, content string").repartition(5)
    got = exact_dedup.deduplicate(docs, salts=3).collect()
    norm = lambda t: (t or "").translate(LOWER)
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = Counter()
    for i, text, *_ in rows:
        ids = groups[norm(text)]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256(norm(text).encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def brute_lines(rows, max_ratio, min_pages):
    word = lambda s: any(c not in " \t\n\v\f\r" for c in s)
    pages = Counter(h for _, h, _ in rows)
    counts = Counter((h, line) for _, h, t in rows for line in set((t or "").split("\n")) if word(line))
    boiler = {k for k, n in counts.items() if n >= min_pages and n > max_ratio * pages[k[0]]}
    out = Counter()
    for i, h, t in rows:
        lines = (t or "").split("\n")
        rest = [x for x in lines if (h, x) not in boiler]
        if any(map(word, lines)) and not any(map(word, rest)):
            rest = lines
        out[(i, None if t is None else "\n".join(rest), len(lines), len(lines) - len(rest))] += 1
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = ["menu", "home ", "", " ", "footer é", "a", "b", "c", "d" * 30_000, "e"]
    rows = [
        (i, rng.choice(["big", "big", "big", "small", None, ""]), rng.choice([None, "", "menu"] + ["\n".join(rng.choices(lines, k=rng.randint(1, 7))) for _ in range(9)]))
        for i in range(400)
    ] + [(None, "big", "menu\nunique"), (1, "big", "menu\nx"), (1, "big", "menu\nx")]
    schema = "doc_id long, host string, text string"
    pages = spark.createDataFrame(rows, schema).withColumn("lines", F.lit(1)).withColumn("digests", F.lit("d"))
    for ratio, least in ((0.3, 3), (0.05, 1), (0.9, 50)):
        got = line_dedup.drop_boilerplate(pages, F.col("host"), "text", ratio, least)
        got = Counter(map(tuple, got.select("row.doc_id", "text", "n_lines", "n_dropped").collect()))
        assert got == brute_lines(rows, ratio, least)
    assert line_dedup.drop_boilerplate(pages.limit(0), F.col("host")).count() == 0


def test_pages_of_boilerplate_alone_are_reported(spark):
    rows = [(i, "hot", "menu\nfooter") for i in range(6)] + [(6, "hot", "menu\n\nown"), (7, "hot", None), (8, "hot", " \n")]
    rows += [(9 + i, "tiny", "menu") for i in range(4)]  # fewer pages than the floor: nothing is found
    pages = spark.createDataFrame(rows, "doc_id long, host string, text string")
    got = line_dedup.drop_boilerplate(pages, F.col("host")).select("row.doc_id", "text", "n_dropped", "only_boilerplate").collect()
    assert {r.doc_id for r in got if r.only_boilerplate} == set(range(6))
    assert all(r.n_dropped == 0 and r.text == "menu\nfooter" for r in got if r.only_boilerplate)
    assert {r.doc_id: r.text for r in got}[6] == "\nown"


def test_host_of_a_url(spark):
    urls = ["http://A.example.org/x", "https://b.example.com:80?q", "ftp://c", "no url", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(line_dedup.host_of(F.col("url")))
    assert [r[0] for r in rows.collect()] == ["a.example.org", "b.example.com", "c", "", None]
