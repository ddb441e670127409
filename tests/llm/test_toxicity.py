"""Toxicity: the grammar against plain rules, and accuracy on rows it has not seen."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tremorline.llm import queries, toxicity


def by_rules(symbols, scope=3):
    """What the composed machine should say, written as plain rules."""
    out, negated, reported, state = [], 0, False, "open"
    for s in symbols:
        mid = s
        if s == "n":
            negated = scope
        elif negated:
            mid, negated = {"i": "N", "h": "o"}.get(s, s), negated - 1
        if mid == "r":
            reported = True
        elif reported and mid in "iNh":
            mid = "o" if mid == "h" else "R"
        if mid == "t":
            out.append("T" if state == "threat" else "t")
            state = "met"
        elif mid == "i":
            out.append("I" if state == "open" else "D")
        else:
            out.append(mid)
            state = "threat" if mid == "h" else state
    return out


def test_composed_machine_equals_the_rules():
    machine = toxicity.grammar()
    for symbols in itertools.chain.from_iterable(itertools.product("ihtnro", repeat=k) for k in range(6)):
        state, out = machine.start, []
        for s in symbols:
            state, result = machine.step(state, s)
            out.append(result)
        assert out == by_rules(symbols), symbols


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("what an idiot", "plain"),
        ("you are an idiot", "directed"),
        ("this man is not an idiot", "negated"),
        ("somebody said idiot", "reported"),
        ("kill them", "threat"),
        ("nice day. Idiot weather", "plain"),
    ],
)
def test_kinds_of_clauses(text, kind):
    sums = toxicity.ClauseScorer({"idiot": 3.0}, {}).sums(text)
    assert [k for k, v in zip(toxicity.KINDS, sums) if v > 0] == [kind]
    assert (sums[-1] > 0) == (kind not in ("negated", "reported"))


def test_clauses_without_a_match_count_for_nothing():
    scorer = toxicity.ClauseScorer({"idiot": 3.0}, {"slurr": 2.0})
    assert scorer.sums("You said nothing. They do not care, do they?") == [0.0] * 6
    assert scorer.sums("slurrish")[0] == 2.0 and scorer.sums("slurr")[0] == 0.0


def scores_of(texts, model):
    return [1 / (1 + math.exp(-(model.slope * math.log1p(model.scorer.sums(t)[-1]) + model.intercept))) for t in texts]


def test_order_of_clauses(spark, sf_dir):
    docs, labels = (queries.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    plain, directed, negated, reported, threat, nothing, longer, two, unmatched = scores_of(
        [
            "what an idiot.", "you are an idiot.", "you are not an idiot.", "somebody said idiot.", "I will kill you.",
            "a nice day.", "what an idiot. " + "a nice day, it was. " * 90, "what an idiot. you idiot.", "they kill time.",
        ],
        model,
    )
    assert model.slope > 0
    assert directed > plain > nothing == negated == reported == unmatched and threat > plain
    assert longer == plain and two > directed


def by_hand(text, scorer):
    """Worth of a text by the plain rules above."""
    worth = 0.0
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        found = [scorer.symbol(w) or ("o", 0.0) for w in re.findall(r"[^\W\d_]+", clause)]
        value, pending = 0.0, 0.0
        for (symbol, weight), out in zip(found, by_rules([s for s, _ in found])):
            pending = weight if out == "h" else pending
            value += {"I": weight, "D": 2 * weight, "N": -weight, "R": -weight, "T": 2 * pending}.get(out, 0.0)
        worth += max(0.0, value)
    return worth


def test_scores_of_the_whole_table_equal_the_rules(spark, sf_dir):
    docs, labels = (queries.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in queries.op3_toxicity(spark, sf_dir).collect()}
    assert sum(model.scorer.sums(r.text or "")[-1] > 0 for r in docs.collect()) > 5
    for r in docs.collect():
        margin = model.slope * math.log1p(by_hand(r.text or "", model.scorer)) + model.intercept
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)


def corpus(rng, n):
    """Invented prose; toxic rows hold words that begin with one of two invented stems."""
    syllables = ["ba", "ko", "ti", "re", "mu", "sa", "lo", "ne", "vi", "du"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    for i in range(n):
        words = [word() + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(30, 150))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["zhuk", "qrell"]) + rng.choice(syllables))
        yield i, " ".join(words), int(toxic)


def test_held_out_rows(spark):
    rows = list(corpus(random.Random(8), 1500))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    wrong = sum(r.predicted != r.toxic for r in scored)
    assert len(scored) > 400 and wrong <= 0.02 * len(scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = list(corpus(random.Random(9), 300))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (dict(toxicity.score(docs, toxicity.fit(docs, y)).select("doc_id", "score").collect()) for y in (labels, flipped))
    assert one == two


def test_awkward_rows(spark):
    rows = [(None, "idiot", 1), (1, None, 1), (1, None, 1), (2, "", 0), (3, "You idiot! " * 30_000, 0), (4, "x" * 200_000, 0), (5, "you idiot", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sums int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(2, 0), (2, 1), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")):
        model = toxicity.fit(docs, labels)
        assert toxicity.score(docs, model).count() == len(rows)
        assert toxicity.score(docs.limit(0), model).count() == 0
    scores = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in scores)
    by_id = {r.doc_id: r.predicted for r in scores}
    assert by_id[5] == by_id[3] == 1 and by_id[2] == by_id[4] == by_id[1] == 0


def test_query(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    got = queries.op3_toxicity(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == docs.count()
