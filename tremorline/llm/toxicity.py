"""Toxicity by a weighted finite-state grammar over clauses.

*Lexicon*: words and word beginnings with a weight, the log-odds that a document with them
is toxic, counted over labelled rows, besides short fixed lists of insults, threats,
targets, negations and verbs of reporting. The lexicon turns a clause into symbols.

*Grammar*: one transducer each for negation (an insult within a few words of a negation),
reported speech (an insult after a verb of reporting), targets (an insult after a person
spoken to or about) and threats (a threat with a target after it) rewrites those symbols.
They are composed into one machine, which reads each clause that holds an insult or a
threat. Its output arcs carry factors (``FACTORS``): an insult at a person and a threat
count more than an insult by itself, a negated or reported one is taken off. A clause is
worth the sum of factor times weight, or nothing if that is negative; words outside of such
clauses count for nothing.

*Score*: a logistic function of the clauses' worth, added up over the text, and of nothing
else. It is fitted on rows whose worth comes from a lexicon that has not seen them (two
folds), so that it knows what chance entries of a lexicon are worth; its slope is never
negative, so a match that raises a clause's worth never lowers the score.

Scale: the lexicon and the regression are fitted on at most ``TRAIN_ROWS`` labelled rows,
chosen by a hash of their id; scoring is work on single rows where they lie. The sample
(ids and labels only) and the lexicon (at most ``LEXICON_SIZE`` entries) are all that is
broadcast.

Defined cases: a missing or empty text has no clause and gets the score of one; without
labelled rows of both classes the fixed lists alone decide; rows without an id are scored
and never trained on; rows labelled twice count once, as toxic if any label says so;
repeated rows are scored each; a very long text is read whole, clause by clause; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.session import stage

TRAIN_ROWS = 20_000
LEXICON_SIZE = 20_000
PREFIXES = range(4, 9)
MIN_DOCS = 3
MIN_EVIDENCE = 15.0
FIXED_WEIGHT = 3.0

# Seeds of the lexicon in English, German, French and Spanish.
INSULTS = """idiot idiots stupid moron morons loser losers scum trash clown clowns pathetic worthless disgusting dumb fool
vermin filth garbage imbecile jerk dumm dummkopf idioten trottel arschloch abschaum versager widerlich erbärmlich
imbécile crétin débile connard ordure minable dégoûtant estúpido estúpida imbécil idiota basura escoria asqueroso patético""".split()
THREATS = """kill hurt destroy beat burn hang shoot stab töten umbringen schlagen verbrennen vernichten
tuer frapper brûler détruire pendre matar golpear quemar destruir colgar""".split()
TARGETS = """you your yourself he him she her they them we us people du dich dir dein ihr euch sie er ihn wir uns
tu te toi ton vous votre il elle ils elles eux nous tú ti usted ustedes él ella ellos ellas nosotros""".split()
NEGATIONS = "not never no nobody isn aren don doesn nicht nie kein keine niemand pas jamais aucun ni nunca jamás nadie".split()
REPORTS = """said says called calls wrote quoted claimed reported sagte nannte schrieb behauptete zitierte
dit appelé écrit cité prétendu dijo llamó escribió citó afirmó""".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ihtnro"
KINDS = ("plain", "directed", "negated", "reported", "threat")
# What an output symbol of the grammar is worth, in weights of the word it stands for.
FACTORS = {"I": 1.0, "D": 2.0, "N": -1.0, "R": -1.0, "T": 2.0}
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")


@dataclass
class Transducer:
    """Arcs state -> symbol -> (next state, output symbol); a symbol without an arc goes
    through unchanged and leads to ``rest[state]`` (the state itself if not given)."""

    arcs: dict[object, dict[str, tuple[object, str]]]
    start: object
    rest: dict[object, object] = field(default_factory=dict)

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        found = self.arcs.get(state, {}).get(symbol)
        return found if found else (self.rest.get(state, state), symbol)

    def compose(self, after: Transducer, symbols: str) -> Transducer:
        """The machine that gives the output of this one to ``after``."""
        start = (self.start, after.start)
        arcs: dict[object, dict[str, tuple[object, str]]] = {}
        waiting = [start]
        while waiting:
            state = waiting.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for symbol in symbols:
                mine, between = self.step(state[0], symbol)
                other, out = after.step(state[1], between)
                arcs[state][symbol] = ((mine, other), out)
                waiting.append((mine, other))
        return Transducer(arcs, start)


def grammar(scope: int = 3) -> Transducer:
    """Negation, then reported speech, then targets, as one machine.

    Output symbols: ``I`` plain, ``D`` directed, ``N`` negated and ``R`` reported insult,
    ``T`` threat at a target, ``h`` a threat that has not met one.
    """
    negation = Transducer(
        {
            **{k: {NEGATION: (scope, NEGATION), INSULT: (k - 1, "N"), THREAT: (k - 1, OTHER)} for k in range(1, scope + 1)},
            0: {NEGATION: (scope, NEGATION)},
        },
        0,
        {k: k - 1 for k in range(1, scope + 1)},
    )
    report = Transducer({0: {REPORT: (1, REPORT)}, 1: {INSULT: (1, "R"), "N": (1, "R"), THREAT: (1, OTHER)}}, 0)
    target = Transducer(
        {
            "open": {TARGET: ("met", TARGET), INSULT: ("open", "I"), THREAT: ("threat", THREAT)},
            "met": {INSULT: ("met", "D"), THREAT: ("threat", THREAT)},
            "threat": {TARGET: ("met", "T"), INSULT: ("threat", "D")},
        },
        "open",
    )
    symbols = "".join((INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER))
    return negation.compose(report, symbols).compose(target, symbols)


_PLACE = {"I": 0, "D": 1, "N": 2, "R": 3, "T": 4}


class ClauseScorer:
    """Sums of weights by kind for a text, under a lexicon of words and beginnings."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], threat: float = FIXED_WEIGHT) -> None:
        self.words, self.beginnings = words, beginnings
        self.machine = grammar()
        self.fixed = {
            **{w: (REPORT, 0.0) for w in REPORTS},
            **{w: (NEGATION, 0.0) for w in NEGATIONS},
            **{w: (TARGET, 0.0) for w in TARGETS},
            **{w: (THREAT, threat) for w in THREATS},
        }
        self.memory: dict[str, tuple[str, float] | None] = {}

    def symbol(self, word: str) -> tuple[str, float] | None:
        """Symbol and weight of a word; None for one that the grammar passes over."""
        if word in self.fixed:
            return self.fixed[word]
        weight = self.words.get(word)
        if weight is None:
            found = [self.beginnings[word[:k]] for k in PREFIXES if k < len(word) and word[:k] in self.beginnings]
            weight = max(found, default=None)
        return None if weight is None else (INSULT, weight)

    def sums(self, text: str) -> list[float]:
        """Weights matched by kind, then the worth of the clauses."""
        memory = self.memory
        tokens = _TOKEN.findall(text.lower())
        for word in set(tokens).difference(memory):
            if len(memory) > 500_000:
                memory.clear()
            memory[word] = self.symbol(word)
        lookup = [memory.get(t) or (self.symbol(t) if t not in memory else None) for t in tokens]
        out = [0.0] * (len(KINDS) + 1)
        marked = [i for i, s in enumerate(lookup) if s is not None and s[1] > 0]
        done = 0
        for i in marked:
            if i < done:
                continue
            first = i
            while first and tokens[first - 1] not in _ENDS:
                first -= 1
            last = i
            while last < len(tokens) and tokens[last] not in _ENDS:
                last += 1
            self._read(lookup[first:last], out)
            done = last
        return out

    def _read(self, clause: list[tuple[str, float] | None], out: list[float]) -> None:
        state, step, pending, worth = self.machine.start, self.machine.step, 0.0, 0.0
        for found in clause:
            symbol, weight = found or (OTHER, 0.0)
            state, result = step(state, symbol)
            if result == THREAT:
                pending = weight
            elif result in FACTORS:
                value = pending if result == "T" else weight
                out[_PLACE[result]] += value
                worth += FACTORS[result] * value
        out[-1] += max(0.0, worth)


def worth(sums: Column) -> Column:
    """What the score is a function of: the worth of all clauses, on a log scale."""
    return F.log1p(F.get(sums, F.lit(len(KINDS))))


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def held_out(id_col: str) -> Column:
    return F.coalesce(remainder(id_col) == 1, F.lit(False))


def sample(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """About ``rows`` training rows at most: id, label, fold (0 or 1)."""
    usable = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("sample_id"))
        .agg(F.max(label_col).alias("label"))
    )
    share = min(1.0, rows / max(1, usable.count()))
    return usable.filter(F.pmod(F.xxhash64("sample_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(
        "sample_id", "label", (remainder("sample_id") == 2).cast("int").alias("fold")
    )


def counted_terms(train: DataFrame) -> DataFrame:
    """Documents with each word (``w:``) and word beginning (``p:``), by label and fold.

    Copies of a text count once.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                "words",
                lambda w: F.transform(
                    F.filter(F.array(*map(F.lit, PREFIXES)), lambda k: k < F.length(w)),
                    lambda k: F.concat(F.lit("p:"), F.substring(w, F.lit(1), k)),
                ),
            )
        )
    )
    once = train.dropDuplicates(["text_key"]).select("label", "fold", words.alias("words"))
    terms = F.concat(F.transform("words", lambda w: F.concat(F.lit("w:"), w)), starts)
    toxic = F.col("label") > 0
    return (
        once.select("label", "fold", F.explode(terms).alias("term"))
        .groupBy("term")
        .agg(
            *(
                F.count_if(which & (F.col("fold") == fold)).alias(f"n{int(label)}_{fold}")
                for fold in (0, 1)
                for label, which in ((True, toxic), (False, ~toxic))
            )
        )
    )


def lexicon(terms: DataFrame, totals: dict[tuple[int, int], int], folds: tuple[int, ...]) -> ClauseScorer:
    """The scorer whose lexicon is counted over ``folds``."""
    with_term = {k: sum((F.col(f"n{k}_{f}") for f in folds), F.lit(0)) for k in (0, 1)}
    size = {k: sum(totals.get((k, f), 0) for f in folds) for k in (0, 1)}
    words = dict.fromkeys(INSULTS, FIXED_WEIGHT)
    beginnings: dict[str, float] = {}
    if size[0] and size[1]:
        weight = F.log((with_term[1] + 0.5) / (size[1] + 1)) - F.log((with_term[0] + 0.5) / (size[0] + 1))
        # Evidence that the term goes with the label: grows with the documents that show it.
        seen = with_term[1] + with_term[0]
        chance = size[1] / (size[0] + size[1])
        part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
        evidence = 2 * (part(with_term[1], seen * chance) + part(with_term[0], seen * (1 - chance)))
        found = (
            terms.filter(with_term[1] >= MIN_DOCS)
            .select("term", weight.alias("weight"), evidence.alias("evidence"))
            .filter((F.col("weight") > math.log(8)) & (F.col("evidence") >= MIN_EVIDENCE))
            .orderBy(F.desc("evidence"), "term")
            .limit(LEXICON_SIZE)
            .collect()
        )
        for row in found:
            (words if row.term[0] == "w" else beginnings)[row.term[2:]] = row.weight
    # Seeds too rare to be learned, and threats, weigh what the seeds that were learned do.
    learned = [words[w] for w in INSULTS if words[w] != FIXED_WEIGHT]
    usual = max(FIXED_WEIGHT, sum(learned) / len(learned)) if learned else FIXED_WEIGHT
    seeds = {w: usual for w in INSULTS if words[w] == FIXED_WEIGHT}
    return ClauseScorer(words | seeds, beginnings, usual)


def summed(docs: DataFrame, scorers: dict[int, ClauseScorer], text_col: str, keep: list[str], which: str | None = None) -> DataFrame:
    """``keep`` columns and ``sums``; column ``which`` names the scorer of a row (else 0)."""
    columns = [*keep, text_col, *([which] if which else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            numbers = batch.column(which).to_pylist() if which else [0] * len(texts)
            sums = [scorers[n].sums(t or "") for n, t in zip(numbers, texts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sums, pa.list_(pa.float64()))], [*keep, "sums"]
            )

    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}
    return docs.select(*dict.fromkeys(columns)).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", sums array<double>")


@dataclass
class Model:
    scorer: ClauseScorer
    slope: float
    intercept: float


# Used where there are no labels to fit on.
FALLBACK = (2.5, -2.0)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = TRAIN_ROWS,
) -> Model:
    """Lexicon and regression from labelled rows that are not held out."""
    chosen = sample(labels, id_col, label_col, rows)
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample is bounded by ``rows``: some tens of bytes each.
    train = texts.join(F.broadcast(chosen), texts["doc"] == chosen["sample_id"]).select(
        "text", "label", "fold", F.sha2("text", 256).alias("text_key")
    )
    train = stage(train, "toxicity_train")
    totals = {
        (int(r.toxic), r.fold): r.n
        for r in train.groupBy((F.col("label") > 0).alias("toxic"), "fold").agg(F.countDistinct("text_key").alias("n")).collect()
    }
    terms = stage(counted_terms(train).filter(F.col("n1_0") + F.col("n1_1") >= MIN_DOCS), "toxicity_terms")
    scorers = {0: lexicon(terms, totals, (1,)), 1: lexicon(terms, totals, (0,))}
    final = lexicon(terms, totals, (0, 1))
    if {k for k, _ in totals} != {0, 1}:
        return Model(final, *FALLBACK)
    seen = stage(summed(train, scorers, "text", ["label"], "fold"), "toxicity_sums")
    points = seen.select(
        (F.col("label") > 0).cast("double").alias("label"), array_to_vector(F.array(worth(F.col("sums")))).alias("features")
    )
    fitted = LogisticRegression(maxIter=60, regParam=1e-4).fit(points)
    return Model(final, max(0.0, float(fitted.coefficients[0])), float(fitted.intercept))


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7
) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 from ``threshold`` on)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sums = summed(rows, {0: model.scorer}, "text", ["id"])
    margin = worth(F.col("sums")) * model.slope + model.intercept
    return sums.select("id", (1 / (1 + F.exp(-margin))).alias("score")).select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
