"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read as symbols: insults (in four strengths), threatening verbs, words
of intent, targets, negation, reported speech. Transducers pass it on to each
other: negation and reported speech mark the insults and verbs in their scope, the
target transducer marks insults next to whoever is addressed, the threat transducer
accepts intent, verb and target in order. Their composition is one automaton,
built as far as texts walk it; the state it ends a clause in names the clause's
patterns, such as "strong insult, aimed at someone" or "threat, reported". A
document is scored by how many of its clauses match which pattern, with a weight
for each pattern.

Insult words and stems and the pattern weights are learned from labelled rows, the
weights over matches of a lexicon learned from other rows than those it is
matched in. A pattern that too few rows show has a fixed weight or a share of that of its
plain form. The cue words of the other transducers are fixed lists. Scoring is
one pass over each text: no shuffle, memory bounded by the text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import Shared, clean_text, latest, small_batches, write_table

# Bound of the labelled rows that are learned from, which bounds what is learned and broadcast.
TRAIN_ROWS = 20_000
STEM_LENGTHS = tuple(range(3, 11))
# A word's or stem's evidence (twice the log-likelihood ratio) and odds ratios of the strengths.
EVIDENCE = 20.0
STRENGTHS = (1.2, 2.2, 3.5, 5.0)
THRESHOLD = 0.3
FOLDS = 5
# Rows that must show a pattern for its weight to be learned; else the weights of threats by context,
# and the shares of the plain insult's weights.
SUPPORT = 20
THREAT_WEIGHTS = (0.0, 7.0, 1.0, 1.0)
SHARES = (1.0, 1.0, 0.3, 0.3)

# Cue words in four languages.
TARGETS = "you your yours yourself he him his she her they them their du dich dir dein deine ihr euch sie tu te toi ton vous votre il elle ils usted ustedes vosotros ellos ella"
NEGATIONS = "not no never neither nor none isn aren wasn don doesn nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás tampoco"
REPORTS = "said says say told wrote quoted quote called reported according sagte sagt schrieb laut zitiert dit disait écrit selon cité dijo dice escribió según citado"
INTENTS = "will ll shall gonna going must should wanna werde werden wird soll sollte muss vais va allons veux doit voy vamos quiero debe"
VERBS = (
    "kill killing murder murdering hurt hurting destroy destroying punish beat beating burn burning shoot shooting stab stabbing strangle smash "
    "töten umbringen schlagen vernichten erschießen verprügeln verletzen zerstören tuer frapper détruire brûler massacrer égorger matar golpear destruir quemar"
)
# Targets that stand before the verb as its object, and words that are two symbols at once.
OBJECTS = "dich dir euch te vous"
INTENT_VERBS = "tuerai tuerons frapperai détruirai brûlerai mataré mataremos golpearé destruiré quemaré"
VERB_TARGETS = "matarte matarlo matarla matarlos golpearte destruirte quemarte"

OTHER, BREAK, TARGET, OBJECT, NEGATION, REPORT, INTENT, VERB, INSULT = range(9)  # INSULT + strength
SYMBOLS = INSULT + len(STRENGTHS)
PLAIN, AIMED, NEGATED, REPORTED = range(4)  # contexts of an insult; a threat is aimed at least
SCOPE = 3  # words that negation, a target and intent reach
_TOKEN = regex.compile(r"[^\W\d_]+|[.!?;:\n]")

# ---- the transducers: (state, input) -> state, output


def negation_step(left: int, symbol: int) -> tuple[int, bool]:
    """State: words that the last negation still reaches. Output: is this word negated?"""
    return (SCOPE if symbol == NEGATION else max(left - 1, 0)), left > 0


def report_step(open_: bool, symbol: int) -> tuple[bool, bool]:
    """Words of reporting reach to the end of the clause. Output: is this word reported?"""
    return open_ or symbol == REPORT, open_


def target_step(state: tuple, symbol: int, context: int) -> tuple[tuple, int]:
    """State: words that the last target still reaches, strengths of the plain insults of the last three words.
    Output: the pattern met at this word, 0 if none."""
    left, recent = state
    strength = symbol - INSULT + 1 if symbol >= INSULT else 0
    addressed = symbol in (TARGET, OBJECT)
    if strength and context == PLAIN and left:
        context = AIMED
    met = strength * 4 + context if strength else max(recent) * 4 + AIMED if addressed and any(recent) else 0
    recent = (0,) * SCOPE if addressed else (strength if context == PLAIN else 0, *recent[:-1])
    return (SCOPE if addressed else max(left - 1, 0), recent), met


def threat_step(state: tuple, symbol: int, context: int) -> tuple[tuple, int]:
    """Intent, verb and target in order, or the object before the verb or before the intent ("te voy a matar").
    State: words that intent, object and both together still reach, contexts of the verbs of the last two words.
    Output: the context of the threat met at this word, 0 if none."""
    intent, object_, both, verbs = state
    found = [c for c in verbs if c] if symbol in (TARGET, OBJECT) else []
    if symbol == VERB and both:
        found.append(max(context, AIMED))
    verb = max(context, AIMED) if symbol == VERB and intent else 0
    after = lambda left: max(left - 1, 0)
    joined = (symbol == OBJECT and intent) or (symbol == INTENT and object_)
    state = (
        SCOPE if symbol == INTENT else after(intent),
        2 if symbol == OBJECT else after(object_),
        SCOPE if joined else after(both),
        (verb, verbs[0]),
    )
    return state, min(found, default=0)


def worse(a: int, b: int) -> int:
    """Of two insult patterns the graver: neither negated nor reported, then the stronger, then the aimed one."""
    return max(a, b, key=lambda p: (p > 0, p % 4 < NEGATED, p // 4, p % 4 in (AIMED, NEGATED)))


START = (0, False, (0, (0,) * SCOPE), (0, 0, 0, (0, 0)), 0, 0)


def step(state: tuple, symbol: int) -> tuple:
    """The composition: what negation and report emit is read by the target and the threat transducer."""
    negation, report, target, threat, insult_met, threat_met = state
    negation, negated = negation_step(negation, symbol)
    report, reported = report_step(report, symbol)
    context = REPORTED if reported else NEGATED if negated else PLAIN
    target, met = target_step(target, symbol, context)
    threat, threatened = threat_step(threat, symbol, context)
    threat_met = min(filter(None, (threat_met, threatened)), default=0)
    return negation, report, target, threat, worse(insult_met, met), threat_met


class Automaton:
    """The composed automaton by number of state, built as it is walked, and the patterns that each state stands for."""

    def __init__(self, most: int = 1 << 16):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number = {START: 0}
        self.states, self.table, self.patterns = [START], [[-1] * SYMBOLS], [()]

    def walk(self, clause: bytes) -> tuple[int, ...]:
        """The insult's pattern and the threat's, as far as the clause holds them."""
        if len(self.states) > self.most:
            self.clear()
        at, table = 0, self.table
        for symbol in clause:
            after = table[at][symbol]
            at = after if after >= 0 else self._build(at, symbol)
        return self.patterns[at]

    def _build(self, at: int, symbol: int) -> int:
        state = step(self.states[at], symbol)
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
            self.table.append([-1] * SYMBOLS)
            self.patterns.append(tuple(p for p in state[-2:] if p))
        self.table[at][symbol] = found
        return found


PATTERNS = (1 + len(STRENGTHS)) * 4  # threats by context, then insults by strength and context
FEATURES = 2 * PATTERNS


class Grammar:
    """The composed automaton with a learned lexicon: term -> (strength, evidence); stems end in "*"."""

    def __init__(self, lexicon: dict[str, tuple[int, float]]):
        self.lexicon = lexicon
        lists = ((NEGATIONS, [NEGATION]), (REPORTS, [REPORT]), (INTENTS, [INTENT]), (VERBS, [VERB]))
        lists = ((TARGETS, [TARGET]), (OBJECTS, [OBJECT]), *lists, (INTENT_VERBS, [INTENT, VERB]), (VERB_TARGETS, [VERB, TARGET]))
        self.cues = {w: bytes(symbols) for words, symbols in lists for w in words.split()}
        self.automaton = Automaton()
        self.breaks = dict.fromkeys(".!?;:\n", bytes([BREAK]))
        self.known = dict(self.breaks)
        self.cold = bytes(range(VERB))

    def symbol(self, word: str) -> bytes:
        """The lexicon transducer: a word's own entry or that of its best stem, else its cue."""
        found = [e for t in (word, *(word[:n] + "*" for n in STEM_LENGTHS if n <= len(word))) if (e := self.lexicon.get(t))]
        s = bytes([INSULT + max(found, key=lambda e: e[1])[0]]) if found else self.cues.get(word, b"\0")
        if len(self.known) > 1 << 17:
            self.known = dict(self.breaks)
        self.known[word] = s
        return s

    def clauses(self, text: str) -> tuple[Counter, int]:
        """How many clauses match each pattern, and the number of words."""
        words = _TOKEN.findall(text.lower())
        known = self.known
        symbols = b"".join([known[w] if w in known else self.symbol(w) for w in words])
        counts: Counter = Counter()
        if symbols.translate(None, self.cold):  # some verb or insult
            for clause in symbols.split(bytes([BREAK])):
                if clause.translate(None, self.cold):
                    counts.update(self.automaton.walk(clause))
        return counts, len(words)

    def features(self, text: str) -> list[float]:
        """Of each pattern, the logarithm of one plus its clauses, and the same of its clauses per 1,000 words."""
        counts, n = self.clauses(text)
        out = [0.0] * FEATURES
        for p, c in counts.items():
            out[p] = math.log1p(c)
            out[PATTERNS + p] = math.log1p(1000 * c / n)
        return out


def _stems(words: str, n: int):
    """The first ``n`` letters of each word that has so many, with a star."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def _fold(text: str):
    return F.pmod(F.xxhash64(text, F.lit(1)), F.lit(FOLDS)).cast("int")


def learn_lexicons(train: DataFrame) -> list[dict[str, tuple[int, float]]]:
    """Terms and stems that mark toxic rows, from ``text, toxic``: from all rows, then from those outside each fold.

    A term is in by its evidence alone, so each needs several toxic rows and their number is bounded by the rows.
    """
    rows = train.groupBy(F.xxhash64("text").alias("row")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    words = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))
    stems = [_stems("words", n) for n in STEM_LENGTHS]
    folded = rows.select("toxic", _fold("text").alias("fold"), words.alias("words"))
    terms = folded.select("toxic", "fold", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term")).where(F.length("term") > 1)
    within = lambda k, c: F.sum(F.when(F.col("fold") == k, c).otherwise(0))
    toxic, clean = F.col("toxic"), 1 - F.col("toxic")
    sums = [within(k, c).alias(f"{name}{k}") for k in range(FOLDS) for name, c in (("pos", toxic), ("neg", clean))]
    total = folded.agg(*sums).first()
    if total.pos0 is None:
        return [{}] * (FOLDS + 1)
    counted = terms.groupBy("term").agg(*sums)
    measures, usable = [], []
    for left_out in (None, *range(FOLDS)):
        used = [k for k in range(FOLDS) if k != left_out]
        pos, neg = (sum(F.col(f"{name}{k}") for k in used) for name in ("pos", "neg"))
        all_pos, all_neg = (sum(total[f"{name}{k}"] for k in used) for name in ("pos", "neg"))
        usable.append(all_pos > 0 and all_neg > 0)
        p = all_pos / max(all_pos + all_neg, 1)
        part = lambda k, n, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0) if share else F.lit(0.0)
        evidence = 2 * (part(pos, pos + neg, p) + part(neg, pos + neg, 1 - p))
        odds = F.log((pos + 0.5) / (all_pos + 1)) - F.log((neg + 0.5) / (all_neg + 1))
        measures.append(F.when((evidence >= EVIDENCE) & (odds >= STRENGTHS[0]), F.struct(evidence.alias("evidence"), odds.alias("odds"))))
    found = counted.select("term", F.array(*measures).alias("m")).where(F.exists("m", lambda x: x.isNotNull())).collect()
    strength = lambda odds: sum(odds >= s for s in STRENGTHS) - 1
    return [
        _most_specific({r.term: (strength(r.m[k].odds), r.m[k].evidence) for r in found if r.m[k]}) if ok else {}
        for k, ok in enumerate(usable)
    ]


def _most_specific(terms: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    """Without the stems that a longer term replaces at (nearly) no loss of evidence."""
    best: dict[str, float] = {}
    for term, (_, evidence) in terms.items():
        body = term.rstrip("*")
        for n in STEM_LENGTHS:
            if n < len(body) or (n == len(body) and term == body):
                stem = body[:n] + "*"
                best[stem] = max(best.get(stem, 0.0), evidence)
    return {t: e for t, e in terms.items() if best.get(t, 0.0) < 0.95 * e[1]}


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = [Grammar(lexicon) for lexicon in shared.value]
        for batch in batches:
            found = [grammars[k.as_py()].features(t.as_py() or "") for t, k in zip(batch.column(0), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["features", "toxic"])

    return run


def fallback(weights: list[float], rows: list[int]) -> list[float]:
    """The weights, but those of patterns that fewer than ``SUPPORT`` rows show: fixed for threats, for others a share
    of the plain insult's, unless that is rarer still."""
    out = list(weights)
    for p in range(PATTERNS):
        if rows[p] >= SUPPORT:
            continue
        context = p % 4
        if p < 4:
            out[p], out[PATTERNS + p] = THREAT_WEIGHTS[context], 0.0
        elif rows[p] <= rows[p - context]:
            out[p], out[PATTERNS + p] = (SHARES[context] * weights[at + p - context] for at in (0, PATTERNS))
    return out


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Lexicon and pattern weights from at most ``rows`` labelled rows that aren't held out, those with the least id hash."""
    small_batches(docs.sparkSession)
    marked = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = write_table(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "label-sample")
    train = write_table(docs.select("doc_id", clean_text("text").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic"), "labelled")
    lexicon, *others = learn_lexicons(train)
    model = {"lexicon": lexicon, "weights": fallback([0.0] * FEATURES, [0] * PATTERNS), "bias": math.log(0.01)}
    if lexicon:
        rows_by_fold = train.select("text", "toxic", _fold("text").alias("fold"))
        found = rows_by_fold.mapInArrow(_featured(Shared(docs.sparkSession, others)), "features array<double>, toxic int")
        table = write_table(found, "clause-features")
        shown = table.agg(*(F.count_if(F.col("features")[p] > 0).alias(f"p{p}") for p in range(PATTERNS))).first()
        found = table.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"))
        lr = LogisticRegression(regParam=1e-4, standardization=False, maxIter=100).fit(found)
        model |= {"weights": fallback([float(w) for w in lr.coefficients], list(shown)), "bias": float(lr.intercept)}
    return model


def _scorer(shared):
    return latest(shared, lambda m: (Grammar(m["lexicon"]), m["weights"], m["bias"]))


def _score(scorer, text: str) -> float:
    grammar, weights, bias = scorer
    z = bias + sum(w * x for w, x in zip(weights, grammar.features(text), strict=True) if x)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, held_out, score, predicted``.

    ``score`` is the probability of the label, ``predicted`` is 1 from 0.3 on. Null
    and empty texts match nothing and get the score of no pattern. Only the text
    is scored; null ids and repeated rows are kept; other columns are ignored.
    """
    shared = Shared(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            scores = [_score(scorer, t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                names=[id_col, "held_out", "score", "predicted"],
            )

    rows = docs.select(id_col, held_out(id_col).alias("held_out"), docs[text_col].cast("string").alias(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, unshuffled; nulls as in ``score_documents``."""
    shared = Shared(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            yield batch.filter(pa.array([_score(scorer, t.as_py() or "") < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
