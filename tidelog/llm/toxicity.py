"""Operator 5: toxicity by a weighted finite-state pattern grammar.

Texts are cut into clauses; each word becomes a label (insult, threat, target, intent, negation,
reported speech, other). Five transducers - reported speech, negation, threats, insults and scoring -
are composed into one machine, which runs over the labels of a clause and yields the clause's weight.
A threat is a pattern of several words: an intent, a verb of violence and a person, in this order and
near one another, or the person before the verb; verb and person without an intent count for less. An insult weighs more near a
person. What is negated or somebody else's speech keeps a part of its weight. A text's score is the
logistic of a base plus its clauses' weights.

Which words are insults is learned from labelled rows: stems and words far commoner in toxic than in
other texts, with their log-odds as arc weights. The weights of the threat patterns start from fixed
values and move to their log-odds in the labelled rows with the number of texts that have them. At
most ``train_rows`` labelled rows are used, those of the smallest key hash (a documented bound); every
text is scored whole.

Defined cases: null and empty texts score the base; labels of null are not learned from; rows that
repeat get the same score; without usable labels the fixed word lists alone are the grammar; an empty
table gives an empty result; very long texts are read clause by clause, whole; columns that are
carried keep their names and values, but for _score and _clauses, which are the results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.shared import small_batches

# Labels of the grammar. Small letters are labels a transducer has rewritten: an insult or threat that is
# negated (n) or reported (r), an insult aimed at somebody (i), a verb of violence after an intent (h). The
# word that ends a threat becomes one of WHOLE, with and without an intent.
OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT = "OIHTWNR"
WHOLE = "Kk"

# Weights of whole threats before labels are seen.
THREAT_WEIGHTS = {"K": 3.5, "k": 1.0}

# Fixed word lists, by language en, de, fr, es.
TARGETS = "you your youre yourself they them he she his her we us du dich dir dein ihr euch sie ihn er tu te toi vous il elle ils lui eux leur tú usted ustedes él ella ellos vosotros".split()
NEGATIONS = "not no never isnt arent wasnt dont nicht kein keine keinen nie niemals ne pas jamais aucun no nunca jamás ningún ninguna".split()
REPORTS = "said says say claimed wrote quoted called reported sagte sagt schrieb behauptete nannte dit disait écrit déclaré appelé dijo dice escribió afirmó llamó".split()
INTENTS = "will gonna shall should must going deserve deserves i'll we'll they'll werde werden wirst wird soll sollte sollten vais va allons vont devrait devraient mérite méritent voy va vamos van deberían merece merecen".split()
THREATS = "kill hurt destroy stab shoot töten umbringen verletzen schlagen tuer frapper blesser détruire matar golpear herir destruir".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
STEMS = (3, 4, 5, 6, 7)  # characters of the stems that are tried
STOPS = frozenset(".!?;:\n")


class Transducer:
    """Arcs (state, label) -> (state, label out, weight); a label without an arc passes unchanged and leads to ``rest``."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], rest: dict[int, int] | None = None) -> None:
        self.arcs, self.rest = arcs, rest or {}

    def step(self, state: int, label: str) -> tuple[int, str, float]:
        got = self.arcs.get((state, label))
        return got or (self.rest.get(state, state), label, 0.0)


class Composed(Transducer):
    """The composition of two transducers, its states made as they are reached."""

    def __init__(self, first: Transducer, second: Transducer) -> None:
        self.first, self.second = first, second
        self.pairs, self.ids, self.known = [(0, 0)], {(0, 0): 0}, {}

    def step(self, state: int, label: str) -> tuple[int, str, float]:
        if (got := self.known.get((state, label))) is None:
            p, q = self.pairs[state]
            p, mid, w1 = self.first.step(p, label)
            q, out, w2 = self.second.step(q, mid)
            if (p, q) not in self.ids:
                self.ids[p, q] = len(self.pairs)
                self.pairs.append((p, q))
            got = self.known[state, label] = self.ids[p, q], out, w1 + w2
        return got


def reported_speech() -> Transducer:
    """After a reporting word, insults and threats of the clause are somebody else's."""
    return Transducer({(0, REPORT): (1, REPORT, 0.0), (1, INSULT): (1, "r", 0.0), (1, THREAT): (1, "r", 0.0)})


def negation(reach: int = 3) -> Transducer:
    """A negation takes the force of an insult or threat within ``reach`` words."""
    arcs = {(s, NEGATION): (reach, NEGATION, 0.0) for s in range(reach + 1)}
    arcs |= {(s, x): (s - 1, "n", 0.0) for s in range(1, reach + 1) for x in (INSULT, THREAT)}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


def threats(reach: int = 3) -> Transducer:
    """Intent, verb of violence and person, or intent, person and verb, each within ``reach`` words of the one before.

    States: 0; 1 to reach after an intent; then as many after a bare verb, after a verb with an intent, and after a
    person with an intent. What comes last ends the threat.
    """
    after = lambda kind, s: kind * reach < s <= (kind + 1) * reach
    intent, bare, meant, person = range(4)
    states, arcs = range(4 * reach + 1), {}
    for s in states:
        arcs[s, INTENT] = ((intent + 1) * reach, INTENT, 0.0)
        arcs[s, THREAT] = ((meant + 1) * reach, "h", 0.0) if after(intent, s) or after(meant, s) else (0, WHOLE[0], 0.0) if after(person, s) else ((bare + 1) * reach, THREAT, 0.0)
        if after(bare, s) or after(meant, s):
            arcs[s, TARGET] = (0, WHOLE[0] if after(meant, s) else WHOLE[1], 0.0)
        elif after(intent, s):
            arcs[s, TARGET] = ((person + 1) * reach, TARGET, 0.0)
    return Transducer(arcs, {s: 0 if s == 0 or (s - 1) % reach == 0 else s - 1 for s in states})


def insults(reach: int = 4) -> Transducer:
    """An insult near a word for a person is aimed at it."""
    arcs = {(s, x): (reach, x, 0.0) for s in range(reach + 1) for x in (TARGET, *WHOLE)}
    arcs |= {(s, INSULT): (s, "i", 0.4) for s in range(1, reach + 1)}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


def scoring() -> Transducer:
    """Weights to multiply a word's own: full, doubtful when reported or negated; less for what follows in the clause."""
    full = {INSULT: 1.0, "i": 1.0, THREAT: 0.5, "h": 1.0, "r": 0.3, "n": 0.3, **dict.fromkeys(WHOLE, 1.0)}
    return Transducer({(s, x): (1, x, w * (1.0 if s == 0 or x in WHOLE else 0.8)) for s in (0, 1) for x, w in full.items()})


def grammar() -> Composed:
    return Composed(Composed(Composed(Composed(reported_speech(), negation()), threats()), insults()), scoring())


class Scorer:
    """Labels words by the lexicon and runs the grammar over clauses."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], base: float, whole: dict[str, float] | None = None) -> None:
        self.words, self.stems, self.base, self.whole = words, stems, base, THREAT_WEIGHTS if whole is None else whole
        self.machine = grammar()
        self.fixed = {w: (x, 1.0) for x, ws in ((TARGET, TARGETS), (INTENT, INTENTS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}
        self.lengths = sorted({len(s) for s in stems})
        self.cache: dict[str, tuple[str, float] | None] = {}
        self.stop = dict.fromkeys(STOPS, None)

    def lexical(self, word: str) -> tuple[str, float] | None:
        if w := self.words.get(word):
            return INSULT, w
        best = max((self.stems.get(word[:n], 0.0) for n in self.lengths), default=0.0)
        return (INSULT, best) if best else self.fixed.get(word)

    def label(self, token: str) -> tuple[str, float] | None:
        if token not in self.cache:
            if len(self.cache) > 400_000:
                self.cache.clear()
            found = [self.fixed.get(w) if w in INTENTS else self.lexical(w.replace("'", "")) for w in WORD.findall(token.lower()) if w not in STOPS]
            self.cache[token] = next((x for x in found if x and x[0] == INSULT), next(filter(None, found), None))
        return self.cache[token]

    def clause(self, labels: list[tuple[str, float] | None]) -> tuple[float, set[str]]:
        """Its weight, and which whole threats it holds."""
        state, total, whole = 0, 0.0, set()
        for x in labels:
            label, own = x or (OTHER, 0.0)
            state, out, weight = self.machine.step(state, label)
            if out in WHOLE:
                total += self.whole[out] * weight
                whole.add(out)
            elif out not in (OTHER, TARGET, INTENT, NEGATION, REPORT):
                total += own * weight
        return total, whole

    def matched(self, text: str) -> list[tuple[float, set[str]]]:
        """What the clauses that hold an insult or threat weigh."""
        tokens = text.split()
        marks = list(map(self.label, tokens))
        if not any(x is not None and x[0] in (INSULT, THREAT) for x in set(marks)):
            return []
        out, clause = [], []
        for token, mark in zip(tokens, marks, strict=True):
            clause.append(mark)
            if token[-1] in ".!?;:":
                out.append(clause)
                clause = []
        out.append(clause)
        return [self.clause(c) for c in out if any(x is not None and x[0] in (INSULT, THREAT) for x in c)]

    def score(self, text: str | None) -> tuple[float, int]:
        clauses = self.matched(text or "")
        total = self.base + sum(w for w, _ in clauses)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), len(clauses)


def _features(text: str) -> set[str]:
    words = set(WORD.findall(text.lower())) - STOPS
    return {f"w{w}" for w in words} | {f"s{w[:n]}" for w in words for n in STEMS if len(w) > n}


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            count[label].update(_features(text or ""))
            count[label][""] += 1
    for label, c in count.items():
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["term", "label", "n"])


def _cover(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    wanted = set(terms)
    for b in batches:
        hits = [sorted(_features(x or "") & wanted) for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.string()))], ["hits"])


def _whole_threats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each kind of whole threat, by label."""
    scorer, count = Scorer({}, {}, 0.0), Counter()
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            count.update((x, label) for x in set().union(*(kinds for _, kinds in scorer.matched(text or ""))))
    rows = list(count)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32()), pa.array([count[r] for r in rows], pa.int64())], ["kind", "label", "n"])


def threat_weights(texts: DataFrame, one: int, zero: int, prior: float = 20.0) -> dict[str, float]:
    """Fixed weights, worth ``prior`` texts, and the log-odds in the labelled texts, worth as many as have the pattern."""
    seen = Counter()
    for r in texts.mapInArrow(_whole_threats, "kind string, label int, n long").collect():
        seen[r.kind, r.label] += r.n
    out = {}
    for kind, fixed in THREAT_WEIGHTS.items():
        a, b = seen[kind, 1], seen[kind, 0]
        odds = math.log((a + 0.5) / (one + 1) / ((b + 0.5) / (zero + 1)))
        out[kind] = (prior * fixed + (a + b) * max(0.0, odds)) / (prior + a + b)
    return out


def learn(texts: DataFrame, least: int = 3, ratio: float = 12.0, gain: float = 0.004) -> tuple[dict[str, float], dict[str, float], float, dict[str, float]]:
    """(text, label) rows, a bounded sample, to insult words and stems with their log-odds, the base, and the weights of threats.

    Of the telling terms, those are taken in turn that explain most toxic texts not yet explained, so
    words that only happen to sit in a much copied text stay out.
    """
    counted = texts.mapInArrow(_feature_counts, "term string, label int, n long")
    t = counted.groupBy("term").agg(F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("b"))
    total = t.filter("term = ''").collect()
    if not total or not total[0].a or not total[0].b:
        return {}, {}, -3.5, dict(THREAT_WEIGHTS)
    one, zero = total[0].a, total[0].b
    odds = F.log((F.col("a") + 0.5) / (one + 1) / ((F.col("b") + 0.5) / (zero + 1)))
    best = t.filter((F.col("term") != "") & (F.col("a") >= least)).withColumn("w", odds).filter(F.col("w") > math.log(ratio)).collect()
    weight = {r.term: float(r.w) for r in best}
    toxic = texts.filter("label = 1").select("text")
    left = [[set(r.hits), 0] for r in toxic.mapInArrow(lambda it: _cover(it, list(weight)), "hits array<string>").collect()]
    support = {r.term: r.a for r in best}
    chosen: list[str] = []
    free = set(weight)

    def covers(c: str, x: str) -> bool:
        """Whether a chosen term leaves nothing to another: stems of one line, and a word that nearly is its stem."""
        if c[0] == "s":
            return x[0] == "s" and (x.startswith(c) or c.startswith(x))
        return x[0] == "s" and c[1:].startswith(x[1:]) and support[c] >= 0.8 * support[x]

    for often in (1, 2, 3, 4):  # every text explained once, then again by widespread, telling terms
        if often == 2:
            free = {x for x in free if support[x] >= 0.03 * one and weight[x] > 5}
        while True:
            count = Counter(x for hits, n in left if n < often for x in hits & free)
            # ties: words before stems, and the longer stem, which is the safer one
            term = max(count, key=lambda x: (count[x] * weight[x], x[0] == "w", len(x), x), default=None)
            if term is None or count[term] < max(2, gain * one):
                break
            chosen.append(term)
            free = {x for x in free if not covers(term, x)}
            for row in left:
                if term in row[0]:
                    row[0].discard(term)
                    row[1] += 1
    return {x[1:]: weight[x] for x in chosen if x[0] == "w"}, {x[1:]: weight[x] for x in chosen if x[0] == "s"}, -3.5, threat_weights(texts, one, zero)


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = 6000) -> DataFrame:
    """(text, label) of at most ``train_rows`` labelled rows outside the held-out fold, those of the smallest hash."""
    usable = labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
    some = usable.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label")).orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(train_rows)
    return docs.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).groupBy(F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, lexicon: tuple, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """``carry``, _score and _clauses (number of matched ones) of each row; ``lexicon`` holds what Scorer takes."""
    small_batches(docs.sparkSession)
    carry = list(docs.columns if carry is None else carry)
    kept = [f"_c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*lexicon)
        for b in batches:
            got = [scorer.score(x) for x in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([x for x, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], [*kept, "_score", "_clauses"])

    named = docs.select(*(F.col(c).alias(k) for k, c in zip(kept, carry, strict=True)), F.col(text).alias("_t"))
    schema = T.StructType([*named.schema.fields[:-1], T.StructField("_score", T.DoubleType()), T.StructField("_clauses", T.LongType())])
    return named.mapInArrow(run, schema).select(*(F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)), "_score", "_clauses")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, learn(training_rows(docs.select("doc_id", "text"), labels)), ["doc_id"])
    value = F.round("_score", 6)
    return out.select("doc_id", held_out().alias("held_out"), value.alias("score"), F.when(value >= 0.3, 1).otherwise(0).alias("predicted"), F.col("_clauses").alias("clauses"))
