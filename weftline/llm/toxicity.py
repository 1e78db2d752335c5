"""Operator 9: toxicity by a weighted finite-state pattern grammar.

Words and marks become symbols: insult, threat, target, negation, reported speech, comma, colon, quotation mark, stop.
A line that holds an insult or a threat is read by a bimachine. From right to left a first transducer tells each symbol
whether a target follows in its clause and whether it stands in a quotation that a verb of reporting follows. From left
to right three transducers, composed into one, then tell which pattern each insult or threat makes: negation reaches a
few words ahead in its clause; reported speech reaches to the end of its clause, or of a quotation that it introduces;
the pattern transducer tells an insult or threat with a target in its clause from one without, and from a negated or
reported one. A document's score is a logistic function of the weighted patterns of all its clauses, so the same word
counts much in one clause and hardly in another.

Learned from labelled rows, a bounded sample of them (`rows`) outside the held-out part: which whole words are insults
and how much each weighs (words that toxic texts use in several contexts and that are far more often in toxic texts than
in clean ones), and the weights of the patterns, from counts made with words that were learned on other texts. Weights
keep to what the grammar says whatever the labels are (see `_bounds`). Targets, negations, verbs of reporting and threats
are fixed lists. A text's repetitions of one word in one pattern count once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, text_buffers
from .segments import SegmentCache, let_go, pieces, span_hashes
from .words import WORD_CHARS, words

# Seed words of each class, in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons scum trash loser losers pathetic worthless stupid disgusting dumb idioten dummkopf abschaum trottel arschloch connard connasse imbécile ordure salaud idiota imbécil estúpido basura escoria".split()
THREATS = "kill hurt destroy burn beat shoot stab strangle töten umbringen verprügeln tuer frapper matar golpear".split()
TARGETS = "you your yours yourself u ur he she they him her them these those dich dir deine euch vous toi tes usted ustedes ellos".split()
#: "t" is what the word rule leaves of a contraction with "not".
NEGATIONS = "not no never t isnt arent wasnt dont wont nor neither nicht kein keine niemals nie ne pas jamais nunca jamás".split()
REPORTS = "said says say called calls quoted quote reported reports claimed claims alleged wrote writes sagte nannte zitierte schrieb disait appelait écrivait dijo llamó escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COMMA, COLON, QUOTE, STOP = range(10)
PATTERNS = ("insult", "insult_target", "threat", "threat_target", "negated", "reported")
#: Weights before anything is learned: by pattern, then the bias.
PRIOR = np.array([3.0, 4.5, 0.3, 4.5, 0.0, 0.2, -3.0])
#: Parts of the labelled sample; each is counted with words learned from the others.
FOLDS = 4
#: Words between a negation and what it negates, at most.
SCOPE = 3
_MARK = np.zeros(256, np.uint8)
for _chars, _kind in ((",", COMMA), (":", COLON), ('"', QUOTE), (".;!?()|\n", STOP)):
    _MARK[[ord(c) for c in _chars]] = _kind
# UTF-8 quotation marks and the apostrophe, and ASCII of the same length that stands for them.
_CURLY = [(s.encode(), a) for s, a in (("“", b'"  '), ("”", b'"  '), ("„", b'"  '), ("«", b'" '), ("»", b'" '), ("’", b"'  "))]


class Transducer:
    """Deterministic transducer: step(state, symbol) gives the next state and the symbol put out."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, other: "Transducer") -> "Transducer":
        """Composition: what this machine puts out is what the other reads."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols) -> dict:
        """All reachable steps as {(state number, symbol): (state number, out)}; the start is state 0."""
        number, todo, rows = {self.start: 0}, [self.start], {}
        while todo:
            s = todo.pop()
            for x in symbols:
                t, out = self.step(s, x)
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
                rows[number[s], x] = (number[t], out)
        return rows


def _ahead(state, kind):
    """From right to left. State: whether a target follows in the clause; the verb of reporting to the right (0: none, 1:
    one in this sentence, 2: we are inside the quotation before it)."""
    target, verb = state
    if kind in (COMMA, COLON, QUOTE, STOP):
        if kind == QUOTE:
            verb = {0: 0, 1: 2, 2: 0}[verb]
        elif kind == STOP and verb == 1:
            verb = 0
        return (False, verb), (kind, False, False)
    out = (kind, target, verb == 2)
    return (target or kind == TARGET, 1 if kind == REPORT and verb == 0 else verb), out


def _negation(reach: int, symbol):
    """State: how many words a negation still reaches."""
    kind, target, quoted = symbol
    if kind == NEGATION:
        return SCOPE, (OTHER, target, quoted, False)
    if kind in (COMMA, COLON, QUOTE, STOP):
        return 0, (kind, target, quoted, False)
    return max(0, reach - 1), (kind, target, quoted, reach > 0)


def _report(state: int, symbol):
    """State: 0 plain, 1 behind a verb of reporting, 2 behind its comma, 3 in the quotation that it introduces."""
    kind, target, quoted, negated = symbol
    if kind == REPORT:
        return state if state == 3 else 1, (OTHER, target, "plain")
    if kind == QUOTE:
        return 3 if state in (1, 2) else 0, (kind, target, "plain")
    if kind == STOP:
        return 3 if state == 3 else 0, (kind, target, "plain")
    if kind == COMMA:
        return 2 if state == 1 else state, (kind, target, "plain")
    mark = "negated" if negated else "reported" if quoted or state in (1, 3) else "plain"
    return 0 if state == 2 and kind != OTHER else state, (kind, target, mark)


def _pattern(state: bool, symbol):
    """State: whether a target was read in the clause."""
    kind, target, mark = symbol
    if kind == TARGET:
        return True, None
    if kind in (COMMA, COLON, QUOTE, STOP):
        return False, None
    if kind not in (INSULT, THREAT):
        return state, None
    if mark != "plain":
        return state, mark
    return state, ("insult" if kind == INSULT else "threat") + "_target" * (state or target)


def grammar() -> tuple[dict, dict]:
    """The tables of the two directions: from right to left, then the composed machine from left to right."""
    kinds = range(10)
    marked = [(k, t, q) for k in kinds for t in (False, True) for q in (False, True)]
    forward = Transducer(0, _negation) @ Transducer(0, _report) @ Transducer(False, _pattern)
    return Transducer((False, 0), _ahead).table(kinds), forward.table(marked)


@dataclass
class Lexicon:
    """Classes of words, and weights of insults (1 if not given)."""

    classes: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def seed() -> "Lexicon":
        out = {}
        for names, kind in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (INSULTS, INSULT)):
            out.update({w: kind for w in names})
        return Lexicon(out)


def _hash(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), offs[:-1], offs[1:]) if raw else np.zeros(0, np.uint64)


class Reader:
    """Counts patterns of whole texts."""

    def __init__(self, lexicon: Lexicon):
        self.back, self.forth = grammar()
        names = list(lexicon.classes)
        self.kinds = np.array([lexicon.classes[w] for w in names], np.uint8)
        self.weights = np.array([lexicon.weights.get(w, 1.0) for w in names])
        self.words = SegmentCache(max(10, (4 * len(names)).bit_length()))
        self.words.add(_hash(names), [[0]] * len(names))

    def read(self, kinds: list[int]) -> list[str | None]:
        """The pattern that each symbol of a line makes, or None."""
        state, marked = 0, []
        for k in reversed(kinds):
            state, out = self.back[state, k]
            marked.append(out)
        state, found = 0, []
        for x in reversed(marked):
            state, out = self.forth[state, x]
            found.append(out)
        return found

    def counts(self, data, offs: np.ndarray) -> np.ndarray:
        """A row of pattern counts for each text."""
        out = np.zeros((len(offs) - 1, len(PATTERNS)))
        for i, j in pieces(offs):
            o = offs[i : j + 1] - offs[i]
            raw = np.frombuffer(data, np.uint8)[offs[i] : offs[j]].tobytes()
            for mark, plain in _CURLY:
                raw = raw.replace(mark, plain)
            part = np.frombuffer(raw, np.uint8)
            h, starts, _, at = words(part, o, WORD_CHARS)
            if not len(h):
                continue
            h = np.where(h == 0, np.uint64(1), h)
            found = self.words.find(h)
            kind = np.where(found >= 0, self.kinds[np.maximum(found, 0)], OTHER).astype(np.uint8)
            core = np.flatnonzero((kind == INSULT) | (kind == THREAT))
            if not len(core):
                continue
            # A line ends at a line end and at the end of its text; only lines with an insult or a threat are read.
            ends = part == 10
            ends[o[(o > 0) & (o < len(part))] - 1] = True
            line = np.cumsum(ends) - ends
            read = np.zeros(int(line[-1]) + 1, bool)
            read[line[starts[core]]] = True
            # Other words matter only as far as a negation may reach over them.
            place = np.arange(len(h))
            last = np.maximum.accumulate(np.where(kind == NEGATION, place, -SCOPE - 1))
            use = np.flatnonzero(((kind != OTHER) | (place - last <= SCOPE)) & read[line[starts]])
            marks = np.flatnonzero(_MARK[part] > 0)
            marks = marks[read[line[marks]]]
            where = np.concatenate([starts[use], marks])
            symbol = np.concatenate([kind[use], _MARK[part[marks]]])
            word = np.concatenate([use, np.full(len(marks), -1)])
            order = np.argsort(where, kind="stable")
            where, symbol, word = where[order], symbol[order], word[order]
            own = line[where]
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])).tolist()
            text = np.searchsorted(o, where, side="right") - 1
            counted: set = set()
            for a, b in zip(edge[:-1], edge[1:]):
                t = int(text[a])
                for k, pattern in enumerate(self.read(symbol[a:b].tolist()), a):
                    if pattern is not None and (t, x := int(h[word[k]]), pattern) not in counted:
                        counted.add((t, x, pattern))
                        out[i + t, PATTERNS.index(pattern)] += self.weights[found[word[k]]]
        return out


def scores(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic function of the weighted, log-damped pattern counts; bias last."""
    return 1 / (1 + np.exp(-(np.log1p(counts) @ weights[:-1] + weights[-1])))


#: The score from which a text counts as toxic, and how far (in log odds) the grammar's certain cases lie from it.
THRESHOLD, MARGIN = 0.3, 0.5


def _bounds(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest weights that the grammar allows under a bias: one targeted insult or threat of full weight is
    toxic by itself, and a targeted insult counts no less than a bare one; one threat without target isn't, nor are three
    negated or reported ones."""
    gap = np.log(THRESHOLD / (1 - THRESHOLD)) - w[-1]
    sure, one, three = (gap + MARGIN) / np.log(2), max(0.0, gap - MARGIN) / np.log(2), max(0.0, gap - MARGIN) / np.log(4)
    return np.array([0.0, max(sure, w[0]), 0.0, sure, -1.0, -1.0, -8.0]), np.array([20.0, 30.0, one, 20.0, three, three, -2.0])


def fit_weights(counts: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Penalised logistic regression around the prior weights, by Newton steps inside the grammar's bounds."""
    w = PRIOR.copy()
    if not len(labels):
        return w
    times = np.ones(len(labels)) if times is None else times
    x = np.hstack([np.log1p(counts), np.ones((len(counts), 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ ((p - labels) * times) + ridge * (w - PRIOR)
        lo, hi = _bounds(w)
        free = ~(((w <= lo) & (grad > 0)) | ((w >= hi) & (grad < 0)))
        hess = (x * (p * (1 - p) * times)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        new = w - np.clip(step, -1, 1)
        new[-1] = np.clip(new[-1], -8.0, -2.0)
        new = np.clip(new, *_bounds(new))
        new = np.clip(new, *_bounds(new))  # the bound of a targeted insult follows the bare one's new weight
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def held_out(key) -> "F.Column":
    """Rows kept from learning: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _split(text: str) -> list[str]:
    import re

    upper = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(upper))


def _contexts(batches):
    """(fold, word, context) of toxic texts: each word once for each text, with the least hash of its neighbours there;
    so copies of a text, or one long text, lend a word hardly any support."""
    import zlib

    let_go()
    for batch in batches:
        folds, found, contexts = [], [], []
        for fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = ["", *_split(text), ""]
            least: dict[str, int] = {}
            for a, w, b in {(own[k - 1], own[k], own[k + 1]) for k in range(1, len(own) - 1)}:
                c = zlib.crc32(f"{a} {b}".encode())
                if c < least.get(w, 1 << 32):
                    least[w] = c
            found += least
            contexts += least.values()
            folds += [fold] * len(least)
        yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(found, pa.string()), pa.array(contexts, pa.int64())], names=["fold", "word", "context"])


def _enlist(uses: dict[str, tuple[int, int, int]], total: tuple[int, int], support: int, purity: float) -> Lexicon:
    """The seed classes and the words that uses (contexts, toxic texts, clean texts) make insults. A weight is the log
    odds of a word over those of all words, of at most 8, as a share of 8; seed words have the whole."""
    out = Lexicon.seed()
    for w, (contexts, p, q) in sorted(uses.items()):
        if contexts >= support and p >= purity * (p + q) and w not in out.classes:
            weight = np.log((p + 0.5) / (q + 0.5) * (total[1] + 1) / (total[0] + 1))
            out.classes[w], out.weights[w] = INSULT, float(np.clip(weight, 0, 8) / 8)
    return out


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 20_000, support: int = 3, purity: float = 0.8) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from at most `rows` labelled texts outside the held-out part, those with the least hashes of
    their keys. `support`: contexts that an insult needs in toxic texts; `purity`: the share of its uses (distinct words
    of a text) that are in toxic ones. The driver gets words that have both and the distinct rows of pattern counts, both
    bounded by the sample.

    Rows without key, label or text are not learned from; a key's several labels count as toxic if one is; equal texts
    count once, as toxic if one is; without labelled rows the seed lists and prior weights are returned.
    """
    bound_batches(docs.sparkSession)
    lab = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("k")))
    lab = lab.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    own = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    # The sample has `rows` rows at most, whatever the tables' size.
    own = own.join(F.broadcast(lab), "k").groupBy(F.xxhash64("t").alias("h")).agg(F.max("y").alias("y"), F.first("t").alias("t"))
    sample = own.select(F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "t", (F.col("y") > 0).cast("int").alias("y")).persist()
    try:
        seen = sample.where("y = 1").select("fold", "t").mapInArrow(_contexts, "fold int, word string, context bigint").distinct()
        n = [F.count(F.when(F.col("fold") == f, 1)).alias(f"n{f}") for f in range(FOLDS)]
        supported = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *n).where(F.col("n") >= support).drop("n")
        contexts = {r[0]: tuple(r[1:]) for r in supported.collect()}
        use = frozenset(contexts)

        def hold(batches):
            """Texts of each fold and label that hold each word, and under "" the words of all texts."""
            from collections import Counter

            seen = {(f, y): Counter() for f in range(FOLDS) for y in (0, 1)}
            for batch in batches:
                for f, t, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    own = set(_split(t))
                    seen[f, y].update(own & use)
                    seen[f, y][""] += len(own)
            for (f, y), c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([2 * f + y] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["part", "word", "n"])

        parts = range(2 * FOLDS)
        sums = [F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"s{k}") for k in parts]
        held = sample.mapInArrow(hold, "part int, word string, n bigint").groupBy("word").agg(*sums)
        # A word may be pure without one fold and not with it; so all that are not hopeless are looked at.
        toxic, clean = (sum(F.col(f"s{k}") for k in parts if k % 2 == y) for y in (1, 0))
        held = {r[0]: tuple(r[1:]) for r in held.where((F.col("word") == "") | (toxic >= purity / 2 * (toxic + clean))).collect()}
        total = held.pop("", (0,) * len(parts))

        def lexicon(without: int | None = None) -> Lexicon:
            folds = [f for f in range(FOLDS) if f != without]
            both = lambda s: (sum(s[2 * f + 1] for f in folds), sum(s[2 * f] for f in folds))
            return _enlist({w: (sum(contexts[w][f] for f in folds), *both(s)) for w, s in held.items()}, both(total), support, purity)

        # Patterns of a text are counted with words learned from the other folds, so weights are not fitted to words
        # that the text itself has lent.
        others = [lexicon(f) for f in range(FOLDS)]

        def count(batches):
            readers = [Reader(x) for x in others]
            for batch in batches:
                fold = batch.column(0).to_numpy()
                c = np.zeros((len(fold), len(PATTERNS)))
                for f, reader in enumerate(readers):
                    c[fold == f] = reader.counts(*text_buffers(batch.column(1).filter(pa.array(fold == f))))
                yield pa.RecordBatch.from_arrays([batch.column(2), *[pa.array(c[:, i]) for i in range(len(PATTERNS))]], names=["y", *PATTERNS])

        got = sample.mapInArrow(count, "y int, " + ", ".join(f"{p} double" for p in PATTERNS)).groupBy("y", *PATTERNS).agg(F.count(F.lit(1)).alias("times")).collect()
        # In a fixed order, so that sums do not depend on which task was first.
        table = np.array(sorted([*(float(r[p]) for p in PATTERNS), float(r.y), float(r.times)] for r in got)).reshape(-1, len(PATTERNS) + 2)
        return lexicon(), fit_weights(table[:, :-2], table[:, -2], table[:, -1])
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """(key, score, predicted, clauses: pattern counts by name), or with keep the columns of docs and predicted.

    Null and empty texts have the score of a text without patterns. Narrow: no shuffle. Repeated rows each get a row;
    an empty table gives none; a column of docs named `predicted` is replaced under keep.
    """
    bound_batches(docs.sparkSession)
    lexicon, weights = model
    names = [c for c in docs.columns if c != "predicted"]

    def run(batches):
        let_go()
        reader = Reader(lexicon)
        for batch in batches:
            if keep:
                s = scores(reader.counts(*text_buffers(batch.column(names.index(text)))), weights)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((s >= threshold).astype(np.int32))], names=[*names, "predicted"])
                continue
            c = reader.counts(*text_buffers(batch.column(1)))
            s = scores(c, weights)
            clauses = pa.array([[(p, v) for p, v in zip(PATTERNS, row) if v] for row in c.tolist()], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), clauses], names=["key", "score", "predicted", "clauses"])

    if keep:
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names], "predicted int"])
        return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double, predicted int, clauses map<string,double>").withColumnRenamed("key", key)
