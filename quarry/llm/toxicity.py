"""Toxicity by a weighted finite-state pattern grammar.

A weighted lexicon classifies words as insult, threat, target, negation or report. Insults and
their weights are learned from labelled texts (whole words, and word stems for inflected
roots); threats, targets, negations and words of reported speech are closed classes. A clause
(up to ``. ! ? ; :`` or a newline) becomes a list of symbols: its marked words, quotation marks that
open and close around them, and between two marked words a gap, near (``NEGATION_REACH`` words), short
(``REACH``) or long. Five transducers over such lists are composed into one machine:

    negation   deletes negations; a harm after one, linked by near gaps, is negated (-)
    report     deletes reports and quotation marks; harms after or between them are reported (")
    target     deletes targets; a harm linked to one by short gaps, before or after, is directed (>)
    insult     deletes gaps; an insult linked to another by short gaps is stacked (+)
    threat     deletes threats that are not directed

What it writes are the clause's patterns, such as an insult that is directed and reported.
Where a clause has several readings (a harm need not wait for a target) the path of least weight in the
tropical semiring is taken: leaving a harm undirected costs 1. Each pattern adds its
lexicon weight to the text's features, whose learned path weights a logistic model turns into a score. Readings
are kept by symbol list, so cost follows the distinct marked clauses, not the text.

Learning takes at most ``FIT_ROWS`` labelled documents (least hash of doc_id within each label),
weighted so that the labels keep their ratio in the whole table; learning and scoring read whole texts.
Defined results: null and empty texts have no clause and get the model's base score, as does
any text if there are no labels of both kinds (0 then). Repeated rows get equal scores. A document
is labelled toxic if any of its labels says so; of several texts with its doc_id, the one with the least hash is learned.
Labels that are null, or without a doc_id, are ignored. An empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sample, _scratch
from . import _text as tx
from ._wfst import EPS, Transducer

FIT_ROWS = 4000
STEMS = (4, 5, 6)
MIN_DOCS = 5
MIN_LOG_ODDS = 2.5
REACH, NEGATION_REACH = 6, 3
READINGS = 50_000
KINDS = ("word", *(f"stem{k}" for k in STEMS))
INSULT, THREAT, TARGET, NEGATION, REPORT = range(1, 6)

# The closed classes of the grammar, as fixed values.
TARGETS = "you your yours yourself he she they them him her his their we us people everyone du dich dir sie ihr ihn tu te toi vous il elle ils vosotros ustedes usted el ella ellos ti".split()
THREATS = "kill hurt destroy beat burn shoot punch murder stab crush töten schlagen umbringen verletzen tuer frapper brûler détruire matar golpear quemar destruir".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nobody none without nicht kein keine nie niemals ne pas jamais sans aucun nunca jamás sin ningún tampoco".split()
REPORTS = "said says say told wrote reported claimed quoted called according sagte schrieb laut dit écrit selon dijo escribió según".split()

FEATURES = ("insult", "stacked", "directed", "threat", "negated", "reported", "strongest", "density")


def _hash(words: list[str]) -> np.ndarray:
    h, _ = tx.words(pa.array(words, pa.string()), tx.NOT_ALNUM, fold=True)
    return h


def tokens(column: pa.Array) -> dict[str, np.ndarray]:
    """Word hashes, stem hashes, rows, and the clause number of each word."""
    buf, offsets = tx.text_buffer(column)
    buf = tx.fold_latin1(buf)
    s, e, rows = tx.spans(buf, offsets, tx.NOT_ALNUM)
    stop = np.zeros(256, bool)
    stop[[ord(c) for c in ".!?;:\n"]] = True
    marks = np.concatenate(([0], np.cumsum(stop[buf]))) if len(buf) else np.zeros(1, np.int64)
    quotes = np.concatenate(([0], np.cumsum(buf == 0x22))) if len(buf) else np.zeros(1, np.int64)
    clause = marks[s] + rows
    in_quotes = (quotes[s] - quotes[offsets[rows]]) % 2 == 1
    out = {"rows": rows, "clause": clause, "quoted": in_quotes, "word": tx.span_hashes(buf, s, e)}
    for k in STEMS:
        cut = np.minimum(s + k, e)
        h = tx.span_hashes(buf, s, cut)
        out[f"stem{k}"] = np.where(e - s > k, tx.mix64(h + tx.U64(k)), tx.U64(0))
    return out


class Grammar:
    """Lexicon (sorted hashes, symbols, weights) and path weights."""

    def __init__(self, found: pa.Table | None = None, n1: int = 0, n0: int = 0):
        """``found``: of the words and stems of ``n1`` toxic and ``n0`` clean texts, how many of each hold them."""
        self.ready = n1 > 0 and n0 > 0
        self.path = np.zeros(len(FEATURES) + 1)
        if not self.ready:
            return
        key, toxic, clean = (found[c].to_numpy() for c in ("key", "toxic", "clean"))
        odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
        good = (toxic + clean >= MIN_DOCS) & (odds >= MIN_LOG_ODDS) & (key != 0)
        keys, weights, symbols = [key[good].view(tx.U64)], [odds[good]], [np.full(good.sum(), INSULT)]
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            h = np.unique(_hash(words))
            keys.append(h)
            weights.append(np.ones(len(h)))
            symbols.append(np.full(len(h), symbol))
        key, weight, symbol = (np.concatenate(x) for x in (keys, weights, symbols))
        order = np.lexsort((symbol, key))
        key, weight, symbol = key[order], weight[order], symbol[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        self.key, self.weight, self.symbol = key[first], weight[first], symbol[first]

    def weigh(self, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> None:
        """Learn the path weights from the texts' features and labels; a text stands for
        ``share`` labelled texts."""
        mean = np.average(x, 0, share)
        self.scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, 0, share)), 1e-6)
        self.path = _logistic(x / self.scale, y, share / share.mean())

    def _marked(self, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, symbols and weights of the words that the lexicon knows; of a word and
        its stems, the heaviest entry counts."""
        n = len(t["word"])
        symbol, weight = np.zeros(n, np.int64), np.zeros(n)
        for kind in KINDS:
            at = np.minimum(np.searchsorted(self.key, t[kind]), len(self.key) - 1)
            hit = self.key[at] == t[kind]
            better = hit & (self.weight[at] > weight) & ~((symbol > INSULT) & (self.symbol[at] != INSULT))
            symbol[better], weight[better] = self.symbol[at][better], self.weight[at][better]
        pos = np.flatnonzero(symbol)
        return pos, symbol[pos], weight[pos]

    def features(self, t: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((n, len(FEATURES)))
        pos, symbol, weight = self._marked(t)
        hot = np.isin(symbol, (INSULT, THREAT))
        clauses = np.unique(t["clause"][pos[hot]])
        use = np.isin(t["clause"][pos], clauses)
        pos, symbol, weight = pos[use], symbol[use], weight[use]
        clause, rows, quoted = t["clause"][pos], t["rows"][pos], t["quoted"][pos]
        borders = np.flatnonzero(np.diff(clause)) + 1
        for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(pos)], strict=True):
            if b > a:
                run_clause(pos[a:b].tolist(), symbol[a:b].tolist(), weight[a:b].tolist(), quoted[a:b].tolist(), out[rows[a]])
        words = np.maximum(np.bincount(t["rows"], minlength=n), 1)
        out[:, 7] = out[:, 0] / np.sqrt(words)
        return np.sign(out) * np.log1p(np.abs(out))

    def score(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if not self.ready:
            return np.zeros(n)
        x = self.features(tokens(column), n) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.path[:-1] + self.path[-1], -30, 30)))


NEAR, SHORT, LONG, OPEN, CLOSE = "near", "short", "long", "open", "close"
GAPS = (NEAR, SHORT, LONG)
WORDS = {INSULT: "I", THREAT: "T", TARGET: "G", NEGATION: "N", REPORT: "R"}


def _with(harms: list[str], flag: str) -> list[str]:
    return [h + flag for h in harms]


def _same(state: int, symbols, to: int | None = None) -> list[tuple]:
    return [(state, x, x, state if to is None else to) for x in symbols]


def _marks(state: int, harms: list[str], flag: str, to: int | None = None) -> list[tuple]:
    return [(state, h, h + flag, state if to is None else to) for h in harms]


def parts() -> list[Transducer]:
    """The transducers, in the order in which they are composed."""
    harms = ["I", "T"]
    others = ["G", "R", OPEN, CLOSE]
    negation = Transducer.of(
        [*_same(0, [*harms, *others, *GAPS]), (0, "N", EPS, 1), (1, "N", EPS, 1), *_marks(1, harms, "-"), *_same(1, [*others, NEAR]), *_same(1, [SHORT, LONG], 0)], [0, 1]
    )
    harms += _with(harms, "-")
    plain = ["G", *GAPS]
    report = Transducer.of(
        [
            *_same(0, [*harms, *plain]), (0, "R", EPS, 1), (0, OPEN, EPS, 2), (0, CLOSE, EPS, 0),
            *_marks(1, harms, '"'), *_same(1, plain), *((1, x, EPS, 1) for x in ("R", OPEN, CLOSE)),
            *_marks(2, harms, '"'), *_same(2, plain), (2, "R", EPS, 1), (2, OPEN, EPS, 2), (2, CLOSE, EPS, 0),
        ],
        [0, 1, 2],
    )
    harms += _with(harms, '"')
    target = Transducer.of(
        [
            # 0: no target near; 1: a target near; 2: a directed harm waits for its target
            *((0, h, h, 0, 1.0) for h in harms), *_marks(0, harms, ">", 2), (0, "G", EPS, 1), *_same(0, GAPS),
            *_marks(1, harms, ">"), (1, "G", EPS, 1), *_same(1, [NEAR, SHORT]), *_same(1, [LONG], 0),
            *_marks(2, harms, ">"), (2, "G", EPS, 1), *_same(2, [NEAR, SHORT]),
        ],
        [0, 1],
    )
    harms += _with(harms, ">")
    insults, threats = ([h for h in harms if h[0] == x] for x in "IT")
    insult = Transducer.of(
        [*_same(0, insults, 1), *_same(0, threats), *((0, g, EPS, 0) for g in GAPS), *_marks(1, insults, "+"), *_same(1, threats), (1, NEAR, EPS, 1), (1, SHORT, EPS, 1), (1, LONG, EPS, 0)], [0, 1]
    )
    insults += _with(insults, "+")
    threat = Transducer.of([*_same(0, insults), *((0, h, h if ">" in h else EPS, 0) for h in threats)], [0])
    return [negation, report, target, insult, threat]


@cache
def machine() -> Transducer:
    """All of them, composed."""
    out, *rest = parts()
    for part in rest:
        out = out.then(part)
    return out


_readings: dict[tuple[str, ...], list[str]] = {}


def read(symbols: tuple[str, ...]) -> list[str]:
    """The patterns that the composed machine writes, symbol by symbol."""
    if symbols not in _readings:
        if len(_readings) >= READINGS:
            _readings.clear()
        _readings[symbols] = machine().best(symbols)
    return _readings[symbols]


def symbols_of(pos: list[int], symbol: list[int], quoted: list[bool]) -> tuple[list[str], list[int]]:
    """The symbol list of a clause, and the place in it of each marked word."""
    out, at, before, speech = [], [], None, False
    for p, s, q in zip(pos, symbol, quoted, strict=True):
        if before is not None:
            out.append(NEAR if p - before <= NEGATION_REACH else SHORT if p - before <= REACH else LONG)
        if q != speech:
            out.append(OPEN if q else CLOSE)
            speech = q
        at.append(len(out))
        out.append(WORDS[s])
        before = p
    return out, at


def run_clause(pos: list[int], symbol: list[int], weight: list[float], quoted: list[bool], out: np.ndarray) -> None:
    """Add the patterns of one clause to a text's features."""
    symbols, at = symbols_of(pos, symbol, quoted)
    patterns = read(tuple(symbols))
    for k, w in zip(at, weight, strict=True):
        pattern = patterns[k]
        if not pattern:
            continue
        if pattern[0] == "I":
            out[0] += w
            out[6] = max(out[6], w)
            out[1] += w * ("+" in pattern)
            out[2] += w * (">" in pattern)
        else:
            out[3] += 1
        out[4] += w * ("-" in pattern)
        out[5] += w * ('"' in pattern)


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method, rows weighted by ``share``; the last weight is the constant."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) / len(y) + ridge * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _occurrences(sample: DataFrame) -> DataFrame:
    """``kind, key, toxic, clean``: how many texts of either label hold a word or stem. Only
    what could come into the lexicon is given back."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            t, label = tokens(tx.column(b, "text")), np.asarray(tx.column(b, "toxic")).astype(np.int64)
            for k, kind in enumerate(KINDS):
                key, row = np.unique(np.stack((tx.signed(t[kind]), t["rows"])), axis=1)
                key, at = np.unique(key, return_inverse=True)
                held = [np.bincount(at, v[row], len(key)).astype(np.int64) for v in (label, 1 - label)]
                yield pa.record_batch([pa.array(np.full(len(key), k, np.int32)), pa.array(key), *map(pa.array, held)], names=["kind", "key", "toxic", "clean"])

    found = sample.mapInArrow(emit, "kind int, key long, toxic long, clean long")
    sums = found.groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return sums.where((F.col("toxic") + F.col("clean") >= MIN_DOCS) & (F.col("toxic") > 0))


def _features(sample: DataFrame, grammar: Grammar) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(grammar)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            x = shared.value.features(tokens(tx.column(b, "text")), b.num_rows)
            yield pa.record_batch([tx.column(b, "doc_id"), tx.column(b, "toxic"), *(pa.array(c) for c in x.T)], names=["doc_id", "toxic", *FEATURES])

    return sample.mapInArrow(emit, "doc_id long, toxic int, " + ", ".join(f"{c} double" for c in FEATURES))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Fit on a bounded sample of the labelled rows of ``docs(doc_id, text)``; its texts are read
    whole, in the executors, and only lexicon entries and features come to the driver."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("toxic"))
    marked = _scratch.write_table(marked, "labels")
    every = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    wanted = {}
    for label, total in every.items():
        wanted |= dict.fromkeys((r["doc_id"] for r in _sample.least_hashed(marked.where(F.col("toxic") == label), FIT_ROWS // 2, total, 5, "doc_id").select("doc_id").collect()), label)
    _scratch.drop_table(marked)
    if not wanted:
        return Grammar()
    taken = Counter(wanted.values())
    stands_for = {label: every[label] / taken[label] for label in taken}
    text = docs.where(F.col("doc_id").cast("long").isin(list(wanted))).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = text.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    toxic = F.col("doc_id").isin([i for i, label in wanted.items() if label]).cast("int")
    sample = _scratch.write_table(one.withColumn("toxic", toxic), "labelled")
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    grammar = Grammar(_occurrences(sample).toArrow(), counts.get(1, 0), counts.get(0, 0))
    if grammar.ready:
        found = _features(sample, grammar).toArrow().sort_by([("doc_id", "ascending"), *((c, "ascending") for c in FEATURES)])
        y = found["toxic"].to_numpy()
        grammar.weigh(np.stack([found[c].to_numpy() for c in FEATURES], 1), y.astype(np.float64), np.array([stands_for[k] for k in y.tolist()]))
    _scratch.drop_table(sample)
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # at most the words of FIT_ROWS texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            p = shared.value.score(tx.column(b, "text"))
            yield pa.record_batch([tx.column(b, "doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int")
