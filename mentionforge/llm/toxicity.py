"""Toxicity: a linear-chain conditional random field over tokens, learned from labels of documents.

A token is clean or toxic. Features of a toxic token are its word, its beginnings and its shape; candidates are entries that
go with toxic documents in many different surroundings. Tokens carry no labels of their own, so these are estimated: at first
every token with features of a toxic document counts as toxic; the chain is fitted to that by its likelihood gradient, and
then tokens are labelled by its own marginals, given that the document is clean (no toxic token) or toxic (one at least), and
so on. Forward-backward marginals of a whole text then give offending spans and, through a small logistic calibration, the
document's score. Stretches of tokens without features multiply in as powers of one 2 x 2 matrix, so the recursions cost as
much as a text has tokens with features. All potentials of the clean path are zero, so log Z is minus the log probability that
all is clean.

Fitting happens on the driver over a bounded, hash-chosen sample of labelled documents."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionforge.llm.common import bounded_sample, table
from mentionforge.session import map_in_arrow, spread

#: Fitting bounds: labelled rows by class, code points of a fitted text. What is learned from them has no bound of its own.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 2000, 8000, 20_000
LEAST_CONTEXTS, LEAST_ODDS = 5, 2.5
PREFIXES = (4, 5, 6)
#: Estimates of the token labels, rounds and step of the fit to each, and the weight of the squared weights in its objective.
ESTIMATES, ROUNDS, STEP, RIDGE = 3, 30, 0.15, 0.1
_EDGE = ".,;:!?\"'()[]{}<>«»„“”…*_-"
_WORD = re.compile(r"\S+")


def entries_of(word: str) -> list[str]:
    """Word and beginnings, without marks at the edges and in lower case."""
    w = word.strip(_EDGE).lower()
    return [f"={w}", *(w[:n] for n in PREFIXES if len(w) > n)] if w else []


def shapes_of(word: str) -> list[str]:
    w = word.strip(_EDGE)
    return [f"#{min(len(w), 12)}", *(name for name, has in (("#upper", w.isupper()), ("#title", w[:1].isupper()), ("#digit", any(c.isdigit() for c in w)), ("#mark", not w.isalnum())) if has)]


@dataclass
class Model:
    """weights by entry; move: log potentials of clean to toxic, toxic to clean, and toxic to toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    move: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, -1.0]))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, 0.0, 0.0]))

    def features(self, word: str) -> list[str]:
        found = [e for e in entries_of(word) if e in self.weights]
        return found + [x for x in shapes_of(word) if x in self.weights] if found else []

    def score(self, word: str) -> float:
        return sum(self.weights[x] for x in self.features(word))


def _powers(move: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(top, ratio, A, B) with N ** k = top ** k * (A + ratio ** k * B) for the matrix N of a token without features."""
    n = np.array([[1.0, math.exp(move[0])], [math.exp(move[1]), math.exp(move[2])]])
    values, vectors = np.linalg.eig(n)
    one = int(values.argmax())
    parts = [np.outer(vectors[:, k], np.linalg.inv(vectors)[k]) for k in (0, 1)]
    return float(values[one]), float(values[1 - one] / values[one]), parts[one], parts[1 - one]


class _Chain:
    """Forward and backward vectors at the tokens with features of one text; scaled, so that no length overflows."""

    def __init__(self, m: Model):
        self.top, self.ratio, a, b = _powers(m.move)
        self.log_top, self.a, self.b = math.log(self.top), tuple(a.ravel().tolist()), tuple(b.ravel().tolist())
        self.enter, self.leave, self.stay = (math.exp(x) for x in m.move)

    def _gap(self, k: int) -> tuple[float, ...]:
        r = self.ratio**k
        return tuple([x + r * y for x, y in zip(self.a, self.b, strict=True)])

    def run(self, n: int, at: list[int], scores: list[float]) -> tuple[float, list[float]]:
        """log P(no toxic token), and P(toxic) at each of the tokens `at`, of a text of n tokens; a clean token stands before it."""
        f0, f1, log_z, last, forward, links = 1.0, 0.0, 0.0, -1, [], []
        for place, s in zip(at, scores, strict=True):
            k, e, m = place - last - 1, math.exp(s), None
            if k:
                m = self._gap(k)
                f0, f1 = f0 * m[0] + f1 * m[2], f0 * m[1] + f1 * m[3]
                log_z += k * self.log_top
            f0, f1 = f0 + f1 * self.leave, (f0 * self.enter + f1 * self.stay) * e
            z = f0 + f1
            log_z += math.log(z)
            f0, f1, last = f0 / z, f1 / z, place
            forward.append((f0, f1))
            links.append((m, e))
        b0 = b1 = 1.0
        if (k := n - 1 - last) > 0:
            m = self._gap(k)
            b0, b1 = m[0] + m[1], m[2] + m[3]
            log_z += k * self.log_top
        log_z += math.log(f0 * b0 + f1 * b1)
        marginals = []
        for (g0, g1), (m, e) in zip(reversed(forward), reversed(links), strict=True):
            p0, p1 = g0 * b0, g1 * b1
            marginals.append(p1 / (p0 + p1))
            b0, b1 = b0 + self.enter * e * b1, self.leave * b0 + self.stay * e * b1
            if m:
                b0, b1 = m[0] * b0 + m[1] * b1, m[2] * b0 + m[3] * b1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
        marginals.reverse()
        return min(0.0, -log_z), marginals


def _features(log_clean: float, marginals: list[float], n: int) -> np.ndarray:
    toxic = -math.expm1(log_clean)
    odds = math.log(max(toxic, 1e-12)) - max(log_clean, -27.6)
    count = sum(marginals)
    return np.array([1.0, max(-12.0, min(12.0, odds)) / 4, math.log1p(count), 100 * count / max(n, 100)])


def learn_lexicon(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Entries with LEAST_CONTEXTS different surroundings, one a toxic text (copies share theirs), and log-odds of LEAST_ODDS;
    words that a listed beginning covers though they go with clean texts come with their own, lower odds."""
    number: dict[str, int] = {}
    pairs = array("q")
    n_toxic = sum(toxic)
    n_clean = len(toxic) - n_toxic
    for t, y in zip(texts, toxic, strict=True):
        if y:
            words, least = ["", *t.split(), ""], {}
            for a, w, b in zip(words, words[1:], words[2:], strict=False):
                c = zlib.crc32(f"{a} {b}".lower().encode("utf-8", "surrogatepass"))
                least[w] = min(c, least.get(w, c))
            for w, c in least.items():
                pairs.extend(number.setdefault(e, len(number)) << 32 | c for e in entries_of(w))
    contexts = np.bincount(np.unique(np.frombuffer(pairs, np.int64)) >> 32, minlength=len(number))
    wide = {e for e, k in number.items() if contexts[k] >= LEAST_CONTEXTS}
    del number, pairs, contexts
    seen = {0: defaultdict(int), 1: defaultdict(int)}
    for t, y in zip(texts, toxic, strict=True):
        found = set()
        for w in set(t.split()):
            found.update(e for e in entries_of(w) if e in wide)
        for e in found:
            seen[y][e] += 1
    odds_of = lambda k, c: math.log((k + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    odds = {e: odds_of(k, seen[0][e]) for e, k in seen[1].items()}
    best = sorted(((o, e) for e, o in odds.items() if o >= LEAST_ODDS), key=lambda x: (-x[0], x[1]))
    lexicon = {e: o for o, e in best}
    beginnings = {e for e in lexicon if e[0] != "="}
    harmless: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for t, y in zip(texts, toxic, strict=True):
        for w in {w.strip(_EDGE).lower() for w in t.split()}:
            if any(w[:n] in beginnings for n in PREFIXES if len(w) > n):
                harmless[w][y] += 1
    for w, (c, p) in harmless.items():
        if c and f"={w}" not in lexicon:
            lexicon[f"={w}"] = odds_of(p, c) - LEAST_ODDS
    return lexicon


class _Sample:
    """Texts as arrays: their words with features, in groups of like numbers of them."""

    def __init__(self, m: Model, texts: list[str], toxic: list[int]):
        place = {e: k for k, e in enumerate(m.weights)}
        known: dict[str, int] = {}
        feature, owner, rows = [], [], defaultdict(list)
        self.n_kinds = 0
        for d, (t, y) in enumerate(zip(texts, toxic, strict=True)):
            at, kinds, words = [], [], t.split()
            for k, w in enumerate(words):
                kind = known.get(w)
                if kind is None:
                    found, kind = m.features(w), -1
                    if found:
                        kind = self.n_kinds
                        feature += [place[x] for x in found]
                        owner += [kind] * len(found)
                        self.n_kinds += 1
                    known[w] = kind
                if kind >= 0:
                    at.append(k)
                    kinds.append(kind)
            rows[(len(at) - 1).bit_length() if at else -1].append((d, y, at, kinds, len(words)))
        self.feature, self.owner, self.groups = np.array(feature, np.int64), np.array(owner, np.int64), []
        for held in rows.values():
            size = max(len(r[2]) for r in held)
            gap, kind, on = (np.zeros((len(held), size), x) for x in (np.int64, np.int64, bool))
            rest = np.zeros(len(held), np.int64)
            for i, (_, _, at, kinds, n) in enumerate(held):
                gap[i, : len(at)] = np.diff(at, prepend=-1) - 1
                kind[i, : len(at)], on[i, : len(at)] = kinds, True
                rest[i] = n - 1 - (at[-1] if at else -1)
            self.groups.append((np.array([r[0] for r in held]), np.array([r[1] for r in held], bool), gap, kind, on, rest))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=weights[self.feature], minlength=self.n_kinds)

    def solve(self, move: np.ndarray, scores: np.ndarray, backward: bool = True) -> Iterator[tuple]:
        """By group: (group, log Z, marginals of its tokens or None)."""
        top, ratio, a, b = _powers(move)
        enter, leave, stay = np.exp(move)
        for group in self.groups:
            _, _, gap, kind, on, rest = group
            across = lambda k: a + (ratio ** k.astype(float))[:, None, None] * b
            f, log_z, forward, e = np.tile([1.0, 0.0], (len(rest), 1)), np.zeros(len(rest)), [], np.exp(scores[kind]) if len(scores) else np.ones(kind.shape)
            for k in range(gap.shape[1]):
                g = np.einsum("di,dij->dj", f, across(gap[:, k]))
                h = np.stack([g[:, 0] + g[:, 1] * leave, (g[:, 0] * enter + g[:, 1] * stay) * e[:, k]], axis=1)
                z = h.sum(axis=1)
                log_z += np.where(on[:, k], np.log(z), 0) + gap[:, k] * math.log(top)
                f = np.where(on[:, k, None], h / z[:, None], f)
                forward.append(f)
            v = across(rest).sum(axis=2)
            log_z += np.log((f * v).sum(axis=1)) + rest * math.log(top)
            if not backward:
                yield group, np.maximum(log_z, 0), None
                continue
            marginals = np.zeros(gap.shape)
            for k in range(gap.shape[1] - 1, -1, -1):
                p = forward[k] * v
                marginals[:, k] = np.where(on[:, k], p[:, 1] / p.sum(axis=1), 0)
                u = np.stack([v[:, 0] + enter * e[:, k] * v[:, 1], leave * v[:, 0] + stay * e[:, k] * v[:, 1]], axis=1)
                u = np.einsum("dij,dj->di", across(gap[:, k]), u)
                v = np.where(on[:, k, None], u / u.sum(axis=1, keepdims=True), v)
            yield group, np.maximum(log_z, 0), marginals

    def expected(self, labels: list[np.ndarray]) -> np.ndarray:
        """Expected numbers of steps clean to toxic, toxic to clean and toxic to toxic under independent token labels."""
        out = np.zeros(3)
        for (_, _, gap, _, on, rest), q in zip(self.groups, labels, strict=True):
            if not gap.shape[1]:
                continue
            before = np.where(gap[:, 1:] == 0, q[:, :-1], 0) * on[:, 1:]
            before = np.concatenate([np.zeros((len(rest), 1)), before], axis=1)
            both = (before * q).sum()
            last = q[np.arange(len(rest)), np.maximum(on.sum(axis=1) - 1, 0)] * (rest == 0)  # nothing comes after these
            out += [q.sum() - both, q.sum() - both - last.sum(), both]
        return out

    def log_z(self, move: np.ndarray, scores: np.ndarray) -> float:
        return sum(float(z.sum()) for _, z, _ in self.solve(move, scores, False))


def _fit_chain(m: Model, sample: _Sample, rounds: int = ROUNDS) -> None:
    """Adam on the likelihood of token labels, re-estimated ESTIMATES times: first every token with features of a toxic document
    is toxic, then it is as far as the chain says so, given that one token of the document is."""
    weights, move = np.array(list(m.weights.values())), m.move.copy()
    n, labels = len(weights), [np.where(g[1][:, None] & g[4], 1.0, 0.0) for g in sample.groups]
    theta = np.concatenate([weights, move])
    for _ in range(ESTIMATES):
        m1, m2, slope, told = 0.0, 0.0, np.zeros(3), sample.expected(labels)
        for i in range(1, rounds + 1):
            weights, move = theta[:n], theta[n:]
            scores, by_kind = sample.scores(weights), np.zeros(sample.n_kinds)
            for ((_, _, _, kind, on, _), _, marginals), q in zip(sample.solve(move, scores), labels, strict=True):
                by_kind += np.bincount(kind[on], weights=(q - marginals)[on], minlength=sample.n_kinds)
            if i % 4 == 1:  # three numbers: differences do
                now = sample.log_z(move, scores)
                slope = told - np.array([sample.log_z(move + 1e-4 * np.eye(3)[k], scores) - now for k in range(3)]) / 1e-4
            g = np.concatenate([np.bincount(sample.feature, weights=by_kind[sample.owner], minlength=n) - RIDGE * weights, slope - RIDGE * (move - m.move)])
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            theta = theta + STEP * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
            theta[n:] = np.clip(theta[n:], -12, 2)
        scores = sample.scores(theta[:n])
        labels = [np.where(g[1][:, None], np.minimum(1.0, p / -np.expm1(-np.maximum(z, 1e-9))[:, None]), 0.0) for g, z, p in sample.solve(theta[n:], scores)]
    m.weights, m.move = dict(zip(m.weights, theta[:n].tolist(), strict=True)), theta[n:]


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a ridge; toxic and clean rows weigh as they come."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.clip(np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w), -3, 3)
    return w


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from texts and 0/1 labels; exact copies count once. Without both classes, a model that finds nothing."""
    pairs = list(dict.fromkeys(zip(texts, toxic, strict=True)))
    texts, toxic = [p[0] for p in pairs], [p[1] for p in pairs]
    m = Model()
    if len(set(toxic)) < 2:
        return m
    m.weights = learn_lexicon(texts, toxic)  # where the fit begins
    shapes = {x for t, y in pairs if y for w in set(t.split()) if any(e in m.weights for e in entries_of(w)) for x in shapes_of(w)}
    m.weights |= dict.fromkeys(sorted(shapes), 0.0)
    sample = _Sample(m, texts, toxic)
    _fit_chain(m, sample)
    tag, x = _Tagger(m), []
    for t in texts:
        x.append(_features(*tag.chain.run(*tag.hits(t.split())), len(t.split())))
    m.calibration = _fit_logistic(np.array(x), np.array(toxic, float))
    return m


class _Tagger:
    """Scores of words, with a bounded memory of words met before."""

    MOST = 200_000

    def __init__(self, model: Model):
        self.model, self.chain, self.known = model, _Chain(model), {}

    def hits(self, words: list[str]) -> tuple[int, list[int], list[float]]:
        """How many words there are, and places and scores of those with features."""
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        try:
            s = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.model.score(w)
            s = [known[w] for w in words]
        at = [k for k, x in enumerate(s) if x]
        return len(words), at, [s[k] for k in at]

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score, and (start, end, probability) of tokens more likely toxic than not; offsets in code points."""
        n, at, scores = self.hits(text.split())
        log_clean, marginals = self.chain.run(n, at, scores)
        z = float(_features(log_clean, marginals, n) @ self.model.calibration)
        spans = []
        if any(p >= 0.5 for p in marginals):
            words = [m.span() for m in _WORD.finditer(text)]
            spans = [(*words[k], p) for k, p in zip(at, marginals, strict=True) if p >= 0.5]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), spans


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = _Tagger(model.value)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for t in batch.column(1):
                z, found = tag.score(t.as_py() or "")
                scores.append(z)
                spans.append([{"start": a, "end": b, "probability": p} for a, b, p in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array(spans, spans_type)], ["doc_id", "text_hash", "score", "spans"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS) -> Model:
    """A model from the rows of labels (doc_id, toxic) that are not held out: at most about most_toxic + most_clean texts of
    at most most_chars code points reach the driver, whatever the size of the tables. Of rows that share an id the least text
    counts, and the label 1 if there are both; rows without id, text or label are left out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known.where("toxic = 1"), "doc_id", most_toxic).unionByName(bounded_sample(known.where("toxic = 0"), "doc_id", most_clean))
    rows = docs.select("doc_id", "text").where(F.length("text") <= most_chars).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").select("text", "toxic").toArrow()
    return fit(rows.column(0).to_pylist(), rows.column(1).to_pylist())


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_hash, score, spans) for every row of docs. Null texts count as empty, which are scored as a text
    without any hit; rows without id and repeated rows are scored too; only id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return map_in_arrow(rows, _scorer(shared), "doc_id bigint, text_hash bigint, score double, spans array<struct<start:int,end:int,probability:double>>")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _dropper(model, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = _Tagger(model.value)
        for batch in batches:
            yield batch.filter(pa.array([tag.score(t.as_py() or "")[0] < threshold for t in batch.column(text_at)], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score is threshold or more, in one pass and without a shuffle. Null and empty texts are
    scored as a text without any hit, long ones whole; rows without id are judged too, repeated rows alike; columns may have
    any name; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))
    return map_in_arrow(docs, _dropper(shared, docs.columns.index("text"), threshold), docs.schema)
