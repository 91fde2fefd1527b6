"""Toxicity scores by a support vector machine with a subsequence string kernel on Nyström landmarks.

The kernel compares words by the subsequences of ``3`` characters they share, gaps included: a subsequence
that spans n characters weighs ``DECAY ** n``, spans end at ``SPAN``, and a mark stands before the first
character. So an insult with inserted, dropped or changed characters stays close to the insult. Single
characters between blanks count as one spelt-out word.

Labels are on texts, so words to learn from are found first, of two kinds. An insult is one word in many. Words
with a character run that occurs in toxic texts alone, more often than chance explains, are positive examples, and
so are disguises of the most frequent; words of other texts are the negative ones, with the worst mistakes added
twice. A machine is trained in the space of ``LANDMARKS`` words. Its weights are a sum over landmarks of
their subsequences, so they collapse into one table of weights by subsequence, and a text is scored by
looking its subsequences up, in bulk, without a landmark in sight.

Toxic texts without such a word differ by how many of their words are of some sort: they carry runs in a share of
their words with far higher odds than clean texts (a likelihood-ratio test, at a chance over all runs). The best run,
and those that are not significantly worse, make a set; the next set comes from the toxic texts that none of these
explains, and so on, so that each language gets its own. For each set another machine learns the toxic texts' words
that hold its runs against words that do not. No column but the text is looked at.

A text's probability is a logistic function of its highest words and of how many words are above the first machine's
margin, and of the share of words above each other machine's, fitted on labelled texts that no machine learnt from.

Null and empty texts, and texts without words, score as a text whose words are all unremarkable. Null
labels, labels without a document and labels with a null doc_id teach nothing. With labels of one class
only, or none, every text gets the smoothed base rate. Equal texts are scored alike, however often they occur, and so
are rows with a null doc_id, whose ``held_out`` is null; the score replaces a column of its name, other columns stay.
"""

from __future__ import annotations

import dataclasses
import math
import statistics
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality

SPAN = 6
DECAY = 0.7
LANDMARKS = 96
SAMPLE_PER_CLASS = 2_000
POSITIVE, NEGATIVE = 1_500, 4_000
#: Chance, over all runs, that a character run is taken for a mark of toxic texts by accident.
CHANCE = 1e-3
#: Shares of a text's words with a run that are told apart in the contrast of toxic and clean texts, and its least
#: odds ratio.
SHARES = (0.0, 0.005, 0.01, 0.02)
ODDS = 8.0
#: Added to the share of marked words before its logarithm.
LEAST_SHARE = 0.005
#: Positive words, most frequent first, whose disguises are learnt as well.
DISGUISED = 60
_IDS = 64
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _alphabet() -> np.ndarray:
    """Character code -> one of 64 numbers; 0 is white space, and the mark before a word."""
    table = np.array([1 + c % 62 for c in range(0x250)], dtype=np.int64)
    table[[*range(9, 14), *range(28, 33), 0x85, 0xA0]] = 0
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = table[ord(c.upper())] = 1 + k
    for c in range(0x21, 0x7F):
        if not chr(c).isalpha():
            table[c] = 27 + c % 16
    for c in range(0xC0, 0x250):
        table[c] = 43 + ord(chr(c).lower()[0]) % 20
    return table


_TABLE = _alphabet()


def numbers(text: str) -> np.ndarray:
    """Alphabet numbers of " " + text + " ", where blanks inside a spelt-out word are 63."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], 1 + codes % 62)
    blank = own == 0
    if len(own) > 6:
        single = blank[2:-2] & blank[:-4] & blank[4:] & ~blank[1:-3] & ~blank[3:-1]
        own[2:-2][single] = 63
    return own


def _subsequences(own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(positions of the first character, subsequence code, weight) for every shape of gaps."""
    word = np.cumsum(own == 0)
    for a, b in _GAPS:
        if len(own) <= b:
            return
        n = len(own) - b
        at = np.flatnonzero((word[:n] == word[b:]) & (own[b:] != 0))
        yield at, (own[at] * _IDS + own[at + a]) * _IDS + own[at + b], DECAY ** (b + 1)


def _scale(length: np.ndarray) -> np.ndarray:
    """Norm of a word of so many characters (its mark included) whose subsequences all differ; of SPAN at least."""
    length = np.maximum(length, SPAN)
    total = np.zeros(len(length))
    for _, b in _GAPS:
        total += np.maximum(0, length - b) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def features(word: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of one word, scaled."""
    own = numbers(word)[:-1]
    codes, weights = [], []
    for _, code, weight in _subsequences(own):
        codes.append(code)
        weights.append(np.full(len(code), weight))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0)
    keys, back = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(back, np.concatenate(weights)) / _scale(np.array([len(own)]))[0]


def word_scores(text: str, weights: np.ndarray) -> np.ndarray:
    """Each machine's value (a column of ``weights``) for every word of a text, without its intercept."""
    own = numbers(text)
    value = np.zeros((len(own), weights.shape[1]))
    for at, code, weight in _subsequences(own):
        value[at] += weight * weights[code]
    starts = np.flatnonzero(own == 0)
    length = np.diff(np.append(starts, len(own)))
    total = np.add.reduceat(value, starts, axis=0)
    real = length > 1
    return total[real] / _scale(length[real].astype(float))[:, None]


@dataclasses.dataclass
class Model:
    #: Weights by subsequence and intercepts, a column for each machine, that of insults first.
    table: np.ndarray | None
    intercepts: np.ndarray
    weights: list[float]
    bias: float
    base: float

    def summary(self, text: str | None) -> list[float]:
        """[highest word, second highest, log of 1 + words above the margin, log share above each other margin]."""
        every = word_scores(text, self.table) + self.intercepts if text else np.zeros((0, len(self.intercepts)))
        if not len(every):
            return [-1.0, -1.0, 0.0] + [math.log(LEAST_SHARE)] * (len(self.intercepts) - 1)
        values = every[:, 0]
        top = np.partition(values, -2)[-2:] if len(values) > 1 else np.array([-1.0, values[0]])
        shares = np.log(LEAST_SHARE + (every[:, 1:] > 0).mean(axis=0)).tolist()
        return [float(np.clip(top[1], -2, 2)), float(np.clip(top[0], -2, 2)), math.log1p(float((values > 0).sum())), *shares]

    def score(self, text: str | None) -> float:
        if self.table is None:
            return self.base
        z = sum(w * x for w, x in zip(self.weights, self.summary(text), strict=True)) + self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _runs(word: str) -> set[str]:
    own = "^" + word
    return {own[i : i + 4] for i in range(len(own) - 3)}


def witnesses(words: list[set[str]], toxic: np.ndarray) -> set[str]:
    """Character runs in so many toxic texts, and in so few others, that chance does not explain it."""
    in_toxic, in_clean = Counter(), Counter()
    for own, y in zip(words, toxic, strict=True):
        (in_toxic if y else in_clean).update(set().union(*map(_runs, own)) if own else ())
    share = max(0.02, float(toxic.mean()))
    allowed = int(0.002 * (toxic == 0).sum())
    # the chance that one of so many runs falls on toxic texts alone, each time it occurs
    least = math.log(CHANCE / max(1, len(in_toxic))) / math.log(share)
    return {run for run, n in in_toxic.items() if in_clean[run] <= min(allowed, n // 20) and n >= least}


def contrasts(words: list[set[str]], toxic: np.ndarray, explained: np.ndarray) -> list[set[str]]:
    """Sets of character runs that toxic texts carry in some share of their words with higher odds than clean ones.

    Each set is what tells most of the toxic texts that are not ``explained`` yet, by the sets before it or otherwise:
    other languages, mostly.
    """
    n = [int((toxic == k).sum()) for k in (0, 1)]
    carried: list[dict] = []
    for own in words:
        in_words = Counter(run for word in own for run in _runs(word))
        carried.append({(run, k) for run, c in in_words.items() for k in SHARES if c > k * len(own)})
    clean = Counter(key for own, y in zip(carried, toxic, strict=True) if not y for key in own)
    left = [own for own, y, known in zip(carried, toxic, explained, strict=True) if y and not known]
    least = statistics.NormalDist().inv_cdf(1 - CHANCE / max(1, len(set().union(*left)))) ** 2 if left else 0.0
    found: list[set[str]] = []
    while left and n[0]:
        m, ratios = len(left), {}
        share = m / (m + n[0])
        for key, a in Counter(key for own in left for key in own).items():
            b = clean[key]
            cells = (a + 0.5, m - a + 0.5, b + 0.5, n[0] - b + 0.5)
            if cells[0] * cells[3] < ODDS * cells[1] * cells[2]:
                continue
            expected = [(x + y) * z for x, y in ((a, b), (m - a, n[0] - b)) for z in (share, 1 - share)]
            ratio = 2 * sum(o * math.log(o / e) for o, e in zip((a, b, m - a, n[0] - b), expected, strict=True) if o)
            if ratio >= least:
                ratios[key] = ratio
        if not ratios:
            break
        best = {key for key, ratio in ratios.items() if ratio >= max(ratios.values()) - least}
        found.append({run for run, _ in best})
        left = [own for own in left if best.isdisjoint(own)]
    return found


def disguised(word: str) -> list[str]:
    """The word with characters set between, doubled, inserted or replaced."""
    inner = len(word) // 2
    return [*(c.join(word) for c in ".-*_ "), word[:inner] + "*" + word[inner:], word[:inner] + "." + word[inner:], word[:inner] + word[inner - 1] * 2 + word[inner:], word[:1] + "1" + word[2:], word[:inner] + "*" + word[inner + 1 :]]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 40) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent; the last weight is the intercept.

    Examples that rest at a bound are looked at again in every fifth round only.
    """
    x = np.column_stack([x, np.ones(len(x))]) * y[:, None]
    norm, bound = (x * x).sum(axis=1).tolist(), cost.tolist()
    alpha, w = [0.0] * len(x), np.zeros(x.shape[1])
    rng = np.random.default_rng(7)
    moving = np.arange(len(x))
    for epoch in range(epochs):
        every = epoch % 5 == 0
        moved, last = [], 0.0
        for i in rng.permutation(len(x) if every else moving).tolist():
            before = alpha[i]
            now = min(max(before - (float(x[i] @ w) - 1) / norm[i], 0.0), bound[i])
            if now != before:
                alpha[i] = now
                w += (now - before) * x[i]
                moved.append(i)
                last = max(last, abs(now - before))
        moving = np.array(moved, dtype=np.int64)
        if every and last < 1e-4:
            break
    return w[:-1], float(w[-1])


_AROUND = ".,;:!?\"'()*#%&$|"


def _words(text: str) -> set[str]:
    return {w for w in (x.strip(_AROUND) for x in text.lower().split()) if 0 < len(w) <= 24}


def _tokens(text: str) -> set[str]:
    return {w for w in text.lower().split() if len(w) <= 24}


def _machine(positive: list[str], pool: list[str], known_disguises: int = 0, turns: int = 3) -> tuple[np.ndarray, float]:
    """Table of weights by subsequence, and intercept, of the machine that tells positive words from the pool's."""
    positive = positive + [x for w in positive[:known_disguises] for x in disguised(w)]
    rng = np.random.default_rng(11)
    negative = [pool[i] for i in rng.permutation(len(pool))[:NEGATIVE]]
    half = min(len(positive), LANDMARKS // 2)
    marks = [*positive[: half // 2], *[positive[i] for i in rng.permutation(len(positive))[: half - half // 2]], *negative[: LANDMARKS - half]]
    marks = list(dict.fromkeys(marks))
    space = np.zeros((len(marks), _IDS**3), dtype=np.float32)
    for row, word in zip(space, marks, strict=True):
        codes, weights = features(word)
        row[codes] = weights
    gram = (space @ space.T).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6) + 1e-3)) @ vectors.T

    known: dict[str, np.ndarray] = {}

    def embed(own: list[str]) -> np.ndarray:
        for word in own:
            if word not in known:
                codes, weights = features(word)
                known[word] = space[:, codes] @ weights
        return np.array([known[w] for w in own]).reshape(len(own), len(marks)) @ root

    table, intercept = np.zeros(_IDS**3), 0.0
    for turn in range(turns):
        x = np.vstack([embed(positive), embed(negative)])
        sign = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        cost = np.where(sign > 0, 10.0 * max(1.0, len(negative) / (4 * len(positive))), 10.0)
        w, intercept = _svm(x, sign, cost)
        table = (root @ w) @ space.astype(np.float64)
        if turn < turns - 1:  # add the clean words that the machine is most wrong about
            more = pool if len(pool) <= 40_000 else [pool[i] for i in rng.permutation(len(pool))[:40_000]]
            scores = np.array([v for w_ in range(0, len(more), 2000) for v in _bulk(more[w_ : w_ + 2000], table)])
            worst = [more[i] for i in np.argsort(-scores)[:1500]]
            negative = list(dict.fromkeys(negative + worst))
    return table.astype(np.float32), intercept


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The model; it is learnt from a sample of bounded size, on the driver."""
    texts, y, counts = quality.sample(docs, labels, label, per_class)
    base = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    return learn(texts, y, base)


def learn(texts: list[str], y: np.ndarray, base: float) -> Model:
    """The model of labelled texts, where a share of base has label 1."""
    if len(set(y.tolist())) < 2:
        return Model(None, np.zeros(1), [], 0.0, base)
    held = np.zeros(len(y), dtype=bool)
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        held[own[max(1, int(0.7 * len(own))) :]] = True
    words = [_words(texts[i]) for i in np.flatnonzero(~held)]
    toxic = y[~held]
    seen, clean = Counter(), Counter()
    for own, t in zip(words, toxic, strict=True):
        (seen if t else clean).update(own)
    # clean words as they stand, so that signs around a word are seen to be harmless
    pool = sorted(set().union(clean, *(_tokens(t) for t, h, z in zip(texts, held, y, strict=True) if not h and not z)))
    rare = witnesses(words, toxic)
    insults = np.array([any(not rare.isdisjoint(_runs(w)) for w in own) for own in words], dtype=bool)
    sets = contrasts(words, toxic, insults)
    positive = sorted((w for w in seen if not rare.isdisjoint(_runs(w)) and not clean[w]), key=lambda w: (-seen[w], w))[:POSITIVE]
    if not positive and not sets:
        return Model(None, np.zeros(1), [], 0.0, base)
    # without insults, no word is above the margin
    machines = [_machine(positive, pool, DISGUISED) if positive else (np.zeros(_IDS**3, dtype=np.float32), -1.0)]
    for runs in sets:
        held_by = {w: not runs.isdisjoint(_runs(w)) for w in set(seen) | set(clean)}
        own = sorted((w for w in seen if held_by[w]), key=lambda w: (-seen[w], w))[:POSITIVE]
        machines.append(_machine(own, sorted(w for w, h in held_by.items() if not h), turns=2))
    model = Model(np.stack([t for t, _ in machines], axis=1), np.array([i for _, i in machines]), [], 0.0, base)
    rest = np.flatnonzero(held)
    if len(set(y[rest].tolist())) < 2:
        rest = np.arange(len(y))
    own = y[rest]
    weight = np.where(own == 1, base / max(1, (own == 1).sum()), (1 - base) / max(1, (own == 0).sum())) * len(own)
    model.weights, model.bias = quality._logistic(np.array([model.summary(texts[i]) for i in rest]), own.astype(float), weight)
    return model


def _bulk(words: list[str], table: np.ndarray) -> np.ndarray:
    return word_scores(" ".join(words), table[:, None])[:, 0]


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(x) for x in texts], dtype="float64")

    return docs.withColumn(column, probability(F.col("text")))
