"""Toxicity: a sparse linear classifier whose scores may not follow from which group a text mentions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIT_ROWS, crc_mod, free_names, in_order, labelled_sample, scored, sigmoid

#: Identity terms that are swapped for each other, by language.
IDENTITY = {
    "en": "women men girls boys muslims christians jews hindus buddhists atheists gays lesbians immigrants refugees americans mexicans asians africans europeans blacks whites elderly disabled muslim christian jewish hindu gay lesbian black white asian african mexican".split(),
    "de": "frauen männer mädchen jungen muslime christen juden hindus atheisten schwule lesben einwanderer flüchtlinge deutsche türken".split(),
    "fr": "femmes hommes filles garçons musulmans chrétiens juifs hindous athées homosexuels lesbiennes immigrés réfugiés français".split(),
    "es": "mujeres hombres niñas niños musulmanes cristianos judíos hindúes ateos homosexuales lesbianas inmigrantes refugiados españoles".split(),
}
GROUPS = {w: lang for lang, words in IDENTITY.items() for w in words}
#: Letters of the beginnings and ends of words that count as features beside whole words.
STARTS, ENDS = (3, 4, 5, 6), (4, 5, 6)
#: Features that a model may have at most beside those of identity terms, by how far they tell the labels apart alone.
FEATURES = 1500
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Of a lower-case word: itself (=), its beginnings (^) and its ends ($)."""
    return ["=" + word, *("^" + word[:n] for n in STARTS if len(word) >= n), *("$" + word[-n:] for n in ENDS if len(word) >= n)]


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swapped(found: set[str], turn: int) -> set[str]:
    """The words with each identity term exchanged for another of its language; for a text without any, one is put in."""
    own = [w for w in found if w in GROUPS]
    if not own:
        pool = IDENTITY[("en", "de", "fr", "es")[turn % 4]]
        return found | {pool[turn // 4 % len(pool)]}
    out = found - set(own)
    for w in own:
        pool = IDENTITY[GROUPS[w]]
        out.add(pool[(pool.index(w) + 1 + turn % (len(pool) - 1)) % len(pool)])
    return out


@dataclass
class ToxicityModel:
    """weights: of features; constant: the logit of a text that has none of them."""

    weights: dict[str, float]
    constant: float

    def __getstate__(self):
        return {"weights": self.weights, "constant": self.constant}

    def found(self, text: str) -> set[str]:
        """The model's features in the whole text, in one pass whatever their number."""
        if not hasattr(self, "_finder"):
            kinds: dict[str, list[str]] = {}
            for f in self.weights:
                kinds.setdefault(f[1:], []).append(f)
            self._finder = ahocorasick.Automaton()
            for part, names in kinds.items():
                self._finder.add_word(part, (len(part), names))
            self._finder.make_automaton()
        low, hits = text.lower(), set()
        for end, (size, names) in self._finder.iter(low) if self.weights else ():
            first = end < size or not WORD.match(low[end - size])
            last = end + 1 == len(low) or not WORD.match(low[end + 1])
            hits.update(f for f in names if (first or f[0] == "$") and (last or f[0] == "^"))
        return hits

    def score(self, texts: list[str]) -> np.ndarray:
        """Each feature counts once, however often a text has it."""
        return sigmoid(np.array([self.constant + sum(self.weights[f] for f in sorted(self.found(t))) for t in texts]))


def fit(rows: Iterable[tuple[str, int]], fairness: float = 0.2, sparsity: float = 1e-3, ridge: float = 2e-5, steps: int = 200, most: int = FEATURES) -> ToxicityModel:
    """Logistic loss + fairness * mean (logit of a row - logit of its counterfactual) ** 2 + a penalty on the weights.

    The penalty is sparsity * |w| first, by accelerated proximal steps, which leaves a few features; then
    ridge * w ** 2 on those, by Newton steps. Either label weighs the same in all.
    """
    vocabulary = {w: k for k, w in enumerate(GROUPS)}  # words as numbers, so that many texts stay small
    texts, known = [], []
    for t, label in rows:
        texts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words(t)), dtype=np.int32))
        known.append(label)
    y = np.array(known, dtype=float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    seen = np.bincount(np.concatenate(texts), minlength=len(vocabulary))
    seen[: len(GROUPS)] = 2
    ids: dict[str, int] = {}
    of_word = [np.array([ids.setdefault(f, len(ids)) for f in features(w)]) if n > 1 else None for w, n in zip(vocabulary, seen)]
    texts = [t[seen[t] > 1] for t in texts]
    bag = lambda t: np.unique(np.concatenate([of_word[k] for k in t])) if len(t) else np.zeros(0, dtype=np.int64)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    sums, often = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
    for t, v in zip(texts, weight * (2 * y - 1)):
        found = bag(t)
        sums[found] += v
        often[found] += 1
    every = list(ids)
    told = sorted(np.flatnonzero(often > 2), key=lambda f: (-abs(sums[f]) / often[f] ** 0.5, every[f]))[:most]
    names = sorted({*(every[f] for f in told), *(f for w in GROUPS for f in features(w))})
    place = np.full(len(ids), -1)
    place[[ids[f] for f in names]] = np.arange(len(names))
    terms = list(GROUPS)

    def matrix(texts: Iterable[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(y), len(names)), dtype=np.float32)
        for k, t in enumerate(texts):
            at = place[bag(t)]
            out[k, at[at >= 0]] = 1
        return out

    def counterfactual(t: np.ndarray, turn: int) -> np.ndarray:
        group = swapped({terms[k] for k in t[t < len(terms)]}, turn)
        return np.concatenate([t[t >= len(terms)], np.array(sorted(vocabulary[w] for w in group), dtype=np.int32)])

    x = matrix(texts)
    gap = matrix(counterfactual(t, k) for k, t in enumerate(texts))
    np.subtract(x, gap, out=gap)
    del texts, of_word, ids, every, vocabulary
    n = len(y)
    w = v = np.zeros(len(names))
    c = cv = 0.0
    top = np.ones(len(names), dtype=np.float32)
    for _ in range(20):  # the largest curvature of the smooth part, which bounds the steps
        top /= np.linalg.norm(top)
        top = x.T @ (weight.astype(np.float32) / 4 * (x @ top)) + np.float32(2 * fairness / n) * (gap.T @ (gap @ top))
    t, rate = 1.0, 1.0 / (0.3 + 1.2 * float(np.linalg.norm(top)))
    for _ in range(steps):
        p = sigmoid(x @ v.astype(np.float32) + cv)
        grad = x.T @ (weight * (p - y)).astype(np.float32) + 2 * fairness / n * (gap.T @ (gap @ v.astype(np.float32)))
        new = v - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
        c_new, t_new = cv - rate * (weight * (p - y)).sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, cv = new + (t - 1) / t_new * (new - w), c_new + (t - 1) / t_new * (c_new - c)
        w, c, t = new, c_new, t_new
    own = np.flatnonzero(w)
    z, g = np.c_[x[:, own], np.ones(n)].astype(float), np.c_[gap[:, own], np.zeros(n)].astype(float)
    u = np.r_[w[own], c]
    keep = np.r_[np.full(len(own), 2 * ridge), 1e-9]
    for _ in range(30):
        p = sigmoid(z @ u)
        down = z.T @ (weight * (p - y)) + 2 * fairness / n * g.T @ (g @ u) + keep * u
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 2 * fairness / n * g.T @ g + np.diag(keep)
        u = u - np.clip(np.linalg.solve(h, down), -2, 2)
    return ToxicityModel({names[k]: float(a) for k, a in zip(own, u) if abs(a) > 1e-6}, float(u[-1]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn=None, rows: int = FIT_ROWS, column: str = "score") -> DataFrame:
    """The documents with `score` (or another column), the chance that a text is toxic.

    Learns from the whole texts of at most `rows` labelled documents that `learn` allows; scores whole texts. A null or empty text gets the score of a text without words; repeated rows are all scored, alike;
    with no labels every score is a half; an empty table stays empty; other columns pass unchanged, but for a `score`,
    which is replaced.
    """
    learn = F.lit(True) if learn is None else learn
    return scored(docs, fit(in_order(labelled_sample(docs, labels, "toxic", learn, rows))).score, column)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = crc_mod("doc_id", 3) == 1
    out = toxicity_scores(docs.select("doc_id", "text"), labels, ~held)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns, whatever their names."""
    (score,) = free_names(docs, "score")
    return toxicity_scores(docs, labels, crc_mod("doc_id", 3) != 1, column=score).where(F.col(score) < THRESHOLD).drop(score)
