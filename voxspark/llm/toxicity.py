"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons of insults, lexicons of words and of word
beginnings mined from labelled texts, and patterns (an insult after a pronoun, several
insults, none at all, and what share of the words is suspect: an insult, or begins like words that
stand in toxic texts more often than in clean ones).  A generative label model estimates how often each voter fires
on toxic and on clean texts, and how much voters repeat each other; voters that
correlate share their weight.  It is fitted by expectation maximisation on the numbers of
all vote patterns in the training rows, where labelled texts keep their labels.  A linear
classifier on hashed words, word beginnings and votes then learns from the posterior labels.

Bounds: mining takes at most ``toxic`` and ``clean`` labelled texts, the classifier as many
by their posterior labels; votes are counted over all training rows (at most
2**voters patterns); scoring reads every text whole.

Results for odd inputs: null and empty texts get the classifier's bias; without labelled
texts only the fixed lexicons and patterns vote; rows with null or repeated ids are
scored each, and rows with null ids are not learnt from; texts of any length are read whole; an
empty table gives no rows; other columns pass through, but columns named `score` and `predicted` give way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .bytehash import U, Rolling, batches, combine, pieces
from .labelled import binary_labels, sample_texts, scored
from ..scratch import Scratch

#: Common insults, and pronouns of the second person.
ENGLISH = "idiot idiots moron morons stupid dumb imbecile loser losers scum trash garbage clown worthless pathetic disgusting filthy vermin freak jerk bastard bitch crap retard ugly fool hateful scumbag"
OTHERS = "idiota imbécil estúpido estúpida basura asqueroso asquerosa inútil patético payaso idiote imbécile stupide débile ordure minable dégoûtant pathétique connard salaud bouffon trottel idioten dummkopf abschaum arschloch versager widerlich erbärmlich dreck blödmann nutzlos"
PRONOUNS = "you your youre ur tu eres usted vous toi vos du dein deine sie ihr"
PREFIXES = (4, 5, 6)
SUSPECT_PREFIXES = (4, 5, 6, 7, 8)
PATTERNS = 5  # voters beyond the lexicons and beginnings
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class ToxicityParams:
    toxic: int = 1500  # texts to learn from
    clean: int = 4500
    max_bytes: int = 1 << 16
    least_docs: int = 3
    least_odds: float = 3.0
    suspect_odds: float = 1.5
    dense: float = 0.01  # share of suspect words from which on a text is full of them
    sparse: float = 0.0025  # and below which it has hardly any
    word_voters: int = 4
    buckets: int = 1 << 18
    epochs: int = 200
    rate: float = 0.5
    decay: float = 2e-3
    least_weight: float = 0.1
    threshold: float = 0.5
    rounds: int = 40


@dataclass
class Voters:
    """Sorted keys of each lexicon; beginnings of words by length."""

    lexicons: list[np.ndarray]
    beginnings: dict[int, np.ndarray]
    pronouns: np.ndarray
    suspects: dict[int, np.ndarray] = field(default_factory=dict)
    dense: float = 0.01
    sparse: float = 0.0025
    names: list[str] = field(default_factory=list)


class Words:
    """Words of some texts, in lower case, by key."""

    def __init__(self, texts: list[bytes]):
        texts = [t.decode("utf-8", "replace").lower().encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"".join(t + b" " for t in texts), dtype=np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        flag = np.zeros(len(data) + 2, dtype=np.int8)
        flag[1:-1] = WORD[data]
        turn = np.flatnonzero(np.diff(flag))
        self.a, self.b = turn[::2], turn[1::2]
        self.rolling = Rolling(data)
        self.of = np.searchsorted(starts, self.a, "right") - 1
        self.key = self.rolling.slices(self.a, self.b)

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first n bytes of longer words, and which words these are."""
        k = np.flatnonzero(self.b - self.a > n)
        return self.rolling.slices(self.a[k], self.a[k] + n), k


def keys_of(words: str) -> np.ndarray:
    return np.unique(Words([words.encode()]).key)


def _in(keys: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(lexicon, keys), len(lexicon) - 1)
    return lexicon[at] == keys


def beyond_chance(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Which of many features go with toxic texts: in a toxic and b clean ones, at an overall share of toxic ones.

    The bound on the chance of such a split must stay small even for the most
    striking of all features that were looked at (Chernoff's bound, with a union bound).
    """
    n = np.maximum(a + b, 1e-9)
    q = np.clip(a / n, 1e-12, 1 - 1e-12)
    share = min(max(share, 1e-9), 1 - 1e-9)
    bound = n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))
    return (q > share) & (bound >= np.log(max(1, int((n >= 2).sum()))) + 2)


def _telling(keys_by_text: list[np.ndarray], y: np.ndarray, p: ToxicityParams, least_odds: float) -> np.ndarray:
    """Keys that stand in several toxic texts and hardly in clean ones."""
    toxic, clean = int(y.sum()), int((y == 0).sum())
    if not toxic or not clean:
        return np.empty(0, dtype=U)
    sizes = [len(k) for k in keys_by_text]
    keys, at = np.unique(np.concatenate(keys_by_text), return_inverse=True)
    label = np.repeat(y, sizes)
    a, b = np.bincount(at, label, len(keys)), np.bincount(at, 1 - label, len(keys))
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    return keys[(a >= p.least_docs) & (odds >= least_odds) & beyond_chance(a, b, toxic / (toxic + clean))]


def make_voters(texts: list[bytes], classes: list[int], p: ToxicityParams) -> Voters:
    keys, starts = [], {n: [] for n in SUSPECT_PREFIXES}
    y = np.array(classes, dtype=np.int64)
    for t in texts:
        w = Words([t])
        keys.append(np.unique(w.key))
        for n in SUSPECT_PREFIXES:
            starts[n].append(np.unique(w.beginnings(n)[0]))
    mined = _telling(keys, y, p, p.least_odds) if texts else np.empty(0, dtype=U)
    lexicons = [keys_of(ENGLISH), keys_of(OTHERS)] + [mined[mined % U(p.word_voters) == U(k)] for k in range(p.word_voters)]
    begin = lambda lengths, odds: {n: _telling(starts[n], y, p, odds) if texts else np.empty(0, dtype=U) for n in lengths}
    return Voters(lexicons, begin(PREFIXES, p.least_odds), keys_of(PRONOUNS), begin(SUSPECT_PREFIXES, p.suspect_odds), p.dense, p.sparse)


def vote(texts: list[bytes], v: Voters) -> np.ndarray:
    """A bit for each voter that fires, for each text."""
    parts, of = pieces(texts, 1 << 20)
    out, hits, doubts, words = (np.zeros(len(texts), dtype=np.int64) for _ in range(4))
    for i, j in batches(parts, 1 << 20):
        w = Words(parts[i:j])
        insult, bit = np.zeros(len(w.key), dtype=bool), 0
        fire = lambda words: np.bitwise_or.at(out, of[i:j][w.of[words]], np.int64(1) << bit)  # noqa: B023, E731
        for lexicon in v.lexicons:
            found = _in(w.key, lexicon)
            insult |= found
            fire(found)
            bit += 1
        for n in PREFIXES:
            key, at = w.beginnings(n)
            at = at[_in(key, v.beginnings[n])]
            insult[at] = True
            fire(at)
            bit += 1
        near = np.zeros(len(w.key), dtype=bool)
        if len(w.key) > 1:
            after = _in(w.key[:-1], v.pronouns) & (w.of[:-1] == w.of[1:])
            near[1:] = insult[1:] & after
            near[2:] |= insult[2:] & after[:-1] & (w.of[:-2] == w.of[2:])
        fire(near)
        suspect = insult.copy()
        for n, starts in v.suspects.items():
            key, at = w.beginnings(n)
            suspect[at[_in(key, starts)]] = True
        np.add.at(hits, of[i:j][w.of[insult]], 1)
        np.add.at(doubts, of[i:j][w.of[suspect]], 1)
        np.add.at(words, of[i:j][w.of], 1)
    bit = len(v.lexicons) + len(PREFIXES) + 1
    dense = (doubts >= 2) & (doubts >= v.dense * words)
    for k, fires in enumerate((hits >= 2, doubts < v.sparse * words, dense, (hits == 0) & ~dense)):
        out |= fires.astype(np.int64) << (bit + k)
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray, gold_y: np.ndarray, voters: int, rounds: int):
    """Posterior log odds of toxicity as a function of a vote pattern.

    patterns and counts: of all rows; gold and gold_y: patterns and classes of labelled
    texts.  Alternates posteriors and rates of firing; the weight of a voter is the
    inverse of how many voters it amounts to, by its correlations within the classes.
    """
    fires = lambda x: ((x[:, None] >> np.arange(voters)) & 1).astype(np.float64)
    f, known = fires(patterns), fires(gold)
    guess = np.where((f[:, -2] > 0) | ((f[:, -1] == 0) & (f[:, -3] == 0)), 0.9, 0.02)  # at first: many suspect words, or an insult among few others
    weight = np.ones(voters)
    anchor = min(1.0, counts.sum() / max(1, 4 * len(gold))) if len(gold) else 0.0
    for _ in range(rounds):
        rate, joint = [], []
        for y in (0, 1):
            m = counts * (guess if y else 1 - guess)
            g = anchor * (gold_y == y)
            total = m.sum() + g.sum()
            r = (m @ f + g @ known + 0.5) / (total + 1)
            rate.append(np.clip(r, 1e-4, 1 - 1e-4))
            centred, centred_g = f - r, known - r
            cov = (centred * m[:, None]).T @ centred + (centred_g * g[:, None]).T @ centred_g
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            joint.append((total, np.clip(cov / np.outer(sd, sd), 0, 1)))
        corr = sum(t * c for t, c in joint) / max(sum(t for t, _ in joint), 1e-9)
        np.fill_diagonal(corr, 1)
        weight = 1 / corr.sum(axis=1)
        prior = np.log((joint[1][0] + 1) / (joint[0][0] + 1))
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        new = 1 / (1 + np.exp(-np.clip(prior + f @ (weight * on) + (1 - f) @ (weight * off), -50, 50)))
        if np.abs(new - guess).max(initial=0) < 1e-6:
            break
        guess = new
    return lambda x: prior + fires(x) @ (weight * on) + (1 - fires(x)) @ (weight * off)


def _buckets(w: Words, p: ToxicityParams):
    """(text, bucket) of all features."""
    yield w.of, (combine(w.key) % U(p.buckets)).astype(np.int64)
    for n in PREFIXES:
        key, at = w.beginnings(n)
        yield w.of[at], (combine(key, np.full(len(key), U(n))) % U(p.buckets)).astype(np.int64)


def _bits(votes: np.ndarray, voters: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, voter) of all votes."""
    return np.nonzero((votes[:, None] >> np.arange(voters)) & 1)


def fit_linear(texts: list[bytes], votes: np.ndarray, voters: int, target: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights of features, present or not, and a bias, for posterior labels in [0, 1]; votes are features beyond the buckets."""
    size = p.buckets + voters
    if not len(texts):
        return np.zeros(size, dtype=np.float32), 0.0
    rows = [np.unique(np.concatenate([b for _, b in _buckets(Words([t]), p)])) for t in texts]
    voted, by = _bits(votes, voters)
    of, at = np.concatenate([np.repeat(np.arange(len(rows)), [len(r) for r in rows]), voted]), np.concatenate([*rows, p.buckets + by])
    seen = np.bincount(at, minlength=size)
    mean = target.mean()
    toxic = np.bincount(at, target[of], size)
    use = (seen >= p.least_docs) & beyond_chance(toxic, seen - toxic, mean)
    ok = use[at]
    of, at = of[ok], at[ok]
    share = (target / max(mean, 1e-9) + (1 - target) / max(1 - mean, 1e-9)) / (2 * len(rows))  # both classes count alike
    w, speed, bias, bias_speed = np.zeros(size), np.full(size, 1e-6), 0.0, 1e-6
    for epoch in range(p.epochs):
        if epoch == p.epochs * 2 // 3:  # small weights go, the others are fitted on
            keep = np.abs(w) >= p.least_weight
            w[~keep] = 0
            ok = keep[at]
            of, at = of[ok], at[ok]
        z = bias + np.bincount(of, w[at], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * share
        grad = np.bincount(at, g[of], size) + p.decay * w / len(rows)
        speed += grad * grad
        w -= p.rate * grad / np.sqrt(speed)
        bias_speed += g.sum() ** 2
        bias -= p.rate * g.sum() / np.sqrt(bias_speed)
    w[np.abs(w) < p.least_weight] = 0
    return w.astype(np.float32), float(bias)


def linear_scores(texts: list[bytes], v: Voters, weights: np.ndarray, bias: float, p: ToxicityParams) -> np.ndarray:
    parts, of = pieces(texts, 1 << 20)
    texts_, buckets_ = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in batches(parts, 1 << 20):
        for text, bucket in _buckets(Words(parts[i:j]), p):
            told = weights[bucket] != 0
            texts_.append(of[i:j][text[told]])
            buckets_.append(bucket[told])
    code = np.unique(np.concatenate(texts_) * p.buckets + np.concatenate(buckets_))
    z = bias + np.bincount(code // p.buckets, weights[code % p.buckets], len(texts))
    voted, by = _bits(vote(texts, v), len(weights) - p.buckets)
    z += np.bincount(voted, weights[p.buckets + by], len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, column: str = "toxic", params: ToxicityParams = ToxicityParams(), scratch: Scratch | None = None) -> DataFrame:
    """docs with score and predicted; learns only from rows where `learn` holds."""
    spark, p = docs.sparkSession, params
    scratch = scratch or Scratch(spark, "toxicity")
    texts, classes, _ = sample_texts(docs, binary_labels(labels, column, learn), (p.clean, p.toxic), p.max_bytes)
    voters = make_voters(texts, classes, p)
    number = len(voters.lexicons) + len(PREFIXES) + PATTERNS

    rows = docs.where(F.coalesce(learn, F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    votes = scratch.keep(scored(rows, lambda batch: vote(batch, voters), "votes").select("doc_id", F.col("votes").cast("long").alias("votes")), "votes")
    seen = sorted(votes.groupBy("votes").count().collect())  # 2**number rows at most, in a fixed order
    patterns, counts = np.array([r["votes"] for r in seen], dtype=np.int64), np.array([r["count"] for r in seen], dtype=np.float64)
    posterior = label_model(patterns, counts, vote(texts, voters), np.array(classes, dtype=np.int64), number, p.rounds) if len(patterns) else (lambda x: np.zeros(len(x)))

    toxic = [int(x) for x in patterns[posterior(patterns) > 0]]
    guessed = votes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("votes").alias("votes")).select("doc_id", F.col("votes").isin(toxic).cast("int").alias("y"))
    taught, _, sizes = sample_texts(docs, guessed, (p.clean, p.toxic), p.max_bytes)
    cast = vote(taught, voters)
    target = 1 / (1 + np.exp(-np.clip(posterior(cast), -50, 50))) if taught else np.empty(0)
    weights, bias = fit_linear(taught, cast, number, target, p)
    model = spark.sparkContext.broadcast(weights)  # 4 bytes a feature
    scratch.drop(votes)
    return scored(docs, lambda batch: linear_scores(batch, voters, model.value, bias, p)).withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))
