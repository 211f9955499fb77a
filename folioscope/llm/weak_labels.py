"""Toxicity by weak supervision.

Voters look at a whole text: lexicons of abusive words, the words that the
labelled rows show to be typical of toxic texts (dealt into several voters),
and patterns.  A generative model with a hidden label estimates how often each
voter fires on toxic and on clean texts, and how strongly voters agree beyond
that; voters that repeat one another share their weight.  A linear classifier
is trained on the posterior labels and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import ALNUM, U64, Words, gram_hashes, loose, per_text, text_portions
from folioscope.llm.samples import labelled_sample, sampled_texts
from folioscope.llm.set_join import word_hashes
from folioscope.session import cut_lineage

#: Lexicon voters: words of abuse by kind.
LEXICONS: dict[str, tuple[str, ...]] = {
    "persons": ("idiot", "idiots", "moron", "morons", "loser", "losers", "fool", "imbecile", "jerk", "clown", "clowns"),
    "contempt": ("pathetic", "worthless", "disgusting", "despicable", "repulsive"),
    "stupidity": ("stupid", "dumb", "brainless", "stupidity", "idiotic", "moronic"),
    "filth": ("scum", "trash", "garbage", "filth", "vermin", "scumbag"),
}
#: Pattern voters: one of the first words followed by one of the second.
PATTERNS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "addressed": (("you", "such", "absolute", "utter", "complete"), ("idiot", "moron", "loser", "fool", "clown", "scum", "trash", "stupid", "pathetic", "worthless", "disgusting")),
    "threats": (("kill", "hurt", "hate"), ("yourself", "you", "them")),
    "strengthened": (("so", "very", "really", "are"), ("stupid", "pathetic", "disgusting", "worthless", "dumb")),
}
MINED_VOTERS = 4
MINED_WORDS = 200
#: Lengths of stems in characters.
STEMS = (4, 5, 6)


@dataclass
class Voters:
    """Word lists as sorted hashes; ``mined`` holds one list for each mined voter."""

    mined: Sequence[Sequence[str]]

    def __post_init__(self) -> None:
        self.lists = [*LEXICONS.values(), *self.mined]
        self.words = sorted({w for one in self.lists for w in one})
        where = {w: i for i, w in enumerate(self.words)}
        self.member = np.zeros((len(self.words), len(self.lists)), np.int64)
        for at, one in enumerate(self.lists):
            self.member[[where[w] for w in one], at] = 1
        # whole words, and stems by their length in bytes: sorted hashes and the words they stand for
        self.known: dict[int | None, tuple[np.ndarray, np.ndarray]] = {}
        kinds = {w: len(w[:-1].encode()) if w.endswith("*") else None for w in self.words}
        for kind in set(kinds.values()):
            own = [w for w in self.words if kinds[w] == kind]
            hashes = word_hashes([w.rstrip("*") for w in own])
            order = np.argsort(hashes)
            self.known[kind] = hashes[order], np.array([where[own[i]] for i in order])
        self.pairs = [np.sort(np.array([gram_hashes(word_hashes([a, b]), 2)[0] for a in left for b in right], U64)) for left, right in PATTERNS.values()]
        self.votes = len(self.lists) + len(self.pairs) + 1
        self.features = self.votes + len(self.words) + 2

    def look(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Votes (0 or 1), then whether each word occurs, then two densities."""
        rows = len(offsets) - 1
        words = Words(data, offsets, ALNUM)
        hashes, count = words.hashes(), np.diff(words.bounds)
        found = np.zeros((rows, len(self.words)))
        for kind, (known, number) in self.known.items() if len(hashes) else ():
            own = hashes if kind is None else words.hashes(kind)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = np.flatnonzero(known[at] == own)
            np.add.at(found, (words.text[hit], number[at[hit]]), 1)
        by_list = found @ self.member
        votes = [by_list > 0]
        grams = gram_hashes(hashes, 2)
        inside = words.text[:-1] == words.text[1:] if len(words) > 1 else np.zeros(0, bool)
        for pairs in self.pairs:
            place = np.minimum(np.searchsorted(pairs, grams), len(pairs) - 1)
            hit = inside & (pairs[place] == grams)
            votes.append((np.bincount(words.text[:-1][hit], minlength=rows) > 0)[:, None] if len(grams) else np.zeros((rows, 1), bool))
        shouts = per_text(rows, offsets, (data == 33).astype(np.int64)) * 20 > np.maximum(count, 20)
        votes.append(shouts[:, None])
        lexicon = by_list[:, : len(LEXICONS)].sum(axis=1)
        density = lexicon / np.maximum(count, 1)
        return np.concatenate([np.concatenate(votes, axis=1), found > 0, np.log1p(lexicon)[:, None], np.minimum(20 * density, 2.0)[:, None]], axis=1).astype(np.float64)


def _stems(length: int) -> Column:
    longer = F.filter("words", lambda w: F.length(w) > length)
    return F.transform(longer, lambda w: F.concat(F.substring(w, 1, length), F.lit("*")))


def mine(texts: DataFrame, most: int = MINED_WORDS) -> list[list[str]]:
    """Words and stems (``stem*``) of a fiftieth of the toxic texts, twenty times as common there as in clean ones.

    Texts whose words have the same smallest hash count once, so that copies
    of one text make none of its words typical.  A word whose stem is chosen is
    left out, as is a stem that is found with one chosen word only.
    """
    letters = F.translate(F.col("body").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.regexp_extract_all(letters, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)))
    read = texts.select("label", words.alias("words")).withColumn("least", F.array_min(F.transform("words", lambda w: F.xxhash64(w))))
    stems = [_stems(n) for n in STEMS]
    once = read.groupBy("label", "least").agg(F.min("words").alias("words")).select("label", F.array_distinct(F.concat("words", *stems)).alias("words"))
    once = cut_lineage(once)
    totals = once.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    toxic, clean = int(totals["toxic"] or 0), int(totals["clean"] or 0)
    if not toxic or not clean:
        return [[] for _ in range(MINED_VOTERS)]
    counted = once.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    rate, other = F.col("toxic") / F.lit(float(toxic)), (F.col("clean") + 1) / F.lit(clean + 1.0)
    best = counted.filter((F.col("toxic") >= 5) & (rate >= 0.02) & (rate >= 20 * other)).orderBy(F.col("toxic").desc(), F.col("word").endswith("*"), F.length("word").desc(), "word").limit(most)
    found: dict[str, int] = {}
    for row in best.collect():
        stem = row["word"].rstrip("*")
        covered = any(stem.startswith(known[:-1]) for known in found if known.endswith("*"))
        adds_nothing = any(known.startswith(stem) and n == row["toxic"] for known, n in found.items())
        if not covered and not (adds_nothing and row["word"].endswith("*")):
            found[row["word"]] = row["toxic"]
    return [list(found)[at::MINED_VOTERS] for at in range(MINED_VOTERS)]


@dataclass
class LabelModel:
    """Hidden label with a share of toxic texts, and voters with rates for either label.

    ``weight`` is below 1 for a voter that agrees with others more than the
    label explains.
    """

    share: float
    rates: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on, off = np.log(self.rates), np.log1p(-self.rates)
        evidence = votes @ (self.weight * (on[1] - on[0])) + (1 - votes) @ (self.weight * (off[1] - off[0]))
        return 1 / (1 + np.exp(-np.clip(evidence + np.log(self.share / (1 - self.share)), -30, 30)))


def fit_label_model(votes: np.ndarray, share: float, rounds: int = 50) -> LabelModel:
    """Expectation maximisation from "any two voters"; the share of toxic texts is given and held."""
    total = votes.sum(axis=1)
    share = float(np.clip(share, 1e-3, 0.5))
    belief = np.where(total >= 2, 0.9, np.where(total == 1, 0.4, 0.01))
    model = LabelModel(share, np.full((2, votes.shape[1]), 0.5), np.ones(votes.shape[1]))
    for _ in range(rounds):
        hit = belief @ votes
        model.rates = np.stack([((1 - belief) @ votes + 0.5) / ((1 - belief).sum() + 2), (hit + 0.5) / (belief.sum() + 2)]).clip(1e-4, 0.99)
        # a voter that fires on clean texts as often as on toxic ones says nothing
        model.rates[1] = np.maximum(model.rates[1], model.rates[0])
        rest = np.zeros((votes.shape[1],) * 2)
        for label, chance in ((0, 1 - belief), (1, belief)):
            centred = votes - model.rates[label]
            rest += (centred * chance[:, None]).T @ centred
        spread = np.sqrt(np.maximum(np.diag(rest), 1e-9))
        agreement = np.clip(rest / spread[:, None] / spread[None, :], 0, 1)
        np.fill_diagonal(agreement, 0)
        model.weight = 1 / (1 + np.where(agreement > 0.3, agreement, 0).sum(axis=1))
        belief = model.posterior(votes)
    return model


def fit_linear(values: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model for labels between 0 and 1, by Newton's method; the last is the intercept."""
    x = np.concatenate([values, np.ones((len(values), 1))], axis=1)
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = np.maximum(chance * (1 - chance), 1e-5)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (target - chance) - penalty * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    label_model: LabelModel | None

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(values @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _look(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_portions(batch.column("body")):
                found = voters.look(data, offsets)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * voters.features), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(low, high - low), values], ["label", "values"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = 12_000) -> Model:
    """Voters, label model and classifier from at most ``rows`` labelled documents.

    Labels choose the mined words, give the share of toxic texts and, as one
    more piece of evidence, pull the posterior of their own row.
    """
    texts = sampled_texts(docs, labelled_sample(labels, label_col, rows))
    voters = Voters(mine(texts))
    found = texts.mapInArrow(_look(voters), "label int, values array<double>").toArrow()
    values = np.array(found.column("values").to_pylist(), np.float64).reshape(-1, voters.features)
    label = np.asarray(found.column("label"), np.float64)
    order = np.lexsort((*values.T, label)) if len(label) else np.zeros(0, int)
    values, label = values[order], label[order]
    if not len(label):
        weights = np.zeros(voters.features + 1)
        weights[: len(LEXICONS)], weights[-1] = 2.0, -3.0
        return Model(voters, weights, None)
    votes = values[:, : voters.votes]
    known = fit_label_model(votes, (label.sum() + 0.5) / (len(label) + 1))
    # a label is itself a noisy voter: it errs one time in twenty
    chance = known.posterior(votes)
    like, unlike = np.where(label == 1, 0.95, 0.05), np.where(label == 1, 0.05, 0.95)
    target = chance * like / (chance * like + (1 - chance) * unlike)
    return Model(voters, fit_linear(values, target), known)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_portions(batch.column("body")):
                found = model.voters.look(data, offsets)
                votes = found[:, : model.voters.votes].sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([loose(batch.column("row")).slice(low, high - low), pa.array(model.score(found)), pa.array(votes)], ["row", "score", "votes"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the ``carry`` columns), the chance of a toxic text, and how many voters fired.

    Every row gets a score; NULL counts as an empty text, for which no voter
    fires.  An empty table gives an empty result.
    """
    own = docs.select(F.struct(*[F.col(c) for c in (carry or ["doc_id"])]).alias("row"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    return own.mapInArrow(_scores(model), f"row {own.schema['row'].dataType.simpleString()}, score double, votes long")
