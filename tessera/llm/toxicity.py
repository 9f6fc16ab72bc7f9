"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters of three kinds, toxic and clean ones: word lists, patterns (an insult after "you", shouting, runs of
   exclamation marks), and mined words and word beginnings. Features of all labelled training rows are counted by class; those that
   are far more frequent in one class, beyond chance, vote for it. A voter votes or abstains.
2. Label model. Over all training rows, labelled or not, the patterns of votes are counted. Given the class, two voters
   that know nothing of each other covary as the product of their differences ``d = P(vote | toxic) - P(vote | clean)``,
   times share * (1 - share). So a rank-one fit of the covariances gives every d, without labels (the moment method of
   Fu et al., "Fast and Three-rious"), and d and the rate of votes give both chances. What a pair covaries beyond that is
   correlation given the class; strongly correlated pairs are left out of the fit, which is then done again, and form cliques, each of
   which votes once. Votes of different cliques combine as independent; an abstention says nothing, and texts without
   votes share the toxic share that is left.
3. Classifier. A logistic regression on hashed words and beginnings learns the label model's posterior
   labels of a sample; it scores every text, so it can also use words that no voter knows.

Labels are used for nothing but mining features and the share of toxic rows. Texts are lower-cased
(A-Z), and ASCII punctuation and blanks end words. Null and empty texts get the score of a text without
features. Repeated rows get the same score; labels that repeat for an id count as toxic if any is; null
labels and ids are left out of training. Extra columns pass through. Without labels of both
classes every score is the share of toxic labels (0 without any). An empty table gives an empty result.

Bounds: the classifier is fitted on at most ``SAMPLE`` rows of each class, chosen by a hash of the id, of which the driver gathers
telling buckets only; of mined features the ``VOTERS`` of largest gain vote, all others still reach the
classifier; clean voters are looked for among features of that sample, and counted over all rows. Counts by class come as two tables of ``BUCKETS`` numbers; the label model gathers at most the square of the voters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, SPACE, mix, small_batches, text_bytes, word_hashes, written

#: Labelled training rows of each class that the classifier is fitted on, at most, and mined voters, at most.
SAMPLE, VOTERS = 5_000, 384
#: A mined voter is on at least so many texts of its class, and so many times as often as on the other's.
LEAST, LIFT = 5, 5.0
#: Deviations of both rates that are taken against a mined voter: many features are tried.
SURE = 2.0
#: Buckets of the classifier's features, the lengths (bytes) of word beginnings, and its ridge.
BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6)
#: Cells of the table that keeps hopeless features off the shuffle.
CELLS = 1 << 22
RIDGE = 1.0
#: Deviations from chance that a feature needs to tell classes apart, and the correlation given the class from which voters count as one.
TELLING, CORRELATED = 3.0, 0.6
STEPS = 60
#: Patterns of votes that a task counts.
PATTERN_ROWS = 50_000
#: Words after "you" in which an insult counts, and the share of capital words that is shouting.
NEAR, SHOUTING = 4, 0.3

#: Common insults and polite words of four languages, and words for "you".
INSULTS = {
    "en": "idiot idiots stupid moron morons dumb loser losers pathetic disgusting scum trash garbage worthless clown imbecile fool".split(),
    "fr": "idiot idiote imbécile crétin débile abruti ordure minable pathétique dégoûtant stupide".split(),
    "de": "idiot idioten dumm dummkopf trottel blöd abschaum versager widerlich erbärmlich".split(),
    "es": "idiota idiotas estúpido estúpida imbécil basura tonto asqueroso patético payaso".split(),
}
POLITE = {"en": "please thanks thank welcome".split(), "fr": "merci bonjour".split(), "de": "bitte danke".split(), "es": "gracias".split()}
YOU = "you your youre tu vous du dich ihr usted eres".split()
PATTERNS = ("you_insult", "shouting", "exclaiming")

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings of each text, with repeats, and where each text's begin."""
    data, offsets = text_bytes(column)
    data = _PLAIN[data]
    words, first = word_hashes(data, offsets)
    if not len(words):
        return words, first
    kinds = [words]
    blank = SPACE[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[at] = ~blank[at]
    starts = np.flatnonzero(begins)
    # A word ends at a blank or where the next text begins.
    stop = blank.copy()
    stop[at] = True
    ends = np.append(np.flatnonzero(stop), len(data))
    ends = ends[np.searchsorted(ends, starts, side="right")]
    padded = np.concatenate([data, np.zeros(max(BEGINNINGS), np.uint8)]).astype(np.uint64)
    for k in BEGINNINGS:
        head = np.full(len(starts), k, np.uint64)
        for j in range(k):
            head = head * np.uint64(257) + padded[starts + j] + np.uint64(1)
        # Shorter words have no beginning of this length: they repeat their whole word.
        kinds.append(np.where(ends - starts >= k, mix(head), words))
    return np.stack(kinds, 1).reshape(-1), first * len(kinds)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _held(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each text's distinct features, of those in ``wanted`` buckets where these are given."""
    hashes, begin = features(column)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    if wanted is not None:
        keep = wanted[_bucket(hashes)]
        hashes, text = hashes[keep], text[keep]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return text[new], hashes[new]


def _hashes(words: list[str]) -> np.ndarray:
    """The feature of each word."""
    data, offsets = text_bytes(pa.array(words, pa.string()))
    return word_hashes(data, offsets)[0]


@dataclass
class Voters:
    """Features (sorted) with the number of the voter that each belongs to; for each voter its name and class (1 toxic, -1 clean).

    The last ``len(PATTERNS)`` voters are the patterns.
    """

    hashes: np.ndarray
    number: np.ndarray
    names: list[str]
    sign: np.ndarray

    def __post_init__(self) -> None:
        self.wanted = np.zeros(BUCKETS, bool)
        self.wanted[_bucket(self.hashes)] = True
        self.you, self.insults = _hashes(YOU), _hashes([w for words in INSULTS.values() for w in words])

    def votes(self, column: pa.Array) -> np.ndarray:
        """A row for each text, a column for each voter."""
        out = np.zeros((len(column), len(self.names)), bool)
        text, own = _held(column, self.wanted)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        right = self.hashes[at] == own
        # A feature may belong to a list and be mined as well.
        while right.any():
            out[text[right], self.number[at[right]]] = True
            text, own, at = text[right], own[right], at[right] + 1
            right = (at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == own)
        out[:, -len(PATTERNS) :] = self.patterns(column)
        return out

    def patterns(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column, lower=False)
        out = np.zeros((len(column), len(PATTERNS)), bool)
        if not len(data):
            return out
        of = np.repeat(np.arange(len(column)), np.diff(offsets))
        lower, _ = text_bytes(column)
        words, first = word_hashes(_PLAIN[lower], offsets)
        whose = np.repeat(np.arange(len(column)), np.diff(first))
        insults = np.flatnonzero(np.isin(words, self.insults))
        you = np.isin(words, self.you)
        for back in range(1, NEAR + 1):
            at = insults[insults >= back]
            at = at[you[at - back] & (whose[at - back] == whose[at])]
            out[whose[at], 0] = True
        # Capitals and small letters of ASCII decide what shouting is.
        capital, small = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
        n_capital, n_small = np.bincount(of, capital, minlength=len(column)), np.bincount(of, small, minlength=len(column))
        out[:, 1] = n_capital > SHOUTING * np.maximum(n_capital + n_small, 20)
        twice = np.flatnonzero((data[1:] == 33) & (data[:-1] == 33) & (of[1:] == of[:-1]))
        out[of[twice], 2] = True
        return out


@dataclass
class LabelModel:
    """The clique of each voter, for each clique its chances to vote on toxic and clean texts, and the toxic share of texts without votes."""

    clique: np.ndarray
    share: float
    toxic: np.ndarray
    clean: np.ndarray
    silent: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) for rows of votes (0 or 1) of the voters. Voters speak on their own matter only: an abstention says nothing."""
        heard = _by_clique(votes, self.clique)
        odds = np.log(self.share / (1 - self.share)) + heard @ np.log(self.toxic / self.clean)
        return np.where(heard.any(1), 1 / (1 + np.exp(-np.clip(odds, -30, 30))), self.silent)


def _by_clique(votes: np.ndarray, clique: np.ndarray) -> np.ndarray:
    """Votes of cliques: a clique votes where one of its voters does. Voters of clique -1 aren't heard."""
    heard = np.zeros((len(votes), int(clique.max(initial=-1)) + 1), bool)
    for i in np.flatnonzero(clique >= 0):
        heard[:, clique[i]] |= votes[:, i].astype(bool)
    return heard


def chances(both: np.ndarray, n: int, share: float, sign: np.ndarray, left_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(vote | toxic) and P(vote | clean) of each voter, by a rank-one fit of the covariances.

    ``both``: texts on which two voters vote, on the diagonal those of one; ``sign``: the class that a voter
    is meant for, where the fit begins; ``left_out``: pairs that the fit leaves out.
    """
    rate = both.diagonal() / n
    moment = (both / n - np.outer(rate, rate)) / (share * (1 - share))
    # A pair counts by its precision, which follows from the rates.
    weight = 1 / np.maximum(np.outer(rate * (1 - rate), rate * (1 - rate)), 1e-18)
    np.fill_diagonal(weight, 0)
    if left_out is not None:
        weight = np.where(left_out, 0, weight)
    # Both chances lie between 0 and 1.
    high, low = np.minimum(rate / share, (1 - rate) / (1 - share)), -np.minimum(rate / (1 - share), (1 - rate) / share)
    d = 0.7 * np.where(sign > 0, high, low)
    for _ in range(300):
        new = np.clip((weight * moment) @ d / np.maximum(weight @ d**2, 1e-12), low, high)
        if np.abs(new - d).max(initial=0) < 1e-9:
            break
        d = 0.5 * (d + new)
    least = 0.5 / max(1, n)
    return np.clip(rate + (1 - share) * d, least, 1 - least), np.clip(rate - share * d, least, 1 - least)


def correlations(both: np.ndarray, n: int, share: float, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """For each pair of voters the correlation of their votes given the class: what they covary beyond what the class explains."""
    beyond = both / n - share * np.outer(toxic, toxic) - (1 - share) * np.outer(clean, clean)
    within = np.sqrt(share * toxic * (1 - toxic) + (1 - share) * clean * (1 - clean))
    return beyond / np.maximum(np.outer(within, within), 1e-12)


def cliques(both: np.ndarray, n: int, share: float, sign: np.ndarray) -> np.ndarray:
    """Numbers of cliques: voters are joined where their votes are strongly correlated given the class, as those of a word and its beginning are."""
    left_out = None
    for _ in range(5):
        joint = correlations(both, n, share, *chances(both, n, share, sign, left_out)) >= CORRELATED
        np.fill_diagonal(joint, False)
        if left_out is not None and (joint == left_out).all():
            break
        left_out = joint
    number = np.full(len(sign), -1)
    for i in np.argsort(-both.diagonal(), kind="stable"):
        if number[i] < 0:
            # A clique holds what is correlated with its most frequent voter.
            number[(number < 0) & left_out[i]] = number[i] = number.max(initial=-1) + 1
    return number


def fit_classifier(row: np.ndarray, column: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of feature buckets and an intercept: logistic regression on soft labels, by accelerated gradients.

    ``row`` and ``column``: which rows have which buckets.
    """
    used, column = np.unique(column, return_inverse=True)
    k, n, total = len(used), len(target), weight.sum()
    w, b = np.zeros(k), float(np.log((target @ weight + 1e-9) / ((1 - target) @ weight + 1e-9)))
    # Step by feature: the curvature is at most a quarter of the weight of the rows that have it.
    bound = 0.25 * np.bincount(column, weight[row], minlength=k) + RIDGE
    move, last = w.copy(), w.copy()
    spread = max(1.0, float(np.sqrt(len(row) / max(1, n))))
    for step in range(STEPS):
        odds = np.bincount(row, move[column], minlength=n) + b
        error = weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target)
        slope = np.bincount(column, error[row], minlength=k) + RIDGE * move
        w = move - slope / (bound * spread)
        b -= error.sum() / (0.25 * total * spread)
        move = w + (step / (step + 3)) * (w - last)
        last = w
    out = np.zeros(BUCKETS)
    out[used] = w
    return out, b


def _bucket_counts(marked: DataFrame) -> np.ndarray:
    """For each class the texts (text, toxic) that hold a feature of each bucket."""
    size = 1 << 12

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            text, own = _held(batch.column("text"))
            toxic = batch.column("toxic").to_numpy()
            both = np.unique(text * BUCKETS + _bucket(own))
            total += np.bincount(toxic[both // BUCKETS] * BUCKETS + both % BUCKETS, minlength=2 * BUCKETS)
        at = [i for i in range(0, 2 * BUCKETS, size) if total[i : i + size].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[i : i + size].tolist() for i in at], pa.list_(pa.int64()))], ["at", "counts"])

    parts = marked.mapInArrow(counted, "at long, counts array<long>").select("at", F.posexplode("counts").alias("i", "n")).filter("n > 0").groupBy((F.col("at") + F.col("i")).alias("cell")).agg(F.sum("n").alias("n"))
    found = parts.toPandas()  # two numbers a bucket, at most
    out = np.zeros(2 * BUCKETS)
    out[found["cell"].to_numpy(np.int64)] = found["n"]
    return out.reshape(2, BUCKETS)


def _apart(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Deviations from chance by which texts with a feature are more often toxic than others (negative: clean)."""
    held, share = clean + toxic, n_toxic / (n_clean + n_toxic)
    return (toxic - held * share) / np.sqrt(np.maximum(held * share * (1 - share), 1e-9))


def _counted(marked: DataFrame, cells: np.ndarray | None = None) -> DataFrame:
    """(feature, clean, toxic): on how many texts (text, toxic) of each class a feature is; of features of some ``cells`` where these are given."""
    shared = marked.sparkSession.sparkContext.broadcast(cells)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, own = _held(batch.column("text"))
            if shared.value is not None:
                keep = np.unpackbits(shared.value[(own & np.uint64(CELLS - 1)) >> np.uint64(3)][:, None], axis=1, bitorder="little")[np.arange(len(own)), (own & np.uint64(7)).astype(np.int64)] == 1
                text, own = text[keep], own[keep]
            toxic = batch.column("toxic").to_numpy()[text]
            feature, at = np.unique(own, return_inverse=True)
            by_class = [np.bincount(at, w, minlength=len(feature)).astype(np.int64) for w in (1 - toxic, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), *map(pa.array, by_class)], ["feature", "clean", "toxic"])

    return marked.mapInArrow(counted, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _mined(marked: DataFrame, some: DataFrame, n_clean: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that vote, and the class of each.

    ``some`` holds all toxic rows of ``marked`` and a sample of clean ones. Only a feature on ``LEAST`` texts of either class there
    can vote; so few are counted over all rows, others are kept off the shuffle by a bit table of their hashes.
    """
    likely = written(_counted(some).filter((F.col("toxic") >= LEAST) | (F.col("clean") >= LEAST)).select("feature"), "likely-voters")
    at = likely.select(F.col("feature").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).distinct().toPandas()["cell"].to_numpy(np.int64)  # CELLS numbers, at most
    cells = np.zeros(CELLS, bool)
    cells[at] = True
    sums = _counted(marked, np.packbits(cells, bitorder="little")).join(likely, "feature", "left_semi")
    p, q = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.5) / (n_clean + 1)
    # What the counts leave open is taken against a voter: some deviations from either rate.
    sure = lambda x, y, m, k: x - SURE * F.sqrt(x / (m + 1)) >= LIFT * (y + SURE * F.sqrt(y / (k + 1)))
    sign = F.when((F.col("toxic") >= LEAST) & sure(p, q, n_toxic, n_clean), 1).when((F.col("clean") >= LEAST) & sure(q, p, n_clean, n_toxic), -1)
    gain = F.when(sign > 0, n_toxic * p * F.log(p / q)).otherwise(n_clean * q * F.log(q / p))
    top = sums.withColumns({"sign": sign, "gain": gain}).filter("sign IS NOT NULL").orderBy(F.desc("gain"), "feature").limit(VOTERS).select("feature", "sign").toPandas()
    return top["feature"].to_numpy(np.int64).view(np.uint64), top["sign"].to_numpy(np.int64)


def choose_voters(mined: np.ndarray, sign: np.ndarray) -> Voters:
    """Word lists, mined features and patterns, in this order."""
    lists = [(f"{kind}_{lang}", words, s) for kind, table, s in (("insults", INSULTS, 1), ("polite", POLITE, -1)) for lang, words in table.items()]
    names = [name for name, _, _ in lists] + [f"mined_{h:016x}" for h in mined.tolist()] + list(PATTERNS)
    parts = [_hashes(words) for _, words, _ in lists] + [mined]
    number = np.concatenate([np.repeat(np.arange(len(lists)), [len(x) for x in parts[:-1]]), len(lists) + np.arange(len(mined))])
    hashes = np.concatenate(parts)
    order = np.argsort(hashes, kind="stable")
    return Voters(hashes[order], number[order], names, np.array([s for _, _, s in lists] + sign.tolist() + [1] * len(PATTERNS)))


def _patterns(texts: DataFrame, voters: Voters) -> DataFrame:
    """(pattern, n): the sets of voters that vote on a text (bits), and on how many texts; written."""
    shared = texts.sparkSession.sparkContext.broadcast(voters)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.packbits(shared.value.votes(batch.column("text")), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bits], pa.binary())], ["pattern"])

    return written(texts.mapInArrow(voted, "pattern binary").groupBy("pattern").agg(F.count("*").alias("n")), "vote-patterns")


def _by_size(patterns: DataFrame) -> DataFrame:
    """A task for each ``PATTERN_ROWS`` patterns: each task gives one number for a pair of voters."""
    return patterns.coalesce(max(1, -(-patterns.count() // PATTERN_ROWS)))


def _pair_counts(patterns: DataFrame, k: int, clique: np.ndarray) -> np.ndarray:
    """For each pair of cliques the texts on which both vote; on the diagonal those of one."""
    shared = patterns.sparkSession.sparkContext.broadcast(clique)
    size = int(clique.max()) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            votes = np.stack([np.unpackbits(np.frombuffer(p, np.uint8))[:k] for p in batch.column("pattern").to_pylist()])
            heard = _by_clique(votes, shared.value).astype(np.float64)
            total += (heard * batch.column("n").to_numpy()[:, None]).T @ heard
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "n"])

    out = np.zeros((size, size))
    for r in _by_size(patterns).mapInArrow(counted, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def _silent(patterns: DataFrame, model: LabelModel) -> float:
    """The toxic share of texts without votes: what the posteriors of the others leave."""
    shared, k = patterns.sparkSession.sparkContext.broadcast(model), len(model.clique)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = np.stack([np.unpackbits(np.frombuffer(p, np.uint8))[:k] for p in batch.column("pattern").to_pylist()])
            n, heard = batch.column("n").to_numpy(), _by_clique(votes, shared.value.clique).any(1)
            yield pa.RecordBatch.from_arrays([pa.array([float(n @ (heard * shared.value.posterior(votes)))]), pa.array([int(n @ ~heard)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["toxic", "silent", "n"])

    r = _by_size(patterns).mapInArrow(summed, "toxic double, silent long, n long").agg(F.sum("toxic").alias("toxic"), F.sum("silent").alias("silent"), F.sum("n").alias("n")).first()
    return min(model.share, max(0.01 * model.share, (model.share * (r["n"] or 0) - (r["toxic"] or 0)) / max(1, r["silent"] or 0)))


def _gathered(marked: DataFrame, voters: Voters, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a sample (text, toxic): rows and telling buckets that they hold, their votes, their class."""
    shared = marked.sparkSession.sparkContext.broadcast((voters, telling))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, telling = shared.value
        for batch in batches:
            text, own = _held(batch.column("text"), telling)
            both = np.unique(text * BUCKETS + _bucket(own))
            cut = np.searchsorted(both // BUCKETS, np.arange(batch.num_rows + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(cut), pa.array((both % BUCKETS).astype(np.int32)))
            votes = np.packbits(voters.votes(batch.column("text")), axis=1)
            yield pa.RecordBatch.from_arrays([held, pa.array([v.tobytes() for v in votes], pa.binary()), batch.column("toxic")], ["held", "votes", "toxic"])

    rows = marked.mapInArrow(gathered, "held array<int>, votes binary, toxic int").toArrow().combine_chunks()  # a bounded sample, selected buckets
    held = pa.array(rows.column("held").to_pylist(), pa.list_(pa.int32())) if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    votes = np.stack([np.unpackbits(np.frombuffer(v, np.uint8))[: len(voters.names)] for v in rows.column("votes").to_pylist()]) if rows.num_rows else np.zeros((0, len(voters.names)), np.uint8)
    return np.repeat(np.arange(rows.num_rows), np.diff(held.offsets.to_numpy())), held.values.to_numpy().astype(np.int64), votes, rows.column("toxic").to_numpy()


@dataclass
class Model:
    """The classifier: weights of feature buckets and an intercept."""

    weights: np.ndarray
    intercept: float
    label_model: LabelModel | None = None

    def score(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1; no shuffle."""
        shared = docs.sparkSession.sparkContext.broadcast((self.weights.astype(np.float32), float(self.intercept)))

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            weights, intercept = shared.value
            wanted = weights != 0
            for texts in batches:
                text, own = _held(texts, wanted)
                both = np.unique(text * BUCKETS + _bucket(own))
                odds = np.bincount(both // BUCKETS, weights[both % BUCKETS], minlength=len(texts)) + intercept
                yield pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))

        return docs.withColumn(score, scored(F.col(text)))


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text (null: empty), modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on ``docs`` and ``labels``, both already without held-out rows."""
    small_batches(docs.sparkSession)
    known = written(labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label)).cast("int").alias("toxic")), "toxicity-labels")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Model(np.zeros(BUCKETS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    share = n_toxic / (n_toxic + n_clean)
    # Labelled texts are read several times. Few labels are broadcast, so that texts aren't shuffled; of many, the joined rows are written once.
    few = n_toxic + n_clean <= BROADCAST_IDS
    marked = docs.select(key, F.col(text).alias("text")).join(F.broadcast(known) if few else known, key).select("text", "toxic", F.col(key).alias("id"))
    if not few:
        marked = written(marked, "toxicity-rows")
    plain = marked.select("text", "toxic")
    clean, toxic = _bucket_counts(plain)
    apart = _apart(clean, toxic, n_clean, n_toxic)
    telling = (np.abs(apart) >= TELLING) & (clean + toxic >= LEAST)
    picked = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64(key), key).limit(sample) for c in (1, 0)]
    ids = written(picked[0].unionByName(picked[1]).select(F.col(key).alias("id")), "toxicity-sample")
    sampled = marked.join(F.broadcast(ids), "id")
    some = marked.filter("toxic = 1").select("text", "toxic").unionByName(sampled.filter("toxic = 0").select("text", "toxic"))
    mined, sign = _mined(plain, some, n_clean, n_toxic)
    voters = choose_voters(mined, sign)
    patterns = _patterns(docs.select(F.col(text).alias("text")), voters)
    n = patterns.agg(F.sum("n")).first()[0] or 0
    alone = np.arange(len(voters.names))
    both = _pair_counts(patterns, len(alone), alone)
    # Voters on too few texts have no measurable covariance: they aren't heard.
    heard = both.diagonal() >= LEAST
    if not telling.any() or heard.sum() < 3:
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    clique = np.full(len(alone), -1)
    clique[heard] = cliques(both[np.ix_(heard, heard)], n, share, voters.sign[heard])
    meant = np.array([voters.sign[clique == c][0] for c in range(clique.max() + 1)])
    label_model = LabelModel(clique, share, *chances(_pair_counts(patterns, len(alone), clique), n, share, meant), silent=0.0)
    label_model.silent = _silent(patterns, label_model)
    row, column, votes, is_toxic = _gathered(sampled.select("text", "toxic"), voters, telling)
    if not len(is_toxic) or is_toxic.all() or not is_toxic.any():
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    # The sample has each class apart; weights bring back the classes' shares.
    weight = np.where(is_toxic == 1, share / is_toxic.mean(), (1 - share) / (1 - is_toxic.mean()))
    weights, intercept = fit_classifier(row, column, label_model.posterior(votes), weight)
    return Model(weights, intercept, label_model)
