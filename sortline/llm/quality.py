"""Quality classifier by co-training.

Two logistic classifiers see separate views of a document: its text (words, letters, punctuation, lines, repetition), and its page metadata, which are the other columns
(language, source, length as stated). Over some rounds each labels those of all unlabelled rows that it is sure of, for the other to
learn from; rows stay in Spark, and a step of the fit reads their sums. Their outputs, calibrated on held-out labelled rows, are combined, all documents are scored, and the
threshold comes from labelled rows that neither fit nor calibration has seen.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Labelled ids that the fit reads.
MAX_LABELLED = 10_000
ROUNDS = 3
#: How sure a view must be of a row to label it.
SURE = 0.95
NEWTON_STEPS = 20
MOST_STEP = 1.0
#: Parts of the labelled rows: three fit, one calibrates, one sets the threshold.
FIT, CALIBRATE, JUDGE = 0, 1, 2
PARTS = (FIT, FIT, FIT, CALIBRATE, JUDGE)
#: What a share of good rows rejected costs, in shares of bad rows kept.
GOOD_COST = 10
LEAST_THRESHOLD, MOST_THRESHOLD = 1e-6, 0.5

#: Places that a hash gives an id, of which a share is read: many, so that a share of any table can be told.
SPOTS = 1 << 50

LANGS, SOURCES = 8, 16
#: A last character that ends no word or clause.
ODD = re.compile(r"[^\w.,;:!?\"')]|_")


def text_view(text: str) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum() + counts[128:192].sum() // 2, counts[48:58].sum()
    point = counts[[33, 44, 46, 59, 58, 63]].sum()
    mark = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum() - point
    size = max(1, len(raw))
    seen = Counter(words)
    share = np.fromiter(seen.values(), float, len(seen)) / n
    again = sum(map(eq, words, words[1:])) / n
    caps = sum(map(str.isupper, words)) / n
    bare = sum(map(str.isalpha, words)) / n
    odd = len(ODD.findall("".join(map(itemgetter(-1), words)))) / n
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    lengths = [len(x) for x in lines] or [0]
    sentences = text.count(". ") + text.count(".\n") + text.count("! ") + text.count("? ") + 1
    return [
        np.log1p(len(words)),
        len(seen) / n ** 0.85,
        share.max(initial=0),
        float(-(share * np.log(share)).sum()) / np.log(n + 1),
        again,
        caps,
        bare,
        odd,
        np.sqrt(again),
        np.sqrt(caps),
        np.sqrt(odd),
        upper / size,
        upper / max(1, upper + lower),
        digit / size,
        np.sqrt(mark / size),
        mark / size,
        point / size,
        min(40, sum(map(len, words)) / n),
        counts[33] / size,
        np.log1p(n_lines),
        np.log1p(max(lengths)),
        np.log1p(sum(lengths) / n_lines),
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / n_lines,
        len(set(lines)) / n_lines,
        np.log1p(size / sentences),
        np.sqrt(counts[124] / size),
        counts[32] / size,
    ]


def meta_view(lang: str | None, source: str | None, n_chars: float) -> list[float]:
    """Nothing of this is read from the text."""
    out = [0.0] * (LANGS + SOURCES)
    if lang:
        out[zlib.crc32(lang.encode()) % LANGS] = 1.0
    if source:
        out[LANGS + zlib.crc32(source.encode()) % SOURCES] = 1.0
    length = np.log1p(max(0.0, n_chars)) if n_chars == n_chars else 0.0
    return [*out, length, length * length, float(n_chars != n_chars)]


def views(text, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray]:
    texts = np.array([text_view(t if isinstance(t, str) else "") for t in text], float)
    return texts, np.array([meta_view(*row) for row in zip(lang, source, n_chars)], float)


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)

    def sure(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class CoTrained:
    """The fitted model. both: combines the two views' calibrated logits. Without two classes to learn from all is None and `prior` is every score."""

    text: Logistic | None
    meta: Logistic | None
    both: Logistic | None
    threshold: float
    prior: float
    exchanged: int = 0

    def predict(self, text, lang, source, n_chars) -> pd.DataFrame:
        if self.both is None:
            same = np.full(len(text), self.prior)
            return pd.DataFrame({"p_text": same, "p_meta": same, "score": same, "accepted": np.ones(len(text), bool)})
        a, b = views(text, lang, source, n_chars)
        if not len(a):
            return pd.DataFrame({"p_text": [], "p_meta": [], "score": [], "accepted": np.zeros(0, bool)})
        score = self.both.sure(np.column_stack([self.text.logit(a), self.meta.logit(b)]))
        return pd.DataFrame({"p_text": self.text.sure(a), "p_meta": self.meta.sure(b), "score": score, "accepted": score >= self.threshold})


class Rows:
    """Rows to fit on: views x and m, label (1, 0, or -1 for unlabelled) and the part of a labelled row. `total` sums a function of batches over all of them."""

    def __init__(self, x: np.ndarray, m: np.ndarray, label: np.ndarray, part: np.ndarray):
        self.batch = x, m, label, part
        self.widths = [x.shape[1], m.shape[1]]

    def total(self, f) -> np.ndarray:
        return f(*self.batch)

    def labelled(self) -> Rows:
        """Those with a label: steps that need no others read no others."""
        some = self.batch[2] >= 0
        return Rows(*(a[some] for a in self.batch))


class SparkRows(Rows):
    """Rows of a DataFrame with x, m, label and part. Every task gives one row of sums."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.widths = [len(text_view("")), len(meta_view(None, None, 0.0))]

    def total(self, f) -> np.ndarray:
        def run(batches):
            out = None
            for batch in batches:
                if batch.num_rows:
                    one = f(*_arrays(batch))
                    out = one if out is None else out + one
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["sums"])

        got = [np.array(r[0], float) for r in self.df.mapInArrow(run, "sums array<double>").collect()]
        return sum(got[1:], got[0]) if got else f(*(np.zeros((0, w)) for w in self.widths), np.zeros(0), np.zeros(0))

    def labelled(self) -> Rows:
        return SparkRows(self.df.filter("label >= 0"))


def _arrays(batch) -> tuple:
    x, m = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for c in ("x", "m"))
    return x, m, batch.column("label").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(zero_copy_only=False)


def _standard(rows: Rows, views_of, widths: list[int]) -> list[Logistic]:
    """Regressions without weights yet, with the mean and scale of their columns. views_of: the columns and weights of a batch, for each."""
    got = rows.total(lambda *batch: np.concatenate([np.r_[w.sum(), w @ z, w @ (z * z)] for z, w in views_of(*batch)]))
    out = []
    for width in widths:
        n, total, squares = max(1.0, got[0]), got[1 : width + 1], got[width + 1 : 2 * width + 1]
        mean = total / n
        out.append(Logistic(mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)) + 1e-6, np.zeros(width + 1)))
        got = got[2 * width + 1 :]
    return out


def _newton(rows: Rows, models: list[Logistic], cases, ridge: float) -> list[Logistic]:
    """Ridge logistic regressions from where `models` stand. cases: the columns, labels and weights of a batch, for each. A step needs the sums of gradients and Hessians alone."""
    for _ in range(NEWTON_STEPS):

        def sums(*batch, models=models):
            out = []
            for model, (x, y, case) in zip(models, cases(*batch)):
                used = case > 0
                z, y, case = model.columns(x[used]), y[used], case[used]
                p = 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))
                out += [z.T @ (case * (p - y)), np.ravel((z * (case * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z)]
            return np.concatenate(out)

        got, moved, most = rows.total(sums), [], 0.0
        for model in models:
            n = len(model.weights)
            step = np.linalg.solve(got[n : n + n * n].reshape(n, n) + ridge * np.eye(n), got[:n] + ridge * model.weights)
            step *= min(1, MOST_STEP / max(np.abs(step).max(), 1e-12))  # a full step may overshoot where classes part widely
            got, most = got[n + n * n :], max(most, np.abs(step).max())
            moved.append(Logistic(model.mean, model.scale, model.weights - step))
        models = moved
        if most < 1e-3:
            break
    return models


def _given(views_: tuple, past: list, k: int) -> np.ndarray:
    """What view k is told of a batch by the other view's models of the rounds before: 1, 0, or -1 where none was sure. The first word stands."""
    out = np.full(len(views_[0]), -1)
    for models in past:
        p = models[1 - k].sure(views_[1 - k])
        out = np.where(out >= 0, out, np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1)))
    return out


def co_train_rows(rows: Rows, rounds: int = ROUNDS) -> CoTrained:
    """Fit on labelled and unlabelled rows. In each round every unlabelled row is scored by both views, and those that one is sure of teach the other;
    together they weigh no more than the labelled rows of their class."""
    known = rows.labelled()
    n = known.total(lambda x, m, label, part: np.array([((label == c) & (part == h)).sum() for h in (FIT, CALIBRATE, JUDGE) for c in (0, 1)], float)).reshape(3, 2)
    fitted, prior = n[FIT], float(n[:, 1].sum() / n.sum()) if n.sum() else 1.0
    if min(fitted) < 5 or n[CALIBRATE:].min() < 2:
        return CoTrained(None, None, None, 0.0, prior)
    models = _standard(rows, lambda x, m, label, part: [(z, np.where((part != FIT) & (label >= 0), 0.0, 1.0)) for z in (x, m)], rows.widths)
    past, told = [], np.zeros((2, 2))
    for nth in range(rounds + 1):
        if nth:
            counts = lambda x, m, label, part, past=tuple(past): np.array([((label < 0) & (_given((x, m), past, k) == c)).sum() for k in (0, 1) for c in (0, 1)], float)
            before, told = told, rows.total(counts).reshape(2, 2)
            if not told.any() or nth > 1 and np.array_equal(told, before):  # nothing new is told: another fit would add nothing
                break
        share = np.minimum(1, fitted / np.maximum(1, told))
        # both classes weigh alike, whatever their shares
        whole = fitted + share * told
        by_class = 0.5 * whole.sum(1, keepdims=True) / whole

        def cases(x, m, label, part, past=tuple(past), share=share, by_class=by_class):
            out = []
            for k, z in enumerate((x, m)):
                given = np.where(label < 0, _given((x, m), past, k), np.where(part == FIT, label, -1)).astype(int)
                weight = by_class[k][given] * np.where(label < 0, share[k][given], 1.0)
                out.append((z, given.astype(float), np.where(given >= 0, weight, 0.0)))
            return out

        models = _newton(rows if nth else known, models, cases, 1.0)
        past.append(tuple(models))
    text, meta = models
    both_of = lambda x, m: np.column_stack([text.logit(x), meta.logit(m)])
    kept = lambda label, part: ((part == CALIBRATE) & (label >= 0)).astype(float)
    start = _standard(known, lambda x, m, label, part: [(both_of(x, m), kept(label, part))], [2])
    classes = 0.5 * n[CALIBRATE].sum() / n[CALIBRATE]
    calibrating = lambda x, m, label, part: [(both_of(x, m), label.astype(float), kept(label, part) * classes[np.maximum(label, 0).astype(int)])]
    (both,) = _newton(known, start, calibrating, 0.1)
    # shares of judged bad rows kept and of good ones rejected at each threshold: a few good rows that look bad cannot pull it down to junk
    spots = np.r_[np.geomspace(LEAST_THRESHOLD, 0.05, 50), np.linspace(0.06, MOST_THRESHOLD, 45)]

    def errors(x, m, label, part):
        score = both.sure(both_of(x, m))
        good, bad = np.sort(score[(part == JUDGE) & (label == 1)]), np.sort(score[(part == JUDGE) & (label == 0)])
        return np.r_[np.searchsorted(good, spots), len(bad) - np.searchsorted(bad, spots)].astype(float)

    rejected, kept_bad = known.total(errors).reshape(2, -1)
    cost = GOOD_COST * rejected / n[JUDGE][1] + kept_bad / n[JUDGE][0]
    best = np.flatnonzero(cost == cost.min())
    threshold = float(np.sqrt(spots[best[0]] * spots[best[-1]]))  # between those of equal costs, nearer to the lower ones: what is doubtful stays
    return CoTrained(text, meta, both, threshold, prior, int(told.sum()))


def co_train(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """Fit on labelled rows (views xs, labels y) and unlabelled rows that are at hand. Two in five labelled rows are held out, see PARTS."""
    x, m = (np.concatenate([a, b]) if len(b) else a for a, b in zip(xs, pool))
    part = np.array(PARTS)[np.arange(len(x)) % len(PARTS)]
    return co_train_rows(Rows(x, m, np.r_[y, np.full(len(pool[0]), -1)], part), rounds)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    rounds: int = ROUNDS,
) -> CoTrained:
    """Fit on the rows of at most about `max_labelled` labelled ids, picked by a hash of the id, and on all other rows as unlabelled; smaller tables of labels are read whole.

    Labels with a null id or label aren't read. Repeated rows count as often as they come. An id with both labels counts as 0.
    """
    spot = F.pmod(F.xxhash64("label_of", F.lit("fit")), F.lit(SPOTS))
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("label_of")).agg(F.min(label_col).cast("int").alias("label"))
    marks = marks.filter(spot < int(min(1, max_labelled / max(1, marks.count())) * SPOTS))
    read = docs.select(F.col(id_col).alias("of"), *(F.col(c) for c in ("text", "lang", "source", "n_chars")))
    both = read.join(F.broadcast(marks), F.col("of") == F.col("label_of"), "left")  # max_labelled bounds the side that is broadcast
    part = F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(F.xxhash64("of", F.lit("part")), F.lit(len(PARTS))) + 1).cast("int"))
    rows = materialize(_features(both.withColumn("part", part).withColumn("label", F.coalesce("label", F.lit(-1)))), "features")
    model = co_train_rows(SparkRows(rows), rounds)
    discard(rows)
    return model


def _features(df: DataFrame) -> DataFrame:
    """label, part and the two views, made where the texts are."""

    def run(batches):
        for pdf in batches:
            a, b = views(pdf["text"], pdf["lang"], pdf["source"], pdf["n_chars"].astype(float))
            yield pd.DataFrame({"label": pdf["label"], "part": pdf["part"], "x": list(a), "m": list(b)})

    return df.select("label", "part", "text", "lang", "source", "n_chars").mapInPandas(run, "label int, part int, x array<float>, m array<float>")


def score(docs: DataFrame, model: CoTrained, column: str = "quality_score") -> DataFrame:
    """docs with a struct `column`: p_text, p_meta, score (of being good) and accepted, for every row. Rejected are
    documents with a score below the threshold. Null texts count as empty, null metadata as unknown."""

    @F.pandas_udf("p_text double, p_meta double, score double, accepted boolean")
    def predict(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        return model.predict(text, lang, source, n_chars.astype(float))

    return docs.withColumn(column, predict("text", "lang", "source", "n_chars"))
