"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on form features gives each document's own evidence. Sites
are the host of ``source`` and, below it, a path (the first path segment, or the
language where the source has none). Quality counts of all documents, labels
where there are any and the classifier's probability elsewhere, are summed by
site. The spread between hosts, and between paths of a host, gives the strength
of a Beta prior at each level (analysis of variance, by moments); a path's
posterior is shrunk towards its host's, and that towards the global share, the
more the fewer documents there are. A document's own count is left out of its
site's. Its posterior log-odds are

    logit(own) + logit(path posterior) - logit(global share),

and it is kept where that is at least ``threshold``.

Scale: two grouped aggregations with map-side combine, so a site with a third of
all rows is one row a task; sites are broadcast only when counted to be few. The
classifier is fitted on about ``max_train`` labelled rows, never more (a documented
bound): labelled rows are counted, a share of them is taken by a hash of the id
where they lie, and only these go to the driver. All else covers every document.

Defined cases: a null text is empty, and a very long one is read whole; a null source or language is the site "";
null labels are ignored, several labels of a document are averaged; without
labels of both kinds the classifier says 1/2 and all documents are kept; a null
id has no label; repeated rows each get a row; an empty table gives an empty
result; documents of equal evidence tie at equal posteriors, and one that meets
the threshold exactly is kept; working columns start with ``__``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import cut

KINDS = ("upper", "lower", "digit", "space", "line", "stop", "symbol", "other")


def _classes() -> np.ndarray:
    of = np.full(256, 7, np.uint8)
    for i in range(33, 127):
        of[i] = 0 if chr(i).isupper() else 1 if chr(i).islower() else 2 if chr(i).isdigit() else 5 if chr(i) in ".,;:?'\"-()" else 6
    of[[32, 9]], of[[10, 13]] = 3, 4
    return of


CLASS = _classes()
N_FEATURES = 2 * len(KINDS) + 6


def text_features(text: str | None) -> np.ndarray:
    """Shares of byte classes (plain and as square roots), size, word length, and repetition of words and lines."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(CLASS[data], minlength=8) / max(1, len(data))
    words, lines = (text or "").split(), (text or "").split("\n")
    n = max(1, len(words))
    distinct = len(set(words))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words) / n
    return np.concatenate([share, np.sqrt(share), [np.log1p(len(data)), len(data) / n, distinct / n, np.log1p(distinct), len(set(lines)) / len(lines), marked]])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    return pd.Series([text_features(t) for t in texts])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[list[float], float]:
    """Weights and intercept of a logistic regression, for features as they are."""
    if len(y) == 0 or y.min() >= 0.5 or y.max() < 0.5:
        return [0.0] * (x.shape[1] if x.ndim == 2 else N_FEATURES), 0.0
    mean, sd = x.mean(0), x.std(0)
    sd[sd < 1e-9] = 1.0
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(z.shape[1] - 1, ridge), 1e-9]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    own = w[:-1] / sd
    return own.tolist(), float(w[-1] - own @ mean)


def _sites(docs: DataFrame) -> list[Column]:
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("source", "lang"))
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)(?:/([^/?#]*))?"
    path = F.regexp_extract(source, parts, 2)
    return [F.lower(F.regexp_extract(source, parts, 1)).alias("__host"), F.when(path != "", path).otherwise(lang).alias("__path")]


def _own(weights: list[float], intercept: float) -> Column:
    """The classifier's probability, kept off 0 and 1."""
    z = F.aggregate(F.zip_with("__x", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(intercept), lambda a, b: a + b)
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 1 / (1 + F.exp(-z))))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(between: float, groups: int, squares: float, total: float, share: float, above: int = 1) -> float:
    """Prior documents from the sum of squares between groups, weighted by their sizes."""
    within = share * (1 - share)
    if groups <= above or total <= groups or within <= 0:
        return 1e4
    size = (total - squares / total) / (groups - above)
    rho = (between / (groups - above) - within) / (within * max(size, 1.0))
    rho = min(0.5, max(1e-4, rho))
    return (1 - rho) / rho


class Model:
    """A fitted classifier and the sites' sums."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_train: int = 20_000):
        rows = cut(docs.select("doc_id", *_sites(docs), features("text").alias("__x")))
        marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("__y"))
        self.marks = cut(marks)
        known = rows.join(self.marks, "doc_id", "left")
        labelled = known.where("__y is not null")
        share = max_train / max(1, labelled.count())
        h = F.xxhash64("doc_id")
        some = labelled if share >= 1 else labelled.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
        train = some.orderBy(h, "doc_id").limit(max_train).select("__x", "__y").toPandas()
        self.weights, self.intercept = fit(np.array(train["__x"].tolist(), np.float64), train["__y"].to_numpy(np.float64))
        self.rows = rows
        y = F.coalesce("__y", _own(self.weights, self.intercept))
        self.known = known.withColumn("__y", y).withColumn("__p", _own(self.weights, self.intercept))
        path = cut(self.known.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("__pn"), F.sum("__y").alias("__ps")))
        host = path.groupBy("__host").agg(F.sum("__pn").alias("__hn"), F.sum("__ps").alias("__hs"))
        n, s = (x or 0.0 for x in path.agg(F.sum("__pn"), F.sum("__ps")).first())
        self.share = min(0.999, max(0.001, s / n)) if n else 0.5
        h = host.agg(F.sum(F.col("__hn") * (F.col("__hs") / F.col("__hn") - self.share) ** 2), F.count(F.lit(1)), F.sum(F.col("__hn").cast("double") ** 2)).first()
        self.host_strength = _strength(h[0] or 0.0, h[1], h[2] or 0.0, n, self.share)
        both = path.join(host, "__host")
        p = both.agg(F.sum(F.col("__pn") * (F.col("__ps") / F.col("__pn") - F.col("__hs") / F.col("__hn")) ** 2), F.count(F.lit(1)), F.sum(F.col("__pn").cast("double") ** 2)).first()
        self.path_strength = _strength(p[0] or 0.0, p[1], p[2] or 0.0, n, self.share, max(1, h[1]))
        self.sites = cut(both)
        self.n_sites = p[1]

    def posterior(self, rows: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
        """``rows`` (with __host, __path, __p and __y) and __host_post, __path_post, __post."""
        sites = F.broadcast(self.sites) if self.n_sites <= broadcast_rows else self.sites
        host = (F.col("__hs") - F.col("__y") + self.host_strength * self.share) / (F.col("__hn") - 1 + self.host_strength)
        path = (F.col("__ps") - F.col("__y") + self.path_strength * F.col("__host_post")) / (F.col("__pn") - 1 + self.path_strength)
        kept = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
        odds = _logit(F.col("__p")) + _logit(F.col("__path_post")) - float(np.log(self.share / (1 - self.share)))
        out = rows.join(sites, ["__host", "__path"], "left").withColumn("__host_post", kept(host)).withColumn("__path_post", kept(path))
        return out.withColumn("__post", 1 / (1 + F.exp(-odds)))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 20_000) -> DataFrame:
    """doc_id, host, path, own, host_posterior, path_posterior, posterior, keep."""
    m = Model(docs, labels, max_train)
    out = m.posterior(m.known)
    return out.select("doc_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__p").alias("own"), F.col("__host_post").alias("host_posterior"), F.col("__path_post").alias("path_posterior"), F.col("__post").alias("posterior"), (F.col("__post") >= threshold).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 20_000, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` less those that the classifier rejects: the rows that ``classified`` keeps."""
    m = Model(docs, labels, max_train)
    # What is left out of the site is what was counted there: the label where there is one.
    marks = F.broadcast(m.marks) if m.marks.count() <= broadcast_rows else m.marks
    rows = docs.join(marks, "doc_id", "left").select("*", *_sites(docs), features("text").alias("__x")).withColumn("__p", _own(m.weights, m.intercept)).withColumn("__y", F.coalesce("__y", "__p"))
    return m.posterior(rows).where(F.col("__post") >= threshold).select(*docs.columns)
