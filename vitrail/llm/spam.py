"""Pages of strung keywords, link lists and product tags, found as robust outliers in spam-directed directions.

1. Function words are learned, not listed: per language, over all documents, a word is one if a share of ``FREQUENT`` of the documents have it and it is spread over
   them as evenly as chance would spread it (document frequency and variance of its counts against those of a Poisson word of equal count). Words of a topic come in
   bursts, also frequent ones; so any language with enough documents has its function words.
2. Every text becomes shares in [0, 1] or so: words in stretches without function words (density), words that are none, links, codes and tags, separators,
   repeated words and pairs, entropy, sentence ends. Batches of texts are described at once, as arrays of word numbers.
3. Per language, centre and covariance of these features are estimated robustly from all documents: medians and median deviations first, then mean
   and covariance of the documents within a quantile of the distance. A short text's shares are less sure, so each document adds the
   sampling variance of its own length to the covariance; of function words a text shorter than a window is less than one observation, which may vary as much as any share.
4. A document is flagged if its Mahalanobis distance is an outlier's and its deviation points to spam: along
   a direction and beyond a cut that are fitted to a bounded sample of labelled pages (``max_labels``). Without enough labels the direction is the density of
   function words. Everything else covers all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.sources.tables import cut

#: A function word is in this share of the documents of its language at least, in no fewer of them than this share of what chance lets expect, and its
#: counts vary about what the lengths let expect by at most so many times what chance does.
FREQUENT, EVEN, DISPERSED = 0.03, 0.94, 5.0
#: Languages of fewer documents use the words and figures of all documents. Of the others so many at most have their own, the largest ones.
MIN_LANGUAGE, MAX_LANGUAGES = 50, 62
#: A word is strung if its window of so many words has fewer than ``DISTINCT`` different function words.
WINDOW, DISTINCT = 13, 2
FEATURES = ["strung", "content", "links", "codes", "marks", "repeated", "sameness", "unstopped", "bigrams"]
FEATURE_SCHEMA = "language string, words int, " + ", ".join(f"{f} double" for f in FEATURES)
# Kana runs and Han or Katakana runs are words of their own; letters of other scripts and digits make words, also joined by inner marks.
_KANA, _HAN = "ぁ-ゟー", "々〆一-鿿㐀-䶿ァ-ヺー"
# A run of common letters before a blank is tried first: it is a whole word, and most words are such.
TOKEN = re.compile(
    rf"[ ]*([A-Za-zäöüßéèàçñíóáú]+(?= )|<[^<>]{{1,400}}>|(?:https?://|www\.)[^\s)\]>\"<]+|#\w+|[{_KANA}]+|[{_HAN}]+|[^\W_{_KANA}{_HAN}]+(?:['’\-/.,×][^\W_{_KANA}{_HAN}]+)*|[.!?。！？…]+(?=\s|$|[\"'”»)\w])|[|•·>»/:;,\n\[\]<=*~–—-])"
)
_INVISIBLE = re.compile("[­؀-؅؜۝᠎​-‏‪-‮⁠-⁯﻿￹-￻]+")
# Cyrillic letters that stand for Latin ones.
LOOKALIKES = str.maketrans("аеорсухіАЕОРСУХІВМНТК", "aeopcyxiAEOPCYXIBMHTK")
_MIXED = re.compile(r"(?=.*[a-zA-Z])(?=.*[Ѐ-ӿ])")
WORD, LINK, CODE, MARK, STOP, NOTHING = range(6)
#: Words a worker remembers before it starts anew.
MEMORY = 400_000


def clean(text: str) -> str:
    """Compatibility forms folded and invisible characters dropped."""
    return text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def _kind(token: str) -> tuple[int, str]:
    """The kind of a token and its folded form; markup counts as a link if it is one, else as a mark."""
    first = token[0]
    if first == "<" and len(token) > 2:
        return (LINK, "<a>") if "href" in token else (MARK, "<")
    if first in ".!?。！？…":
        return STOP, "."
    if len(token) == 1 and not token.isalnum():
        return MARK, token
    lowered = token.casefold()
    if lowered.startswith(("http://", "https://", "www.")):
        return LINK, lowered
    if first == "#":
        return CODE, lowered
    if not lowered.isascii():
        if _MIXED.match(lowered):
            lowered = lowered.translate(LOOKALIKES)
        lowered = lowered.replace("’", "'")
    return (CODE if any(c.isdigit() for c in lowered) else WORD), lowered


class Vocabulary(dict):
    """Numbers of tokens, given as they come: ``kind`` and ``languages`` (a bit for each language that has the word as a function word) by number."""

    def __init__(self, function_words: dict[str, frozenset[str]] | None = None):
        super().__init__()
        self.sets = [frozenset(v) for v in (function_words or {}).values()]
        self.forms: dict[str, int] = {}
        self.kinds: list[int] = []
        self.bits: list[int] = []

    def __missing__(self, token: str) -> int:
        kind, form = _kind(token)
        number = self.forms.get(form)
        if number is None:
            number = self.forms[form] = len(self.kinds)
            self.kinds.append(kind)
            self.bits.append(sum(1 << k for k, s in enumerate(self.sets) if form in s) if kind == WORD else 0)
        self[token] = number
        return number

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number, document) of every token of the texts."""
        if len(self) > MEMORY:
            self.clear()
            self.forms.clear()
            self.kinds.clear()
            self.bits.clear()
        found = [list(map(self.__getitem__, TOKEN.findall(clean(t)))) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((n for one in found for n in one), np.int64, int(sizes.sum()))
        return flat, np.repeat(np.arange(len(texts)), sizes)


_COUNTS = ["documents", "times", "squares", "cross"]


def count_words(documents: DataFrame) -> DataFrame:
    """(language, word, size, documents, times, squares, cross) of each stated language: how many documents have a word, how often it occurs, the sums of the squares of its
    counts and of their products with the documents' words. Under a null word, by size class, the documents, their words and the squares of these. ``documents`` (t, l)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for batch in batches:
            if not batch.num_rows:
                continue
            names, language = np.unique(np.array([s or "" for s in batch.column(1).to_pylist()], object), return_inverse=True)
            flat, doc = known.numbers(batch.column(0).to_pylist())
            words = np.asarray(known.kinds, np.int8)[flat] == WORD if len(flat) else np.zeros(0, bool)
            flat, doc = flat[words], doc[words]
            forms = np.array(list(known.forms), object)
            length = np.bincount(doc, minlength=batch.num_rows)
            pair, c = np.unique(doc * max(1, len(forms)) + flat, return_counts=True)
            d, w = pair // max(1, len(forms)), pair % max(1, len(forms))
            key, at = np.unique(language[d] * max(1, len(forms)) + w, return_inverse=True)
            sums = [np.bincount(at, x, minlength=len(key)) for x in (np.ones(len(c)), c, c.astype(float) ** 2, c * length[d].astype(float))]
            has = np.flatnonzero(length)
            size = np.floor(np.log(length[has]) * 10).astype(np.int64)
            classes, of = np.unique(language[has] * 1000 + size, return_inverse=True)
            whole = [np.bincount(of, x, minlength=len(classes)) for x in (np.ones(len(has)), length[has], length[has].astype(float) ** 2, np.zeros(len(has)))]
            columns = [
                pa.array(np.concatenate([names[key // max(1, len(forms))], names[classes // 1000]]), pa.string()),
                pa.array(list(forms[key % max(1, len(forms))]) + [None] * len(classes) if len(forms) else [None] * len(classes), pa.string()),
                pa.array(np.concatenate([np.zeros(len(key), np.int32), (classes % 1000).astype(np.int32)])),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.concatenate(x)) for x in zip(sums, whole)]], ["language", "word", "size", *_COUNTS])

    return documents.select("t", "l").mapInArrow(run, "language string, word string, size int, " + ", ".join(f"{c} double" for c in _COUNTS))


def function_words(documents: DataFrame) -> dict[str, frozenset[str]]:
    """The function words of each language of at least ``MIN_LANGUAGE`` documents, and under ``*`` those of all documents; ``documents`` (t, l)."""
    counted = count_words(documents).groupBy("language", "word", "size").agg(*[F.sum(c).alias(c) for c in _COUNTS]).withColumn("language", F.explode(F.array("language", F.lit("*"))))
    counted = cut(counted.groupBy("language", "word", "size").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    by_size: dict[str, list[tuple[float, float, float]]] = defaultdict(list)
    for r in counted.where("word is null").collect():  # a row a language and size class
        by_size[r["language"]].append((r["documents"], r["times"], r["squares"]))
    total = {lang: sum(x[0] for x in sizes) for lang, sizes in by_size.items()}
    chosen = sorted((lang for lang, n in total.items() if lang and (n >= MIN_LANGUAGE or lang == "*")), key=lambda x: (x != "*", -total[x], x))[: MAX_LANGUAGES + 1]
    if not chosen:
        return {}
    least = documents.sparkSession.createDataFrame([(lang, FREQUENT * total[lang]) for lang in chosen], "language string, least double")
    out: dict[str, set[str]] = {lang: set() for lang in chosen}
    # The frequent words of a language are no more than the distinct words of its average document times 1 / FREQUENT.
    for r in counted.where("word is not null").join(F.broadcast(least), "language").where("documents >= least").collect():
        n, words, squares = np.array(by_size[r["language"]]).T
        rate = r["times"] / words.sum()
        expected = float((n * -np.expm1(-rate * words / n)).sum())
        dispersion = (r["squares"] - 2 * rate * r["cross"] + rate * rate * squares.sum()) / r["times"]
        if r["documents"] >= EVEN * expected and dispersion <= DISPERSED:
            out[r["language"]].add(r["word"])
    return {lang: frozenset(words) for lang, words in out.items()}


def _per_doc(weights: np.ndarray | None, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n)


def describe(texts: list[str | None], known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, words, features) of texts: the place of the language whose function words a text has most of, -1 if it has fewer than two; no words and
    zeros for a null, empty or blank text."""
    size = len(texts)
    flat, doc = known.numbers(texts)
    kind = np.asarray(known.kinds, np.int8)[flat] if len(flat) else np.zeros(0, np.int8)
    marks, stops = _per_doc((kind == MARK).astype(float), doc, size), _per_doc((kind == STOP).astype(float), doc, size)
    word = kind <= CODE
    flat, doc, kind = flat[word], doc[word], kind[word]
    n = np.bincount(doc, minlength=size)
    begin = np.cumsum(n) - n
    bits = np.asarray(known.bits, np.int64)[flat] if len(flat) else np.zeros(0, np.int64)
    hits = np.array([_per_doc((bits >> k & 1).astype(float), doc, size) for k in range(1, len(known.sets))]) if len(known.sets) > 1 else np.zeros((1, size))
    best = hits.argmax(0)
    language = np.where(hits.max(0) >= 2, best + 1, -1) if len(known.sets) > 1 else np.full(size, -1)
    even = (bits >> np.maximum(language, 0)[doc] & 1).astype(bool) if len(known.sets) else np.zeros(len(doc), bool)
    # Each function word reaches the places around it; reaches of one word that overlap count once.
    at = np.flatnonzero(even)
    order = np.lexsort((at, flat[at], doc[at]))
    at = at[order]
    starts = np.maximum(begin[doc[at]], at - WINDOW // 2)
    ends = np.minimum((begin + n)[doc[at]], at + WINDOW // 2 + 1)
    same = np.flatnonzero((np.diff(flat[at]) == 0) & (np.diff(doc[at]) == 0)) + 1
    starts[same] = np.maximum(starts[same], ends[same - 1])
    reach = np.cumsum(np.bincount(starts, minlength=len(doc) + 1) - np.bincount(ends, minlength=len(doc) + 1))[: len(doc)]
    link, code = kind == LINK, kind == CODE
    strung = (reach < DISTINCT) | link
    key = doc * np.int64(len(known.kinds) + 1) + flat
    pair, times = np.unique(key, return_counts=True)
    of = pair // (len(known.kinds) + 1)
    distinct = np.bincount(of, minlength=size)
    safe = np.maximum(n, 1)
    share = times / safe[of]
    entropy = _per_doc(-share * np.log(share), of, size) / np.maximum(np.log(np.maximum(safe, 2)), 1e-9)
    entropy[n < 2] = 1.0
    follows = np.flatnonzero(np.diff(doc) == 0)
    # Pairs of words by a hash; what collides changes a share by next to nothing.
    double = np.sort((key[follows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ flat[follows + 1].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24) | (doc[follows].astype(np.uint64) << np.uint64(40)))
    new = np.flatnonzero(np.concatenate([[True], np.diff(double) != 0])) if len(double) else np.zeros(0, np.int64)
    often = np.diff(new, append=len(double))
    bigrams = _per_doc(np.where(often > 1, often, 0).astype(float), (double[new] >> np.uint64(40)).astype(np.int64), size) / np.maximum(1, n - 1)
    features = np.column_stack(
        [
            _per_doc(strung.astype(float), doc, size) / safe,
            1 - _per_doc(even.astype(float), doc, size) / safe,
            _per_doc(link.astype(float), doc, size) / safe,
            _per_doc(code.astype(float), doc, size) / safe,
            np.minimum(2.0, marks / safe),
            1 - distinct / safe,
            1 - entropy,
            1 / (1 + 12 * stops / safe),
            bigrams,
        ]
    )
    features[n == 0] = 0
    return language, n, features


#: The quantile 0.999 of the chi-squared distribution with as many degrees of freedom as there are features.
OUTLIER = 27.88
MAX_LABELS = 50_000
MIN_LABELS = 30
DEFAULT_CUT = 0.45
_FLOOR = 0.03
#: How many words make one independent observation of each feature: a window for those of function words.
_FORCED = np.isin(FEATURES, ["strung", "content", "unstopped"])
_SPAN = np.array([WINDOW, WINDOW, 1, 1, 1, 1, 1, 1, 1], float)


def _texts(documents: DataFrame, id_column: str, text_column: str, language_column: str) -> DataFrame:
    return documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("t"), F.lower(F.trim(F.col(language_column).cast("string"))).alias("l"))


def features(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """(doc_id, language, words, features...) of every row; the language is recognised, else the stated one if it is a known one, else ``und``."""
    slim = _texts(documents, id_column, text_column, language_column)
    learned = function_words(slim)
    names = list(learned)
    sent = documents.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(sent.value)
        for batch in batches:
            stated = batch.column(2).to_pylist()
            language, words, shares = describe(batch.column(1).to_pylist(), known)
            named = [names[k] if k >= 0 else s if s in learned else "und" for k, s in zip(language.tolist(), stated)]
            columns = [pa.array(named, pa.string()), pa.array(words.astype(np.int32))]
            columns += [pa.array(shares[:, x]) for x in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "language", "words", *FEATURES])

    return slim.mapInArrow(run, "doc_id bigint, " + FEATURE_SCHEMA)


def robust_figures(feats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and covariance of the bulk of the documents of each language, and of all under the name ``*``."""
    written = feats.where(F.col("words") > 0)
    each = written.withColumn("language", F.explode(F.array("language", F.lit("*"))))
    medians = each.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f, 0.5, 10_000).alias(f"m_{f}") for f in FEATURES])
    off = each.join(F.broadcast(medians), "language")
    spreads = off.groupBy("language").agg(*[F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{f}")), 0.5, 10_000).alias(f"s_{f}") for f in FEATURES])
    distance = sum((((F.col(f) - F.col(f"m_{f}")) / F.greatest(1.4826 * F.col(f"s_{f}"), F.lit(_FLOOR))) ** 2 for f in FEATURES), F.lit(0.0))
    bulk = off.join(F.broadcast(spreads), "language").where(distance <= OUTLIER)
    pairs = [(a, b) for x, a in enumerate(FEATURES) for b in FEATURES[x:]]
    rows = bulk.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).collect()  # a row a language
    out = {}
    for r in rows:
        cov = np.zeros((len(FEATURES), len(FEATURES)))
        for a, b in pairs:
            cov[FEATURES.index(a), FEATURES.index(b)] = cov[FEATURES.index(b), FEATURES.index(a)] = r[f"c_{a}_{b}"] or 0.0
        if r["n"] >= MIN_LANGUAGE or r["language"] == "*":
            out[r["language"]] = (np.array([r[f"m_{f}"] for f in FEATURES]), cov + np.eye(len(FEATURES)) * _FLOOR**2)
    return out


def by_length(feats: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the logarithm of the number of words, over all such documents: the medians of the features, and the variances of one observation, m (1 - m) with the mean m."""
    sized = feats.where(F.col("words") > 0).groupBy(F.floor(F.log2("words")).cast("int").alias("size"))
    rows = sized.agg(*[F.least(F.avg(f), F.lit(1.0)).alias(f) for f in FEATURES], *[F.percentile_approx(f, 0.5, 10_000).alias(f"m_{f}") for f in FEATURES]).collect()  # a row a power of two
    return {r["size"]: (np.array([r[f"m_{f}"] for f in FEATURES]), np.array([r[f] * (1 - r[f]) for f in FEATURES])) for r in rows}


def fit_direction(feats: DataFrame, labels: DataFrame, figures: dict[str, tuple[np.ndarray, np.ndarray]], max_labels: int = MAX_LABELS) -> tuple[np.ndarray, float]:
    """The spam direction and the cut of the score along it, from at most ``max_labels`` labelled pages.

    The direction separates the labelled spam from the bulk (linear discriminant); the cut is the middle of the best cuts for the labels, pages with
    conflicting labels left out. Without ``MIN_LABELS`` pages of either kind together, or without one kind, the score is the share of strung words.
    """
    fixed = np.array([1.0] + [0.0] * (len(FEATURES) - 1)), DEFAULT_CUT
    agreed = labels.where(F.col("spam_label").isNotNull()).groupBy("doc_id").agg(F.min("spam_label").alias("low"), F.max("spam_label").alias("high")).where("low = high")
    drawn = agreed.orderBy(F.xxhash64("doc_id")).limit(max_labels)
    rows = feats.where(F.col("words") > 0).join(drawn, "doc_id").select("language", "high", *FEATURES).collect()
    spam = np.array([r["high"] == 1 for r in rows])
    if len(rows) < MIN_LABELS or not spam.any() or spam.all() or "*" not in figures:
        return fixed
    x = np.array([[r[f] for f in FEATURES] for r in rows]) - np.array([figures.get(r["language"], figures["*"])[0] for r in rows])
    # Raters err: the middle of the labelled spam and the spread of its nearer half in every feature stand for it.
    middle = np.median(x[spam], axis=0)
    deviation = np.abs(x[spam] - middle)
    spread = np.diag(np.maximum(1.4826 * np.median(deviation, axis=0), _FLOOR) ** 2)
    direction = np.linalg.solve(figures["*"][1] + spread, middle)
    size = float(direction @ middle)
    if size <= 0:
        return fixed
    direction = direction / size  # the middle of the labelled spam scores 1, that of the bulk 0
    score = x @ direction
    cuts = np.linspace(0.1, 0.9, 161)
    wrong = np.array([(spam != (score > c)).sum() for c in cuts])
    best = np.flatnonzero(wrong == wrong.min())
    return direction, float(cuts[best[len(best) // 2]])


def deviations(x: np.ndarray, words: np.ndarray, centre: np.ndarray, covariance: np.ndarray, lengths: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Deviations from the centre of texts of so many words, and their squared Mahalanobis distances with the sampling variance of each length.

    In the distance, the function words and sentence ends of texts shorter than a window deviate from the median of their length: it forces these shares.
    """
    n = np.maximum(words, 1)
    zero = np.zeros(len(FEATURES))
    of = [lengths.get(p, (zero, zero)) for p in np.floor(np.log2(n)).astype(int).tolist()]
    median, variance = (np.array([f[k] for f in of]).reshape(-1, len(FEATURES)) for k in (0, 1))
    short = (n < WINDOW)[:, None]
    d_all = x - np.where(short & _FORCED, median, centre)
    variance = np.where(short & (_SPAN > 1), 0.25, variance) * _SPAN / n[:, None]
    out = np.empty(len(x))
    for s in range(0, len(x), 4096):
        each = covariance[None] + variance[s : s + 4096, :, None] * np.eye(len(FEATURES))[None]
        d = d_all[s : s + 4096]
        out[s : s + 4096] = np.einsum("ij,ij->i", d, np.linalg.solve(each, d[:, :, None])[:, :, 0])
    return x - centre, out


def score_pages(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, language, distance, score, outlier, directed) of every document with words: both tests and what they rest on."""
    feats = cut(features(documents))
    figures = robust_figures(feats)
    if not figures:
        return feats.where(F.lit(False)).select("doc_id", "language", F.lit(0.0).alias("distance"), F.lit(0.0).alias("score"), F.lit(False).alias("outlier"), F.lit(False).alias("directed"))
    lengths = by_length(feats)
    direction, least = fit_direction(feats, labels, figures, max_labels)
    fixed = bool((direction[1:] == 0).all())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(3 + k)) for k in range(len(FEATURES))])
            words = np.asarray(batch.column(2))
            language = np.array(batch.column(1).to_pylist(), object)
            distance, score = np.zeros(len(x)), np.zeros(len(x))
            for name in set(language.tolist()):
                centre, covariance = figures.get(name, figures["*"])
                at = language == name
                off, distance[at] = deviations(x[at], words[at], centre, covariance, lengths)
                score[at] = (x[at] if fixed else off) @ direction
            columns = [batch.column(0), batch.column(1), *map(pa.array, (distance, score, distance > OUTLIER, score > least))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(words > 0)) for c in columns], ["doc_id", "language", "distance", "score", "outlier", "directed"])

    return feats.mapInArrow(run, "doc_id bigint, language string, distance double, score double, outlier boolean, directed boolean")


def find_spam(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, language, distance, score) of the documents flagged as spam: outliers in the direction of spam.

    Null, empty and blank texts are never flagged; a text of few words only if links, codes or tags make it an outlier all the same. Repeated rows come out each for itself. An
    empty table gives an empty result; without labels the fixed direction holds. Other columns of either table don't matter.
    """
    return score_pages(documents, labels, max_labels).where("outlier and directed").select("doc_id", "language", "distance", "score")
