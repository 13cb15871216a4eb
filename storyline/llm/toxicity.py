"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit, on a bounded sample (at most `max_examples` labelled rows a class, the first by a hash of doc_id; votes are
weighted back to the classes' true sizes):
  * features are all lower-cased words of the examples and the first four letters of longer words (inflected
    and compounded words share them); none is left out;
  * a feature weighs (1 + ln tf) * idf * relevance. Relevance is FLOOR for every feature and grows with the z of its
    share among examples of label 1 against label 0, so that a few marks in a long text are not drowned by the words
    that all texts share (plain TF-IDF, `relevance=False`, is there for comparison);
  * examples are such vectors of length one in an inverted index: postings by feature, cut into blocks of 64 examples,
    with the largest weight of each feature in each block;
  * votes are calibrated by a logistic curve fitted to leave-one-out votes of the examples, moved so that it passes
    THRESHOLD at the vote that parts them best (the largest F-measure of label 1 in leave-one-out).

Score, one map over whole texts without a shuffle: upper bounds of all blocks come from the block maxima; postings are
read in the order of the blocks' bounds until no bound reaches the k-th best cosine, so that the k nearest are exact.
Votes weigh by 1 / (1.1 - cosine). Words that no example has count in the text's length. Only a text without any known
feature (an empty one, say) has no nearest examples; it gets the share of label 1 among examples of that sort.

Only labelled rows whose crc32(doc_id as text) mod 3 is not 1 are learned from; doc_id, lang, source and labels are no
inputs of a score. What is collected and broadcast are the vectors of at most 2 * max_examples texts.

Defined results: null and empty texts are texts without features; labels that are null or conflict (the larger counts)
or name no document are no error; with no usable labelled row every score is 0.5; repeated rows are scored one by one;
equal labelled texts are one example, with the smallest doc_id; of equally near examples the one earlier in the index
(by main feature, then doc_id) counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import filter_rows, map_rows, table, written

LETTERS = re.compile(r"[^\W\d_]+")
#: Examples in a block, texts in a batch, and the share of examples beyond which a feature is frequent.
BLOCK, BATCH, FREQUENT = 64, 256, 8
NEIGHBOURS = 15
PREFIXES = (4,)
THRESHOLD = 0.7
MAX_EXAMPLES = 1000
#: Relevance of a feature that marks nothing, and the z that chance reaches among many features.
FLOOR, CHANCE_Z = 0.01, 2.0

SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("neighbours", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))),
    ]
)


def prefixes_of(word: str) -> Iterator[str]:
    for n in PREFIXES:
        if len(word) > n:
            yield "^" + word[:n]


def held_out(doc_id):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_in(text: str | None) -> Counter:
    return Counter(LETTERS.findall((text or "").lower()))


class Vocabulary(dict):
    """word -> numbers of its features, whole words first; remembers words, up to a bound."""

    def __init__(self, words: list[str], prefixes: list[str]):
        self.n_words = len(words)
        self.number = {f: i for i, f in enumerate((*words, *prefixes))}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.number[f] for f in (word, *prefixes_of(word)) if f in self.number)
        if len(self) < 100_000:
            self[word] = found
        return found

    def counts(self, words: Counter) -> tuple[dict[int, int], list[int]]:
        """Counts by feature, and counts of the words that no example has."""
        known: dict[int, int] = {}
        unknown = []
        for word, n in words.items():
            found = self[word]
            for i in found:
                known[i] = known.get(i, 0) + n
            if not found or found[0] >= self.n_words:
                unknown.append(n)
        return known, unknown


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [start, end) in a row, and the number of each range."""
    sizes = ends - starts
    of = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
    return np.arange(of.size, dtype=np.int32) + (starts - (np.cumsum(sizes) - sizes)).astype(np.int32)[of], of


class BlockMaxIndex:
    """Postings of the examples' unit vectors by feature, in blocks of examples with block maxima.

    Features that over 1 / FREQUENT of the examples have (their postings fill every block) are columns of a matrix: one
    product scores a batch of texts over them, and its maximum in a block is the block's bound for them.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_features: int):
        main = np.array([numbers[values.argmax()] if numbers.size else 0 for numbers, values in vectors], dtype=np.int64)
        order = np.lexsort((ids, main))  # alike examples share a block: sharper maxima
        self.ids, self.labels, self.weights = ids[order], labels[order], weights[order]
        self.vectors = [vectors[i] for i in order]
        self.n_blocks = -(-len(order) // BLOCK)
        self.block_of = np.arange(len(order)) // BLOCK
        none = [np.zeros(0, np.int64)]
        features = np.concatenate(none + [v[0] for v in self.vectors])
        places = np.concatenate(none + [np.full(v[0].size, i) for i, v in enumerate(self.vectors)])
        values = np.concatenate([np.zeros(0)] + [v[1] for v in self.vectors])
        frequent = np.flatnonzero(np.bincount(features, minlength=n_features) * FREQUENT > len(order))
        self.column = np.full(n_features, -1)
        self.column[frequent] = np.arange(frequent.size)
        column = self.column[features]
        self.matrix = np.zeros((frequent.size, len(order)))
        self.matrix[column[column >= 0], places[column >= 0]] = values[column >= 0]
        features, places, values = features[column < 0], places[column < 0], values[column < 0]
        by = np.lexsort((places, features))
        features, self.places, self.values = features[by], places[by], values[by]
        group = features * max(1, self.n_blocks) + self.places // BLOCK
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if group.size else np.zeros(0, np.int64)
        ends = np.append(starts[1:], group.size) if group.size else starts
        self.of_feature = np.searchsorted(features[starts], np.arange(n_features + 1))
        self.maxima = np.maximum.reduceat(self.values, starts) if group.size else np.zeros(0)
        self.blocks = self.block_of[self.places[starts]].astype(np.int32)
        self.places, self.starts, self.ends = (x.astype(np.int32) for x in (self.places, starts, ends))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, leave_one_out: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query places and cosines of the k nearest examples (equal cosines: the smaller place first).
        leave_one_out: the queries are the examples in their order, and none finds itself."""
        for at in range(0, len(queries), BATCH):
            batch = queries[at : at + BATCH]
            dense = np.zeros((len(batch), self.matrix.shape[0]))
            for row, (numbers, values) in enumerate(batch):
                column = self.column[numbers]
                dense[row, column[column >= 0]] = values[column >= 0]
            scores = dense @ self.matrix
            bounds = np.maximum.reduceat(scores, np.arange(0, self.ids.size, BLOCK), axis=1) if self.ids.size else scores
            for row, (numbers, values) in enumerate(batch):
                rare = self.column[numbers] < 0
                yield self.best(numbers[rare], values[rare], scores[row], bounds[row], k, at + row if leave_one_out else -1)

    def best(self, numbers: np.ndarray, values: np.ndarray, cosines: np.ndarray, bounds: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest from the cosines and bounds over frequent features and the rare features of a query."""
        entries, of = spread(self.of_feature[numbers], self.of_feature[numbers + 1])
        weight, blocks = values[of], self.blocks[entries]
        bounds = bounds + np.bincount(blocks, self.maxima[entries] * weight, self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        opened = np.zeros(self.n_blocks, bool)
        at, size, least, best = 0, 4, 0.0, np.zeros(0, np.int64)
        while at < order.size and bounds[order[at]] >= least - 1e-12 and bounds[order[at]] > 0:
            chosen = np.zeros(self.n_blocks, bool)
            chosen[order[at : at + size]] = True
            chosen &= (bounds >= least - 1e-12) & (bounds > 0)
            opened |= chosen
            at, size = at + size, self.n_blocks
            here = chosen[blocks]
            postings, entry = spread(self.starts[entries[here]], self.ends[entries[here]])
            cosines = cosines + np.bincount(self.places[postings], self.values[postings] * weight[here][entry], self.ids.size)
            found = np.flatnonzero(opened[self.block_of] & (cosines > max(least - 1e-12, 0.0)))
            found = found[found != without]
            best = found[np.lexsort((found, -cosines[found].round(12)))[:k]]
            least = cosines[best[-1]] if best.size == k else 0.0
        return best, cosines[best]


class Model:
    """The fitted index. examples: doc_id, toxic, words (a Counter) of each; weight: what an example of a class counts."""

    def __init__(self, examples: list[tuple[int, int, Counter]], weight: dict[int, float], k: int = NEIGHBOURS, relevance: bool = True):
        self.k, self.n = k, len(examples)
        words = sorted({w for _, _, c in examples for w in c})
        self.words, self.prefixes = words, sorted({p for w in words for p in prefixes_of(w)})
        vocabulary = Vocabulary(self.words, self.prefixes)
        n_features = len(vocabulary.number)
        counted = [vocabulary.counts(c) for _, _, c in examples]
        labels = np.array([e[1] for e in examples], dtype=np.int64)
        seen = np.zeros((2, n_features))
        for (known, _), label in zip(counted, labels):
            seen[label, list(known)] += 1
        self.idf = np.log((1 + self.n) / (1 + seen.sum(axis=0))) + 1
        self.scale = self.idf * (self.relevance(seen, labels) if relevance and n_features else 1.0)
        self.unknown = (np.log(1 + self.n) + 1) * (FLOOR if relevance else 1.0)
        vectors = [self.vector(*c) for c in counted]
        ids, weights = np.array([e[0] for e in examples], dtype=np.int64), np.array([weight[e[1]] for e in examples])
        some = np.array([bool(c[0]) for c in counted], dtype=bool)
        self.prior = float(weights @ labels / weights.sum()) if self.n else 0.5
        plain = weights[~some]
        # one example's worth of the overall share keeps the estimate defined
        self.without = float((plain @ labels[~some] + self.prior * weights.mean()) / (plain.sum() + weights.mean())) if self.n else 0.5
        self.index = BlockMaxIndex([v for v, s in zip(vectors, some) if s], ids[some], labels[some], weights[some], n_features)
        self.slope, self.shift = 1.0, 0.0
        if some.any():
            self.calibrate()

    @staticmethod
    def relevance(seen: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """FLOOR for all; up to 1 more for the feature that marks label 1 the most significantly."""
        n0, n1 = (labels == 0).sum(), (labels == 1).sum()
        pooled = np.clip(seen.sum(axis=0) / (n0 + n1), 1e-9, 1 - 1e-9)
        z = (seen[1] / n1 - seen[0] / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
        over = np.maximum(z - CHANCE_Z, 0.0)
        return FLOOR + over / max(over.max(), 1.0)

    def vector(self, known: dict[int, int], unknown: list[int]) -> tuple[np.ndarray, np.ndarray]:
        numbers = np.fromiter(known, np.int64, len(known))
        values = (1 + np.log(np.fromiter(known.values(), np.float64, len(known)))) * self.scale[numbers]
        other = self.unknown * (1 + np.log(np.array(unknown, dtype=np.float64)))
        return numbers, values / (np.sqrt(values @ values + other @ other) or 1.0)

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the distance-weighted votes, drawn to the share of label 1 by one vote at cosine zero."""
        weights = self.index.weights[places] / self.index.weights.mean() / (1.1 - cosines)
        own = 1 / 1.1
        share = (weights @ self.index.labels[places] + own * self.prior) / (weights.sum() + own)
        return float(np.log(share / (1 - share))) if 0 < share < 1 else float(np.sign(share - 0.5)) * 10

    def calibrate(self) -> None:
        """Logistic curve over leave-one-out votes, by Newton steps on smoothed targets."""
        x = np.array([self.vote(*found) for found in self.index.nearest(self.index.vectors, self.k, leave_one_out=True)])
        y, w = self.index.labels, self.index.weights
        ones, zeros = (y == 1).sum(), (y == 0).sum()
        target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        design, theta = np.stack((x, np.ones_like(x)), axis=1), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            gradient = design.T @ (w * (p - target)) + 1e-3 * (theta - [1.0, 0.0]) * w.sum()
            hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * w.sum() * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            theta = theta - step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(float(theta[0]), 1e-3), float(theta[1])
        if 0 < ones < y.size:
            self.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - self.slope * best_cut(x, y, w)
        self.index.vectors = []  # served the calibration only

    def scores(self, texts: list[tuple[dict[int, int], list[int]]]) -> Iterator[tuple[float, list[dict]]]:
        """Score and neighbours of each text, given by its counts."""
        index = self.index
        for places, cosines in index.nearest([self.vector(*t) for t in texts], self.k):
            if not places.size:
                yield self.without, []
                continue
            raw = self.slope * self.vote(places, cosines) + self.shift
            ids, labels = index.ids[places].tolist(), index.labels[places].tolist()
            yield 1 / (1 + float(np.exp(-raw))), [{"doc_id": i, "cosine": c, "toxic": t} for i, c, t in zip(ids, cosines.tolist(), labels)]


def best_cut(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The value between two votes x at which "x or more" finds label 1 with the largest F-measure, rows weighted by w.
    Of equally good ones the middle one."""
    order = np.argsort(-x, kind="stable")
    x, hit = x[order], np.cumsum((w * y)[order])
    f = 2 * hit / (np.cumsum(w[order]) + (w @ y))
    ends = np.flatnonzero(np.append(x[1:] < x[:-1], True))  # equal votes are on one side
    best = ends[f[ends] >= f[ends].max() - 1e-12]
    at = int(best[best.size // 2])
    return float(x[at] if at + 1 == x.size else (x[at] + x[at + 1]) / 2)


def sample(docs: DataFrame, labels: DataFrame, max_examples: int) -> tuple[DataFrame, dict[int, int]]:
    """Bounded sample of labelled texts (doc_id, toxic, text) and the classes' sizes."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = None
    for label in (0, 1):
        part = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * max_examples small rows
    return found.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")), sizes


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, relevance: bool = True) -> Model:
    examples, sizes = sample(docs, labels, max_examples)

    def counted(cols: dict[str, list]) -> dict:
        return {"doc_id": cols["doc_id"], "toxic": cols["toxic"], "words": [list(words_in(t).items()) for t in cols["text"]]}

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("words", T.MapType(T.StringType(), T.IntegerType()))])
    found = map_rows(examples, schema, counted).collect()  # at most 2 * max_examples rows
    rows = sorted(((r.doc_id, r.toxic, Counter(r.words)) for r in found), key=lambda r: (r[0], r[1]))
    here = Counter(r[1] for r in rows)
    if not here[0] or not here[1]:
        return Model([], {0: 1.0, 1: 1.0})
    return Model(rows, {c: sizes[c] / here[c] for c in (0, 1)}, relevance=relevance)


def scorer(docs: DataFrame, model: Model):
    """texts -> (score, neighbours) in the tasks; a worker keeps one vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        m = shared.value
        if not hasattr(m, "vocabulary"):
            m.vocabulary = Vocabulary(m.words, m.prefixes)
        out = []
        for at in range(0, len(texts), BATCH):
            out += m.scores([m.vocabulary.counts(words_in(t)) for t in texts[at : at + BATCH]])
        return out

    return of


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score under the threshold."""
    of = scorer(docs, model)
    return filter_rows(docs, lambda texts: [s < threshold for s, _ in of(texts)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and neighbours (evidence) for every row."""
    of = scorer(docs, model)

    def rows(cols: dict[str, list]) -> dict:
        scored = of(cols["text"])
        return {"doc_id": cols["doc_id"], "score": [s for s, _ in scored], "neighbours": [n for _, n in scored]}

    return map_rows(docs.select("doc_id", "text"), SCORED, rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    nearest = F.transform(F.slice("neighbours", 1, 3), lambda n: F.concat_ws(":", n.doc_id, n.toxic, F.round(n.cosine, 4)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.array_join(nearest, ",").alias("evidence"))
