"""Quality classifier: an additive model with pairwise interactions on bins.

Every whole text becomes a few numbers (``FEATURES``), counted over its bytes,
words and lines. Each number is cut into bins at quantiles. Boosting goes round
the features in turn and adds, a small step at a time, a shallow tree of one
feature to that feature's table of bins; then round the pairs with the strongest
remaining signal, with small trees over two features. What is learned is a table
for each feature and pair, so a score is a sum of looked-up bins: vectorised,
the same on every executor, and readable.

Labels: rows of ``labels`` whose crc32(doc_id) mod ``folds`` is not 0, at most
``max_labels`` of them in order of a hash of the id, and at most ``max_labels`` labelled
documents (ids that occur more than once come in that order too): documented bounds, so that
the fit on the driver has a fixed size at any scale. No score sees labels, lang, source or id.

Defined results: a null text is scored as an empty one; a null ``doc_id`` is held
out (its checksum is taken as 0); rows labelled twice count twice, null labels are
ignored; without two classes of labels every score is the smoothed share of ones;
an empty table gives no rows; other columns are ignored or, in ``reject``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relquery.llm.common import LOWER, SPACE, chunks, in_arrow, mix, span_hashes, table, texts_of, word_spans

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "high_bytes", "brackets", "strange", "shouts", "stops",
    "commas", "space", "bare_symbols", "odd_ends", "distinct_words", "distinct_lines", "words_a_line", "words_a_stop",
    "top_word", "capital_words", "long_words",
)
THRESHOLD = 0.3
MAX_LABELS, FOLDS = 20_000, 5


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_UPPER, _LOWER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz"), _mask("0123456789")
_HIGH = np.arange(256) >= 128
_ALNUM = _UPPER | _LOWER | _DIGIT | _HIGH
_STRANGE = _mask("#$%&*+<=>@\\^_`|~/")
_END = _mask(".,;:!?'\")")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    size = np.diff(offsets)
    rows = len(size)

    def count(mask: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[at[1:]] - sums[at[:-1]]).astype(np.int64)

    space = SPACE[data]
    starts, ends, first = word_spans(space, offsets)
    words = np.diff(first)
    text_of = np.repeat(np.arange(rows), words)
    length = ends - starts
    hashes = span_hashes(data, starts, ends, LOWER) if len(data) else np.zeros(0, np.uint64)

    def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many distinct hashes each text has, and how often its commonest occurs."""
        _, where, times = np.unique(h ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
        top = np.zeros(rows, np.int64)
        np.maximum.at(top, owner[where], times)
        return np.bincount(owner[where], minlength=rows), top

    n_distinct, top = distinct(hashes, text_of)
    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1]])) if len(data) else np.zeros(0, np.int64)
    breaks = breaks[breaks < len(data)]
    line_ends = np.append(breaks[1:], len(data))
    line_of = np.searchsorted(offsets, breaks, "right") - 1
    lines = np.bincount(line_of, minlength=rows)
    n_lines, _ = distinct(span_hashes(data, breaks, line_ends, LOWER) if len(data) else np.zeros(0, np.uint64), line_of)
    head, tail = (data[starts], data[ends - 1]) if len(data) else (data, data)
    letters, upper, stops = count(_UPPER[data] | _LOWER[data]), count(_UPPER[data]), count(_mask(".!?")[data])
    columns = [
        np.log1p(size), np.log1p(words), _share(np.bincount(text_of, length, rows), words), _share(upper, letters), _share(count(_DIGIT[data]), size),
        _share(count(_HIGH[data]), size), _share(count(_mask("[]{}()")[data]), size), _share(count(_STRANGE[data]), size), _share(count(_mask("!?")[data]), size), _share(stops, words),
        _share(count(_mask(",;:")[data]), words), _share(count(space), size), _share(count(~_ALNUM[head] & (length == 1), first), words), _share(count(~_ALNUM[tail] & ~_END[tail], first), words), _share(n_distinct, words),
        _share(n_lines, lines), _share(words, lines), _share(words, stops), _share(top, words), _share(count(_UPPER[head], first), words), _share(count(length > 20, first), words),
    ]
    return np.stack(columns, axis=1).astype(float)


@dataclass
class AdditiveModel:
    """Log-odds: ``base`` + a bin of ``tables[f]`` for each feature + a bin of each pair's table."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cuts, x[:, f], "right")]
        for f, g, values in self.pairs:
            total += values[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, ridge: float) -> np.ndarray:
    """The steps of a tree over bins in order, from sums of gradients, curvatures and rows."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    cg, ch, cn = (np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, n))

    def best(a: int, b: int) -> tuple[float, int]:
        c = np.arange(a + 1, b)
        ok = (cn[c] - cn[a] >= least) & (cn[b] - cn[c] >= least)
        if not ok.any():
            return 0.0, -1
        c = c[ok]
        gains = _gain(cg[c] - cg[a], ch[c] - ch[a], ridge) + _gain(cg[b] - cg[c], ch[b] - ch[c], ridge) - _gain(cg[b] - cg[a], ch[b] - ch[a], ridge)
        k = int(np.argmax(gains))
        return float(gains[k]), int(c[k])

    while len(parts) < leaves:
        gain, cut, part = max((*best(*p), p) for p in parts)
        if gain <= 0:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The steps of a tree of four leaves over a grid: a cut of one feature, then one of the other on each side."""
    best, out = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        ca, cb = (np.cumsum(np.cumsum(v, axis=0), axis=1) for v in (a, b))
        whole_g, whole_h = ca[-1, -1], cb[-1, -1]
        top_g, top_h = ca[:-1], cb[:-1]
        low_g, low_h = ca[-1] - top_g, cb[-1] - top_h
        sides = []
        for sg, sh in ((top_g, top_h), (low_g, low_h)):
            gains = _gain(sg[:, :-1], sh[:, :-1], ridge) + _gain(sg[:, -1:] - sg[:, :-1], sh[:, -1:] - sh[:, :-1], ridge)
            sides.append((gains.max(axis=1), gains.argmax(axis=1)))
        gains = sides[0][0] + sides[1][0] - _gain(whole_g, whole_h, ridge)
        r = int(np.argmax(gains))
        if gains[r] > best:
            best, steps = float(gains[r]), np.zeros_like(a)
            for rows, (_, cut) in ((slice(0, r + 1), sides[0]), (slice(r + 1, None), sides[1])):
                c = int(cut[r]) + 1
                for cols in (slice(0, c), slice(c, None)):
                    steps[rows, cols] = a[rows, cols].sum() / (b[rows, cols].sum() + ridge)
            out = steps.T if flip else steps
    return out, best


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, bins: int = 64, grid: int = 8, rate: float = 0.1, leaves: int = 3, least: int = 5, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic boosting on bins. y: 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return AdditiveModel(base)
    width = x.shape[1]
    model = AdditiveModel(base, [_quantiles(x[:, f], bins) for f in range(width)], coarse=[_quantiles(x[:, f], grid) for f in range(width)])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    rows = [np.bincount(a, minlength=len(t)) for a, t in zip(at, model.tables, strict=True)]
    total = np.full(len(y), base)
    for _ in range(rounds):
        for f in range(width):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), rows[f], leaves, least, ridge)
            model.tables[f] += step
            total += step[at[f]]
    small = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.coarse)]

    def grids(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)
        cell = small[f] * shape[1] + small[g]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    p = 1 / (1 + np.exp(-total))
    wide = [f for f in range(width) if len(model.coarse[f])]
    gains = sorted(((_pair_tree(*grids(f, g, p), ridge)[1], f, g) for f in wide for g in wide if f < g), reverse=True)
    tables = {(f, g): np.zeros((len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)) for _, f, g in gains[:pairs]}
    for _ in range(pair_rounds):
        for (f, g), values in tables.items():
            p = 1 / (1 + np.exp(-total))
            step = rate * _pair_tree(*grids(f, g, p), ridge)[0]
            values += step
            total += step[small[f], small[g]]
    model.pairs = [(f, g, values) for (f, g), values in tables.items()]
    return model


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds


def learn(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, folds: int = FOLDS) -> AdditiveModel:
    """The model of the labelled documents outside fold 0; see the module for the bound."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null")
    known = known.where(fold(F.col("doc_id"), folds) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labels)
    names = [f"f{k}" for k in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = features(*texts_of(part.column(2)))
                yield pa.record_batch([part.column(0), part.column(1), *[pa.array(c) for c in x.T]], names=["doc_id", "quality", *names])

    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = text.join(F.broadcast(known), "doc_id")  # max_labels small rows at most
    made = in_arrow(joined.select("doc_id", "quality", "text"), run, "doc_id long, quality int, " + ", ".join(f"{n} double" for n in names))
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *names).limit(max_labels).toPandas().sort_values([*names, "quality"])
    return fit(got[names].to_numpy(float), got["quality"].to_numpy(float))


def _scored(batches: Iterator[pa.RecordBatch], model: AdditiveModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            score = model.score(features(*texts_of(part.column(part.schema.get_field_index("text")))))
            rest = [part.column(k) for k, name in enumerate(part.schema.names) if name != "text"]
            yield pa.record_batch([*rest, pa.array(score)], names=[*[n for n in part.schema.names if n != "text"], "score"])


def quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labels: int = MAX_LABELS, folds: int = FOLDS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    model = learn(documents, labels, max_labels, folds)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = in_arrow(rows, lambda batches: _scored(batches, model), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labels: int = MAX_LABELS, folds: int = FOLDS) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    model = learn(documents, labels, max_labels, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                keep = model.score(features(*texts_of(part.column(part.schema.get_field_index("text"))))) >= threshold
                yield part.filter(pa.array(keep))

    return in_arrow(documents, run, documents.schema)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
