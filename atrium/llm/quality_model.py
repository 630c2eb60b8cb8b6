"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, map_arrow
from .quality_stats import STATS, stats, with_stats
from .words import text_slices

FEATURES = ["n_words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "upper", "digits", "marks", "distinct", "same_next", "pipes", "stops", "other_chars"]


def features(f: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of FEATURES from statistics. Language, source and id have no part in it."""
    f = {k: np.asarray(v, float) for k, v in f.items()}
    words, lines, chars = (np.maximum(f[k], 1) for k in ("n_words", "n_lines", "n_chars"))
    return np.column_stack([f["n_words"], f["word_chars"] / words, f["n_symbols"] / words, f["n_dup_lines"] / lines, f["n_repeat_words"] / words, f["n_words"] / lines, f["n_upper"] / chars, f["n_digits"] / chars, f["n_marks"] / words, f["n_distinct"] / words, f["n_same_next"] / words, f["n_pipes"] / words, f["n_stops"] / words, (f["n_chars"] - f["word_chars"]) / chars])


@dataclass
class Trees:
    """All trees in flat arrays: a leaf is its own child. value is added at the leaf that a row ends in."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features, level by level. One class or no row: a constant."""
    p = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
        margin = np.full(len(y), base)
        n_feat = x.shape[1]
        for _ in range(trees):
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            roots.append(len(feature))
            feature.append(0), cut.append(np.inf), left.append(roots[-1]), right.append(roots[-1]), value.append(0.0)
            at = np.full(len(y), roots[-1])
            open_nodes = [roots[-1]]
            for _ in range(depth):
                slot = np.full(len(feature), -1)
                slot[open_nodes] = np.arange(len(open_nodes))
                mine = slot[at]
                live = mine >= 0
                k = len(open_nodes)
                gain, where = np.full(k, 1e-4), np.full((k, 2), -1)
                tot_g, tot_h = (np.bincount(mine[live], v[live], k) for v in (g, h))
                for j in range(n_feat):
                    idx = mine[live] * bins + binned[live, j]
                    gl, hl = (np.bincount(idx, v[live], k * bins).reshape(k, bins).cumsum(1) for v in (g, h))
                    gr, hr = tot_g[:, None] - gl, tot_h[:, None] - hl
                    s = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (tot_g**2 / (tot_h + ridge))[:, None]
                    s[(hl < least) | (hr < least)] = -1
                    s[:, len(cuts[j]) :] = -1
                    b = s.argmax(1)
                    best = s[np.arange(k), b]
                    up = best > gain
                    gain[up] = best[up]
                    where[up] = np.column_stack([np.full(k, j), b])[up]
                nxt = []
                for node, (j, b) in zip(open_nodes, where, strict=True):
                    if j < 0:
                        continue
                    kids = len(feature), len(feature) + 1
                    for kid in kids:
                        feature.append(0), cut.append(np.inf), left.append(kid), right.append(kid), value.append(0.0)
                    feature[node], cut[node], left[node], right[node] = int(j), float(cuts[j][b]), *kids
                    inside = at == node
                    at[inside] = np.where(binned[inside, j] <= b, *kids)
                    nxt += kids
                open_nodes = nxt
                if not nxt:
                    break
            sg, sh = (np.bincount(at, v, len(feature)) for v in (g, h))
            for node in np.unique(at):
                value[node] = float(-rate * sg[node] / (sh[node] + ridge))
            margin += np.asarray(value)[at]
    return Trees(np.array(feature, int), np.array(cut, float), np.array(left, int), np.array(right, int), np.array(value, float), np.array(roots, int), depth, base)


def held_out(id_col) -> F.Column:
    """Rows that no classifier learns from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **fit_args) -> Trees:
    """Fits on a sample of labelled, not held-out rows: the max_rows with the least hash of their id.

    At most that many ids are broadcast and as many rows of statistics collected: of rows that repeat an id one is
    fitted, that of the least statistics, and of its labels the largest counts. Null ids and labels are left out, null
    texts count as empty, very long ones whole; without rows, or with labels of one kind, the model is a constant.
    """
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).where(~held_out(labels[id_col]))
    known = known.groupBy(known[id_col].alias("__key")).agg(F.max(known[label_col]).cast("int").alias("__y"))
    known = known.orderBy(F.xxhash64("__key"), "__key").limit(max_rows)
    src = df.select(df[id_col].alias("__key"), df[text_col].alias("__t"))
    rows = with_stats(src.join(F.broadcast(known), "__key"), ["__key", "__y"], "__t")
    rows = rows.groupBy("__key", "__y").agg(F.min(F.struct(*STATS)).alias("s")).select("__key", "__y", "s.*").toArrow()
    f = {n: rows.column(n).to_numpy() for n in STATS}
    order = np.argsort(rows.column("__key").to_numpy(), kind="stable")
    y = rows.column("__y").to_numpy().astype(float) if rows.num_rows else np.zeros(0)
    return fit(features(f)[order], y[order], **fit_args)


def score(df: DataFrame, model: Trees, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, score (0 to 1) and predicted of each row's whole text (null: empty). No shuffle.

    Empty and very long texts have a score like any other; repeated rows each give a row with the same score; a score of
    0.5 is predicted 1; an empty table gives an empty result; kept columns named score or predicted are replaced.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "predicted int"])
    take_text = text_col in keep
    names = keep if take_text else [*keep, text_col]

    def run(batches):
        for batch in batches:
            got = [model.score(features(stats(s))) for s in text_slices(columns_of(batch, [text_col])[0])]
            p = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*columns_of(batch, keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return map_arrow(df.select(*[df[c] for c in names]), run, schema)
