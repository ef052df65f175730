"""K-means for many models at once on weighted itemsets.

All models of a sweep share every pass over the points: a step assigns each
distinct itemset to its nearest centre under every model and sums the weights
by (centre, code). These sums are whole numbers, so a step gives the same
centres whatever the partitions or the order of rows. A centre is kept as its
code sums and size; in the projected space its place is the projected mean,
which equals the mean of the projected itemsets.

Tasks work on Arrow batches; what comes to the driver, and goes out as a
broadcast, are the centres: at most ``GROUP_BYTES`` a pass, more models take
more passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of centres that one pass sends out.
GROUP_BYTES = 32 << 20
#: Itemsets of a batch that are compared with all centres at once.
ROWS_AT_ONCE = 2048
#: Lloyd steps of a fit, as many as the reference's fits take at most.
MAX_STEPS = 20
#: Distances in the projected space are compared to so many digits.
DIGITS = 9


@dataclass
class Model:
    """One clustering: ``key`` names it, ``sums`` (k x codes) and ``sizes`` are its centres' code sums and sizes."""

    key: tuple
    codes: list
    sums: np.ndarray
    sizes: np.ndarray
    #: None for the 0/1 space, else codes x components of a projection
    loadings: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.sizes)

    def centres(self) -> np.ndarray:
        """Centres in the model's space, one row each."""
        mean = self.sums / self.sizes[:, None]
        return mean if self.loadings is None else mean @ self.loadings

    def form(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a, const, times, over): d^2(x, centre) = |x|^2 + (const - times a.x) / over, a with one row per code.

        In the 0/1 space all but the division is in whole numbers, so equal
        distances are equal doubles.
        """
        if self.loadings is None:
            sums, n = self.sums.astype(float), self.sizes.astype(float)
            return sums.T, (sums * sums).sum(axis=1), 2 * n, n * n
        centres = self.centres()
        one = np.ones(self.k)
        return self.loadings @ centres.T, (centres * centres).sum(axis=1), 2 * one, one


def hash_order(items: str = "archives", weight: str | None = "weight", seed: int = 1) -> list[Column]:
    """Order of itemsets by a seeded hash; with a weight, a sample in proportion to it without repeats."""
    digest = F.md5(F.concat_ws(",", F.lit(str(seed)), F.col(items).cast("array<string>")).cast("binary"))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    if weight is None:
        return [number, F.col(items)]
    return [-F.log((number + 0.5) / F.lit(4294967296.0)) / F.col(weight), F.col(items)]


def seeds(points: DataFrame, k: int, codes: Sequence, weight: str | None = "weight", seed: int = 1) -> np.ndarray:
    """0/1 rows (k x codes) of the first k itemsets of ``points`` in hash order: the first centres of all models."""
    rows = points.orderBy(*hash_order("archives", weight, seed)).limit(k).select("archives").collect()
    place = {c: i for i, c in enumerate(codes)}
    out = np.zeros((len(rows), len(codes)), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, [place[c] for c in r["archives"]]] = 1
    return out


def _groups(models: Sequence[Model]) -> Iterator[list[int]]:
    """Places of models in groups whose centres go out together."""
    group, size = [], 0
    for i, m in enumerate(models):
        own = m.k * len(m.codes) * 8
        if group and size + own > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(i)
        size += own
    if group:
        yield group


def _blocks(batches: Iterator[pa.RecordBatch], codes: list) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, x, row and code of every item): some itemsets as 0/1 rows over all codes."""
    domain = pa.array(codes)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            lists = part.column("archives")
            place = pc.index_in(lists.flatten().cast(domain.type), value_set=domain)
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
            code = place.to_numpy(zero_copy_only=False)
            x = np.zeros((part.num_rows, len(codes)))
            x[row, code] = 1.0
            yield part, x, row, code


def _nearest(x: np.ndarray, form: tuple, rounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row (the first of equals), and its squared distance less |x|^2."""
    a, const, times, over = form
    d = (const - times * (x @ a)) / over
    if rounded:
        d = d.round(DIGITS)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


def _sums(points: DataFrame, models: Sequence[Model]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sums, sizes) of the points nearest to every centre, for every model; one pass a group of models."""
    out: list = [None] * len(models)
    for group in _groups(models):
        codes = models[group[0]].codes
        forms = points.sparkSession.sparkContext.broadcast(
            [(models[i].form(), models[i].loadings is not None, models[i].k) for i in group])
        width = len(codes) + 1

        def run(batches: Iterator[pa.RecordBatch], forms=forms, codes=codes, width=width) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(k * width) for _, _, k in forms.value]
            for part, x, row, code in _blocks(batches, codes):
                w = part.column("weight").to_numpy().astype(float)
                for own, (form, rounded, k) in zip(total, forms.value, strict=True):
                    best, _ = _nearest(x, form, rounded)
                    own += np.bincount(best[row] * width + code, weights=w[row], minlength=k * width)
                    own += np.bincount(best * width + width - 1, weights=w, minlength=k * width)
            for i, own in enumerate(total):
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(own[at].astype(np.int64))],
                                                 names=["model", "at", "n"])

        rows = points.select("archives", "weight").mapInArrow(run, "model int, at long, n long").groupBy("model", "at").agg(
            F.sum("n").alias("n")).toPandas()
        for i, m in enumerate(group):
            own = rows[rows["model"] == i]
            flat = np.zeros(models[m].k * width, dtype=np.int64)
            flat[own["at"].to_numpy(dtype=np.int64)] = own["n"].to_numpy(dtype=np.int64)
            flat = flat.reshape(models[m].k, width)
            out[m] = (flat[:, :-1], flat[:, -1])
        forms.unpersist()
    return out


def lloyd_step(points: DataFrame, models: Sequence[Model]) -> list[Model]:
    """All models after one step; a centre that no point is nearest to stays where it is."""
    out = []
    for m, (sums, sizes) in zip(models, _sums(points, models), strict=True):
        kept = sizes == 0
        out.append(replace(m, sums=np.where(kept[:, None], m.sums, sums), sizes=np.where(kept, m.sizes, sizes)))
    return out


def fit(points: DataFrame, codes: Sequence, specs: dict[tuple, tuple[int, np.ndarray | None]], steps: int = MAX_STEPS,
        weight: str | None = "weight", seed: int = 1) -> dict[tuple, Model]:
    """Models by key for ``specs`` (key -> number of clusters, loadings or None), all fitted in the same passes.

    ``points`` is (archives, weight): distinct itemsets of ``codes``. Every
    model starts from the first k itemsets in hash order and takes ``steps``
    Lloyd steps, or fewer when no centre moves any more. With fewer than k
    itemsets each is a centre.
    """
    codes = list(codes)
    first = seeds(points, max(k for k, _ in specs.values()), codes, weight, seed) if specs else None
    models = {key: Model(key, codes, first[:k].copy(), np.ones(len(first[:k]), dtype=np.int64), loadings)
              for key, (k, loadings) in specs.items()}
    moving = [key for key, m in models.items() if m.k]
    for _ in range(steps):
        if not moving:
            break
        still = []
        for new in lloyd_step(points, [models[key] for key in moving]):
            old = models[new.key]
            if not (np.array_equal(old.sums, new.sums) and np.array_equal(old.sizes, new.sizes)):
                still.append(new.key)
            models[new.key] = new
        moving = still
    return models


def costs(points: DataFrame, models: Sequence[Model]) -> DataFrame:
    """(model, cost): weighted squared distances of all points to their nearest centre, by place in ``models``."""
    out = None
    for group in _groups(models):
        codes = models[group[0]].codes
        forms = points.sparkSession.sparkContext.broadcast([(i, models[i].form(), models[i].loadings) for i in group])

        def run(batches: Iterator[pa.RecordBatch], forms=forms, codes=codes) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(forms.value))
            for part, x, _, _ in _blocks(batches, codes):
                w = part.column("weight").to_numpy().astype(float)
                for j, (_, form, loadings) in enumerate(forms.value):
                    size = x.sum(axis=1) if loadings is None else ((x @ loadings)**2).sum(axis=1)
                    total[j] += (w * np.maximum(_nearest(x, form, loadings is not None)[1] + size, 0.0)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in forms.value], pa.int32()), pa.array(total)],
                                             names=["model", "cost"])

        rows = points.select("archives", "weight").mapInArrow(run, "model int, cost double")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("model").agg(F.sum("cost").alias("cost"))


def assign(points: DataFrame, models: Sequence[Model], keep: Sequence[str] = ("archives", "weight")) -> DataFrame:
    """``keep`` columns of every point and ``labels``: its nearest centre under every model, in order.

    A model of many centres is searched by groups: a point is compared with
    one pivot centre of each group, then, in the order of their distance
    from the best pivot, with those centres alone that can still be nearer
    (a centre twice as far from the pivot as the point is cannot).
    """
    groups = list(_groups(models))
    out, names = points, []
    for number, group in enumerate(groups):
        codes = models[group[0]].codes
        own = [(models[i], Pruned(models[i]) if models[i].k >= PRUNE_FROM else None) for i in group]
        sent = points.sparkSession.sparkContext.broadcast([(m.form(), m.loadings is not None, p) for m, p in own])
        kept, name = out.columns, f"_labels{number}"
        names.append(name)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, codes=codes, kept=kept, name=name) -> Iterator[pa.RecordBatch]:
            for part, x, _, _ in _blocks(batches, codes):
                labels = np.stack([pruned.nearest(x) if pruned else _nearest(x, form, rounded)[0]
                                   for form, rounded, pruned in sent.value], axis=1).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(labels) + 1, dtype=np.int32) * labels.shape[1]),
                                                pa.array(labels.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), flat], names=[*kept, name])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
        out = out.mapInArrow(run, f"{fields}, {name} array<int>")
    return out.select(*keep, F.concat(*names).alias("labels") if names else F.array().cast("array<int>").alias("labels"))


#: Centres from which on a model is searched by groups.
PRUNE_FROM = 64


class Pruned:
    """Nearest centres with pruning by centre-to-centre distances; finds what the full search finds."""

    def __init__(self, model: Model):
        self.form, self.rounded = model.form(), model.loadings is not None
        self.loadings = model.loadings
        centres = model.centres()
        step = max(1, int(np.sqrt(model.k)))
        self.pivots = np.arange(0, model.k, step)
        apart = np.sqrt(np.maximum(((centres[self.pivots, None] - centres[None])**2).sum(axis=2), 0.0))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        #: rows times centres that were compared, and that a full search compares
        self.compared = self.all = 0

    def _distances(self, x: np.ndarray, some: np.ndarray) -> np.ndarray:
        a, const, times, over = self.form
        d = (const[some] - times[some] * (x @ a[:, some])) / over[some]
        return d.round(DIGITS) if self.rounded else d

    def nearest(self, x: np.ndarray) -> np.ndarray:
        size = x.sum(axis=1) if self.loadings is None else ((x @ self.loadings)**2).sum(axis=1)
        to_pivots = self._distances(x, self.pivots)
        pivot = to_pivots.argmin(axis=1)
        radius = np.sqrt(np.maximum(to_pivots[np.arange(len(x)), pivot] + size, 0.0))
        # a centre further than twice the radius from the pivot is further from the point; the slack covers rounding
        reach = 2 * radius * (1 + 1e-9) + 1e-6
        best = np.zeros(len(x), dtype=np.int64)
        self.all += len(x) * len(self.form[1])
        self.compared += len(x) * len(self.pivots)
        order = np.lexsort((reach, pivot))
        for at in range(0, len(order), 64):
            for p in np.unique(pivot[order[at:at + 64]]):
                rows = order[at:at + 64][pivot[order[at:at + 64]] == p]
                some = np.sort(self.order[p, :max(np.searchsorted(self.apart[p], reach[rows].max(), side="right"), 1)])
                best[rows] = some[self._distances(x[rows], some).argmin(axis=1)]
                self.compared += len(rows) * len(some)
        return best


def silhouettes(points: DataFrame, ks: Sequence[int], codes: Sequence) -> DataFrame:
    """(model, score): mean silhouette in the 0/1 space of every clustering in ``labels``.

    ``points`` is (archives, weight, labels); clustering i has the clusters
    0..ks[i]-1. Squared Euclidean, each subject counted (see
    ``clusters.weighted_silhouette``): with the sizes n, the sums of squares
    psi and the code sums Y of the clusters, the summed distances of x to
    cluster c are |x|^2 n + psi - 2 x.Y. One pass sums these, one scores.
    Scores come from per-code arrays of the clusters' sums, so no row holds
    a clustering; the clusterings go out in groups of bounded size.
    """
    codes = list(codes)
    blank = [Model((i,), codes, np.zeros((k, len(codes)), dtype=np.int64), np.ones(k, dtype=np.int64)) for i, k in enumerate(ks)]
    out, width = None, len(codes) + 2
    for group in _groups(blank):
        def totals(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(ks[i] * width) for i in group]
            for part, x, row, code in _blocks(batches, codes):
                w, labels = part.column("weight").to_numpy().astype(float), _labels(part)
                for own, i in zip(sums, group, strict=True):
                    c = labels[:, i]
                    own += np.bincount(c[row] * width + code, weights=w[row], minlength=len(own))
                    own += np.bincount(c * width + width - 2, weights=w, minlength=len(own))
                    own += np.bincount(c * width + width - 1, weights=w * x.sum(axis=1), minlength=len(own))
            for own, i in zip(sums, group, strict=True):
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(own[at].astype(np.int64))],
                                                 names=["model", "at", "n"])

        rows = points.select("archives", "weight", "labels").mapInArrow(totals, "model int, at long, n long").groupBy(
            "model", "at").agg(F.sum("n").alias("n")).toPandas()
        tables = []
        for i in group:
            own, flat = rows[rows["model"] == i], np.zeros(ks[i] * width)
            flat[own["at"].to_numpy(dtype=np.int64)] = own["n"]
            flat = flat.reshape(ks[i], width)
            tables.append((i, np.ascontiguousarray(flat[:, :-2].T), flat[:, -2], flat[:, -1]))
        sent = points.sparkSession.sparkContext.broadcast(tables)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, weights = np.zeros(len(sent.value)), np.zeros(len(sent.value))
            for part, x, _, _ in _blocks(batches, codes):
                w, labels, q, every = part.column("weight").to_numpy().astype(float), _labels(part), x.sum(axis=1), np.arange(len(x))
                for j, (i, y, n, psi) in enumerate(sent.value):
                    s, own = q[:, None] * n + psi - 2 * (x @ y), labels[:, i]
                    a = s[every, own] / np.maximum(n[own] - 1, 1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        mean = np.where(n > 0, s / n, np.inf)
                    mean[every, own] = np.inf
                    b = mean.min(axis=1)
                    top = np.maximum(a, b)
                    good = (n[own] > 1) & np.isfinite(b) & (top > 0)
                    total[j] += (w[good] * (b[good] - a[good]) / top[good]).sum()
                    weights[j] += w.sum()
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in sent.value], pa.int32()), pa.array(total), pa.array(weights)],
                                             names=["model", "total", "weight"])

        rows = points.select("archives", "weight", "labels").mapInArrow(score, "model int, total double, weight double")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("model").agg((F.sum("total") / F.sum("weight")).alias("score"))


def _labels(part: pa.RecordBatch) -> np.ndarray:
    return part.column("labels").flatten().to_numpy().reshape(part.num_rows, -1).astype(np.int64)
