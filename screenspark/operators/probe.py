"""Linear probes of genes against control, one well left out at a time, for all genes and wells in one job.

A probe is a row: the gene and the held-out well.  Its training rows are the gene's cells and as many control cells of the other
wells (a hash order decides which); cells are standardised, five penalties are tried in five stratified folds, and
the best by accuracy is fitted to all rows: logistic loss with an elastic net, by accelerated proximal gradient steps
to a fixed tolerance.  Fitted probes are a table; cells of the held-out well are scored by a matrix product per block of probes
and block of cells, so a well's control cells are never in one task with all genes.

Defined results: a gene without cells in the held-out well has no probe there; one without training cells of either class has none
either; constant features weigh nothing; ties between penalties go to the strongest penalty; fewer than
``folds`` rows of a class use as many folds as it has rows, and the strongest penalty below two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .curves import average_precision, roc_auc
from .prefix import row_numbers
from .series import balanced_sample

#: Inverse penalties, from strong to weak.
PENALTIES = tuple(float(c) for c in np.logspace(-4, 4, 5))
FOLDS = 5
L1_SHARE = 0.5
#: Probes and cells of one matrix product.
PROBES, CELLS = 256, 8192


# --- one probe -------------------------------------------------------------------------


def fit_elastic_net(x: np.ndarray, y: np.ndarray, c: float, l1_share: float = L1_SHARE, steps: int = 3000, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise ``c * sum(log loss) + l1_share * |w|_1 + (1 - l1_share) / 2 * |w|^2``."""
    n, d = x.shape
    whole = np.hstack([x, np.ones((n, 1))])
    rate = 1.0 / (c * 0.25 * np.linalg.norm(whole, 2) ** 2 + (1 - l1_share))
    w = np.zeros(d + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(whole @ ahead, -500, 500)))
        slope = c * whole.T @ (p - y)
        slope[:d] += (1 - l1_share) * ahead[:d]
        new = ahead - rate * slope
        new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - rate * l1_share, 0)
        if (ahead - new) @ (new - w) > 0:  # the momentum points uphill
            t = 1.0
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / following * (new - w)
        moved = np.abs(new - w).max()
        w, t = new, following
        if moved < tolerance * max(1.0, np.abs(w).max()):
            break
    return w[:d], float(w[d])


def folds_of(y: np.ndarray, folds: int) -> np.ndarray:
    """Fold of each row: each class is dealt in turn, so every fold has its share of both."""
    out = np.zeros(len(y), dtype=np.int64)
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        out[rows] = np.arange(len(rows)) % folds
    return out


def fit_probe(x: np.ndarray, y: np.ndarray, penalties=PENALTIES, folds: int = FOLDS) -> dict:
    """Standardisation, fold scores per penalty, the chosen penalty, weights and intercept."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - mean) / scale
    k = min(folds, int(np.bincount(y, minlength=2).min()))
    scores = np.zeros(len(penalties))
    if k >= 2:
        fold = folds_of(y, k)
        for j, c in enumerate(penalties):
            hits = []
            for f in range(k):
                w, b = fit_elastic_net(z[fold != f], y[fold != f], c)
                hits.append(np.mean((z[fold == f] @ w + b > 0) == (y[fold == f] == 1)))
            scores[j] = np.mean(hits)
    best = int(np.argmax(scores))
    w, b = fit_elastic_net(z, y, penalties[best])
    return {"mean": mean, "scale": scale, "scores": scores, "penalty": penalties[best], "weights": w, "intercept": b, "n": len(y)}


# --- all probes ------------------------------------------------------------------------

_VECTOR = pa.list_(pa.float64())


def training_rows(cells: DataFrame, control: str, seed: str = "42") -> DataFrame:
    """``gene, split, ID, y, features``: balanced training rows of every gene for every held-out well that holds the gene.

    Control cells have one order per held-out well; a gene takes as many from its start as it has cells, and
    no more cells of its own than there are control cells.
    """
    splits = cells.filter(F.col("gene_id") != control).select(F.col("gene_id").alias("gene"), F.col("plate_well").alias("split")).distinct()
    wells = splits.select("split").distinct()
    hashed = cells.withColumn("h", F.md5(F.concat(F.col("ID").cast("string"), F.lit(seed)).cast("binary")))
    # few rows: genes and wells, not cells
    others = cells.groupBy("gene_id", "plate_well").agg(F.count("*").alias("n"))
    free = others.filter(F.col("gene_id") == control).join(wells, F.col("plate_well") != F.col("split")).groupBy("split").agg(F.sum("n").alias("n_control"))
    own = others.withColumnRenamed("gene_id", "gene").join(splits, "gene").filter("plate_well <> split").groupBy("gene", "split").agg(F.sum("n").alias("n_own"))
    sizes = cut(own.join(free, "split").select("gene", "split", F.least("n_own", "n_control").alias("n")))
    mine = hashed.filter(F.col("gene_id") != control).withColumnRenamed("gene_id", "gene").join(sizes, "gene").filter("plate_well <> split")
    mine = row_numbers(mine, ["gene", "split"], [("h", False), ("ID", False)], "place").filter("place <= n").select("gene", "split", "ID", F.lit(1).alias("y"), "features")
    base = hashed.filter(F.col("gene_id") == control).join(wells, F.col("plate_well") != F.col("split"))
    base = row_numbers(base.select("split", "ID", "h", "features"), ["split"], [("h", False), ("ID", False)], "place")
    base = base.join(sizes, "split").filter("place <= n").select("gene", "split", "ID", F.lit(0).alias("y"), "features")
    return mine.unionByName(base)


_MODEL = "gene string, split string, n long, penalty double, scores array<double>, mean array<double>, scale array<double>, weights array<double>, intercept double"
_MODEL_TYPES = pa.schema([("gene", pa.string()), ("split", pa.string()), ("n", pa.int64()), ("penalty", pa.float64()), ("scores", _VECTOR), ("mean", _VECTOR), ("scale", _VECTOR), ("weights", _VECTOR), ("intercept", pa.float64())])


def _fit(table: pa.Table) -> pa.Table:
    order = np.argsort(np.array(table.column("ID").to_pylist(), dtype=object), kind="stable")  # the result does not depend on the order of rows
    x = np.array(table.column("features").to_pylist(), dtype=np.float64)[order]
    found = fit_probe(x, table.column("y").to_numpy().astype(np.int64)[order])
    row = [table.column("gene")[0].as_py(), table.column("split")[0].as_py(), found["n"], found["penalty"], *(found[k].tolist() for k in ("scores", "mean", "scale", "weights")), found["intercept"]]
    return pa.table([pa.array([v], f.type) for v, f in zip(row, _MODEL_TYPES, strict=True)], schema=_MODEL_TYPES)


def fit_probes(cells: DataFrame, control: str, seed: str = "42") -> DataFrame:
    """A row per gene and held-out well: the fitted probe.  ``cells`` is ``ID, gene_id, plate_well, features``."""
    return training_rows(cells, control, seed).groupBy("gene", "split").applyInArrow(_fit, _MODEL)


def _score(probes: pa.Table, cells: pa.Table) -> pa.Table:
    out = [[], [], [], [], []]
    if probes.num_rows and cells.num_rows:
        mean, scale, weights = (np.array(probes.column(k).to_pylist(), dtype=np.float64) for k in ("mean", "scale", "weights"))
        w = weights / scale
        shift = np.array(probes.column("intercept").to_pylist()) - (w * mean).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(np.array(cells.column("features").to_pylist(), dtype=np.float64) @ w.T + shift, -500, 500)))
        genes, owners, ids = probes.column("gene").to_pylist(), cells.column("gene_id").to_pylist(), cells.column("ID").to_pylist()
        split, control = cells.column("split")[0].as_py(), cells.column("control")[0].as_py()
        for j, gene in enumerate(genes):
            rows = [i for i, owner in enumerate(owners) if owner in (gene, control)]
            out[0] += [gene] * len(rows)
            out[1] += [split] * len(rows)
            out[2] += [ids[i] for i in rows]
            out[3] += [owners[i] == gene for i in rows]
            out[4] += p[rows, j].tolist()
    return pa.table([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64()), strict=True)], names=["gene", "split", "ID", "y", "score"])


def score_held_out(cells: DataFrame, probes: DataFrame, control: str) -> DataFrame:
    """``gene, split, ID, y, score``: the probability that a cell of the held-out well is one of the gene's, for its own cells and control."""
    n_probes, n_cells = max(1, -(-probes.count() // PROBES)), max(1, -(-cells.count() // CELLS))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = probes.withColumn("i", block("gene", n_probes)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
    right = cells.select("ID", "gene_id", F.col("plate_well").alias("split"), "features").withColumn("j", block("ID", n_cells)).withColumn("control", F.lit(control))
    # a gene's cells meet the block of its own probe, control cells every block
    every = F.sequence(F.lit(0), F.lit(n_probes - 1))
    right = right.withColumn("i", F.explode(F.when(F.col("gene_id") == control, every).otherwise(F.array(block("gene_id", n_probes)))))
    return left.groupBy("split", "i", "j").cogroup(right.groupBy("split", "i", "j")).applyInArrow(_score, "gene string, split string, ID string, y boolean, score double")


def probe_metrics(scores: DataFrame, seed: str = "42") -> DataFrame:
    """``gene, split, rows``, accuracy, area under the ROC curve and average precision per probe on balanced (``sampled``) and all cells of its held-out well."""
    keys = ["gene", "split"]
    every = scores.withColumn("kind", F.lit("all"))
    sampled = balanced_sample(scores, keys, "y", "ID", seed).withColumn("kind", F.lit("sampled"))
    both = cut(every.unionByName(sampled).withColumn("y", F.col("y").cast("int")))
    keys = [*keys, "kind"]
    right = (F.col("score") > 0.5) == (F.col("y") == 1)
    plain = both.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(right.cast("int")).alias("accuracy"))
    return plain.join(roc_auc(both, keys), keys).join(average_precision(both, keys), keys)
