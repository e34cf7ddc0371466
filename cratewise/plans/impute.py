"""Features of songs without audio data: one ridge regression per axis, fit on distributed sums."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions.features import clamp
from cratewise.functions.text import hash_bucket
from cratewise.operators.aggregates import leave_one_out, pivot_weights

LAMBDAS = (0.1, 1.0, 10.0, 100.0)
SPLITS = {"train": 0, "val": 1, "test": 2, "artist_test": 3, "target": 4}
LANGUAGE_KEYS = ("lang_en", "lang_he", "lang_fr", "lang_es", "lang_other", "none", "unknown")


def split_code(target: Column, labelled: Column, artist_gid: Column, gid: Column) -> Column:
    """Stable split: targets, −1 without a label, held-out artists (5 %), test (5 %), validation (5 %), train."""
    bucket = hash_bucket(gid, 20)
    return (
        F.when(target, SPLITS["target"]).when(~labelled, -1)
        .when(hash_bucket(artist_gid, 20) == 0, SPLITS["artist_test"])
        .when(bucket == 0, SPLITS["test"]).when(bucket == 1, SPLITS["val"]).otherwise(SPLITS["train"])
    )


def linear(intercept: float, weights: dict[str, float]) -> Column:
    return reduce(add, [F.lit(w) * F.col(n) for n, w in weights.items()], F.lit(intercept))


def base_rows(cand: DataFrame, labels: DataFrame, targets: DataFrame, dims: list[str]) -> DataFrame:
    """Candidates that are labelled or to be predicted, with labels ``y_<dim>`` and their split.

    ``labels``: song plus one column per dim. ``targets``: song.
    """
    y = labels.select("song", *[F.col(d).alias(f"y_{d}") for d in dims], F.lit(True).alias("has_y"))
    t = targets.select("song", F.lit(True).alias("target")).distinct()
    rows = cand.join(y, "song", "left").join(t, "song", "left").na.fill(False, ["has_y", "target"])
    rows = rows.where("has_y or target").withColumn(
        "split", split_code(F.col("target"), F.col("has_y"), F.col("first_artist_gid"), F.col("gid"))
    )
    return rows.withColumns({"held": hash_bucket(F.col("first_artist_gid"), 20) == 0, "ll": F.log1p("proxy_listeners")})


def design_matrix(
    base: DataFrame, weights: DataFrame, clusters: list[str], decades: list[str], dims: list[str]
) -> tuple[DataFrame, list[str]]:
    """Wide rows and the shared feature names: cluster weights, one-hots, scaled listens, leave-one-out means."""
    train = base.where(F.col("split") == SPLITS["train"])
    mu = train.agg(*[F.avg(f"y_{d}").alias(d) for d in dims], F.avg("ll").alias("ll"), F.stddev_pop("ll").alias("sd")).first()
    names = {k: f"w_{k}" for k in clusters}
    wide = pivot_weights(weights, "song", "cluster", clusters, "w").withColumnsRenamed(names)
    rows = base.join(wide, "song", "left").na.fill(0.0, list(names.values()))
    hot = {f"d_{d}": F.coalesce((F.col("decade") == d).cast("double"), F.lit(0.0)) for d in decades}
    hot["d_unknown"] = F.col("decade").isNull().cast("double")
    hot |= {f"l_{k}": (F.col("language") == k).cast("double") for k in LANGUAGE_KEYS}
    hot["loglisten"] = (F.col("ll") - F.lit(mu["ll"] or 0.0)) / F.lit(mu["sd"] or 1.0)
    rows = rows.withColumns(hot)
    centres = {d: float(mu[d] or 0.0) for d in dims}
    ys = {d: f"y_{d}" for d in dims}
    rows = leave_one_out(rows, "first_artist", "has_y", ys, "held", centres, "art")
    rows = leave_one_out(rows, "release_group", "has_y", ys, "held", centres, "rg")
    return rows, [*names.values(), *hot]


def _columns(shared: list[str], d: str) -> list[str]:
    return [*shared, f"art_{d}", "has_art", f"rg_{d}", "has_rg"]


def _matrix(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), pdf[columns].to_numpy(dtype=float)])


def gram_sums(rows: DataFrame, shared: list[str], dims: list[str]) -> DataFrame:
    """(dim, i, j, value) of XᵀX, with Xᵀy in column p: every task adds up its rows, Spark adds the tasks."""

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for d in dims:
                part = pdf[pdf[f"y_{d}"].notna()]
                if part.empty:
                    continue
                x = _matrix(part, _columns(shared, d))
                y = part[f"y_{d}"].to_numpy(dtype=float)
                total[d] = total.get(d, 0) + np.column_stack([x.T @ x, x.T @ y])
        for d, m in total.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"dim": d, "i": i.ravel(), "j": j.ravel(), "value": m.ravel()})

    parts = rows.mapInPandas(partial, "dim string, i int, j int, value double")
    return parts.groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))


def solve(gram: pd.DataFrame, penalty: float) -> np.ndarray:
    """Ridge coefficients of one axis from its summed equations (p × p, p below a hundred)."""
    p = int(gram["i"].max()) + 1
    m = np.zeros((p, p + 1))
    m[gram["i"], gram["j"]] = gram["value"]
    keep = np.eye(p)
    keep[0, 0] = 0.0  # the intercept is not shrunk
    # A column never seen has a zero row: a tiny ridge keeps its coefficient at zero.
    return np.linalg.solve(m[:, :p] + penalty * keep + 1e-12 * np.eye(p), m[:, p])


def fit(rows: DataFrame, shared: list[str], dims: list[str]) -> dict[str, dict]:
    """Per axis: chosen penalty and coefficients. Penalties compete on validation error."""
    train = rows.where(F.col("split") == SPLITS["train"])
    needed = sorted({c for d in dims for c in (f"y_{d}", *_columns(shared, d))})
    sums = gram_sums(train.select(needed), shared, dims).toPandas()  # dims × p × (p + 1) numbers
    betas = {d: [solve(g, lam) for lam in LAMBDAS] for d, g in sums.groupby("dim")}

    def errors(batches):
        for pdf in batches:
            out = []
            for d, options in betas.items():
                part = pdf[pdf[f"y_{d}"].notna()]
                if part.empty:
                    continue
                x, y = _matrix(part, _columns(shared, d)), part[f"y_{d}"].to_numpy(dtype=float)
                for k, beta in enumerate(options):
                    out.append((d, k, float(np.abs(np.clip(x @ beta, -1, 1) - y).sum())))
            yield pd.DataFrame(out, columns=["dim", "k", "err"])

    val = rows.where(F.col("split") == SPLITS["val"]).select(needed)
    scored = val.mapInPandas(errors, "dim string, k int, err double").groupBy("dim", "k").agg(F.sum("err").alias("err"))
    best = {row["dim"]: row["k"] for row in scored.groupBy("dim").agg(F.min_by("k", F.struct("err", "k")).alias("k")).collect()}
    means = train.agg(*[F.avg(f"y_{d}").alias(d) for d in dims]).first()
    model = {}
    for d in betas:
        k = best.get(d, 0)
        names = _columns(shared, d)
        model[d] = {
            "lambda": LAMBDAS[k], "mean": float(means[d] or 0.0), "intercept": float(betas[d][k][0]),
            "weights": dict(zip(names, map(float, betas[d][k][1:]))),
        }
    return model


def predict(rows: DataFrame, model: dict[str, dict]) -> DataFrame:
    """(song, model_has_artist, one column per axis) for the target rows."""
    targets = rows.where(F.col("split") == SPLITS["target"])
    cols = [clamp(linear(m["intercept"], m["weights"])).alias(d) for d, m in model.items()]
    return targets.select("song", F.col("has_art").alias("model_has_artist"), *cols)


def holdout_report(rows: DataFrame, model: dict[str, dict]) -> DataFrame:
    """(dim, split, decade, n, mae, baseline): errors of model and training mean; decade null = whole split."""
    held = rows.where(F.col("split").isin(SPLITS["test"], SPLITS["artist_test"]))
    errors = [
        F.struct(
            F.lit(d).alias("dim"), F.abs(clamp(linear(m["intercept"], m["weights"])) - F.col(f"y_{d}")).alias("e"),
            F.abs(F.lit(m["mean"]) - F.col(f"y_{d}")).alias("b"),
        ) for d, m in model.items()
    ]
    long = held.select("split", "decade", F.inline(F.array(*errors))).where("e is not null")
    measures = [F.count("*").alias("n"), F.avg("e").alias("mae"), F.avg("b").alias("baseline")]
    whole = long.groupBy("dim", "split").agg(*measures).withColumn("decade", F.lit(None).cast("string"))
    parts = long.where(F.col("split") == SPLITS["test"]).groupBy("dim", "split", F.coalesce("decade", F.lit("unknown")).alias("decade")).agg(*measures)
    return whole.unionByName(parts)
