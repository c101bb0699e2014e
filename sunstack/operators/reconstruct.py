"""Kernels over frames: one image at a time in Arrow batches, whole patches as groups dealt by patch.

Image kernels are pure maps (no shuffle). A patch's frames are the one unit that must
meet in a task: a burst's frames cut to the patch, whatever their number."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import restore


def map_images(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], h: int, w: int, column: str = "px") -> DataFrame:
    """Replace each image by kernel(image), vector by vector of an Arrow batch; a null image stays null."""
    @F.pandas_udf("array<double>")
    def run(px: pd.Series) -> pd.Series:
        return px.map(lambda v: None if v is None else np.asarray(kernel(np.asarray(v, float).reshape(h, w))).ravel())

    return frames.withColumn(column, run(F.col(column)))


def measure_images(frames: DataFrame, kernel: Callable[[np.ndarray], float], h: int, w: int, out: str, column: str = "px") -> DataFrame:
    """A number for each image."""
    @F.pandas_udf("double")
    def run(px: pd.Series) -> pd.Series:
        return px.map(lambda v: None if v is None else float(kernel(np.asarray(v, float).reshape(h, w))))

    return frames.withColumn(out, run(F.col(column)))


def map_pairs(pairs: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], list[float]], h: int, w: int, a: str, b: str) -> Column:
    """Numbers for each pair of images, such as a shift or a map."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else list(map(float, kernel(np.asarray(p, float).reshape(h, w), np.asarray(q, float).reshape(h, w)))) for p, q in zip(x, y, strict=True)])

    return run(F.col(a), F.col(b))


RESULT = "patch_id int, object int, img array<double>, psf array<double>, alpha array<double>, metric double, metrics array<double>, n_frames int, status string"


def restore_patches(cutouts: DataFrame, optics: restore.Optics, n_modes: int) -> DataFrame:
    """Fit wavefronts and deconvolve every patch; optics are broadcast. cutouts: patch_id, object, wavefront, frame_no, px.

    A patch whose fit fails comes back as one row with its status instead of stopping the job."""
    shared = cutouts.sparkSession.sparkContext.broadcast(optics)
    n = optics.n

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pid = int(pdf["patch_id"].iloc[0])
        blank = lambda why: pd.DataFrame([(pid, None, None, None, None, None, None, len(pdf), why)], columns=[c.split()[0] for c in RESULT.split(", ")])
        pdf = pdf.sort_values(["object", "wavefront", "frame_no"])
        images = np.stack([np.asarray(p, float).reshape(n, n) for p in pdf["px"]])
        patch = restore.Patch(shared.value, images, pdf["object"].to_numpy(), pdf["wavefront"].to_numpy())
        try:
            alpha, history = restore.solve(patch, n_modes)
        except (FloatingPointError, np.linalg.LinAlgError) as e:
            return blank(f"failed: {e}")
        rows = []
        for k in np.unique(patch.objects):
            own = patch.phases(alpha)[patch.objects == k]
            rows.append((pid, int(k), patch.restore(alpha, k).ravel(), np.mean([restore.psf(shared.value, p) for p in own], axis=0).ravel(), alpha.ravel(), history[-1], history, len(pdf), "ok"))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return cutouts.groupBy("patch_id").applyInPandas(solve, RESULT)
