"""Image perturbations on rows of pixels (schemas.PIXELS).

Thresholding is a column expression; the others run NumPy in Arrow batches.
Codecs need Pillow and raise where it is missing.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions.perturb import register


@register("binarization_thresholding")
def threshold(data: Column, threshold: int = 128, **_) -> Column:
    """I4: 255 above the threshold, else 0; data is one grey value a pixel."""
    return F.transform(data, lambda p: F.when(p > threshold, 255).otherwise(0))


def grey(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 luma in the fixed-point form image libraries use."""
    return F.floor((r * 19595 + g * 38470 + b * 7471 + 0x8000) / 65536).cast("int")


def noise(a: np.ndarray, kind: str, intensity: float, seed: int) -> np.ndarray:
    """I5 for one image, seeded."""
    rng = np.random.default_rng(seed)
    if kind == "gaussian":
        return np.clip(a.astype(np.int16) + rng.normal(0, intensity * 128, a.shape).astype(np.int16), 0, 255)
    if kind != "salt_and_pepper":
        raise ValueError(f"unknown noise {kind}")
    u = rng.random(a.shape[:2])
    out = a.copy()
    out[u < intensity / 2] = 0
    out[u > 1 - intensity / 2] = 255
    return out


def gaussian_blur(a: np.ndarray, radius: float) -> np.ndarray:
    """A separable Gaussian of standard deviation ``radius``; edges repeat. Close to, not equal to, box-blur approximations."""
    if radius <= 0:
        return a
    reach = max(1, int(np.ceil(3 * radius)))
    x = np.arange(-reach, reach + 1)
    w = np.exp(-(x**2) / (2 * radius**2))
    w /= w.sum()
    out = a.astype(np.float64)
    for axis in (0, 1):
        pad = [(reach, reach) if i == axis else (0, 0) for i in range(out.ndim)]
        p = np.pad(out, pad, mode="edge")
        out = sum(w[i] * np.take(p, range(i, i + a.shape[axis]), axis=axis) for i in range(len(w)))
    return np.clip(np.rint(out), 0, 255).astype(a.dtype)


KERNELS = {
    "bilinear": (1.0, lambda x: np.maximum(0, 1 - np.abs(x))),
    "bicubic": (2.0, lambda x: np.where(np.abs(x) < 1, 1.5 * np.abs(x) ** 3 - 2.5 * x**2 + 1, np.where(np.abs(x) < 2, -0.5 * np.abs(x) ** 3 + 2.5 * x**2 - 4 * np.abs(x) + 2, 0))),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)),
}


def resize(a: np.ndarray, width: int, height: int, method: str) -> np.ndarray:
    """Separable resampling with a kernel widened for reduction."""
    if method == "nearest":
        rows = ((np.arange(height) + 0.5) * a.shape[0] / height).astype(int)
        cols = ((np.arange(width) + 0.5) * a.shape[1] / width).astype(int)
        return a[rows][:, cols]
    if method not in KERNELS:
        raise ValueError(f"unknown resampling {method}")
    support, kernel = KERNELS[method]
    out = a.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        old = a.shape[axis]
        scale = max(1.0, old / n)
        center = (np.arange(n) + 0.5) * old / n
        at = np.arange(old)
        w = kernel((at[None, :] + 0.5 - center[:, None]) / scale)
        w[np.abs(at[None, :] + 0.5 - center[:, None]) >= support * scale] = 0
        w /= w.sum(1, keepdims=True)
        out = np.moveaxis(np.tensordot(w, out, axes=(1, axis)), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(a.dtype)


def crop(a: np.ndarray, margin_x: int, margin_y: int, width: bool, bottom: bool) -> np.ndarray:
    """Cut at the right of the last column, and under the last row, that differ from the background by more than 5."""
    g = a if a.ndim == 2 else np.floor((a[..., :3].astype(np.int64) @ [19595, 38470, 7471] + 0x8000) / 65536)
    mask = np.abs(g.astype(np.float64) - np.median(g[:2, :2])) > 5
    cols, rows = np.flatnonzero(mask.any(0)), np.flatnonzero(mask.any(1))
    if width and len(cols):
        a = a[:, : min(a.shape[1], cols[-1] + 1 + margin_x)]
    if bottom and len(rows):
        a = a[: min(a.shape[0], rows[-1] + margin_y)]
    return a


def codec(a: np.ndarray, fmt: str, quality: int) -> np.ndarray:
    """Through a lossy format and back."""
    from PIL import Image

    held = io.BytesIO()
    Image.fromarray(a.astype(np.uint8)).save(held, format=fmt.upper(), quality=quality)
    return np.array(Image.open(held))


def _map(images: DataFrame, f) -> DataFrame:
    """``f(array, image_id)`` on every image; an image that fails is passed on with its error and no pixels."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                try:
                    a = np.array(r.data, np.int64).reshape(r.height, r.width, r.channels)
                    a = f(a[..., 0] if r.channels == 1 else a, r.image_id)
                    rows.append((r.image_id, a.shape[0], a.shape[1], r.channels, a.reshape(-1).tolist(), "success", None))
                except Exception as e:  # one bad image must not end the job
                    rows.append((r.image_id, r.height, r.width, r.channels, None, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["image_id", "height", "width", "channels", "data", "status", "error"])

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, schemas.PIXELS + ", status string, error string")


def _seed(image_id: str, seed: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.md5(f"{image_id}|{seed}".encode()).digest()[:8], "big")


def random_noise(images: DataFrame, noise_type: str = "gaussian", intensity: float = 0.1, seed: int = 0) -> DataFrame:
    """Noise seeded by image id."""
    return _map(images, lambda a, i: noise(a, noise_type, intensity, _seed(i, seed)))


def blur(images: DataFrame, radius: float = 0.5, blur_type: str = "gaussian") -> DataFrame:
    """I6."""
    if blur_type != "gaussian":
        raise ValueError(f"unknown blur {blur_type}")
    return _map(images, lambda a, _: gaussian_blur(a, radius))


def resample(images: DataFrame, method: str = "nearest", scale: float = 0.8) -> DataFrame:
    """To int(width * scale) by int(height * scale)."""
    if method != "nearest" and method not in KERNELS:
        raise ValueError(f"unknown resampling {method}")
    return _map(images, lambda a, _: resize(a, int(a.shape[1] * scale), int(a.shape[0] * scale), method))


def upscale(images: DataFrame, low_dpi: float = 72, high_dpi: float = 200, method: str = "bicubic") -> DataFrame:
    """I8: larger by the ratio of the resolutions."""
    return resample(images, method, high_dpi / low_dpi)


def adaptive_crop(images: DataFrame, margin_x: int, margin_y: int, width: bool = True, bottom: bool = True) -> DataFrame:
    """D7 on every image."""
    return _map(images, lambda a, _: crop(a, margin_x, margin_y, width, bottom))


def lossy(images: DataFrame, fmt: str = "jpeg", quality: int = 50) -> DataFrame:
    """I1 to I3; needs Pillow."""
    if fmt not in ("jpeg", "webp"):
        raise ValueError(f"unknown format {fmt}")
    return _map(images, lambda a, _: codec(a, fmt, quality))


def scaled_size(width: Column, height: Column, scale: float) -> Column:
    """The size that resampling gives."""
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))
