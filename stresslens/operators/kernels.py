"""Pixel kernels in numpy, and the one Arrow function that runs them; rasters are height x width x 3, uint8.

JPEG codecs and perceptual hashes of other libraries can't be matched to the bit here: re-encoding is our own
8x8 cosine quantisation, the hash our own cosine hash, and both are told apart by name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.operators.grid import CONDITIONS

#: The luminance and chrominance tables of the baseline JPEG standard (annex K), row by row.
LUMA_TABLE = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMA_TABLE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66) + (99,) * 38
#: Rec. 601.
LUMA = np.array([0.299, 0.587, 0.114])


class TransformError(ValueError):
    """A raster or a condition that can't be handled."""


def to_uint8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * 255), 0, 255).astype(np.uint8)


def dimension(n: float) -> int:
    return max(1, int(np.rint(n)))


def center_crop(x: np.ndarray, keep: float) -> np.ndarray:
    h, w = x.shape[:2]
    a, b = dimension(h * keep), dimension(w * keep)
    top, left = (h - a) // 2, (w - b) // 2
    return x[top : top + a, left : left + b]


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of 2 * ceil(3 sigma) + 1 taps, no wider than reflection allows."""
    h, w = x.shape[:2]
    f = x.astype(np.float64)
    for axis, n in ((0, h), (1, w)):
        k = min(2 * math.ceil(3 * sigma) + 1, 2 * min(h, w) - 1)
        r = k // 2
        if r == 0 or n == 1:
            continue
        t = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
        t /= t.sum()
        padded = np.pad(f, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="reflect")
        f = sliding_window_view(padded, k, axis=axis) @ t
    return to_uint8(f / 255)


def _resample(n: int, m: int) -> np.ndarray:
    """Bilinear weights from n to m samples; going down the triangle is as wide as the step."""
    scale = n / m
    support = max(scale, 1.0)
    at = (np.arange(m) + 0.5) * scale - 0.5
    d = np.abs(np.arange(n)[None, :] - at[:, None]) / support
    w = np.maximum(0, 1 - d)
    return w / w.sum(1, keepdims=True)


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    f = np.tensordot(_resample(x.shape[0], h), x.astype(np.float64), (1, 0))
    return np.moveaxis(np.tensordot(_resample(x.shape[1], w), f, (1, 1)), 0, 1)


def down_up(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = x.shape[:2]
    small = resize(x, dimension(h * scale), dimension(w * scale))
    return to_uint8(resize(small, h, w) / 255)


def noise_seed(sha256: str, condition: str) -> int:
    return int(hashlib.sha256(f"{sha256}:{condition}".encode()).hexdigest()[:16], 16)


def noise(x: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    drawn = np.random.Generator(np.random.PCG64(seed)).normal(0.0, sigma, (3, *x.shape[:2]))
    f = np.moveaxis(x, 2, 0).astype(np.float32) / np.float32(255) + drawn.astype(np.float32)
    return to_uint8(np.moveaxis(np.clip(f, 0, 1), 0, 2))


def colour(x: np.ndarray, kind: str, factor: float) -> np.ndarray:
    """Blend with black, with the mean grey, or with the grey image."""
    f = x.astype(np.float64) / 255
    grey = f @ LUMA
    other = {"bright": np.zeros_like(f), "contrast": np.full_like(f, grey.mean()), "saturation": np.repeat(grey[:, :, None], 3, 2)}[kind]
    return to_uint8(np.clip(factor * f + (1 - factor) * other, 0, 1))


def _dct() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    d = np.cos((2 * n + 1) * k * math.pi / 16) / 2
    d[0] /= math.sqrt(2)
    return d


def requantise(x: np.ndarray, quality: int) -> np.ndarray:
    """What a JPEG of a quality, chroma halved, does to the pixels: cosine blocks, scaled tables, and back."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    h, w = x.shape[:2]
    f = np.pad(x.astype(np.float64), [(0, -h % 16), (0, -w % 16), (0, 0)], mode="edge")
    y = f @ LUMA
    planes = [y, 0.5 * (f[:, :, 2] - y) / (1 - 0.114), 0.5 * (f[:, :, 0] - y) / (1 - 0.299)]
    d, out = _dct(), []
    for i, p in enumerate(planes):
        table = np.clip(np.floor((np.array(CHROMA_TABLE if i else LUMA_TABLE).reshape(8, 8) * scale + 50) / 100), 1, 255)
        p = p.reshape(p.shape[0] // 2, 2, -1, 2).mean((1, 3)) if i else p - 128
        b = p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        b = d.T @ (np.rint(d @ b @ d.T / table) * table) @ d
        p = b.transpose(0, 2, 1, 3).reshape(p.shape)
        out.append(np.repeat(np.repeat(p, 2, 0), 2, 1) if i else p + 128)
    y, cb, cr = out
    r, b = y + 2 * (1 - 0.299) * cr, y + 2 * (1 - 0.114) * cb
    g = (y - 0.299 * r - 0.114 * b) / 0.587
    return np.clip(np.rint(np.stack([r, g, b], 2)), 0, 255).astype(np.uint8)[:h, :w]


def apply(x: np.ndarray, condition: str, sha256: str = "") -> np.ndarray:
    """A raster under a condition."""
    if x.ndim != 3 or x.shape[2] != 3 or x.dtype != np.uint8:
        raise TransformError("a raster is height x width x 3 of uint8")
    known = {c: (f, p) for c, f, p in CONDITIONS}
    if condition not in known:
        raise TransformError(f"unknown condition {condition}")
    family, p = known[condition]
    kernels: dict[str, Callable[[], np.ndarray]] = {
        "clean": lambda: x.copy(),
        "jpeg": lambda: requantise(x, int(p)),
        "blur": lambda: blur(x, p),
        "resize": lambda: down_up(x, p),
        "noise": lambda: noise(x, p, noise_seed(sha256, condition)),
        "color": lambda: colour(x, condition.split("_")[0], p),
        "crop": lambda: center_crop(x, p),
    }
    return kernels[family]()


#: Mild probes, scored beside the image itself.
PROBES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "probe_jpeg_q92": lambda x: requantise(x, 92),
    "probe_crop_0.96": lambda x: center_crop(x, 0.96),
    "probe_resize_0.90": lambda x: down_up(x, 0.90),
}


def luma(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ LUMA / 255


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return np.einsum("ijkl,kl->ij", sliding_window_view(x, kernel.shape), kernel)


def blur_varlap(y: np.ndarray) -> float:
    if min(y.shape) < 3:
        return 0.0
    return float(convolve(y, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)).var())


def blockiness(y: np.ndarray) -> float:
    """Steps across the 8-pixel grid over the other steps."""
    if min(y.shape) < 17:
        return 0.0
    on, off = [], []
    for d in (np.abs(np.diff(y, axis=1)), np.abs(np.diff(y, axis=0)).T):
        edge = np.arange(d.shape[1]) % 8 == 7
        on.append(d[:, edge].ravel())
        off.append(d[:, ~edge].ravel())
    rest = np.concatenate(off).mean()
    return float(np.concatenate(on).mean() / rest) if rest > 1e-12 else 0.0


def noise_sigma(y: np.ndarray) -> float:
    if min(y.shape) < 3:
        return 0.0
    mask = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]], float)
    return float(np.median(np.abs(convolve(y, mask))) / 0.6745 / 6)


def quality(x: np.ndarray) -> dict[str, float]:
    """The numbers of a raster's quality block."""
    h, w = x.shape[:2]
    y = luma(x)
    high, low = x.max(2).astype(float), x.min(2).astype(float)
    saturation = np.where(high > 0, (high - low) / np.maximum(high, 1), 0.0)
    return {
        "width": w,
        "height": h,
        "megapixels": w * h / 1e6,
        "aspect_ratio": w / h,
        "is_portrait": h > w,
        "blur_varlap": blur_varlap(y),
        "blockiness": blockiness(y),
        "noise_sigma": noise_sigma(y),
        "luminance_mean": float(y.mean()),
        "luminance_std": float(y.std()),
        "saturation_mean": float(saturation.mean()),
        "clipped_low_frac": float((x == 0).all(axis=2).mean()),
        "clipped_high_frac": float((x == 255).all(axis=2).mean()),
    }


def cosine_hash(x: np.ndarray) -> str:
    """64 bits of the low cosine coefficients of the grey image at 32 x 32, above their median; our own, as 16 hex digits."""
    y = resize(x, 32, 32) @ LUMA
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    d = np.cos((2 * n + 1) * k * math.pi / 64)
    low = (d @ y @ d.T)[:8, :8]
    return np.packbits(low.ravel() > np.median(low)).tobytes().hex()


def occlusion(x: np.ndarray, score: Callable[[np.ndarray], float], cells: int = 4) -> np.ndarray:
    """How much the score falls when a cell is filled with the mean."""
    base, mean = score(x), np.rint(x.reshape(-1, 3).mean(0)).astype(np.uint8)
    out = np.zeros((cells, cells))
    rows, cols = (np.linspace(0, n, cells + 1).astype(int) for n in x.shape[:2])
    for i in range(cells):
        for j in range(cells):
            y = x.copy()
            y[rows[i] : rows[i + 1], cols[j] : cols[j + 1]] = mean
            out[i, j] = base - score(y)
    return out


#: Rasters of a task, about, whose views are made there: some seconds of work.
TASK = 128

_VIEW = "rel_path string, condition_id string, sha256 string, view_sha256 string, height int, width int, data binary, quality map<string,double>, phash string, error string"


def views(rasters: DataFrame) -> DataFrame:
    """Each raster (rel_path, sha256, height, width, data, error) under each condition_id it comes with.

    A raster that can't be read or transformed gives a row with an error and no numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rel_path", pa.string()), ("condition_id", pa.string()), ("sha256", pa.string()), ("view_sha256", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary()), ("quality", pa.map_(pa.string(), pa.float64())), ("phash", pa.string()), ("error", pa.string())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = {"rel_path": r["rel_path"], "condition_id": r["condition_id"], "sha256": r["sha256"], "error": r["error"]}
                if not row["error"]:
                    try:
                        x = apply(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3), r["condition_id"], r["sha256"])
                        row |= {"view_sha256": hashlib.sha256(x.tobytes()).hexdigest(), "height": x.shape[0], "width": x.shape[1], "data": x.tobytes(), "quality": [(k, float(v)) for k, v in quality(x).items()], "phash": cosine_hash(x)}
                    except (TransformError, ValueError, TypeError) as e:
                        row["error"] = str(e) or type(e).__name__
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    return rasters.select("rel_path", "condition_id", "sha256", F.col("height").cast("int"), F.col("width").cast("int"), "data", "error").mapInArrow(run, _VIEW)
