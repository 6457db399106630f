"""Kernels on one image: arrays of height x width x 4 bytes. Each returns a new array; alpha is kept."""

from __future__ import annotations

import numpy as np


def luma(image: np.ndarray) -> np.ndarray:
    rgb = image.astype(np.float64)
    return 0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]


def gray(image: np.ndarray) -> np.ndarray:
    return np.floor(luma(image) + 0.5)


def _with(image: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., :3] = np.rint(np.clip(value, 0, 255)).astype(np.uint8)[..., None]
    return out


def grayscale(image):
    return _with(image, gray(image))


def posterize(image, levels: int):
    step = 255 / (levels - 1)
    return _with(image, np.floor(gray(image) / step + 0.5) * step)


def threshold(image, t: float = 160):
    return _with(image, np.where(gray(image) > t, 255, 0))


def quantize_bw(image):
    out = threshold(image, 160)
    out[..., 3] = 255
    return out


def otsu_threshold(image, default: int = 128) -> int:
    n = np.bincount(gray(image).astype(np.int64).ravel(), minlength=256)
    below = np.cumsum(n)
    above, weighted = below[-1] - below, np.cumsum(n * np.arange(256)).astype(float)
    at = (below > 0) & (above > 0)
    apart = weighted[at] / below[at] - (weighted[-1] - weighted[at]) / above[at]
    variance = np.zeros(256)
    variance[at] = below[at].astype(float) * above[at] * apart * apart
    return int(variance.argmax()) if variance.max() > 0 else default


def otsu(image, default: int = 128):
    return threshold(image, otsu_threshold(image, default))


def box_mean(values: np.ndarray, half: int) -> np.ndarray:
    """Means over boxes cut off at the edges, from an integral image."""
    h, w = values.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = values.cumsum(0).cumsum(1)
    y1, y2 = np.maximum(0, np.arange(h) - half), np.minimum(h, np.arange(h) + half + 1)
    x1, x2 = np.maximum(0, np.arange(w) - half), np.minimum(w, np.arange(w) + half + 1)
    sums = total[y2][:, x2] - total[y1][:, x2] - total[y2][:, x1] + total[y1][:, x1]
    return sums / np.outer(y2 - y1, x2 - x1)


def adaptive_box(image, block_size: int = 15, c: float = 10):
    values = gray(image)
    return _with(image, np.where(values > box_mean(values, block_size // 2) - c, 255, 0))


def preview_block(width_px: int, width_pts: float) -> tuple[int, int]:
    """Block size and offset of a preview, scaled from 31 and 10 at 300 dots an inch."""
    scale = width_px / (width_pts / 72 * 300)
    block = max(3, int(np.floor(31 * scale + 0.5)))
    return block + (block % 2 == 0), max(2, int(np.floor(10 * scale + 0.5)))


def adaptive_preview(image, width_pts: float):
    return adaptive_box(image, *preview_block(image.shape[1], width_pts))


def bw_options(width: int, height: int) -> tuple[int, int]:
    """Block size (15 to 75, odd) and offset (6 to 20) that the smaller side implies."""
    odd = lambda v: 3 if v < 3 else v + (v % 2 == 0)
    block = odd(min(max(odd(int(np.floor(min(width, height) / 50 + 0.5))), 15), 75))
    return block, min(max(int(np.floor(block * 0.2 + 0.5)), 6), 20)


def _blurred(values: np.ndarray, weights: np.ndarray, edge: str) -> np.ndarray:
    """A separable filter. edge: replicate the border, or normalise by the weights that lie inside."""
    half = len(weights) // 2

    def along(a, axis):
        pad = [(half, half) if i == axis else (0, 0) for i in range(2)]
        padded = np.pad(a, pad, mode="edge" if edge == "replicate" else "constant")
        out = np.zeros(a.shape)
        for i, w in enumerate(weights):
            out += w * np.take(padded, range(i, i + a.shape[axis]), axis)
        return out

    out = along(along(values, 1), 0)
    if edge == "normalise":
        inside = np.ones(values.shape)
        out /= along(along(inside, 1), 0)
    return out


def gaussian(sigma: float, half: int) -> np.ndarray:
    x = np.arange(-half, half + 1)
    w = np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def adaptive_gaussian(image, block_size: int | None = None, c: int | None = None):
    """Above the Gaussian mean of a block less c; borders repeat, sigma follows from the block."""
    block, offset = bw_options(image.shape[1], image.shape[0])
    block, offset = block_size or block, offset if c is None else c
    values = gray(image)
    mean = _blurred(values, gaussian(0.3 * ((block - 1) / 2 - 1) + 0.8, block // 2), "replicate")
    return _with(image, np.where(values > np.floor(mean + 0.5) - offset, 255, 0))


def blur(image, radius: float = 0.4):
    """Gaussian of sigma `radius` on each channel, by the weights inside the image."""
    half = max(1, int(np.ceil(3 * radius)))
    out = image.copy()
    for i in range(3):
        out[..., i] = np.rint(np.clip(_blurred(image[..., i].astype(float), gaussian(radius, half), "normalise"), 0, 255))
    return out


def remove_shading(image, radius: float = 20, strength: float = 1.2):
    """High-pass: what differs from the blurred image, on white."""
    blurred = blur(image, radius)
    return _with(image, 255 + (luma(image) - luma(blurred)) * strength)


def remove_shading_preview(image, width_pts: float):
    scale = image.shape[1] / (width_pts / 72 * 300)
    return remove_shading(image, max(2, int(np.floor(20 * scale + 0.5))))


def contrast(image, preview: bool = False):
    values = luma(image)
    low, span = values.min(), values.max() - values.min()
    if span > 0:
        return _with(image, (values - low) / span * 255)
    return image.copy() if preview else _with(image, values)


def rotate90(image):
    return np.ascontiguousarray(np.rot90(image, -1))


def crop_half(image, side: str):
    cut = image.shape[1] // 2
    return np.ascontiguousarray(image[:, :cut] if side == "left" else image[:, cut:])


def scaled(image, width: int, height: int, fill_white: bool = False, smooth: bool = True):
    """Resampled: by areas when smooth, else by nearest pixels. fill_white puts it on white."""
    h, w = image.shape[:2]
    if (w, h) != (width, height):
        if smooth:

            def weights(n, m):
                edges = np.linspace(0, n, m + 1)
                lows, highs = edges[:-1, None], edges[1:, None]
                share = np.clip(np.minimum(highs, np.arange(1, n + 1)) - np.maximum(lows, np.arange(n)), 0, None)
                return share / share.sum(1, keepdims=True)

            values = np.einsum("yh,hwc,xw->yxc", weights(h, height), image.astype(float), weights(w, width), optimize=True)
            image = np.rint(values).astype(np.uint8)
        else:
            image = image[np.arange(height) * h // height][:, np.arange(width) * w // width]
    out = image.copy()
    if fill_white:
        alpha = out[..., 3:].astype(float) / 255
        out[..., :3] = np.rint(out[..., :3] * alpha + 255 * (1 - alpha))
        out[..., 3] = 255
    return out


def apply_mode(image, mode: str):
    if mode == "gray":
        return grayscale(image)
    if mode == "bw":
        return adaptive_gaussian(image)
    if mode == "bw-otsu":
        return otsu(image)
    return image.copy()


def packed_bits(image, above: int = 127) -> np.ndarray:
    """height x ceil(width / 8) bytes: the leftmost pixel in the highest bit, set where red > above."""
    return np.packbits(image[..., 0] > above, axis=1)
