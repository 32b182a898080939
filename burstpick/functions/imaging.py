"""Pixels in numpy: gray, sharpness, noise, resizing, tensors, perceptual hash, JPEG headers. One image at a time."""

from __future__ import annotations

import numpy as np

#: Luma weights of red, green, blue (sum 10,000), patch side, scale of the median deviation, floor.
LUMA, LUMA_SUM = (2126, 7152, 722), 10_000
PATCH, MAD_SCALE, NOISE_FLOOR = 16, 1.4826, 0.1
PAD_VALUE = 114
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def jpeg_size(data: bytes | None) -> tuple[int, int]:
    """Width and height from the frame header; (0, 0) where there is none."""
    if not data or data[:2] != b"\xff\xd8":
        return 0, 0
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return 0, 0
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 0, 0


def to_gray(rgb: np.ndarray) -> np.ndarray:
    """8-bit luma of an RGB image, cut to an integer."""
    return (rgb[..., :3].astype(np.uint32) @ np.array(LUMA, np.uint32) // LUMA_SUM).astype(np.uint8)


def variance_of_laplacian(gray: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian over the pixels that have four neighbours."""
    if min(gray.shape) < 3:
        return 0.0
    g = gray.astype(np.float64)
    x = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float((x * x).mean() - x.mean() ** 2)


def estimate_noise(gray: np.ndarray) -> float:
    """Of the flattest patch, the scaled median deviation from its median. Patches that end at the last row or column
    are left out; without a patch 1.0."""
    rows, cols = (max(0, -(-(side - PATCH) // PATCH)) for side in gray.shape)
    if not rows or not cols:
        return 1.0
    tiles = gray[: rows * PATCH, : cols * PATCH].astype(np.float64).reshape(rows, PATCH, cols, PATCH)
    tiles = tiles.transpose(0, 2, 1, 3).reshape(rows * cols, PATCH * PATCH)
    flat = tiles[int(tiles.std(axis=1).argmin())]
    return max(MAD_SCALE * float(np.median(np.abs(flat - np.median(flat)))), NOISE_FLOOR)


def crop_sharpness(gray: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[float, float, float]:
    """Score, variance and noise: the variance of the crop over the noise of the whole image."""
    raw, noise = variance_of_laplacian(gray[y : y + h, x : x + w]), estimate_noise(gray)
    return (raw / noise if noise > 0 else raw), raw, noise


def _triangle(size: int, to: int) -> np.ndarray:
    """Weights (to x size) of a triangle filter, widened when shrinking."""
    ratio = size / to
    reach = max(1.0, ratio)
    centre = (np.arange(to) + 0.5) * ratio
    weight = np.maximum(0.0, 1 - np.abs((np.arange(size) + 0.5)[None, :] - centre[:, None]) / reach)
    return weight / weight.sum(axis=1, keepdims=True)


def _lanczos3(size: int, to: int) -> np.ndarray:
    ratio = size / to
    reach = max(1.0, ratio)
    x = ((np.arange(size) + 0.5)[None, :] - ((np.arange(to) + 0.5) * ratio)[:, None]) / reach
    weight = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weight / weight.sum(axis=1, keepdims=True)


def _resample(img: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.tensordot(rows, img.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(cols, out, (1, 1)), 0, 1)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def resize_exact(img: np.ndarray, w: int, h: int) -> np.ndarray:
    return _resample(img, _triangle(img.shape[0], h), _triangle(img.shape[1], w))


def letterbox(img: np.ndarray, w: int = 640, h: int = 640) -> tuple[np.ndarray, tuple[float, float, float, float, float]]:
    """The image on a canvas of PAD_VALUE, its aspect kept, and (scale, pad_x, pad_y, original width and height)."""
    old_h, old_w = img.shape[:2]
    scale = min(w / old_w, h / old_h)
    new_w, new_h = int(old_w * scale + 0.5), int(old_h * scale + 0.5)
    x, y = (w - new_w) // 2, (h - new_h) // 2
    canvas = np.full((h, w, 3), PAD_VALUE, np.uint8)
    canvas[y : y + new_h, x : x + new_w] = resize_exact(img, new_w, new_h)
    return canvas, (scale, float(x), float(y), float(old_w), float(old_h))


def to_tensor(img: np.ndarray, mean=(0.0, 0.0, 0.0), std=(1.0, 1.0, 1.0), layout: str = "NCHW") -> np.ndarray:
    x = (img.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)
    return (x.transpose(2, 0, 1) if layout == "NCHW" else x)[None].astype(np.float32)


def perceptual_hash(gray: np.ndarray) -> int:
    """Double-gradient hash of 40 bits: the image at 5 x 5, then whether each value is below its right neighbour's (20
    bits) and below its lower one's (20 bits), the first bit the lowest."""
    small = _resample(gray, _lanczos3(gray.shape[0], 5), _lanczos3(gray.shape[1], 5)).astype(int)
    bits = np.r_[(small[:, :-1] < small[:, 1:]).ravel(), (small[:-1] < small[1:]).ravel()]
    return int(bits @ (1 << np.arange(bits.size, dtype=np.int64)))
