"""Page pictures as NumPy arrays (height x width x 3, bytes): crops, stamps, blank pages,
orientation. They run inside a PageReader; DataFrames carry only what they find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK_INK = 0.0008
LEAST_SIDE = 8


def crop(img: np.ndarray, rect: tuple[float, float, float, float]) -> np.ndarray:
    """The part in a normalised rectangle; the whole page where that is a sliver."""
    h, w = img.shape[:2]
    x0, y0, x1, y1 = (int(round(a * b)) for a, b in zip(rect, (w, h, w, h), strict=True))
    part = img[max(0, y0) : y1, max(0, x0) : x1]
    return part if min(part.shape[:2]) >= LEAST_SIDE else img


def without_red(img: np.ndarray, least: int = 120, ahead: int = 40) -> np.ndarray:
    """Red pixels (stamps) whitened."""
    r, g, b = (img[..., k].astype(int) for k in range(3))
    red = (r > least) & (r - g > ahead) & (r - b > ahead)
    return np.where(red[..., None], np.uint8(255), img)


def ink(img: np.ndarray, dark: int = 128) -> np.ndarray:
    return img.mean(axis=2) < dark


def is_blank(img: np.ndarray) -> bool:
    """Too little ink to be text; such pages are skipped, as models invent text for them."""
    return bool(ink(img).mean() < BLANK_INK)


def axis_ratio(img: np.ndarray) -> float:
    """Mean length of ink runs along rows over that along columns; above 1 lines lie flat."""

    def run(a: np.ndarray) -> float:
        starts = a[:, 1:] & ~a[:, :-1]
        n = int(starts.sum() + a[:, 0].sum())
        return float(a.sum()) / n if n else 1.0

    a = ink(img)
    return run(a) / run(a.T)


def rotation(img: np.ndarray, confidence: dict[int, float]) -> int:
    """Degrees to turn a page by: the axis from its ink, the side from a reader's confidence."""
    sides = (0, 180) if axis_ratio(img) >= 1 else (90, 270)
    return max(sides, key=lambda s: (confidence.get(s, 0.0), -s))


def page_facts(pages: DataFrame) -> DataFrame:
    """`page_id, blank, axis` of `page_id`, `height`, `width`, `pixels` (RGB bytes)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            imgs = [np.frombuffer(p, np.uint8).reshape(h, w, 3) for h, w, p in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([is_blank(i) for i in imgs]), pa.array([axis_ratio(i) for i in imgs])], names=["page_id", "blank", "axis"])

    return pages.select("page_id", "height", "width", "pixels").mapInArrow(f, "page_id long, blank boolean, axis double")
