"""Image columns: vectorised functions over IMAGE structs. An image that can't be read gives null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editpairs.functions import pixels as P
from editpairs.schema import IMAGE


def _arrays(images: pd.DataFrame) -> list[np.ndarray | None]:
    out = []
    for h, w, c, data in zip(images["height"], images["width"], images["channels"], images["data"]):
        if data is None or pd.isna(h) or pd.isna(w) or pd.isna(c) or not len(data) or len(data) != h * w * c:
            out.append(None)
        else:
            out.append(P.rgb(np.frombuffer(data, dtype=np.uint8).reshape(int(h), int(w), int(c))))
    return out


def _structs(arrays: list[np.ndarray | None]) -> pd.DataFrame:
    none = [None] * 4
    rows = [none if a is None else [a.shape[0], a.shape[1], a.shape[2], np.ascontiguousarray(a).tobytes()] for a in arrays]
    return pd.DataFrame(rows, columns=IMAGE.names).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})


def _present(function, *columns) -> list:
    """function of the rows that have all values, as lists; its results at their places, None elsewhere."""
    there = [k for k, x in enumerate(zip(*columns)) if not any(v is None or (isinstance(v, float) and np.isnan(v)) for v in x)]
    out = [None] * len(columns[0])
    for k, v in zip(there, function(*([c[k] for k in there] for c in columns)) if there else []):
        out[k] = v
    return out


def _one_by_one(function):
    """A function of lists from one of single images."""
    return lambda *columns: [function(*x) for x in zip(*columns)]


def image_map(many):
    """A column function image -> image from a function of lists of arrays."""

    @F.pandas_udf(IMAGE)
    def udf(images: pd.DataFrame) -> pd.DataFrame:
        return _structs(_present(many, _arrays(images)))

    return lambda column: _nullable(udf(column))


def _nullable(image: Column) -> Column:
    return F.when(image["data"].isNotNull(), image)


def image_score(many, kind: T.DataType):
    """A column function image -> number, flag or array."""

    @F.pandas_udf(kind)
    def udf(images: pd.DataFrame) -> pd.Series:
        return pd.Series(_present(many, _arrays(images)), dtype=object)

    return udf


def pair_score(many, kind: T.DataType = T.DoubleType()):
    """A column function (image, image) -> number."""

    @F.pandas_udf(kind)
    def udf(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        return pd.Series(_present(many, _arrays(a), _arrays(b)), dtype=object)

    return udf


def resized(size_of, kernel: str = "lanczos"):
    """size_of: (width, height) -> (width, height)"""
    return image_map(lambda images: P.resize_many(images, [size_of(x.shape[1], x.shape[0]) for x in images], kernel))


def bounded(most: int):
    return resized(lambda w, h: P.bounded_size(w, h, most))


def scaled(most: int):
    return resized(lambda w, h: P.scaled_size(w, h, most))


def squared(side: int, kernel: str = "lanczos"):
    return resized(lambda w, h: (side, side), kernel)


def trimmed(threshold: int = 250):
    return image_map(_one_by_one(lambda x: P.trim_light(x, threshold)))


def cropped(by: int = 8):
    return image_map(_one_by_one(lambda x: P.crop_edges(x, by)))


to_rgb = image_map(lambda images: images)
channel_means = image_score(P.channel_means, T.ArrayType(T.DoubleType()))
border_anomaly = image_score(_one_by_one(P.border_anomaly), T.DoubleType())
squared_error = pair_score(P.squared_error)


def corner_strip(corner: int = 32, least_pixels: int = 20, dispersion: float = 0.15):
    return image_score(_one_by_one(lambda x: P.corner_strip(x, corner, least_pixels, dispersion)), T.BooleanType())


@F.pandas_udf(IMAGE)
def _resize_like(image: pd.DataFrame, like: pd.DataFrame) -> pd.DataFrame:
    return _structs(_present(lambda x, y: P.resize_many(x, [(v.shape[1], v.shape[0]) for v in y]), _arrays(image), _arrays(like)))


def resize_like(image: Column, like: Column) -> Column:
    """image at the size of `like`."""
    return _nullable(_resize_like(image, like))


@F.pandas_udf(IMAGE)
def _oriented(image: pd.DataFrame, orientation: pd.Series) -> pd.DataFrame:
    return _structs(_present(_one_by_one(P.oriented), _arrays(image), orientation.fillna(1).astype(int).tolist()))


def oriented(image: Column, orientation: Column) -> Column:
    return _nullable(_oriented(image, orientation))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("mse", "ssim", "free")]))
def outside_mask(original: pd.DataFrame, edited: pd.DataFrame, mask: pd.DataFrame) -> pd.DataFrame:
    """Squared error, structural similarity and share of what lies outside a pair's mask."""
    rows = _present(_one_by_one(P.outside_mask), _arrays(original), _arrays(edited), _arrays(mask))
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["mse", "ssim", "free"], dtype="float64")


def from_bgr(image: Column) -> Column:
    """IMAGE of a struct of Spark's image source, whose channels come in the order blue, green, red."""

    @F.pandas_udf(T.BinaryType())
    def swapped(data: pd.Series, channels: pd.Series) -> pd.Series:
        def swap(d, c):
            if d is None or c is None or c < 1:
                return None
            x = np.frombuffer(d, dtype=np.uint8).reshape(-1, int(c))
            return (x[:, [2, 1, 0]] if c >= 3 else np.repeat(x[:, :1], 3, axis=1)).tobytes()

        return pd.Series([swap(d, c) for d, c in zip(data, channels)], dtype=object)

    rgb = F.struct(image["height"].alias("height"), image["width"].alias("width"), F.lit(3).alias("channels"), swapped(image["data"], image["nChannels"]).alias("data"))
    return F.when(image["height"] > 0, rgb)
