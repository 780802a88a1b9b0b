"""Learned scorers as plug-ins: the caller brings a model, this module loads it once a worker and feeds it batches.

A loader is a function without arguments that returns the model, a function over lists. Without a plug-in the
perceptual distance is the mean squared error and every image shows a face.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from editpairs.functions import image_ops as I
from editpairs.functions.image_ops import _arrays


def perceptual_distance(original: Column, edited: Column, loader: Callable | None = None) -> Column:
    """Distance of two images; the model maps two lists of arrays to numbers."""
    if loader is None:
        return I.squared_error(original, edited)

    @F.pandas_udf("double")
    def distance(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
        model = loader()
        for a, b in batches:
            yield pd.Series(model(_arrays(a), _arrays(b)), dtype="float64")

    return distance(original, edited)


def _embedder(loader: Callable, take, batch: int):
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for values in batches:
            items, out = take(values), []
            for a in range(0, len(items), batch):
                out += list(model(items[a : a + batch]))
            yield pd.Series(out, dtype=object)

    return embed


def text_embedding(prompt: Column, loader: Callable, batch: int = 8) -> Column:
    return _embedder(loader, list, batch)(prompt)


def image_embedding(image: Column, loader: Callable, batch: int = 8) -> Column:
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = loader()
        for values in batches:
            items, out = _arrays(values), []
            for a in range(0, len(items), batch):
                out += list(model(items[a : a + batch]))
            yield pd.Series(out, dtype=object)

    return embed(image)


def shows_face(image: Column, loader: Callable | None = None) -> Column:
    """Does the image show a face? The model maps a list of arrays to flags.

    It is asked once for an image, where the column stands: a filter on the flag neither repeats it nor takes it
    below an exchange, to where rows are not dealt out yet.
    """
    if loader is None:
        return F.lit(True)

    @F.pandas_udf("boolean")
    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = loader()
        for values in batches:
            yield pd.Series(list(model(_arrays(values))), dtype=object)

    return detect.asNondeterministic()(image)


def token_ids(prompt: Column, loader: Callable) -> Column:
    """Ids of a tokenizer, to be brought to one length by text.fixed_length."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for values in batches:
            yield pd.Series(list(model(["" if v is None else v for v in values])), dtype=object)

    return encode(prompt)
