"""What a trainer reads: resolved columns, dropout masks, paired tensors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpairs.functions import pixels as P
from editpairs.functions.hashing import seeded_uniform
from editpairs.functions.image_ops import _arrays, _present

ROLES = ["original", "prompt", "edited"]


def resolve_columns(columns: list[str], known: dict[str, str] | None = None, **explicit: str | None) -> dict[str, str]:
    """Role -> column: an explicit name, which must exist; else a known dataset's; else the role's position."""
    out = {}
    for place, role in enumerate(ROLES):
        name = explicit.get(role)
        if name is None:
            name = (known or {}).get(role) or (columns[place] if place < len(columns) else None)
        if name not in columns:
            raise ValueError(f"no column {name} for the {role}; there are {columns}")
        out[role] = name
    return out


def dropout_masks(pairs: DataFrame, p: float | None, seed: int, epoch: int, key: str) -> DataFrame:
    """drop_prompt and drop_image from one draw r a row: r < 2p, and p <= r < 3p; without p neither."""
    if p is None:
        return pairs.withColumns({"drop_prompt": F.lit(False), "drop_image": F.lit(False)})
    r = seeded_uniform(f"{seed}|{epoch}", key)
    return pairs.withColumn("_r", r).withColumns({"drop_prompt": F.col("_r") < 2 * p, "drop_image": (F.col("_r") >= p) & (F.col("_r") < 3 * p)}).drop("_r")


def training_tensors(pairs: DataFrame, side: int, seed: int, epoch: int, key: str, flip: bool = True) -> DataFrame:
    """key, flipped, tensor: both images of a pair as float32 bytes of shape (2, 3, side, side), changed alike."""
    rows = pairs.select(key, (seeded_uniform(f"flip|{seed}|{epoch}", key) < (0.5 if flip else 0.0)).alias("flipped"), "original_image", "edited_image")

    def tensors(batches):
        for batch in batches:
            a, b = (_arrays(pd.DataFrame(batch[c].tolist(), columns=["height", "width", "channels", "data"], index=batch.index)) for c in ("original_image", "edited_image"))
            found = _present(lambda x, y, f: P.training_tensors(x, y, side, f), a, b, batch["flipped"].tolist())
            yield pd.DataFrame({key: batch[key], "flipped": batch["flipped"], "tensor": [None if t is None else t.tobytes() for t in found]})

    return rows.mapInPandas(tensors, f"{key} {dict(pairs.dtypes)[key]}, flipped boolean, tensor binary")
