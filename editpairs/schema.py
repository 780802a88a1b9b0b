"""Column types of the tables that the jobs read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INT, TEXT, REAL, FLAG = T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()

IMAGE = _struct(height=INT, width=INT, channels=INT, data=T.BinaryType())
PAIR = _struct(img_id=TEXT, turn_index=INT, original_image=IMAGE, edited_image=IMAGE, mask_img=IMAGE, edit_prompt=TEXT, split=TEXT)
DISCOVERED = _struct(face_id=TEXT, attribute=TEXT, prompt=TEXT, edited_path=TEXT, json_path=TEXT)
METRICS = _struct(pair_sim=REAL, text_sim=REAL, lpips=REAL, face_orig=FLAG, face_edited=FLAG)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has all these columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df
