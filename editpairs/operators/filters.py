"""Row validity, noisy pairs and face rules: predicates that are never null, and drop reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editpairs.functions import text as X


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename those of the columns that exist."""
    return df.withColumnsRenamed(names)


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def drop_reason(prompt: Column, original: Column, edited: Column) -> Column:
    """Why a pair is invalid: its prompt, then its original, then its edited image; null if it is valid."""
    return F.when(X.normalize_prompt(prompt).isNull(), "empty_prompt").when(original.isNull(), "no_original").when(edited.isNull(), "no_edited")


def valid_pairs(pairs: DataFrame, resize=None) -> DataFrame:
    """Pairs with a prompt and both images, the prompt stripped, images through `resize`; a broken mask is null."""
    images = [c for c in ("original_image", "edited_image", "mask_img") if c in pairs.columns]
    if resize:
        pairs = pairs.withColumns({c: resize(F.col(c)) for c in images})
    reason = drop_reason(F.col("edit_prompt"), F.col("original_image"), F.col("edited_image"))
    return pairs.filter(reason.isNull()).withColumn("edit_prompt", X.normalize_prompt(F.col("edit_prompt")))


def low_change(lpips: Column, prompt: Column, threshold: float = 0.03) -> Column:
    """Almost nothing changed and nothing was to be kept."""
    return _true((lpips < threshold) & ~F.isnan(lpips) & ~X.keeps_intent(prompt))


def low_adherence(clip: Column, threshold: float = 0.18) -> Column:
    return _true((clip < threshold) & ~F.isnan(clip))


def with_drop_reasons(scored: DataFrame, lpips_threshold: float = 0.03, clip_threshold: float = 0.18, generic_words: int = 3) -> DataFrame:
    """drop_reasons: all that hold of generic_prompt, low_change and low_adherence."""
    prompt = F.col("edit_prompt")
    reasons = {
        "low_change": low_change(F.col("lpips"), prompt, lpips_threshold),
        "low_adherence": low_adherence(F.col("clip"), clip_threshold),
        "generic_prompt": X.is_generic(prompt, generic_words),
    }
    return scored.withColumn("drop_reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in reasons.items()))))


def without_noise(scored: DataFrame, **thresholds) -> DataFrame:
    return with_drop_reasons(scored, **thresholds).filter(F.size("drop_reasons") == 0).drop("drop_reasons")


def face_lost(face_orig: Column, face_edited: Column) -> Column:
    """A face in the original and none in the edited image."""
    return _true(face_orig & ~face_edited)


def keep_faces(pairs: DataFrame) -> DataFrame:
    """For a mix: drop pairs that lose a face; originals without one stay."""
    return pairs.filter(~face_lost(F.col("face_orig"), F.col("face_edited")))


def require_faces(pairs: DataFrame) -> DataFrame:
    """For portraits: both images must show a face; without a detector's columns all do."""
    if not {"face_orig", "face_edited"} <= set(pairs.columns):
        return pairs
    return pairs.filter(F.coalesce(F.col("face_orig"), F.lit(True)) & F.coalesce(F.col("face_edited"), F.lit(True)))


def without_strips(pairs: DataFrame, has_strip: Column) -> DataFrame:
    """Drop pairs whose edited image shows a calibration strip."""
    return pairs.filter(~_true(has_strip))


def first_source(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("face_id").isNull())


def second_source(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("face_id").isNotNull())
