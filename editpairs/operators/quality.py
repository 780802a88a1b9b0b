"""Pair metrics, audits by group against a control, gates, and the global colour and border audit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpairs.functions import image_ops as I
from editpairs.functions import pixels as P
from editpairs.functions.text import is_generic, mentions_person, shorten_caption
from editpairs.operators.filters import face_lost
from editpairs.operators.mixing import fraction
from editpairs.operators.order_statistics import exact_percentiles
from editpairs.operators.sampling import up_to
from editpairs.schema import IMAGE

THUMB, CAPTION, HEADER = 224, 34, 34
SHEET_WIDTH = 464


def audit_sample(pairs: DataFrame, per_attribute: int, control: int, seed: int, key: str) -> DataFrame:
    """Up to per_attribute rows of each attribute of the second source, and up to `control` of the first as `control`."""
    group = F.when(F.col("face_id").isNull(), "control").otherwise(F.col("attribute"))
    rows = pairs.withColumn("audit_group", group).filter("audit_group IS NOT NULL")
    return up_to(rows, "audit_group", key, F.when(F.col("audit_group") == "control", control).otherwise(per_attribute), seed)


def prompt_vagueness(pairs: DataFrame, prompt: str = "edit_prompt", group: str = "attribute", words: int = 3) -> DataFrame:
    """Per group: prompts, the generic ones and their share, and how many words prompts have (least, mean, most)."""
    text = F.col(prompt)
    rows = pairs.select(group, is_generic(text, words).alias("vague"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)[\w'-]+")).alias("words"))
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if("vague").alias("vague"), F.min("words").alias("least_words"), F.avg("words").alias("mean_words"), F.max("words").alias("most_words"))
    return out.withColumn("vague_fraction", fraction(F.col("vague"), F.col("n")))


def vague_prompts(pairs: DataFrame, per_group: int, seed: int, key: str, prompt: str = "edit_prompt", group: str = "attribute", words: int = 3) -> DataFrame:
    """A sample of each group's generic prompts, for people to look at."""
    return up_to(pairs.filter(is_generic(F.col(prompt), words)), group, key, F.lit(per_group), seed)


#: Percentiles of an audit: name -> column and share.
PERCENTILES = {"pair_sim_p10": ("pair_sim", 0.1), "lpips_p90": ("lpips", 0.9)}


def quality_columns(percentiles: bool = True) -> list[Column]:
    """Summary of pair_sim, text_sim, lpips, face_orig and face_edited; percentiles are exact, between values linear."""
    n = F.count(F.lit(1))
    flags = {
        "low_pair_sim": F.coalesce(F.col("pair_sim") < 0.70, F.lit(False)), "high_lpips": F.coalesce(F.col("lpips") > 0.35, F.lit(False)),
        "low_text_sim": F.coalesce(F.col("text_sim") < 0.18, F.lit(False)), "face_lost": face_lost(F.col("face_orig"), F.col("face_edited")),
    }
    return [
        n.alias("n"), F.avg("pair_sim").alias("pair_sim_mean"), F.avg("text_sim").alias("text_sim_mean"), F.avg("lpips").alias("lpips_mean"),
        *(F.percentile(c, p).alias(name) for name, (c, p) in PERCENTILES.items() if percentiles),
        *(F.count_if(c).alias(f"{k}_count") for k, c in flags.items()), *((F.count_if(c) / n).alias(f"{k}_fraction") for k, c in flags.items()),
    ]


def audit(metrics: DataFrame, group: str = "audit_group") -> DataFrame:
    """A summary of each group of a sample: its values meet in one task for the percentiles."""
    return metrics.groupBy(group).agg(*quality_columns())


def audit_population(metrics: DataFrame, group: str = "audit_group") -> DataFrame:
    """audit() of groups of any size: counts and means are combined before the shuffle, percentiles narrowed down in passes."""
    summary = metrics.groupBy(group).agg(*quality_columns(percentiles=False))
    found = exact_percentiles(metrics, group, PERCENTILES).withColumnRenamed(group, "_group")
    return summary.join(found, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def gate(summary: DataFrame, group: str = "audit_group", most_suspicious: float = 0.05, tolerance: float = 0.1, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Per attribute: passes if few pairs are suspicious and the mean similarity is near the control group's."""
    control = summary.filter(F.col(group) == "control").select(F.col("pair_sim_mean").alias("control_mean"))  # one row
    rows = summary.filter(F.col(group) != "control").join(F.broadcast(control), how="left")
    ok = (F.col("low_pair_sim_fraction") < most_suspicious) & (F.abs(F.col("pair_sim_mean") - F.col("control_mean")) <= tolerance)
    return rows.select(group, "low_pair_sim_fraction", "pair_sim_mean", "control_mean", (F.coalesce(ok, F.lit(False)) | F.col(group).isin(*exempt)).alias("passes"))


def contact_manifest(sample: DataFrame, group: str, order: str, prompt: str, per_group: int = 12) -> DataFrame:
    """The first pairs of each group with their place on the group's sheet and a short caption."""
    place = F.row_number().over(W.partitionBy(group).orderBy(order))
    rows = sample.withColumn("place", place).filter(F.col("place") <= per_group)
    top = HEADER + (F.col("place") - 1) * (THUMB + CAPTION)
    height = HEADER + F.count(F.lit(1)).over(W.partitionBy(group)) * (THUMB + CAPTION)
    return rows.select(group, order, "place", top.alias("top"), F.lit(SHEET_WIDTH).alias("sheet_width"), height.alias("sheet_height"), shorten_caption(F.col(prompt)).alias("caption"))


def contact_sheets(sample: DataFrame, group: str, order: str, per_group: int = 12, thumb: int = THUMB, caption: int = CAPTION, gap: int = 16) -> DataFrame:
    """group and `sheet`, an IMAGE of the first pairs of each group (original_image, edited_image) in order; no text is drawn.

    A sheet has per_group pairs at most, which are picked by narrow rows before their pixels meet.
    """
    kind = dict(sample.dtypes)[group]
    place = F.row_number().over(W.partitionBy(group).orderBy(order))
    first = sample.select(F.col(group).alias("_g"), F.col(order).alias("_o"), place.alias("_place")).filter(F.col("_place") <= per_group)
    rows = sample.join(first, F.col(group).eqNullSafe(F.col("_g")) & (F.col(order) == F.col("_o")))

    def compose(table):
        import pyarrow as pa

        from editpairs.sources.files import as_images

        table = table.sort_by("_place").slice(0, per_group)
        columns = [[None if i is None else P.rgb(np.frombuffer(i["data"], dtype=np.uint8).reshape(i["height"], i["width"], i["channels"])) for i in table[c].to_pylist()] for c in ("original_image", "edited_image")]
        return pa.table({group: table[group][:1], "sheet": as_images([P.contact_sheet(list(zip(*columns)), thumb, caption, gap)])})

    return rows.select(group, "_place", "original_image", "edited_image").groupBy(group).applyInArrow(compose, f"{group} {kind}, sheet {IMAGE.simpleString()}")


def color_delta(original: str, edited: str) -> Column:
    """Edited minus original mean of red, green and blue."""
    return F.zip_with(I.channel_means(F.col(edited)), I.channel_means(F.col(original)), lambda a, b: a - b)


def global_audit(features: DataFrame) -> DataFrame:
    """features: delta (array of three), border (share), edit_prompt; one row."""
    r, g, b = (F.get("delta", F.lit(i)) for i in range(3))
    person = mentions_person(F.col("edit_prompt"))
    n = F.count(F.lit(1))
    out = features.agg(
        n.alias("n"), F.round(F.avg(r), 2).alias("delta_r"), F.round(F.avg(g), 2).alias("delta_g"), F.round(F.avg(b), 2).alias("delta_b"),
        F.count_if((r > 2) & (b > 2) & (g < 0)).alias("magenta"), F.count_if(F.col("border") > 0.01).alias("border_flags"), F.count_if(person).alias("persons"),
    )
    share = lambda c: F.round(fraction(F.col(c), F.col("n")), 4)
    return out.select("n", "delta_r", "delta_g", "delta_b", share("magenta").alias("magenta_fraction"), share("border_flags").alias("border_fraction"), "persons", share("persons").alias("person_fraction"))
