"""Decoding model outputs into boxes: letterbox metadata, face-detector cells, and UI-element rows; arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: strides of the face detector, the largest upscaling, the padding, and labels of UI elements.
STRIDES, MOST_SCALE, PAD = (8, 16, 32), 1.5, 32
UI_LABELS = ("button", "input", "icon", "text_node", "image")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def letterbox(source_w: Column, source_h: Column, target_w: Column, target_h: Column) -> Column:
    """struct<scale, model_w, model_h, padded_w, padded_h>: scaled into the target, at most by 1.5, padded to 32."""
    scale = F.least(target_w / source_w, target_h / source_h, F.lit(MOST_SCALE))
    w, h = half_up(source_w * scale), half_up(source_h * scale)
    padded = lambda n: (F.ceil(n / PAD) * PAD).cast("int")
    return F.struct(scale.alias("scale"), w.cast("int").alias("model_w"), h.cast("int").alias("model_h"), padded(w).alias("padded_w"), padded(h).alias("padded_h"))


def faces(cells: DataFrame, least: float = 0.55) -> DataFrame:
    """image, stride, cell, score, x, y, w, h of cells (image, stride, cell, cls, obj, b0 to b3, padded_w, padded_h).

    The score is the root of the product of both confidences, each cut to 0 to 1; centres are offsets from the
    cell and sizes logarithms, both in strides.  Cells outside the padded image are none.
    """
    cut = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    columns, rows = F.floor(F.col("padded_w") / F.col("stride")), F.floor(F.col("padded_h") / F.col("stride"))
    own = cells.where(F.col("stride").isin(*STRIDES) & (F.col("cell") >= 0) & (F.col("cell") < columns * rows)).withColumn("score", F.sqrt(cut("cls") * cut("obj"))).where(F.col("score") >= least)
    w, h = F.exp("b2") * F.col("stride"), F.exp("b3") * F.col("stride")
    cx, cy = (F.col("cell") % columns + F.col("b0")) * F.col("stride"), (F.floor(F.col("cell") / columns) + F.col("b1")) * F.col("stride")
    return own.select("image", "stride", "cell", "score", (cx - w / 2).alias("x"), (cy - h / 2).alias("y"), w.alias("w"), h.alias("h"))


def ui_elements(rows: DataFrame, least: float = 0.5, size: int = 640) -> DataFrame:
    """image, ord, label, confidence, x, y, w, h of rows (image, ord, x, y, w, h, conf, class, image_w, image_h, scale_x, scale_y)."""
    names = F.array(*[F.lit(n) for n in UI_LABELS])
    label = F.coalesce(F.when(half_up(F.col("class")) >= 0, F.get(names, half_up(F.col("class")).cast("int"))), F.lit("ui_element"))
    side = lambda c, full, scale: half_up(F.col(c) / size * F.col(full) * F.col(scale)).cast("long").alias(c)
    return rows.where(F.col("conf") > least).select("image", "ord", label.alias("label"), F.col("conf").alias("confidence"), side("x", "image_w", "scale_x"), side("y", "image_h", "scale_y"), side("w", "image_w", "scale_x"), side("h", "image_h", "scale_y"))
