"""Convolution over long tensors: inputs (n, h, w, c, v), kernels (kh, kw, ci, co, v)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conv(inputs: DataFrame, kernel: DataFrame, size: tuple[int, int], kernel_size: tuple[int, int], strides: int | tuple[int, int] = 1, padding: str = "SAME") -> DataFrame:
    """(n, h, w, c, v): cross-correlation of NHWC inputs of the given (height, width).

    The kernel has kh * kw * ci * co rows whatever the inputs' size, and is joined on the input channel.
    """
    sh, sw = (strides, strides) if isinstance(strides, int) else strides
    (height, width), (kh, kw) = size, kernel_size
    if padding == "SAME":
        oh, ow = ceil(height / sh), ceil(width / sw)
        top, left = max((oh - 1) * sh + kh - height, 0) // 2, max((ow - 1) * sw + kw - width, 0) // 2
    elif padding == "VALID":
        oh, ow, top, left = (height - kh) // sh + 1, (width - kw) // sw + 1, 0, 0
    else:
        raise ValueError(padding)
    k = kernel.select("kh", "kw", F.col("ci").alias("c"), "co", F.col("v").alias("weight"))
    y, x = F.col("h") + top - F.col("kh"), F.col("w") + left - F.col("kw")
    hit = (y % sh == 0) & (x % sw == 0) & (y >= 0) & (x >= 0) & (y < oh * sh) & (x < ow * sw)
    return (
        inputs.join(F.broadcast(k), "c")
        .where(hit)
        .groupBy("n", F.expr(f"(h + {top} - kh) div {sh}").cast("int").alias("h"), F.expr(f"(w + {left} - kw) div {sw}").cast("int").alias("w"), F.col("co").alias("c"))
        .agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    )


def _sized(n: int):
    def run(inputs: DataFrame, kernel: DataFrame, size: tuple[int, int], strides: int | tuple[int, int] = 1, padding: str = "SAME") -> DataFrame:
        if kernel.where((F.col("kh") >= n) | (F.col("kw") >= n)).limit(1).count():
            raise AssertionError(f"the kernel is not {n} x {n}")
        return conv(inputs, kernel, size, (n, n), strides, padding)

    return run


conv_1x1 = _sized(1)
conv_3x3 = _sized(3)
