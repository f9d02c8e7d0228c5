"""Vector and small-image expressions with higher-order functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.config import Gray, ModelInput, Shape
from daftar.functions.let import let



def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def deviation(xs: Column) -> Column:
    """Population standard deviation."""
    return let(mean(xs), lambda m: F.sqrt(mean(F.transform(xs, lambda x: (x - m) * (x - m)))))


def softmax(xs: Column) -> Column:
    powers = let(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def slot(xs: Column, i: Column | int, size: int = 10) -> Column:
    return F.slice(xs, F.lit(i) * size + 1 if isinstance(i, int) else i * size + 1, F.lit(size))


def softmax_slots(logits: Column, slots: int = 8, size: int = 10) -> Column:
    """Softmax of each slot of a flat array of logits."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: softmax(slot(logits, i, size))))


def decode_digits(probs: Column, date_prob: Column, model: ModelInput = ModelInput(), is_date: float = 0.5) -> Column:
    """The read of a flat array of digit probabilities: the first largest of each slot."""

    def read(slots: Column) -> Column:
        best = F.transform(slots, lambda s: F.array_max(s))
        picks = F.transform(slots, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("string"))
        return let(F.struct(F.array_join(picks, "").alias("digits"), best.alias("best")), parts)

    def parts(r: Column) -> Column:
        d = r["digits"]
        text = F.concat_ws("/", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
        return F.struct(
            d.alias("digits"), text.alias("text"), (total(r["best"]) / model.slots * 100).alias("confidence"),
            F.array_min(r["best"]).alias("min_prob"), date_prob.alias("date_prob"), (date_prob >= is_date).alias("is_date"),
        )

    return let(F.transform(F.sequence(F.lit(0), F.lit(model.slots - 1)), lambda i: slot(probs, i)), read)


def invert_dark(px: Column, gray: Gray = Gray()) -> Column:
    """Light ink on dark paper is turned around."""
    return F.when(mean(px) < gray.invert_below, F.transform(px, lambda x: 255 - x)).otherwise(px)


def lift(px: Column, gray: Gray = Gray()) -> Column:
    """Gain and offset, saturating, halves to even."""
    return F.transform(px, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(x * gray.gain + gray.lift))).cast("int"))


def stretch(px: Column) -> Column:
    """Spread values over 0..255 unless they are all alike."""

    def over(r: Column) -> Column:
        made = F.transform(px, lambda x: F.floor((x - r["lo"]) * F.lit(255.0) / (r["hi"] - r["lo"]) + 0.5).cast("int"))
        return F.when(r["hi"] > r["lo"], made).otherwise(px)

    return let(F.struct(F.array_min(px).alias("lo"), F.array_max(px).alias("hi")), over)


def standardise(xs: Column, model: ModelInput = ModelInput()) -> Column:
    known = F.struct(mean(xs).alias("m"), deviation(xs).alias("s"))
    return let(known, lambda r: F.transform(xs, lambda x: (x - r["m"]) / (r["s"] + model.epsilon)))


def dense(xs: Column, weights: Column, bias: Column, relu: bool = False) -> Column:
    """One output for each row of weights."""
    out = F.transform(weights, lambda w, o: F.get(bias, o) + total(F.zip_with(xs, w, lambda a, b: a * b)))
    return F.transform(out, lambda x: F.greatest(x, F.lit(0.0))) if relu else out


def max_pool(px: Column, width: int, height: int) -> Column:
    """2x2 maxima of a row-major image; an odd last row or column is left out."""
    ow, oh = width // 2, height // 2

    def cell(i: Column) -> Column:
        at = (F.floor(i / ow) * 2 * width + (i % ow) * 2).cast("int")
        return F.greatest(F.get(px, at), F.get(px, at + 1), F.get(px, at + width), F.get(px, at + width + 1))

    return F.transform(F.sequence(F.lit(0), F.lit(ow * oh - 1)), cell)


def resize_nearest(px: Column, width: int, height: int, new_width: int, new_height: int) -> Column:
    def cell(i: Column) -> Column:
        y = F.floor(F.floor(i / new_width) * height / new_height)
        x = F.floor((i % new_width) * width / new_width)
        return F.get(px, (F.least(y, F.lit(height - 1)) * width + F.least(x, F.lit(width - 1))).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(new_width * new_height - 1)), cell)


def ncc(a: Column, b: Column) -> Column:
    """Normalised cross-correlation over the common length; -1 if there is none or no variance."""
    n = F.least(F.size(a), F.size(b))
    centred = lambda c: let(c, lambda x: let(mean(x), lambda m: F.transform(x, lambda v: v - m)))

    def of(r: Column) -> Column:
        dot = total(F.zip_with(r["x"], r["y"], lambda p, q: p * q))
        squares = total(F.transform(r["x"], lambda v: v * v)) * total(F.transform(r["y"], lambda v: v * v))
        return let(F.sqrt(squares), lambda size: F.when(size > 1e-12, dot / size).otherwise(F.lit(-1.0)))

    both = F.struct(centred(F.slice(a, F.lit(1), n)).alias("x"), centred(F.slice(b, F.lit(1), n)).alias("y"))
    return F.when(n > 0, let(both, of)).otherwise(F.lit(-1.0))


def hu_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))


def ink_mask(px: Column, shape: Shape = Shape()) -> Column:
    return F.transform(px, lambda x: (x < shape.ink).cast("int"))


def quantise(xs: Column) -> Column:
    """Symmetric eight-bit values and their scale."""
    scale = F.greatest(F.array_max(F.transform(xs, lambda x: F.abs(x))) / 127.0, F.lit(1e-9))

    def of(s: Column) -> Column:
        q = F.transform(xs, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x / s))).cast("int"))
        return F.struct(s.alias("scale"), q.alias("q"))

    return let(scale, of)
