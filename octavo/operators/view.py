"""Ray reductions and compositing over samples (pixel, step, v) and pixels (x, y, a, r, g, b).

Maxima are partial aggregates. Opacity is not commutative: samples of a pixel are folded in order, and a
pixel's samples are bounded by the ray, so each fold is one row's array.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octavo.functions.colors import above_pixel, blend_behind, opacity, over_bytes, transfer
from octavo.streaming.stateful import DOUBLE_MS, LONG_AGO_MS

#: Opacity from which nothing behind is seen; least opacity of a lit step.
OPAQUE, LEAST_ALPHA = 0.996, 1e-5


def ray_box(origin: list[Column], direction: list[Column], lo: list[Column], hi: list[Column], near: float = 1.0) -> tuple[Column, Column]:
    """Enter and exit parameter of rays through boxes (slabs), from ``near`` on; enter > exit means a miss.

    Along an axis with no direction the origin must lie inside the slab.
    """
    enters, leaves = [F.lit(near)], []
    for o, d, a, b in zip(origin, direction, lo, hi, strict=True):
        p, q = F.try_divide(a - o, d), F.try_divide(b - o, d)
        miss = (o < a) | (o > b)
        enters.append(F.when(d == 0, F.when(miss, F.lit(float("inf"))).otherwise(F.lit(near))).otherwise(F.least(p, q)))
        leaves.append(F.when(d == 0, F.lit(float("inf"))).otherwise(F.greatest(p, q)))
    return F.greatest(*enters), F.least(*leaves) if len(leaves) > 1 else leaves[0]


def sample_count(length: Column, texel: float, quality: float, least: int = 2) -> Column:
    """Samples of a stretch: proportional to its length in texels and the quality."""
    return F.greatest(F.lit(least), F.floor(length / texel * quality).cast("int") + 1)


def samples(rays: DataFrame, count: Column) -> DataFrame:
    """Rays (enter, leave) as equal steps: step, t."""
    rows = rays.withColumn("_n", count).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("t", F.col("enter") + (F.col("leave") - F.col("enter")) * F.col("step") / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_n")


def view_rectangle(corners: list[tuple[float, float, float]], matrix: np.ndarray, width: int, height: int) -> tuple[int, int, int, int]:
    """Pixels that a box may cover: its projected corners, cut to the viewport; all of it if a corner is behind the eye."""
    out = []
    for c in corners:
        x, y, _, w = matrix @ np.array([*c, 1.0])
        if w <= 0:
            return 0, 0, width, height
        out.append(((x / w + 1) / 2 * width, (1 - y / w) / 2 * height))
    xs, ys = zip(*out, strict=True)
    cut = lambda v, n: max(0, min(n, v))
    return cut(int(np.floor(min(xs))), width), cut(int(np.floor(min(ys))), height), cut(int(np.ceil(max(xs))), width), cut(int(np.ceil(max(ys))), height)


def max_intensity(rows: DataFrame, threshold: float, lo: float, hi: float, keys: list[str]) -> DataFrame:
    """Largest value of at least the threshold per pixel, over [lo, hi]; null where there is none."""
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("v") >= threshold, F.col("v"))).alias("m")).select(*keys, ((F.col("m") - lo) / (hi - lo)).alias("t"))


def crossings(rows: DataFrame, level: float, keys: list[str], value: str | None = None) -> DataFrame:
    """Where consecutive samples lie strictly on two sides of a level: step of the first, t between them.

    With ``value``, a second field at the crossing (``w``), linear between the samples.
    """
    w = Window.partitionBy(*keys).orderBy("step")
    v1, v2 = F.col("v"), F.lead("v").over(w)
    out = rows.select("*", v2.alias("v2"), *([F.lead(value).over(w).alias("w2")] if value else [])).where((v1 - level) * (F.col("v2") - level) < 0)
    t = (level - F.col("v")) / (F.col("v2") - F.col("v"))
    return out.select(*keys, "step", t.alias("t"), *([(F.col(value) + (F.col("w2") - F.col(value)) * t).alias("w")] if value else []))


def multi_crossings(rows: DataFrame, levels: list[float], keys: list[str], value: str | None = None) -> DataFrame:
    """Crossings of several levels, in the order the ray meets them: step, level number, t."""
    from octavo.operators.order import sorted_levels

    levels = sorted_levels(levels)
    w = Window.partitionBy(*keys).orderBy("step")
    out = rows.select("*", F.lead("v").over(w).alias("v2"), *([F.lead(value).over(w).alias("w2")] if value else [])).where(F.col("v2").isNotNull() & F.col("v").isNotNull())
    struct = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(float(x)).alias("l")) for i, x in enumerate(levels)))
    out = out.withColumn("_l", F.explode(F.filter(struct, lambda s: (F.col("v") - s["l"]) * (F.col("v2") - s["l"]) < 0)))
    t = (F.col("_l.l") - F.col("v")) / (F.col("v2") - F.col("v"))
    return out.select(*keys, "step", F.col("_l.n").alias("level_no"), t.alias("t"), *([(F.col(value) + (F.col("w2") - F.col(value)) * t).alias("w")] if value else []))


def nearest_crossing(found: DataFrame, keys: list[str]) -> DataFrame:
    """The first crossing of each ray: what an opaque isosurface shows."""
    return found.groupBy(*keys).agg(F.min(F.struct("step", "t")).alias("f")).select(*keys, "f.step", "f.t")


def fold(rows: DataFrame, keys: list[str], colour: list[Column], order: tuple[str, ...] = ("step",)) -> DataFrame:
    """Front-to-back composition of samples' colours (r, g, b, a) in order; stops adding once opaque."""
    named = [c.cast("double").alias(n) for c, n in zip(colour, "rgba", strict=True)]
    by = rows.select(*keys, *order, *named).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *"rgba"))).alias("s"))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in "rgba"))
    acc = F.aggregate("s", zero, lambda acc, x: F.when(acc["a"] > OPAQUE, acc).otherwise(blend_behind(acc, x)))
    return by.select(*keys, acc.alias("c")).select(*keys, "c.r", "c.g", "c.b", "c.a")


#: A transfer function's knots over relative values: x, r, g, b, a.
Knots = list[tuple[float, float, float, float, float]]
GREY: Knots = [(0.0, 0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 1.0)]


def relative(v: Column, lo: float, hi: float) -> Column:
    return (v - lo) / (hi - lo)


def volume(rows: DataFrame, keys: list[str], knots: Knots, factor: float, lo: float, hi: float, layer: float, shade: Callable[[list[Column]], list[Column]] | None = None) -> DataFrame:
    """Opacity volume: each defined sample has its value's colour, and alpha 1 - (1 - a * factor) ** layer.

    ``factor`` is the threshold's place in the field's range. ``shade`` turns a colour into the lit one; then samples
    that are as good as transparent are left out.
    """
    r, g, b, a = transfer(relative(F.col("v"), lo, hi), knots)
    rows = rows.where("v is not null").withColumn("_a", opacity(factor, a, layer))
    if shade is not None:
        rows = rows.where(F.col("_a") >= LEAST_ALPHA)
        r, g, b = shade([r, g, b])
    return fold(rows, keys, [r, g, b, F.col("_a")])


def alpha_volume(rows: DataFrame, keys: list[str], base: float, lo: float, hi: float, layer: float, light: Column | None = None) -> DataFrame:
    """An opacity volume in grey, as bright as the value, or that times an intensity of light."""
    return volume(rows, keys, GREY, base, lo, hi, layer, None if light is None else lambda c: [x * light for x in c])


def surfaces(found: DataFrame, keys: list[str], knots: Knots, at: Column, alpha: float, shade: Callable[[list[Column]], list[Column]] | None = None) -> DataFrame:
    """Isosurfaces: the crossings of each ray (step, t) with the colour of ``at`` (a relative value), their alpha times
    ``alpha``, lit by ``shade``, composed front to back until nothing behind is seen."""
    r, g, b, a = transfer(at, knots)
    r, g, b = shade([r, g, b]) if shade is not None else (r, g, b)
    return fold(found, keys, [r, g, b, a * alpha], ("step", "t"))


def drawn(image: DataFrame, pixels: DataFrame, keys: list[str], pixel: str = "argb") -> DataFrame:
    """Packed pixels with an image's colours above them; pixels that it does not cover stay."""
    rows = pixels.join(image.select(*keys, F.struct(*"rgba").alias("_new")), keys, "left")
    return rows.withColumn(pixel, F.when(F.col("_new").isNull(), F.col(pixel)).otherwise(above_pixel(F.col(pixel), F.col("_new")))).drop("_new")


def domain_voxels(rows: DataFrame, keys: list[str], colour: tuple[float, float, float, float]) -> DataFrame:
    """Constant colour wherever the field is defined."""
    return fold(rows.where("v is not null"), keys, [F.lit(c) for c in colour])


def layer_exponent(depth: int, level: int, quality: float) -> float:
    return 100.0 / ((1 << (depth + level)) * quality)


def blend_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """8-bit image parts (order, a, r, g, b) composed back to front per pixel, in integers."""
    rows = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("order", *(F.col(c).cast("long").alias(c) for c in "argb")))).alias("s"))
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in "argb"))
    acc = F.aggregate("s", zero, lambda acc, x: over_bytes(acc, F.struct(*(x[c].alias(c) for c in "argb"))))
    return rows.select(*keys, acc.alias("c")).select(*keys, "c.a", "c.r", "c.g", "c.b")


def merge_max(parts: DataFrame, keys: list[str], value: str = "t") -> DataFrame:
    """Maximum over parts; missing values and NaN are ignored."""
    return parts.groupBy(*keys).agg(F.max(F.when(~F.isnan(value), F.col(value))).alias(value))


def assemble(first: DataFrame, second: DataFrame, keys: list[str], mip: bool = False) -> DataFrame:
    """Two neighbouring partial images as one: the second over the first."""
    both = first.withColumn("order", F.lit(0)).unionByName(second.withColumn("order", F.lit(1)))
    return merge_max(both, keys) if mip else blend_parts(both, keys)


def compose(pixels: DataFrame, lattice: DataFrame, keys: list[str], background: tuple[int, int, int]) -> DataFrame:
    """The final image over an opaque background: every pixel of the viewport."""
    rows = lattice.join(pixels, keys, "left")
    a = F.coalesce(F.col("a"), F.lit(0)).cast("long")
    mix = lambda c, bg: F.floor((F.coalesce(F.col(c), F.lit(0)).cast("long") * a + bg * (255 - a)) / 255).cast("int")
    return rows.select(*keys, *(mix(c, bg).alias(c) for c, bg in zip("rgb", background, strict=True)))


def crop(pixels: DataFrame) -> DataFrame:
    """The rectangle of pixels with something in them: x0, y0, x1, y1 (exclusive)."""
    return pixels.where("a > 0").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def progressive(levels: DataFrame, render_level: int, deepest: int) -> DataFrame:
    """The levels to render: one, cut to the deepest, or from coarse to fine if negative."""
    if render_level >= 0:
        return levels.where(F.col("level") == min(render_level, deepest))
    return levels.where(F.col("level") <= deepest).orderBy("level")


def trilinear(at: list[Column], corners: list[Column]) -> Column:
    """Value at a place in [0, 1] per axis from corner values in bit order; null if any is."""
    out = None
    for c, v in enumerate(corners):
        w = reduce(lambda p, q: p * q, [x if c >> d & 1 else 1 - x for d, x in enumerate(at)])
        out = w * v if out is None else out + w * v
    return out


class Camera:
    """A 4 x 4 view matrix on the driver, and the point that the view turns about: reset, rotate, pan, zoom.

    The cube in view has an edge of 10. Movements are in pixels of the viewport, y upward.
    """

    def __init__(self, matrix: np.ndarray | None = None, centre: tuple[float, ...] = (0.0, 0.0, 0.0), viewport: tuple[int, int] = (320, 200), fov: float = 30.0, sensitivity: tuple[float, float, float] = (1.0, 1.0, 1.0)):
        self.matrix = np.eye(4) if matrix is None else np.array(matrix, float)
        self.centre, self.viewport, self.fov, self.sensitivity = np.array(centre, float), viewport, fov, sensitivity

    def _with(self, turn: np.ndarray, shift: np.ndarray, centre: np.ndarray | None = None) -> Camera:
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = turn, shift
        return Camera(m, tuple(self.centre if centre is None else centre), self.viewport, self.fov, self.sensitivity)

    @property
    def eye(self) -> np.ndarray:
        return -np.linalg.inv(self.matrix[:3, :3]) @ self.matrix[:3, 3]

    def reset(self) -> Camera:
        """Looking at the middle from (2, 1, 3), far enough for the whole cube, y upward."""
        back = np.array([2.0, 1.0, 3.0]) / np.sqrt(14.0)
        far = 10 * np.sqrt(3.0) * 1.01 / (2 * np.sin(np.deg2rad(self.fov) / 2))
        side = np.cross([0.0, 1.0, 0.0], back)
        side /= np.linalg.norm(side)
        turn = np.stack([side, np.cross(back, side), back])
        return self._with(turn, -turn @ (back * far), np.zeros(3))

    def rotated(self, dx: float, dy: float) -> Camera:
        """About the centre, by a quarter turn for a movement over the viewport's height."""
        turn, per = self.matrix[:3, :3], self.sensitivity[0] * np.pi / 2 / self.viewport[1]
        inverse = np.linalg.inv(turn)
        side, up = (inverse[:, i] / np.linalg.norm(inverse[:, i]) for i in (0, 1))
        axis = per * (dy * side - dx * up)
        angle = np.linalg.norm(axis)
        x, y, z = axis / angle if angle > 0 else (0.0, 0.0, 0.0)
        spin = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        step = np.eye(3) + np.sin(angle) * spin + (1 - np.cos(angle)) * spin @ spin
        eye = self.centre + step @ (self.eye - self.centre)
        made = turn @ step.T
        return self._with(made, -made @ eye)

    def panned(self, dx: float, dy: float) -> Camera:
        """Along the picture, and the centre with it, by as much as the pixels mean at the centre's distance."""
        inverse = np.linalg.inv(self.matrix[:3, :3])
        per = np.linalg.norm(self.eye - self.centre) * self.sensitivity[1] * np.tan(np.deg2rad(self.fov) / 2) / self.viewport[1]
        move = np.array([dx, dy, 0.0]) * per
        back = sum(inverse[:, i] / np.linalg.norm(inverse[:, i]) * move[i] for i in (0, 1))
        return self._with(self.matrix[:3, :3], self.matrix[:3, 3] + move, self.centre - back)

    def zoomed(self, delta: float) -> Camera:
        """Towards the centre by a factor of e for each ``delta`` of 1, away from it if negative."""
        turn = self.matrix[:3, :3]
        eye = self.centre + np.exp(-delta * self.sensitivity[2]) * (self.eye - self.centre)
        return self._with(turn, -turn @ eye)

    def upright(self, up: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> Camera:
        """From the same place, with ``up`` upward in the picture."""
        eye = self.eye
        back = eye - self.centre
        back = back / np.linalg.norm(back) if np.linalg.norm(back) > 0 else np.array([0.0, 0.0, 1.0])
        side = np.cross(up, back)
        if np.linalg.norm(side) == 0:  # looking along it: any side will do
            side = np.cross(np.eye(3)[int(np.argmin(np.abs(back)))], back)
        side /= np.linalg.norm(side)
        turn = np.stack([side, np.cross(back, side), back])
        return self._with(turn, -turn @ eye)


#: Bits of a mouse state, pixels of a zoom by 1, and the part of a zoom with the shift key.
LEFT, RIGHT, MIDDLE, SHIFT = 1, 2, 4, 8
ZOOM_PIXELS, WHEEL_STEP, SHIFT_PART = 100, 120, 0.1


class Mouse:
    """A camera moved by mouse states one after another: (ms, x, y, flags, wheel), y downward.

    The left button turns, the middle one pans, the right one zooms (finer with the shift key), the wheel zooms, a
    double click resets.
    """

    def __init__(self, camera: Camera):
        self.camera, self.x, self.y, self.flags, self.pressed = camera, 0.0, 0.0, 0, (-LONG_AGO_MS, -LONG_AGO_MS)

    def state(self, ms: float, x: float, y: float, flags: int, wheel: float = 0.0) -> Camera:
        double = False
        if self.flags == 0 and flags == LEFT:
            self.pressed = (ms, self.pressed[0])
        elif flags not in (0, LEFT):
            self.pressed = (ms - LONG_AGO_MS,) * 2
        elif self.flags == LEFT and flags == 0:
            double = ms - self.pressed[1] < DOUBLE_MS
        dx, dy = x - self.x, self.y - y
        held = dx != 0 or dy != 0
        part = SHIFT_PART if flags & SHIFT else 1.0
        if flags == LEFT and held and self.flags & LEFT:
            self.camera = self.camera.rotated(dx, dy)
        elif flags == MIDDLE and held and self.flags & MIDDLE:
            self.camera = self.camera.panned(dx, dy)
        elif flags & ~SHIFT == RIGHT and held and self.flags & RIGHT:
            self.camera = self.camera.zoomed(dy / ZOOM_PIXELS * part)
        elif flags == 0 and double:
            self.camera = self.camera.reset()
        elif flags in (0, SHIFT) and wheel:
            self.camera = self.camera.zoomed(wheel / WHEEL_STEP * part)
        self.x, self.y, self.flags = x, y, flags
        return self.camera
