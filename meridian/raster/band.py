"""Rasters in cell form: rows (x, y, v) with a band's metadata on the driver.

Values are doubles; a cell type narrows them: rounded half away from zero, saturated, NaN to 0.
A cell that has no row is missing; a cell equal to the sentinel is nodata.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges of the integer cell types.
RANGES = {"u8": (0, 255), "u16": (0, 65535), "i16": (-32768, 32767), "u32": (0, 4294967295), "i32": (-2147483648, 2147483647)}


@dataclass(frozen=True)
class GeoTransform:
    """North-up: origin is the upper left corner, cells are positive sizes."""

    origin_x: float = 0.0
    origin_y: float = 0.0
    cell_width: float = 1.0
    cell_height: float = 1.0

    def __post_init__(self) -> None:
        if not (self.cell_width > 0 and self.cell_height > 0 and self.cell_width < float("inf") and self.cell_height < float("inf")):
            raise ValueError("cell sizes must be positive and finite")

    @classmethod
    def from_gdal(cls, c: tuple[float, ...]) -> GeoTransform:
        if c[2] or c[4]:
            raise ValueError("rotated grids aren't supported")
        return cls(c[0], c[3], c[1], abs(c[5]))

    def to_gdal(self) -> tuple[float, ...]:
        return (self.origin_x, self.cell_width, 0.0, self.origin_y, 0.0, -self.cell_height)

    def to_world(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The corner of a cell."""
        return self.origin_x + x * self.cell_width, self.origin_y - y * self.cell_height

    def center(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.to_world(x + 0.5, y + 0.5)

    def to_cell(self, wx: Column, wy: Column) -> tuple[Column, Column]:
        """Fractional."""
        return (wx - self.origin_x) / self.cell_width, (self.origin_y - wy) / self.cell_height

    def downsampled(self, factor: float) -> GeoTransform:
        if not factor > 0:
            raise ValueError("the factor must be positive")
        return replace(self, cell_width=self.cell_width * factor, cell_height=self.cell_height * factor)


@dataclass(frozen=True)
class BandMeta:
    width: int
    height: int
    cell_type: str = "f64"
    nodata: float | None = None
    transform: GeoTransform = GeoTransform()
    epsg: int | None = None

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """(xmin, ymin, xmax, ymax) in world units."""
        g = self.transform
        return g.origin_x, g.origin_y - self.height * g.cell_height, g.origin_x + self.width * g.cell_width, g.origin_y

    @property
    def missing(self) -> float:
        """What a result without a value holds: the sentinel, or 0."""
        return 0.0 if self.nodata is None else self.nodata

    def is_nodata(self, v: Column) -> Column:
        if self.nodata is None:
            return F.lit(False)
        return F.isnan(v) if self.nodata != self.nodata else v == self.nodata

    def valid(self, v: Column) -> Column:
        """The value, null where it is nodata."""
        return F.when(~self.is_nodata(v), v)

    def narrow(self, v: Column) -> Column:
        if self.cell_type not in RANGES:
            return v.cast("float").cast("double") if self.cell_type == "f32" else v
        low, high = RANGES[self.cell_type]
        return F.when(F.isnan(v), 0.0).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.round(v))))

    def filled(self, v: Column) -> Column:
        return F.coalesce(v, F.lit(float(self.missing)))


def binary(left: DataFrame, right: DataFrame, a: BandMeta, b: BandMeta, op) -> DataFrame:
    """``op`` on cells of the same place; nodata on either side gives the left band's sentinel or 0."""
    if (a.width, a.height) != (b.width, b.height):
        raise ValueError("the bands' shapes differ")
    both = left.select("x", "y", F.col("v").alias("l")).join(right.select("x", "y", F.col("v").alias("r")), ["x", "y"])
    return both.select("x", "y", a.filled(a.narrow(op(a.valid(F.col("l")), b.valid(F.col("r"))))).alias("v"))


def add(l: DataFrame, r: DataFrame, a: BandMeta, b: BandMeta) -> DataFrame:  # noqa: E741
    return binary(l, r, a, b, lambda x, y: x + y)


def subtract(l: DataFrame, r: DataFrame, a: BandMeta, b: BandMeta) -> DataFrame:  # noqa: E741
    return binary(l, r, a, b, lambda x, y: x - y)


def multiply(l: DataFrame, r: DataFrame, a: BandMeta, b: BandMeta) -> DataFrame:  # noqa: E741
    return binary(l, r, a, b, lambda x, y: x * y)


def divide(l: DataFrame, r: DataFrame, a: BandMeta, b: BandMeta) -> DataFrame:  # noqa: E741
    """By zero gives nodata."""
    return binary(l, r, a, b, F.try_divide)


def minimum(l: DataFrame, r: DataFrame, a: BandMeta, b: BandMeta) -> DataFrame:  # noqa: E741
    return binary(l, r, a, b, lambda x, y: F.when(y < x, y).when(y.isNotNull(), x))


def maximum(l: DataFrame, r: DataFrame, a: BandMeta, b: BandMeta) -> DataFrame:  # noqa: E741
    return binary(l, r, a, b, lambda x, y: F.when(y > x, y).when(y.isNotNull(), x))


def unary(cells: DataFrame, m: BandMeta, op) -> DataFrame:
    """``op`` on valid cells; nodata stays."""
    return cells.select("x", "y", F.when(m.is_nodata(F.col("v")), F.col("v")).otherwise(m.narrow(op(F.col("v")))).alias("v"))


def scale(cells: DataFrame, m: BandMeta, factor: float) -> DataFrame:
    return unary(cells, m, lambda v: v * float(factor))


def offset(cells: DataFrame, m: BandMeta, delta: float) -> DataFrame:
    return unary(cells, m, lambda v: v + float(delta))


def clamp(cells: DataFrame, m: BandMeta, low: float, high: float) -> DataFrame:
    if low > high:
        raise ValueError("low is above high")
    return unary(cells, m, lambda v: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)))


def reclassify(cells: DataFrame, m: BandMeta, rules: list[tuple[float, float, float]], fallback: float | None = None) -> DataFrame:
    """Rules (min, max, to) for min <= v < max, the first that fits; else the fallback, else nodata."""
    out = F.lit(float(m.missing if fallback is None else fallback))
    for low, high, to in reversed(rules):
        out = F.when((F.col("v") >= low) & (F.col("v") < high), F.lit(float(to))).otherwise(out)
    return unary(cells, m, lambda _: out)


def focal(cells: DataFrame, m: BandMeta, radius: int, stats: dict[str, str]) -> DataFrame:
    """Statistics over (2r+1)^2 windows that shrink at edges and skip nodata.

    ``stats``: output column to one of mean, min, max, sum, range, std (population), median.  A row of
    windows is a range frame along x; the rows above and below come by shifting each row to its
    2r+1 targets first, so cells of one output row share a partition (y) and the frame is sorted, not joined.
    """
    shifted = cells.withColumn("_v", m.valid(F.col("v"))).withColumn("_t", F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius)))
    w = Window.partitionBy("_t").orderBy("x").rangeBetween(-radius, radius)
    kinds = {
        "mean": lambda c: F.avg(c).over(w),
        "min": lambda c: F.min(c).over(w),
        "max": lambda c: F.max(c).over(w),
        "sum": lambda c: F.sum(c).over(w),
        "range": lambda c: F.max(c).over(w) - F.min(c).over(w),
        "std": lambda c: F.stddev_pop(c).over(w),
        "median": lambda c: _median(F.sort_array(F.collect_list(c).over(w))),
    }
    made = shifted.select("x", "y", "_t", *[m.filled(m.narrow(kinds[s](F.col("_v")))).alias(n) for n, s in stats.items()])
    return made.where(F.col("_t") == F.col("y")).drop("_t")


def _median(ordered: Column) -> Column:
    n = F.size(ordered)
    half = F.floor(n / 2).cast("int")
    even = (F.get(ordered, half - 1) + F.get(ordered, half)) / 2
    return F.when(n == 0, None).when(n % 2 == 1, F.get(ordered, half)).otherwise(even)


def focal_kernel(cells: DataFrame, m: BandMeta, kernel: list[list[float]]) -> DataFrame:
    """Weighted sum under an odd kernel, not flipped; any missing cell under it gives nodata."""
    h, w = len(kernel), len(kernel[0])
    if h % 2 == 0 or w % 2 == 0 or any(len(r) != w for r in kernel):
        raise ValueError("the kernel must be rectangular with odd sides")
    weights = F.array(*[F.struct(F.lit(i - w // 2).alias("dx"), F.lit(j - h // 2).alias("dy"), F.lit(float(kernel[j][i])).alias("k")) for j in range(h) for i in range(w)])
    spread = cells.withColumn("_v", m.valid(F.col("v"))).withColumn("_w", F.explode(weights))
    moved = spread.select((F.col("x") - F.col("_w.dx")).alias("x"), (F.col("y") - F.col("_w.dy")).alias("y"), (F.col("_v") * F.col("_w.k")).alias("p"), ((F.col("_w.dx") == 0) & (F.col("_w.dy") == 0)).alias("own"))
    summed = moved.groupBy("x", "y").agg(F.sum("p").alias("s"), F.count("p").alias("n"), F.max("own").alias("own")).where("own")
    return summed.select("x", "y", m.filled(m.narrow(F.when(F.col("n") == h * w, F.col("s")))).alias("v"))


def stats(cells: DataFrame, m: BandMeta) -> DataFrame:
    """One row: valid_count (NaN counts unless it is the sentinel), and min, max, mean over valid cells that aren't NaN."""
    v = m.valid(F.col("v"))
    number = F.when(~F.isnan(v), v)
    return cells.agg(F.count(v).alias("valid_count"), F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"))


def sample_nearest(positions: DataFrame, cells: DataFrame, m: BandMeta) -> DataFrame:
    """``positions`` (wx, wy and more) with ``v`` of the cell they lie in; east and south edges are outside: null, as is nodata."""
    fx, fy = m.transform.to_cell(F.col("wx"), F.col("wy"))
    at = positions.withColumns({"_x": F.floor(fx).cast("int"), "_y": F.floor(fy).cast("int")})
    found = cells.select(F.col("x").alias("_x"), F.col("y").alias("_y"), m.valid(F.col("v")).alias("v"))
    return at.join(found, ["_x", "_y"], "left").drop("_x", "_y")


def sample_bilinear(positions: DataFrame, cells: DataFrame, m: BandMeta, key: str) -> DataFrame:
    """(key, v) from the four cells around; null outside or if one of the four is nodata.

    In the last half column or row the four are the edge's cells alone.
    """
    fx, fy = m.transform.to_cell(F.col("wx"), F.col("wy"))
    inside = (fx >= 0) & (fx < m.width) & (fy >= 0) & (fy < m.height)

    def split(f: Column, n: int) -> tuple[Column, Column]:
        low = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(f - 0.5))).cast("int")
        return low, F.when((f <= 0.5) | (low == n - 1), 0.0).otherwise(f - 0.5 - low)

    ix, tx = split(fx, m.width)
    iy, ty = split(fy, m.height)
    corner = lambda dx, dy, wx, wy: F.struct(F.least(ix + dx, F.lit(m.width - 1)).alias("x"), F.least(iy + dy, F.lit(m.height - 1)).alias("y"), (wx * wy).alias("w"))
    four = F.array(corner(0, 0, 1 - tx, 1 - ty), corner(1, 0, tx, 1 - ty), corner(0, 1, 1 - tx, ty), corner(1, 1, tx, ty))
    asked = positions.where(inside).select(key, F.explode(four).alias("c")).select(key, F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.w").alias("w"))
    found = asked.join(cells.select("x", "y", m.valid(F.col("v")).alias("v")), ["x", "y"], "left")
    summed = found.groupBy(key).agg(F.when(F.count("v") == 4, F.sum(F.col("v") * F.col("w"))).alias("v"))
    return positions.select(key).join(summed, key, "left")


def sample_average(areas: DataFrame, cells: DataFrame, m: BandMeta, key: str) -> DataFrame:
    """(key, v): mean of the valid cells under world rectangles (key, xmin, ymin, xmax, ymax); null where there are none.

    At least the cell of the upper left corner counts, far edges are exclusive, and rectangles outside
    fall on the nearest edge cells.
    """
    left, top = m.transform.to_cell(F.col("xmin"), F.col("ymax"))
    right, bottom = m.transform.to_cell(F.col("xmax"), F.col("ymin"))

    def span(a: Column, b: Column, n: int) -> tuple[Column, Column]:
        first = F.greatest(F.lit(0), F.least(F.floor(a), F.lit(n - 1)))
        return first.cast("int"), F.greatest(F.greatest(F.lit(1), F.least(F.ceil(b), F.lit(n))), first + 1).cast("int")

    finite = F.lit(True)
    for c in (left, top, right, bottom):
        finite = finite & (F.abs(c) < float("inf"))
    (x0, x1), (y0, y1) = span(left, right, m.width), span(top, bottom, m.height)
    under = areas.where(finite).select(key, F.explode(F.sequence(x0, x1 - 1)).alias("x"), y0.alias("_y0"), y1.alias("_y1"))
    tallest = under.agg(F.max(F.col("_y1") - F.col("_y0"))).first()[0] or 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(tallest.bit_length() - 1))).alias("_level")
    # the cells of a column in blocks of 1, 2, 4, ... ; a rectangle takes two of each size at most
    power = F.pow(F.lit(2.0), F.col("_level"))
    valued = cells.select("x", "y", m.valid(F.col("v")).alias("v")).where("v is not null")
    blocks = valued.select("x", "y", "v", levels).groupBy("x", "_level", F.floor(F.col("y") / power).cast("int").alias("_block")).agg(F.sum("v").alias("_sum"), F.count("v").alias("_n"))
    under = under.select("*", levels).withColumns({"_l": F.ceil(F.col("_y0") / power).cast("int"), "_r": F.floor(F.col("_y1") / power).cast("int")})
    l, r = F.col("_l"), F.col("_r")  # noqa: E741
    taken = F.array(F.when((l % 2 == 1) & (l < r), l), F.when((r % 2 == 1) & (l + l % 2 < r), r - 1))
    wanted = under.select(key, "x", "_level", F.explode(F.array_compact(taken)).alias("_block"))
    found = wanted.join(blocks.hint("merge"), ["x", "_level", "_block"]).groupBy(key).agg((F.sum("_sum") / F.sum("_n")).alias("v"))
    return areas.select(key).join(found, key, "left")


def resample_to(cells: DataFrame, m: BandMeta, target: BandMeta, method: str = "nearest") -> DataFrame:
    """Values on any other grid of the same coordinate system: its size and transform are those of ``target``.

    ``method``: nearest or bilinear at the centres of the target's cells, or average over their areas.
    Cells without a value get the source's sentinel or 0; cell type and sentinel are the source's.
    """
    if target.width < 1 or target.height < 1:
        raise ValueError("the target grid has no cells")
    session = cells.sparkSession
    at = session.range(target.width * target.height).select(F.col("id").alias("_t"), (F.col("id") % target.width).cast("int").alias("_tx"), F.floor(F.col("id") / target.width).cast("int").alias("_ty"))
    if method == "average":
        x0, y1 = target.transform.to_world(F.col("_tx"), F.col("_ty"))
        x1, y0 = target.transform.to_world(F.col("_tx") + 1, F.col("_ty") + 1)
        found = sample_average(at.select("_t", x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax")), cells, m, "_t")
    elif method in ("nearest", "bilinear"):
        wx, wy = target.transform.center(F.col("_tx"), F.col("_ty"))
        placed = at.select("_t", wx.alias("wx"), wy.alias("wy"))
        found = sample_nearest(placed, cells, m).select("_t", "v") if method == "nearest" else sample_bilinear(placed, cells, m, "_t")
    else:
        raise ValueError(f"unknown method {method!r}")
    value = F.col("v") if method == "nearest" else m.narrow(F.col("v"))
    return found.select((F.col("_t") % target.width).cast("int").alias("x"), F.floor(F.col("_t") / target.width).cast("int").alias("y"), m.filled(value).alias("v"))


def resample(cells: DataFrame, m: BandMeta, width: int, height: int, method: str = "nearest") -> DataFrame:
    """The same extent on a grid of another size."""
    if width < 1 or height < 1:
        raise ValueError("the target grid has no cells")
    g = m.transform
    sized = replace(g, cell_width=g.cell_width * m.width / width, cell_height=g.cell_height * m.height / height)
    return resample_to(cells, m, replace(m, width=width, height=height, transform=sized), method)


def overview(cells: DataFrame, m: BandMeta, factor: int, method: str = "average") -> DataFrame:
    """Cells ``factor`` times as wide and high by any method; :func:`downsample` is the shorter way to averages."""
    if factor < 1:
        raise ValueError("the factor must be 1 or more")
    target = replace(m, width=-(-m.width // factor), height=-(-m.height // factor), transform=m.transform.downsampled(factor))
    return resample_to(cells, m, target, method)


def downsample(cells: DataFrame, m: BandMeta, factor: int) -> DataFrame:
    """Average of the valid cells of each factor x factor block; the last blocks may be smaller."""
    if factor < 1:
        raise ValueError("the factor must be 1 or more")
    block = cells.groupBy(F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y"))
    return block.agg(m.filled(m.narrow(F.avg(m.valid(F.col("v"))))).alias("v"))


def resample_nearest(cells: DataFrame, m: BandMeta, width: int, height: int) -> DataFrame:
    """The same extent on a grid of another size: every source cell is spread to the target cells whose centres lie in it."""
    sx, sy = m.width / width, m.height / height

    def targets(c: str, s: float, n: int) -> Column:
        first = F.greatest(F.ceil(F.col(c) / s - 0.5), F.lit(0)).cast("int")
        last = F.least(F.ceil((F.col(c) + 1) / s - 0.5) - 1, F.lit(n - 1)).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    return cells.select(F.explode(targets("x", sx, width)).alias("_x"), "y", "v").select(F.col("_x").alias("x"), F.explode(targets("y", sy, height)).alias("_y"), "v").select("x", F.col("_y").alias("y"), "v")
