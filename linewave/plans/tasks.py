"""Runs of many tasks, each with an image, colours, scales, extreme types and k of its own, as one plan.

Settings are a relation ``tasks(task_id, image_id, color1, color2, scales, k)``, with ``rows, cols, max, min`` flags where there are any;
in all results the task's number stands where an image's does, and unlike tasks go through the same stages.

Centring and the transform are linear, and a change of basis mixes the channels of a pixel. So every image is transformed once for each
set of scales that its tasks ask for, along rows and columns, and turned across once; a task's coefficients are these ones mixed by its basis. They
differ from those of its own changed lines by rounding errors (some 1e-13), and are never written: blocks of an image's coefficients meet
the tasks, and a map gives rows, points and graphs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewave.functions.scalars import colours_selected, scale_label
from linewave.operators import color, extrema, lines, neighbors, transform
from linewave.sources import sinks
from linewave.storage import written

FLAGS = ("rows", "cols", "max", "min")
DEFAULT_K = 5
KINDS = ("means", "coefs", "points", "neighbours")
#: Values of a channel in a block of lines at most, but for one line; a matrix of one such block has no more points than a small group.
BLOCK = 2 * neighbors.SMALL
#: Tasks (on average) that a block meets at a time, rows of a partition, partitions, values mixed at a time, and those searched for peaks at a time.
PART, ROWS, MOST, VALUES, CACHED = 256, 2, 10000, 1 << 18, 1 << 15
_WAVE = ["setting", "axis", "direction", "scale", "channel"]
_GROUP = "image_id long, direction int, channel int, scale double"


@dataclass
class _Step:
    """Some tasks' coefficients of a block of lines: ``values`` (sets, channels, values), the lines one behind the other, each set once; ``which`` is a task's."""

    axis: int
    direction: int
    scale: float
    lines: np.ndarray
    sizes: np.ndarray
    channels: np.ndarray
    tasks: np.ndarray
    k: np.ndarray
    asked: np.ndarray
    notes: pa.Array
    values: np.ndarray
    which: np.ndarray

    def keys(self, task: np.ndarray, channel: np.ndarray) -> list[pa.Array]:
        """Matrix keys of rows of these tasks and channels (places in the arrays)."""
        n = len(task)
        return [pa.array(self.tasks[task]), pa.array(np.full(n, self.direction, np.int32)), pa.array(self.channels[channel]), pa.array(np.full(n, self.scale))]

    def peaks(self) -> Iterator[_Peaks]:
        """The peaks of the asked-for types."""
        each = transform.rounded_values(self.values)
        own, n_channels = len(self.sizes), len(self.channels)
        for kind, (axis, sign) in extrema.TYPES.items():
            asked = np.flatnonzero(self.asked[:, list(extrema.TYPES).index(kind)])
            if axis != self.axis or not len(asked):
                continue
            parts, among = [], np.unique(self.which[asked])
            step = max(1, CACHED // max(1, each[0].size))
            for lo in range(0, len(among), step):
                some = among[lo : lo + step]
                sizes = np.tile(self.sizes, len(some) * n_channels)
                starts, flat = np.cumsum(sizes) - sizes, sign * each[some].ravel()
                line, pos = extrema.peak_positions(extrema.upper_envelopes(flat, starts, sizes), starts, sizes)
                matrix = line // own
                parts.append((some[matrix // n_channels] * n_channels + matrix % n_channels, self.lines[line % own], pos))
            matrix, line, pos = (np.concatenate(p) for p in zip(*parts))
            groups, first, sizes = np.unique(matrix, return_index=True, return_counts=True)
            idx = np.arange(len(matrix)) - np.repeat(first, sizes)
            begin = np.searchsorted(matrix, self.which[asked] * n_channels)
            at, point = spread(begin, np.searchsorted(matrix, (self.which[asked] + 1) * n_channels) - begin)
            yield _Peaks(self, kind, matrix, *((pos, line) if axis == 0 else (line, pos)), idx, groups, sizes, asked[at], point)


@dataclass
class _Peaks:
    """Points of one type of a step: (matrix = set * channels + channel, x, y, idx), in order, with the sizes of the matrices that have any; rows ``point`` of them are those of the tasks ``task``."""

    step: _Step
    kind: str
    matrix: np.ndarray
    x: np.ndarray
    y: np.ndarray
    idx: np.ndarray
    groups: np.ndarray
    sizes: np.ndarray
    task: np.ndarray
    point: np.ndarray

    def keys(self, row: np.ndarray | slice = slice(None)) -> list[pa.Array]:
        """Group keys of the tasks' rows, or of some of them."""
        task = self.task[row]
        return [*self.step.keys(task, self.matrix[self.point[row]] % len(self.step.channels)), pa.repeat(self.kind, len(task))]

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(counts, at, far, rank): the neighbours of the tasks' rows, as many as each task asks for; a set is searched once, for the most that any does."""
        own = self.step.k[self.task]
        k = np.zeros(len(self.groups), dtype=np.int64)
        group = np.repeat(np.arange(len(self.groups)), self.sizes)
        np.maximum.at(k, group[self.point], own)
        counts, at, far = neighbors.near_lists(self.x.astype(np.int64), self.y.astype(np.int64), self.idx, self.sizes, k)
        begin, many = (np.cumsum(counts) - counts)[self.point], np.minimum(np.maximum(own, 0), counts[self.point])
        row, listed = spread(begin, many)
        return many, at[listed], far[listed], listed - begin[row]


def spread(begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of the numbers of ranges that begin at ``begin`` and have ``counts`` each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)


def _steps(batch: pa.RecordBatch) -> Iterator[_Step]:
    column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    of = lambda name, row: column[name][row].values
    for row in range(batch.num_rows):
        axis, direction, scale, channel = (column[c][row].as_py() for c in ("axis", "direction", "scale", "channel"))
        channels = np.arange(3, dtype=np.int32) if channel < 0 else np.array([channel], np.int32)
        at, sizes = (of(c, row).to_numpy().reshape(len(channels), -1) for c in ("lines", "sizes"))
        if (at != at[0]).any() or (sizes != sizes[0]).any():
            raise ValueError("the channels of an image must have the same lines")
        raw = of("c", row).to_numpy().reshape(len(channels), -1)
        own = of("own", row)
        bases = None
        if channel < 0:
            bases = own.field(3).flatten().to_numpy().reshape(-1, 9)
            order = np.lexsort(bases.T)
            if (bases[order[1:]] == bases[order[:-1]]).all(axis=1).any():
                # Tasks of one basis lie together.
                own, bases = own.take(pa.array(order)), bases[order]
        tasks, k, asked, notes = (own.field(i) for i in (0, 1, 2, 4))
        asked = asked.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(extrema.TYPES))
        each = max(1, VALUES // max(1, raw.size))
        for lo in range(0, len(tasks), each):
            some = slice(lo, lo + each)
            if bases is None:
                which, values = np.zeros(len(tasks[some]), dtype=np.int64), raw[None]
            else:
                new = np.concatenate([[True], (bases[some][1:] != bases[some][:-1]).any(axis=1)])
                which, b = np.cumsum(new) - 1, bases[some][new].reshape(-1, 3, 3, 1)
                values = b[:, 0] * raw[0] + b[:, 1] * raw[1] + b[:, 2] * raw[2]
            yield _Step(axis, direction, scale, at[0], sizes[0].astype(np.int64), channels, tasks[some].to_numpy(), k[some].to_numpy().astype(np.int64), asked[some], notes[some], values + 0.0, which)


def _coefficients(digits: int | None, text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _steps(batch):
                n_tasks, n_channels, n = len(s.tasks), len(s.channels), len(s.lines)
                place = np.arange(n_tasks * n_channels * n)
                ends = np.concatenate([[0], np.cumsum(np.tile(s.sizes, n_tasks * n_channels))]).astype(np.int32)
                values = (s.values if digits is None or text else transform.rounded_values(s.values, digits))
                values = values if len(values) == n_tasks else values[s.which]
                task = place // (n * n_channels)
                arrays = [*s.keys(task, place // n % n_channels), pa.array(s.lines[place % n], pa.int32()), sinks.decimals(values.ravel(), ends, digits) if text else pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel())), s.notes.take(pa.array(task))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*transform.KEYS, "text" if text else "c", "note"])

    return run


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in _steps(batch):
            for p in s.peaks():
                own = [pa.array(v[p.point], pa.int32()) for v in (p.idx, p.x, p.y)]
                yield pa.RecordBatch.from_arrays([*p.keys(), *own, s.notes.take(pa.array(p.task))], names=[*neighbors.GROUP, "point_idx", "x", "y", "note"])


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in _steps(batch):
            for p in s.peaks():
                counts, at, far, _ = p.near()
                x, y = p.x.astype(np.int64), p.y.astype(np.int64)
                nn = neighbors.list_array(counts, at, far, x, y, p.idx)
                n = np.repeat(p.sizes, p.sizes)
                own = [pa.array(p.idx[p.point], pa.int32()), *(pa.array(v[p.point]) for v in (x, y, n)), nn, pa.array(s.k[p.task], pa.int32()), s.notes.take(pa.array(p.task))]
                yield pa.RecordBatch.from_arrays([*p.keys(), *own], names=[*neighbors.GROUP, "point_idx", "x", "y", "n", "nn", "k", "note"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in _steps(batch):
            for p in s.peaks():
                counts, at, far, rank = p.near()
                row = np.repeat(np.arange(len(counts)), counts)
                own = [pa.array(v, pa.int32()) for v in (p.idx[p.point[row]], rank + 1, p.idx[at])]
                yield pa.RecordBatch.from_arrays([*p.keys(row), *own, pa.array(np.sqrt(far.astype(float)))], names=neighbors.NEIGHBOURS)


@dataclass
class TaskRun:
    """Relations of a run; ``image_id`` is the task's number. ``waves`` and ``tasks`` are written for reuse, the rest is lazy.

    ``waves`` has the coefficients of the images, before a change of basis, in blocks of lines along both axes, with the numbers of the
    settings (image, scales, whether the basis changes) that the tasks have too.
    """

    tasks: DataFrame
    lines: DataFrame
    means: DataFrame
    waves: DataFrame

    def _met(self, which: Column | None = None, note: Column | None = None) -> DataFrame:
        """Blocks, those of ``which``, with some of their tasks each; ``note`` is a text of the tasks that goes with all results."""
        note = F.lit(None).cast("string") if note is None else note
        asked = F.array(*(F.col("rows" if axis == 0 else "cols") & F.col("max" if sign > 0 else "min") for axis, sign in extrema.TYPES.values()))
        part = F.pmod(F.xxhash64("task_id"), F.col("parts"))
        own = F.struct(F.col("task_id"), F.col("k").cast("int").alias("k"), asked.alias("asked"), F.flatten("basis").alias("basis"), note.alias("note"))
        tasks = self.tasks.groupBy("setting", part.alias("part")).agg(F.collect_list(own).alias("own"))
        blocks = self.waves if which is None else self.waves.where(which)
        # First the numbers of the blocks alone: unlike blocks of one setting then meet their tasks in unlike partitions.
        pairs = tasks.join(blocks.select("setting", "wave"), "setting").drop("setting")
        partitions = min(MOST, pairs.count() // ROWS + 1)
        return pairs.join(blocks, "wave").select(*_WAVE[1:], "lines", "sizes", "c", "own").repartition(partitions)

    @cached_property
    def _beyond(self) -> bool:
        """Whether any matrix is in several blocks, or has more points than a small group may have."""
        return self.waves.where("not whole").select("wave").first() is not None

    def coefficients(self, digits: int | None = None) -> DataFrame:
        """(matrix keys, line, c) of the lines that were transformed, rounded to ``digits`` if that is given."""
        return self._met(F.col("axis") == F.col("direction")).mapInArrow(_coefficients(digits), f"{transform.COEFS}, note string").drop("note")

    def coefficient_text(self, note: Column | None = None) -> DataFrame:
        """(matrix keys, line, text, note): :func:`sinks.coefficient_text`, written where the coefficients are worked out."""
        met = self._met(F.col("axis") == 0, note)
        return met.mapInArrow(_coefficients(3, text=True), f"{_GROUP}, line int, text string, note string")

    @property
    def coefs(self) -> DataFrame:
        return self.coefficients()

    def _numbered(self, whole: bool, note: Column | None = None) -> DataFrame:
        met = self._met(F.col("whole") if whole else ~F.col("whole"), note)
        return met.mapInArrow(_points, f"{_GROUP}, extreme_type string, point_idx int, x int, y int, note string")

    @cached_property
    def _large(self) -> DataFrame:
        """The points of matrices beyond one block, numbered by a window."""
        return written(extrema.numbered(self._numbered(False).drop("note", "point_idx")), "points")

    def _named(self, df: DataFrame, note: Column | None, *more: str) -> DataFrame:
        note = F.lit(None).cast("string") if note is None else note
        return df.join(self.tasks.select(F.col("task_id").alias("image_id"), *more, note.alias("note")), "image_id")

    def numbered(self, note: Column | None = None) -> DataFrame:
        """(matrix keys, extreme_type, point_idx, x, y, note): the points of the asked-for types. Those within one block are numbered where they are found."""
        points = self._numbered(True, note)
        return points.unionByName(self._named(self._large, note)) if self._beyond else points

    @property
    def points(self) -> DataFrame:
        return self.numbered().drop("note")

    def graph(self, note: Column | None = None) -> DataFrame:
        """(matrix keys, extreme_type, point_idx, x, y, n, nn, k, note): every point with its task's k nearest neighbours; points of none are left out."""
        near = self._met(F.col("whole"), note).mapInArrow(_graphs, f"{_GROUP}, extreme_type string, {neighbors.LISTS}, k int, note string")
        return (near.unionByName(self._large_graph(note)) if self._beyond else near).where(F.size("nn") > 0)

    def _large_graph(self, note: Column | None = None) -> DataFrame:
        """:meth:`graph` of the matrices beyond one block."""
        most = self.tasks.agg(F.max("k").alias("k")).first().k or 0
        more = self._named(neighbors.graph(self._large, max(0, most)), note, F.col("k").cast("int").alias("k"))
        return more.withColumn("nn", F.slice("nn", F.lit(1), F.greatest(F.lit(0), F.col("k"))))

    def neighbours(self) -> DataFrame:
        """The k nearest neighbours of every point, k being its task's."""
        near = self._met(F.col("whole")).mapInArrow(_neighbours, f"{_GROUP}, extreme_type string, {neighbors.RANKED}")
        return near.unionByName(neighbors.ranked(self._large_graph())) if self._beyond else near

    def files(self, name: Column, began: Column, kinds: tuple[str, ...] = KINDS) -> DataFrame:
        """(folder, file, line, text): the results as text files, in the folders of their tasks and scales.

        ``name`` and ``began`` are columns of the tasks. ``kinds`` are some of means, coefs, points and neighbours; means lie in the task's
        own folder. Types without points and graphs of fewer than two have no file, tasks whose k is 0 no graphs.
        """
        label = scale_label(F.col("scale"), False)
        task = sinks.task_folder(name, began)
        scale = sinks.scale_folder(F.col("note"), label)
        made = {
            "means": lambda: (self._named(sinks.means_text(self.means), task), F.col("note"), F.col("file")),
            "coefs": lambda: (self.coefficient_text(task), scale, sinks.coefficient_file(label)),
            "points": lambda: (sinks.point_text(self.numbered(task)), scale, sinks.point_file(label)),
            "neighbours": lambda: (sinks.graph_text(self.graph(task), "k", label), scale, sinks.neighbour_file(label)),
        }
        out = None
        for kind in kinds:
            text, folder, file = made[kind]()
            part = text.select(folder.alias("folder"), file.alias("file"), F.col("line").cast("int").alias("line"), "text")
            out = part if out is None else out.unionByName(part)
        return out


def is_ready(tasks: DataFrame) -> Column:
    """Whether a task has an image and a scale."""
    return F.col("image_id").isNotNull() & (F.coalesce(F.size("scales"), F.lit(0)) > 0)


def run_tasks(rows: DataFrame, tasks: DataFrame, skip: bool = False) -> TaskRun:
    """Change of basis, centring, transform, extrema and neighbours of every task over its image.

    The basis is changed where both colours are there. Flags that are null or missing are true; a null k is 5. A task without image or
    scales is refused with an error, or left out with ``skip``; one whose image is not in ``rows`` gives nothing. Task numbers must be
    unlike; an image may have many tasks. No tasks or no rows give empty relations.
    """
    flag = lambda c: (F.coalesce(F.col(c), F.lit(True)) if c in tasks.columns else F.lit(True)).alias(c)
    ready = is_ready(tasks)
    if not skip and (waiting := tasks.where(~ready).select("task_id").first()) is not None:
        raise ValueError(f"task {waiting.task_id} has no image or no scales")
    other = [c for c in tasks.columns if c not in (*FLAGS, "k", "scales")]
    own = tasks.where(ready).select(*other, F.col("scales").cast("array<double>").alias("scales"), F.coalesce("k", F.lit(DEFAULT_K)).alias("k"), *map(flag, FLAGS))
    own = own.repartition(tasks.sparkSession.sparkContext.defaultParallelism)  # a small file of tasks has many bases to work out
    basis = F.when(colours_selected(F.col("color1"), F.col("color2")), color.basis_of(F.col("color1"), F.col("color2")))
    own = own.withColumn("basis", basis).withColumn("changed", F.col("basis").isNotNull())
    same = ["image_id", "scales", "changed"]
    settings = own.groupBy(*same).agg(F.ceil(F.count("*") / PART).alias("parts")).withColumn("setting", F.monotonically_increasing_id())
    settings = written(settings, "settings")
    own = written(own.join(settings, same), "tasks")

    placed = rows.join(own.select("task_id", "image_id", "basis"), "image_id").drop("image_id").withColumnRenamed("task_id", "image_id")
    changed = color.in_basis(placed, "basis").select("image_id", "y", "r", "g", "b")
    signals = lines.row_lines(changed).unionByName(lines.column_lines(changed))
    return TaskRun(own, signals, lines.line_means(signals), _waves(rows, settings))


def _waves(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """The coefficients of every setting's image, in blocks of lines along rows (axis 0) and columns (1) of its matrices.

    (setting, axis, direction, scale, channel, lines, sizes, c, whole, wave): where the basis changes, the three channels are one behind
    the other and ``channel`` is -1; else every channel is by itself, as it may be there without the others.
    """
    placed = rows.join(settings.select("image_id", "setting", "changed"), "image_id").where("not changed or (r is not null and g is not null and b is not null)")
    placed = placed.drop("image_id").withColumnRenamed("setting", "image_id")
    signals = lines.row_lines(placed).unionByName(lines.column_lines(placed))
    own = settings.select(F.col("setting").alias("image_id"), "scales")
    coefs = written(transform.morlet_each(lines.centred(signals).join(own, "image_id")), "coefs")
    along = [extrema.matrix_lines(coefs, axis).withColumn("axis", F.lit(axis)) for axis in (0, 1)]
    every = along[0].unionByName(along[1]).withColumnRenamed("image_id", "setting").join(settings.select("setting", "changed"), "setting")
    widths = every.groupBy("setting", "axis", "direction", "scale").agg(F.max(F.size("c")).alias("widest"), F.max("line").alias("last"))
    at_once = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.col("widest")))
    every = every.join(widths, ["setting", "axis", "direction", "scale"]).withColumns({"block": F.floor(F.col("line") / at_once), "whole": (F.col("last") + 1) * F.col("widest") <= BLOCK})
    every = every.withColumns({"part": F.when(F.col("changed"), F.lit(-1)).otherwise(F.col("channel"))})
    blocks = every.groupBy("setting", "axis", "direction", "scale", "part", "block", "whole").agg(F.array_sort(F.collect_list(F.struct("channel", "line", "c"))).alias("l"))
    packed = blocks.select("setting", "axis", "direction", "scale", F.col("part").alias("channel"), F.col("l.line").alias("lines"), F.transform("l", lambda s: F.size(s["c"])).alias("sizes"), F.flatten(F.col("l.c")).alias("c"), "whole")
    return written(packed.withColumn("wave", F.monotonically_increasing_id()), "waves")
