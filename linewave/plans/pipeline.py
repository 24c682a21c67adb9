"""The whole analysis of a set of images as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from linewave.operators import color, extrema, lines, neighbors, transform
from linewave.storage import written


@dataclass(frozen=True)
class Options:
    """What to work out. ``types`` names the extreme types; ``colours`` asks for the change of basis."""

    scales: tuple[float, ...] = tuple(float(s) for s in range(1, 11))
    directions: tuple[int, ...] = (0, 1)
    types: tuple[str, ...] = tuple(extrema.TYPES)
    channels: tuple[int, ...] | None = None
    colours: tuple[tuple[float, float, float], tuple[float, float, float]] | None = None
    k: int = 5


@dataclass
class Analysis:
    """Relations of a run: lazy but for ``coefs`` and ``points``, which are written for reuse."""

    lines: DataFrame
    means: DataFrame
    coefs: DataFrame
    points: DataFrame
    options: Options = field(default_factory=Options)

    def neighbours(self) -> DataFrame:
        """The k nearest neighbours of every point within its matrix and type."""
        return neighbors.nearest(self.points, self.options.k)


def signals(rows: DataFrame, options: Options) -> DataFrame:
    """Lines of the asked-for directions and channels, after the change of basis if there is one."""
    if options.colours:
        rows = color.change_basis(rows, *options.colours)
    parts = [lines.row_lines(rows)] if lines.ROWS in options.directions else []
    if lines.COLUMNS in options.directions:
        parts.append(lines.column_lines(rows))
    if not parts:
        raise ValueError("at least one direction is needed")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return lines.select_channels(both, None if options.channels is None else list(options.channels))


def analyse(rows: DataFrame, options: Options | None = None) -> Analysis:
    """Centre, transform, round, envelop and number the points of every image in ``rows``.

    Coefficients are used along rows and across, so they are written once; so are points. All images,
    channels, scales and directions go through one plan.
    """
    options = options or Options()
    own = signals(rows, options)
    coefs = written(transform.morlet(lines.centred(own), list(options.scales)), "coefs")
    points = written(extrema.numbered(extrema.peak_points(transform.rounded(coefs), list(options.types))), "points")
    return Analysis(own, lines.line_means(own), coefs, points, options)
