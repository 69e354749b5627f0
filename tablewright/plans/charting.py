"""Chart data for a list of chart specifications."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import col, is_numeric, is_text
from ..operators import charts as C
from ..sources.sink import write_clean

# The chart names a specification may use.
SCATTER = "Scatter Plot"
BAR = "Bar Chart"
HISTOGRAM = "Histogram"
PIE = "Pie Chart"
BOX = "Box Plot"
HEATMAP = "Heatmap"
AREA = "Area Chart"
LINE = "Line Chart"
CHART_TYPES = [SCATTER, BAR, HISTOGRAM, PIE, BOX, HEATMAP, AREA, LINE]
NEED_Y = [SCATTER, HEATMAP, AREA, LINE]

DONE, SKIPPED, FAILED = "done", "skipped", "failed"


@dataclass(frozen=True)
class ChartSpec:
    x_axis: str
    y_axis: str | None
    chart_type: str
    info: str | None = None
    # Rows of a sample to read instead of the whole table; a scatter plot has its own number of points.
    sample: int | None = None
    # Kind of band around a line; a bootstrap needs the `key` of `charts`.
    band: str = "normal"
    # Bars or shares at most; None takes the chart's own number.
    k: int | None = None


@dataclass(frozen=True)
class Chart:
    """A specification's outcome: named tables of data, or the reason why there are none."""

    spec: ChartSpec
    status: str
    reason: str | None = None
    data: dict[str, DataFrame] = field(default_factory=dict)


def check_chart(schema: T.StructType, spec: ChartSpec) -> str | None:
    """Why the chart cannot be made of a table with this schema, or None."""
    types = {f.name: f.dataType for f in schema.fields}
    x, y, kind = spec.x_axis, spec.y_axis, spec.chart_type
    missing = [c for c in (x, y) if c is not None and c not in types]
    if missing:
        return f"unknown column {missing[0]!r}"
    if kind not in CHART_TYPES:
        return f"unknown chart type {kind!r}"
    if y is None and kind in NEED_Y:
        return f"{kind} needs a y axis"
    x_type, y_type = types[x], types.get(y)
    if kind == PIE and is_numeric(x_type):
        return f"{kind} is not suitable for the numeric column {x!r}"
    if kind == BOX and not is_numeric(x_type):
        return f"{kind} needs a numeric column"
    if kind == HISTOGRAM and not (is_numeric(x_type) or is_text(x_type)):
        return f"{kind} needs a numeric or text column"
    if kind == BAR and not is_text(x_type):
        if y is not None and not is_numeric(y_type):
            return f"{kind} needs a numeric y axis to average"
        if y is None and not is_numeric(x_type):
            return f"{kind} of a column that is neither text nor numeric needs a y axis"
    both_numeric = is_numeric(x_type) and y is not None and is_numeric(y_type)
    both_text = is_text(x_type) and y is not None and is_text(y_type)
    if kind == HEATMAP and not (both_numeric or both_text):
        return f"{kind} needs two text or two numeric columns"
    if kind in (AREA, LINE) and not both_numeric:
        return f"{kind} needs two numeric columns"
    return None


def charts(df: DataFrame, specs: list[ChartSpec], key: str | list[str] | None = None) -> list[Chart]:
    """The data of every chart; one that cannot be made never stops the rest.

    All charts but single points cover the whole table, unless the specification asks
    for a sample, which is chosen by `key` if one is given. `done` means that the data
    is described; it is computed when it is read, as `write_charts` does.
    """
    out = []
    for spec in specs:
        reason = check_chart(df.schema, spec)
        if reason:
            out.append(Chart(spec, SKIPPED, reason))
            continue
        try:
            out.append(Chart(spec, DONE, data=_data(df, spec, key)))
        except Exception as e:  # noqa: BLE001 - whatever went wrong is the chart's status
            out.append(Chart(spec, FAILED, str(e)))
    return out


def _data(df: DataFrame, spec: ChartSpec, key) -> dict[str, DataFrame]:
    x, y, kind = spec.x_axis, spec.y_axis, spec.chart_type
    text = is_text(df.schema[x].dataType)
    keys = [] if key is None else [key] if isinstance(key, str) else key
    used = df.select(*[col(c) for c in dict.fromkeys([x, *([y] if y else []), *keys])])

    if kind == SCATTER:
        return {"points": C.scatter(used, x, y, spec.sample or C.SCATTER_ROWS, key=key)}
    if spec.sample is not None:
        used = C.pinned_sample(used, spec.sample, key=key)
    if kind == BAR and text:
        return {"bars": C.bar_count(used, x, spec.k or C.BAR_CATEGORIES)}
    if kind == BAR and y:
        return {"bars": C.bar_mean(used, x, y, spec.k or C.BAR_CATEGORIES)}
    if kind == HISTOGRAM and text:
        return {"bars": C.bar_count(used, x, spec.k)}
    if kind in (BAR, HISTOGRAM):
        return dict(zip(("bars", "density"), C.bar_numeric(used, x), strict=True))
    if kind == PIE:
        return {"shares": C.pie_share(used, x, spec.k or C.PIE_CATEGORIES)}
    if kind == BOX:
        summary = C.summarize(used, x)
        return {"box": C.box_stats(used, x, summary), "fliers": C.box_fliers(used, x, summary)}
    if kind == HEATMAP:
        # Pairs that do not occur are left out, so that any number of labels will do.
        return {"cells": C.crosstab_counts(used, x, y) if text else C.corr_pair(used, x, y)}
    if kind == LINE:
        return {"line": C.line_series(used, x, y, spec.band, key)}
    return {"area": C.area_series(used, x, y)}


STATUS = (
    "position int, x_axis string, y_axis string, chart_type string, "
    "status string, reason string, part string, path string, rows bigint"
)


def write_charts(
    df: DataFrame, specs: list[ChartSpec], folder: str, key: str | list[str] | None = None
) -> DataFrame:
    """Write every chart's data as Parquet below `folder`; one status row per written table or refused chart."""
    spark = df.sparkSession
    rows = []
    for i, chart in enumerate(charts(df, specs, key)):
        named = (i, chart.spec.x_axis, chart.spec.y_axis, chart.spec.chart_type)
        if chart.status != DONE:
            rows.append((*named, chart.status, chart.reason, None, None, None))
            continue
        for part, data in chart.data.items():
            path = f"{folder.rstrip('/')}/chart{i}-{part}"
            try:
                write_clean(data, path)
                rows.append((*named, DONE, None, part, path, spark.read.parquet(path).count()))
            except Exception as e:  # noqa: BLE001
                rows.append((*named, FAILED, str(e), part, None, None))
    return spark.createDataFrame(rows, STATUS)
