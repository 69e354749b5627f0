"""Writing cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite `path` with the table; Parquet keeps the types, CSV has a header row."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}; use 'parquet' or 'csv'")
    writer = df.write.mode("overwrite")
    try:
        if fmt == "parquet":
            writer.parquet(path)
        else:
            # Quotes are doubled and spaces kept, so that `scan_csv` reads the same texts.
            writer.csv(
                path,
                header=True,
                quote='"',
                escape='"',
                ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False,
            )
    except Exception as e:
        raise OSError(f"could not save the table to {path!r}: {e}") from e
