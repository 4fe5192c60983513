"""Catalogue of delimited sources and how each is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .delimited import read_delimited, read_whitespace


@dataclass(frozen=True)
class Source:
    """Where a table lies and its shape. ``separator`` None means white space."""

    locations: tuple[str, ...]
    separator: str | None = ","
    header: bool = True
    columns: tuple[str, ...] = ()
    target: str | None = None


# Names, separators, column names and targets of the known tables.
# Locations are file names, resolved against the folder given when loading.
HOUSING = (
    "CRIM", "ZN", "INDUS", "CHAS", "NOX", "RM", "AGE", "DIS", "RAD", "TAX", "PTRATIO", "B", "LSTAT", "MEDV",
)
BREAST = (
    "class", "age", "menopause", "tumor_size", "inv_nodes", "node_caps", "deg_malig", "breast", "breast_quad", "irradiat",
)
AUTO = (
    "mpg", "cylinders", "displacement", "horsepower", "weight", "acceleration", "model_year", "origin", "car_name",
)
SONAR = (*[f"feature_{i}" for i in range(60)], "class")

SOURCES: dict[str, Source] = {
    "boston_housing": Source(("boston_housing",), None, False, HOUSING, "MEDV"),
    "parkinson": Source(("parkinson",), target="status"),
    "sonar": Source(("sonar",), header=False, columns=SONAR, target="class"),
    "white_wine": Source(("white_wine",), ";", target="quality"),
    "red_wine": Source(("red_wine",), ";", target="quality"),
    "breast_cancer": Source(("breast_cancer",), header=False, columns=BREAST, target="class"),
    "ozone": Source(("ozone_eighthr", "ozone_onehr")),
    "concrete": Source(("concrete", "concrete_mirror")),
    "auto_mpg": Source(("auto_mpg",), None, False, AUTO, "mpg"),
}
# The same source under a second name.
ALIASES = {"parkinsons_oxford": "parkinson"}


def find(name: str, sources: Mapping[str, Source] = SOURCES) -> Source:
    name = ALIASES.get(name, name)
    if name not in sources:
        raise KeyError(f"unknown source {name}; known are {sorted([*sources, *ALIASES])}")
    return sources[name]


def split_target(df: DataFrame, target: str | None) -> tuple[list[str], str]:
    """Feature names and target; the last column when the named target is missing."""
    target = target if target in df.columns else df.columns[-1]
    return [c for c in df.columns if c != target], target


def load(spark: SparkSession, name: str, folder: str, sources: Mapping[str, Source] = SOURCES) -> tuple[DataFrame, str]:
    """The table and its target, from the first location that can be read."""
    source = find(name, sources)
    errors = []
    for location in source.locations:
        path = f"{folder}/{location}"
        try:
            if source.separator is None:
                df = read_whitespace(spark, path, source.columns)
            else:
                df = read_delimited(spark, path, source.separator, source.header, source.columns)
            return df, split_target(df, source.target)[1]
        except (AnalysisException, ValueError) as error:  # missing or of another shape: the next location may be right
            errors.append(f"{path}: {error}")
    raise OSError("; ".join(errors))


def load_all(
    spark: SparkSession, folder: str, names: Sequence[str] | None = None, sources: Mapping[str, Source] = SOURCES
) -> tuple[dict[str, tuple[DataFrame, str]], DataFrame]:
    """All tables that can be read, and (name, error) of those that cannot."""
    tables, errors = {}, []
    for name in names or sources:
        try:
            tables[name] = load(spark, name, folder, sources)
        except (OSError, KeyError) as error:
            errors.append((name, str(error)))
    return tables, spark.createDataFrame(errors, "name string, error string")
