"""Column lookup by kind and by what a name says."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name that holds dots or blanks, for expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")


def find_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Columns by name without regard to case; an exact name comes first."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    found = [n if n in df.columns else lower.get(n.lower()) for n in names]
    require(df, [n for n, f in zip(names, found) if f is None])
    return found


# The name patterns of the column classes. Classes are tried in this order; geochem matches the name as
# written ignoring case, the others the lower-cased name, all from its start.
NAME_PATTERNS = {
    "hole_id": [
        r"^hole_?id$", r"^drill_?hole", r"^borehole", r"^hole$", r"^well", r"^site_?id$", r"hole.*number", r"^sample.*id$", r"^collar.*id$", r"^filename$", r"^sample$",
    ],
    "lat": [r"^lat(itude)?(_.*)?$", r"^lat_?y$", r"^northing(_.*)?$", r"^coord_?y$", r"^y$", r"latitude.*gda", r"northing.*gda"],
    "lon": [r"^lon(g(itude)?)?(_.*)?$", r"^lon_?x$", r"^easting(_.*)?$", r"^coord_?x$", r"^x$", r"longitude.*gda", r"easting.*gda"],
    "geochem": [
        r"^SiO2$", r"^Al2O3$", r"^Fe2O3$", r"^FeO$", r"^MgO$", r"^CaO$", r"^Na2O$", r"^K2O$", r"^TiO2$", r"^P2O5$", r"^MnO$", r"^Cr2O3$",
        r"^Cu$", r"^Pb$", r"^Zn$", r"^Au$", r"^Ag$", r"^Ni$", r"^Co$", r"^As$", r"^Sb$", r"^Bi$", r"^Mo$", r"^W$", r"^Sn$", r"^U$",
        r"^Th$", r"^Ba$", r"^Sr$", r"^Rb$", r"^Cs$", r"^Li$", r"^Be$",
        r"^La$", r"^Ce$", r"^Pr$", r"^Nd$", r"^Sm$", r"^Eu$", r"^Gd$", r"^Tb$", r"^Dy$", r"^Ho$", r"^Er$", r"^Tm$", r"^Yb$", r"^Lu$", r"^Y$", r"^Sc$",
        r"^S$", r"^C$", r"^LOI$", r"^Total$",
        r"^[A-Z][a-z]?_ppm$", r"^[A-Z][a-z]?_pct$", r"^[A-Z][a-z]?_ppb$", r"^[A-Z][a-z]?%$",
    ],
    "metadata": [
        r"^hole_?id$", r"^drill_?hole", r"^sample", r"^filename", r"^well", r"^lat(itude)?", r"^lon(gitude)?", r"^northing", r"^easting", r"^x$", r"^y$", r"^depth", r"^from", r"^to", r"^interval", r"^zone", r"^lithology", r"^rock_type", r"^description", r"^date", r"^timestamp", r"^project", r"^area", r"^site",
    ],
}


def classify_column(name: str) -> str:
    """hole_id, lat, lon, geochem, metadata or unknown."""
    for kind, patterns in NAME_PATTERNS.items():
        if any(re.match(p, name, re.I) if kind == "geochem" else re.match(p, name.lower()) for p in patterns):
            return kind
    return "unknown"


def classify_columns(df: DataFrame) -> dict[str, list[str]]:
    """Column names by class; reads the schema only."""
    out: dict[str, list[str]] = {}
    for c in df.columns:
        out.setdefault(classify_column(c), []).append(c)
    return out
