"""Scalar expressions on names, numbers, maps and text."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name patterns of the supported microscopes and defaults of
# fields that a pattern does not deliver.
IMAGE_PATTERNS = {
    "cellvoyager": r"[^_]+_(?P<w>[A-Z]\d{2})_T(?P<t>\d+)F(?P<s>\d+)L\d+A\d+Z(?P<z>\d+)(?P<c>[C]\d{2})\.",
    "metamorph": r".+_?(?P<w>[A-Z]\d{2})_s(?P<s>\d+)(_w(?P<c>\d{1}))?[^_thumb]",
}
METADATA_PATTERNS = {"cellvoyager": r".*\.(mlf|mrf)$", "metamorph": r"(?!.*)"}
FIELD_DEFAULTS = {"w": "A01", "c": "1", "z": "0", "t": "0", "s": "0"}


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def well_row(name) -> Column:
    return F.ascii(F.substring(_c(name), 1, 1)) - 65


def well_column(name) -> Column:
    return F.regexp_extract(_c(name), r"^[A-Z](\d+)", 1).cast("int") - 1


def well_name(row, column) -> Column:
    return F.format_string("%s%02d", F.chr(_c(row) + 65), _c(column) + 1)


def is_well_name(name) -> Column:
    return _c(name).rlike(r"^[A-Z][0-9]{2}$")


def plain_pattern(pattern: str) -> str:
    """Pattern without group names, as Spark's regex functions number groups."""
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def group_numbers(pattern: str) -> Mapping[str, int]:
    unknown = set(re.compile(pattern).groupindex) - set(FIELD_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown fields in pattern: {sorted(unknown)}")
    return re.compile(pattern).groupindex


def filename_fields(name, pattern: str) -> Column:
    """Array of well, channel, z plane, time point and site taken from a file name
    in one pass of the regex; null when the name does not match."""
    numbers = group_numbers(pattern)
    plain = plain_pattern(pattern)
    keys = ("w", "c", "z", "t", "s")
    picked = "\u0001".join(f"${numbers[k]}" if k in numbers else "" for k in keys)
    parts = F.split(F.regexp_replace(_c(name), f"^.*?(?:{plain}).*$", picked), "\u0001")
    defaults = F.array(*[F.lit(FIELD_DEFAULTS[k]) for k in keys])
    return F.when(_c(name).rlike(plain), F.zip_with(
        parts, defaults, lambda v, default: F.when(v == "", default).otherwise(v)))


def action_channel(name, channel) -> Column:
    """Channel name led by the number of the acquisition action."""
    action = F.regexp_extract(_c(name), r"\dL\d{2}(.+?)Z", 1)
    return F.concat_ws("_", action, _c(channel))


def bit_depth(pixel_type) -> Column:
    return F.regexp_extract(_c(pixel_type), r"(\d+)$", 1).cast("int")


def round_stored(value, digits: int = 6) -> Column:
    """Half-even rounding used before values are stored."""
    return F.bround(_c(value), digits)


def to_float(text) -> Column:
    return _c(text).try_cast("double")


def is_number(text) -> Column:
    return _c(text).try_cast("double").isNotNull()


def positions_of(items, value) -> Column:
    """Zero-based positions at which a value occurs in an array."""
    indexed = F.transform(_c(items), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.filter(indexed, lambda e: e["v"] == value), lambda e: e["i"])


def scale_to_byte(value, lower, upper) -> Column:
    """Map ``[lower, upper)`` linearly to 0..255; below is 0, from `upper` on 255."""
    v, lo, hi = _c(value), _c(lower), _c(upper)
    step = F.greatest(hi - lo - 1, F.lit(1))
    inside = F.floor((v - lo) * F.lit(255) / step)
    return F.when(v < lo, 0).when(v >= hi, 255).otherwise(inside).cast("int")


def feature_name(group, feature, channel=None, objects=None, statistic=None) -> Column:
    """Name of a stored feature built from its parts."""
    base = F.concat_ws("_", F.lit(group), F.lit(feature))
    if objects is not None:
        base = F.concat_ws("_", F.lit(objects), base)
    if channel is not None:
        base = F.concat_ws("_", base, F.lit(channel))
    return base if statistic is None else F.concat_ws("_", F.lit(statistic), base)


def is_feature_name(name) -> Column:
    return _c(name).rlike(r"^[A-Za-z0-9_-]+$")


def stored_name(group: str, feature: str, channel: str | None = None, objects: str | None = None,
                statistic: str | None = None) -> str:
    """Column name for a feature; the same rule as :func:`feature_name`."""
    name = "_".join(p for p in (statistic, objects, group, feature, channel) if p is not None)
    if not re.match(r"^[A-Za-z0-9_-]+$", name):
        raise ValueError(f"not a feature name: {name}")
    return name
