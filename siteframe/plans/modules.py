"""User modules over image tables and their composition.

A module is a function from named DataFrames and settings to named DataFrames.
Running a composition only builds one lazy plan per output.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteframe.core import image_keys
from siteframe.operators import analysis as AN
from siteframe.operators import labels as LB
from siteframe.operators import measure as ME
from siteframe.operators import pixels as P
from siteframe.operators import segment as SG
from siteframe.operators.mutate import assign_object_ids

# Columns every handle type must bring along besides the image keys, and their kinds.
WHOLE = ("tinyint", "smallint", "int", "bigint")
HANDLES = {"IntensityImage": {"y": WHOLE, "x": WHOLE, "value": (*WHOLE, "float", "double")}, "MaskImage": {"y": WHOLE, "x": WHOLE, "mask": ("boolean",)},
           "LabelImage": {"y": WHOLE, "x": WHOLE, "label": WHOLE}, "BinaryImage": {"y": WHOLE, "x": WHOLE, "mask": ("boolean",)},
           "SegmentedObjects": {"y": WHOLE, "x": WHOLE, "label": WHOLE}, "Measurement": {"label": WHOLE}}
# Handles of settings and the Python types they take.
SETTINGS = {"Boolean": bool, "Numeric": (int, float), "Character": str, "Sequence": (list, tuple), "Set": (set, frozenset)}

MODULES: dict[str, Callable[..., DataFrame]] = {}
TOOLS: dict[str, Callable[..., DataFrame]] = {}
EXTRACTORS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def module(name: str):
    def register(fn):
        MODULES[name] = fn
        return fn
    return register


def register_tool(name: str):
    def register(fn):
        TOOLS[name] = fn
        return fn
    return register


for _name, _fn in {"smooth": P.smooth, "threshold_manual": P.threshold_manual, "threshold_otsu": P.threshold_otsu,
                   "threshold_adaptive": P.threshold_adaptive, "label": LB.connected_components,
                   "register_objects": LB.register_objects, "fill": LB.fill_holes, "invert": P.invert,
                   "rescale": P.rescale, "project": P.project, "combine_channels": P.combine_channels,
                   "combine_masks": P.combine_masks, "relabel": LB.relabel, "filter": LB.filter_objects,
                   "measure_intensity": ME.measure_intensity, "measure_morphology": ME.measure_morphology,
                   "separate_clumps": SG.separate_clumps, "segment_secondary": SG.segment_secondary, "detect_blobs": SG.detect_blobs,
                   "deblend": SG.deblend, "expand_or_shrink": LB.expand_or_shrink, "measure_neighbours": LB.measure_neighbours,
                   "measure_texture": ME.measure_texture, "measure_zernike": ME.measure_zernike}.items():
    MODULES[_name] = _fn

for _name, _fn in {"Heatmap": AN.heatmap, "Clustering": AN.cluster, "Classification": AN.classify}.items():
    TOOLS[_name] = _fn


def run_tool(name: str, *tables: DataFrame, **payload) -> DataFrame:
    """Answer a request for a registered tool; an unknown tool is an error."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    return TOOLS[name](*tables, **payload)


def check_handle(kind: str, value: object, name: str) -> None:
    """Raise ``TypeError`` unless the value fits the handle type."""
    if kind in SETTINGS:
        if not isinstance(value, SETTINGS[kind]) or (kind == "Numeric" and isinstance(value, bool)):
            raise TypeError(f'"{name}" is not a {kind}: {type(value).__name__}')
        return
    types = dict(value.dtypes)
    missing = set(HANDLES[kind]) - set(types)
    if missing:
        raise TypeError(f'"{name}" is not a {kind}: missing {sorted(missing)}')
    for column, allowed in HANDLES[kind].items():
        if types[column] not in allowed:
            raise TypeError(f'"{name}" is not a {kind}: {column} is {types[column]}')


@dataclass(frozen=True)
class Step:
    """One active module: inputs and outputs name entries of the store."""
    module: str
    inputs: Mapping[str, str]
    output: str
    settings: Mapping[str, object] = field(default_factory=dict)
    kinds: Mapping[str, str] = field(default_factory=dict)
    active: bool = True


def run_steps(steps: Sequence[Step], store: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Apply the active steps in order; an entry nobody has made is an error."""
    store = dict(store)
    for step in steps:
        if not step.active:
            continue
        if step.module not in MODULES:
            raise KeyError(f"unknown module: {step.module}")
        for argument, key in step.inputs.items():
            if key not in store:
                raise KeyError(f'module "{step.module}" needs "{key}", which no earlier step makes')
            if argument in step.kinds:
                check_handle(step.kinds[argument], store[key], key)
        for argument, value in step.settings.items():
            if argument in step.kinds:
                check_handle(step.kinds[argument], value, argument)
        store[step.output] = MODULES[step.module](**{a: store[k] for a, k in step.inputs.items()}, **step.settings)
    return store


def extractor(name: str):
    """Register a function from the pixels of one object to a one-row frame."""
    def register(fn):
        EXTRACTORS[name] = fn
        return fn
    return register


def extract_features(labels: DataFrame, px: DataFrame, name: str, schema: str) -> DataFrame:
    """User-defined features; Python sees a range of labels of one image at a time."""
    keys = image_keys(labels)
    fn = EXTRACTORS[name]
    types = {f.name: f.dataType.simpleString() for f in labels.schema.fields}
    full = ", ".join([f"{k} {types[k]}" for k in keys] + [f"label {types['label']}", schema])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        done = []
        for label, part in pdf.groupby("label", sort=False):
            row = fn(part)
            for k, v in zip([*keys, "label"], [*key[:-1], label]):
                row[k] = v
            done.append(row)
        columns = [c.strip().split(" ")[0] for c in full.split(",")]
        return pd.concat(done)[columns]

    return labels.join(px, [*keys, "y", "x"]).groupBy(*keys, F.expr("label DIV 64")).applyInPandas(run, full)


def save_objects(labels: DataFrame, measurements: DataFrame, features: Mapping[str, str], type_id: int,
                 existing: DataFrame) -> dict[str, DataFrame]:
    """Tables for the objects of a run: ids, centres and feature maps rounded for
    storage. Objects of the type at the same sites are replaced by the new ones."""
    keys = image_keys(labels)
    ids = assign_object_ids(labels.select(*keys, "label"), existing.limit(0).select(*keys, "label", "mapobject_id"), keys)
    start = existing.agg(F.coalesce(F.max("mapobject_id"), F.lit(0)).alias("_start"))
    ids = ids.join(F.broadcast(start)).select(*keys, "label", (F.col("mapobject_id") + F.col("_start")).alias("mapobject_id"))
    entries = [e for name, i in features.items() for e in (F.lit(str(i)), F.bround(F.col(name).cast("double"), 6))]
    values = measurements.join(ids, [*keys, "label"]).select(
        F.col("site_id").alias("partition_key"), "mapobject_id", F.create_map(*entries).alias("values"))
    centres = ME.centroids(labels).join(ids, [*keys, "label"])
    objects = ids.select(F.col("site_id").alias("partition_key"), F.col("mapobject_id").alias("id"),
                         F.lit(type_id).alias("mapobject_type_id"), F.lit(None).cast("long").alias("ref_id"))
    return {"objects": objects, "segmentations": centres, "feature_values": values}
