"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query name: module. Each module holds a function of the query's name.
MODULES = {
    "op1_pfair_mix": "mixing",
    "op2_chunked_warc": "warc",
    "op3_line_frequency": "quality",
    "op4_hypergeometric_shards": "sharding",
    "op5_wavelet_matrix": "wavelet",
    "op6_maximum_subsequence": "html",
    "op7_convolutional_toxicity": "toxicity",
    "op8_setsketch_near_duplicates": "neardup",
    "op9_nn_descent": "nndescent",
    "op10_minimum_bin_slack": "packing",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express: a SQL constant in the query's module."""
    out = {}
    for name, module in MODULES.items():
        if sql := getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None):
            out[name] = sql
    return out
