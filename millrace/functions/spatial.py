"""Spatial functions over well-known binary; text is parsed by Arrow functions."""

from __future__ import annotations

from . import CALLS, builtin

builtin("st_geomfromtext:mr_st_geomfromtext st_geometryfromtext:mr_st_geomfromtext st_x:mr_st_x st_y:mr_st_y st_numpoints:mr_st_numpoints st_length:mr_st_length st_area:mr_st_area")

for _kind in ("geom", "geometry", "linestring", "point", "poly", "polygon"):
    CALLS[f"st_{_kind}fromwkb"] = lambda args: f"cast({args[0]} as binary)"
