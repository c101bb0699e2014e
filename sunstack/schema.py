"""Canonical schemas: frames, calibration, patches, cut-outs, results and exploded pixels."""

from __future__ import annotations

FRAME = "job int, object int, channel int, frame_no int, wavefront int, file string, t_beg timestamp_ntz, t_end timestamp_ntz, h int, w int, px array<double>"
CALIB = "object int, channel int, kind string, h int, w int, px array<double>"
PATCH = "patch_id int, iy int, ix int, cy int, cx int, y0 int, x0 int, y1 int, x1 int"
CUTOUT = "patch_id int, object int, channel int, frame_no int, wavefront int, off_y double, off_x double, px array<double>"
RESULT = "patch_id int, object int, img array<double>, psf array<double>, residual array<double>, alpha array<double>, metric double, metrics array<double>"
PIXEL = "frame_no int, y int, x int, v double"
