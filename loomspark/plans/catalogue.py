"""Imports the modules that register queries."""

from loomspark.plans import additions, fields, further, meshes, measured, models, scalars, spatial  # noqa: F401
