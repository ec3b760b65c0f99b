"""Registered models over the supplied tables, one per operator."""

from tallyloom.plans import (  # noqa: F401
    columns,
    gates,
    loads,
    marts,
    ordered,
    relational,
    staging,
    warehouse,
)
