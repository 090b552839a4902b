"""All registered queries."""

from geoloom.plans import archive, discovery, extras, flows, ranking, rows, sets, streams  # noqa: F401
