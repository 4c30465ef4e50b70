"""All registered queries."""

from wardlight.plans import (  # noqa: F401
    building_blocks,
    forecast_reports,
    incident_reports,
    lifecycle_reports,
    notify_reports,
    request_reports,
    source_reports,
    stream_reports,
    text_reports,
)
from wardlight.plans.registry import ORACLES, QUERIES  # noqa: F401
