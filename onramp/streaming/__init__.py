"""Structured Streaming forms of the operators."""

from .stream_ops import (  # noqa: F401
    ad_touch_rollup_stream,
    dedupe_requests_stream,
    five_minute_trigger,
    log_stream,
    read_events_stream,
    score_stream,
    sticky_decisions_stream,
)
