"""Small hand-written inputs."""

from __future__ import annotations

import json

LOG = "projects/demo/logs/gemini_cli"


def envelope(insert_id="a", time="2024-01-05T10:00:00Z", received=None, payload=None, **extra) -> str:
    entry = {
        "timestamp": time,
        "receiveTimestamp": received or time,
        "logName": LOG,
        "insertId": insert_id,
        "severity": "INFO",
        "resource": {"type": "global", "labels": {"project_id": "p"}},
        "jsonPayload": payload if payload is not None else {"event.name": "gemini_cli.api_response"},
    } | extra
    return json.dumps({k: v for k, v in entry.items() if v is not ...}, separators=(",", ":"))


def event(name, user="u@example.com", model="m", **payload) -> dict:
    keys = {"event.name": f"gemini_cli.{name}", "user.email": user, "model": model} | payload
    return {k: v for k, v in keys.items() if v is not None}


def messages(spark, *values: str):
    return spark.createDataFrame([(v,) for v in values], "value string")
