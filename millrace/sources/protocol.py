"""JSON-Lines sessions between a consumer and its clients."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Message types of either side.
SERVER_TYPES = ("records", "shard_complete", "shutdown_requested", "lease_lost", "shutdown")
CLIENT_TYPES = ("ready", "checkpoint", "stop")

_EVENT = "struct<event_name:string,sequence_number:string,size_bytes:bigint,stream_view_type:string,keys:variant,new_image:variant,old_image:variant,approx_creation_time_ms:bigint>"
MESSAGE = f"type string, shard string, last_seq string, records array<{_EVENT}>, reason string, seq string, owner string"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Messages of lines, with the line; type is null where a line is no message of a known type."""
    text = F.regexp_replace(F.col(column), r"[\r\n]+$", "")
    message = F.from_json(text, MESSAGE, {"mode": "PERMISSIVE"})
    known = message["type"].isin(*SERVER_TYPES, *CLIENT_TYPES)
    found = lines.withColumn("m", F.when(known, message))
    return found.select(*lines.columns, *[F.col(f"m.{name}").alias(name) for name in ("type", "shard", "last_seq", "records", "reason", "seq", "owner")])


def records_of(messages: DataFrame) -> DataFrame:
    """(shard, pos, event fields) of all record batches; images are JSON text."""
    rows = messages.where("type = 'records'").select("shard", F.posexplode("records").alias("pos", "r"))
    text = lambda c: F.to_json(F.col(f"r.{c}"))
    image = lambda c: F.when(~F.coalesce(text(c), F.lit("null")).isin("null", "{}"), text(c))
    return rows.select(
        "shard", "pos", "r.event_name", "r.sequence_number", "r.size_bytes", "r.stream_view_type", F.coalesce(image("keys"), F.lit("{}")).alias("keys"), image("new_image").alias("new_image"), image("old_image").alias("old_image"), "r.approx_creation_time_ms"
    )


def line(kind: str, **fields: Column) -> Column:
    """A message as a line without its end; null fields are left out."""
    if kind not in SERVER_TYPES + CLIENT_TYPES:
        raise ValueError(f"message type {kind!r}")
    return F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(k) for k, c in fields.items()]))


def acknowledgements(messages: DataFrame) -> DataFrame:
    """(line,) checkpoint messages that answer record batches, one for each."""
    return messages.where("type = 'records'").select(line("checkpoint", shard=F.col("shard"), seq=F.col("last_seq")).alias("line"))


def script_lines(script: Iterable[dict]) -> list[str]:
    """The lines that a replayed script emits; steps that await acknowledgements emit none."""
    out = []
    for step in script:
        if "emit" in step:
            out.append(json.dumps(step["emit"]))
        elif "emit_raw" in step:
            out.append(step["emit_raw"])
        elif "await_checkpoints" not in step:
            raise ValueError(f"unknown step {sorted(step)}")
    return out
