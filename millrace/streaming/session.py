"""Sessions over two text streams: JSON lines in, acknowledgements out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import IO, Any

from millrace.sources.protocol import CLIENT_TYPES, SERVER_TYPES


class SessionError(RuntimeError):
    """The other side did not keep to the session."""


def _message(line: str, known: tuple[str, ...]) -> dict | None:
    """A line's message; None for one that is no message of a known type."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return found if isinstance(found, dict) and found.get("type") in known else None


def consume(lines: IO[str], answers: IO[str], factory: Callable[[], Any], owner: str = "") -> dict[str, str]:
    """The client's side: user code per shard, each batch acknowledged once it is processed; each shard's last acknowledgement.

    A processor is made when a shard is first heard of. A batch that it denies (False) or fails is not acknowledged;
    a failure ends the session with a stop. Lines that are no messages are passed over.
    """
    users: dict[str, Any] = {}
    done: dict[str, str] = {}

    def say(kind: str, **fields: str) -> None:
        answers.write(json.dumps({"type": kind, **fields}) + "\n")
        answers.flush()

    def user_of(shard: str) -> Any:
        if shard not in users:
            users[shard] = factory()
            hook(shard, "initialize")
        return users[shard]

    def hook(shard: str, name: str) -> None:
        if hasattr(users.get(shard), name):
            getattr(users[shard], name)(shard)

    say("ready", **({"owner": owner} if owner else {}))
    for line in lines:
        m = _message(line, SERVER_TYPES)
        if m is None:
            continue
        shard = m.get("shard", "")
        match m["type"]:
            case "records":
                try:
                    taken = user_of(shard).process_records(shard, [{"shard_id": shard, "seq": r.get("sequence_number"), "event": r} for r in m.get("records", [])])
                except Exception:
                    say("stop")
                    raise
                if taken is not False:
                    done[shard] = m["last_seq"]
                    say("checkpoint", shard=shard, seq=m["last_seq"])
            case "shard_complete":
                user_of(shard)
                hook(shard, "shard_ended")
                users.pop(shard)
            case "shutdown_requested":
                for s in [shard] if shard else sorted(users):
                    hook(s, "shutdown_requested")
            case "lease_lost":
                hook(shard, "lease_lost")
                users.pop(shard, None)
            case "shutdown":
                break
    return done


def replay(script: Iterable[dict], lines: IO[str], answers: IO[str]) -> dict[str, list[str]]:
    """The server's side of a scripted session: emits, and waits for the acknowledgements that the script names; all of them by shard.

    Raises where the client stops, or where an awaited acknowledgement does not come before its answers end.
    """
    acks: dict[str, list[str]] = {}

    def hear() -> None:
        while True:
            line = answers.readline()
            if not line:
                raise SessionError("the client's answers ended")
            m = _message(line, CLIENT_TYPES)
            if m is None or m["type"] == "ready":
                continue
            if m["type"] == "stop":
                raise SessionError("the client stopped")
            acks.setdefault(m["shard"], []).append(m["seq"])
            return

    for step in script:
        if "emit" in step:
            lines.write(json.dumps(step["emit"]) + "\n")
        elif "emit_raw" in step:
            lines.write(step["emit_raw"] + "\n")
        elif "await_checkpoints" in step:
            lines.flush()
            while any(w["seq"] not in acks.get(w["shard"], []) for w in step["await_checkpoints"]):
                hear()
        else:
            raise ValueError(f"unknown step {sorted(step)}")
    lines.flush()
    return acks
