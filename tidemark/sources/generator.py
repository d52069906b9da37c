"""Synthetic payments that misbehave, the same for the same seed.

Four faults, each with its own knob: a delay before sending, groups sent in a shuffled order, events so old that
their window has closed, and events sent again as they were. ``python -m tidemark.sources.generator`` writes JSON lines, or
files for the streaming source.
"""

from __future__ import annotations

import argparse
import json
import os
import random
import sys
import time
import uuid
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from tidemark.config import Settings

# Payment methods, the memory of copies, the knobs' defaults, the names of the fields.
METHODS = ("pix", "credit", "debit")
#: A copy is of one of the latest so many events sent.
MEMORY = 50


@dataclass(frozen=True)
class Knobs:
    count: int = 200
    rate: float = 20.0
    seed: int = 42
    merchants: int = 5
    accounts: int = 50
    jitter_seconds: float = 5.0
    shuffle: int = 10
    late_fraction: float = 0.10
    late_spread_seconds: float = 60.0
    duplicate_fraction: float = 0.05
    window_seconds: int = 60
    allowed_lateness_seconds: int = 120


Event = dict[str, str]


def encode(event: Event) -> str:
    """The wire form: compact JSON."""
    return json.dumps(event, separators=(",", ":"))


class Feed:
    """An iterator of (event, kind); kind is fresh, late or duplicate."""

    def __init__(self, knobs: Knobs, clock: Callable[[], datetime] | None = None):
        self.knobs = knobs
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.dice = random.Random(knobs.seed)
        self.sent: deque[Event] = deque(maxlen=MEMORY)

    def _age(self, late: bool) -> float:
        """Seconds that an event lies behind the clock; a late one's window has surely closed."""
        k = self.knobs
        if not late:
            return self.dice.uniform(0.0, k.jitter_seconds)
        closed = k.window_seconds + k.allowed_lateness_seconds + k.jitter_seconds
        return closed + self.dice.uniform(0.0, k.late_spread_seconds)

    def _event(self, late: bool) -> Event:
        at = self.clock() - timedelta(seconds=self._age(late))
        dice = self.dice
        return {
            "transaction_id": str(uuid.UUID(bytes=dice.randbytes(16), version=4)),
            "merchant_id": f"M{dice.randrange(self.knobs.merchants):03d}",
            "account_id": f"A{dice.randrange(self.knobs.accounts):05d}",
            "amount": f"{dice.randint(100, 50_000) / 100:.2f}",
            "currency": "BRL",
            "method": dice.choice(METHODS),
            "event_time": at.isoformat(timespec="milliseconds"),
        }

    def _group(self, size: int) -> list[tuple[Event, str]]:
        group = []
        for _ in range(size):
            if self.sent and self.dice.random() < self.knobs.duplicate_fraction:
                group.append((self.dice.choice(list(self.sent)), "duplicate"))
            else:
                late = self.dice.random() < self.knobs.late_fraction
                group.append((self._event(late), "late" if late else "fresh"))
        if size > 1:
            self.dice.shuffle(group)
        return group

    def __iter__(self) -> Iterator[tuple[Event, str]]:
        left, most = self.knobs.count, max(self.knobs.shuffle, 1)
        while left > 0:
            for event, kind in self._group(min(most, left)):
                self.sent.append(event)
                yield event, kind
            left -= min(most, left)


def send(feed, out: Callable[[Event], None], rate: float | None = None) -> Counter:
    """Hand every event to ``out``, at ``rate`` a second if given; returns how many of each kind."""
    kinds: Counter = Counter()
    began = time.monotonic()
    for event, kind in feed:
        out(event)
        kinds[kind] += 1
        if rate:
            time.sleep(max(0.0, began + sum(kinds.values()) / rate - time.monotonic()))
    return kinds


def to_files(feed, folder: str, per_file: int, clock: Callable[[], datetime] | None = None) -> Counter:
    """Files for ``json_files``: a record a line, whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    clock = clock or (lambda: datetime.now(timezone.utc))
    held: list[str] = []
    done = 0

    def flush() -> None:
        nonlocal done
        own = f"{folder}/.{uuid.uuid4().hex}"
        with open(own, "w") as out:
            out.writelines(held)
        done += 1
        os.replace(own, f"{folder}/{done:08d}.json")
        held.clear()

    offset = 0

    def take(event: Event) -> None:
        nonlocal offset
        record = {"value": encode(event), "partition": 0, "offset": offset, "timestamp": clock().isoformat(timespec="milliseconds")}
        offset += 1
        held.append(json.dumps(record) + "\n")
        if len(held) >= per_file:
            flush()

    kinds = send(feed, take)
    if held:
        flush()
    return kinds


class Undelivered(RuntimeError):
    """The broker didn't take every event."""


def connect(servers: str):
    """A producer that waits for all replicas; needs the confluent_kafka library."""
    try:
        from confluent_kafka import Producer
    except ImportError as error:
        raise SystemExit("sending to Kafka needs confluent_kafka") from error
    return Producer({"bootstrap.servers": servers, "acks": "all"})


def to_kafka(feed, producer, topic: str, rate: float | None = None) -> Counter:
    """Every event keyed by its merchant, so that one merchant's stay in order; raises if any wasn't delivered."""
    lost: list[str] = []

    def report(error, _message) -> None:
        if error is not None:
            lost.append(str(error))

    def put(event: Event) -> None:
        while True:
            try:
                producer.produce(topic, key=event["merchant_id"], value=encode(event), on_delivery=report)
                break
            except BufferError:  # its queue is full: let deliveries through
                producer.poll(0.1)
        producer.poll(0)

    kinds = send(feed, put, rate)
    waiting = producer.flush()
    if lost or waiting:
        raise Undelivered(f"{len(lost)} refused, {waiting} still waiting; {lost[0] if lost else 'no answer'}")
    return kinds


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name, value in vars(Knobs()).items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    parser.add_argument("--folder", help="write files there; without it, JSON lines to standard output")
    parser.add_argument("--per-file", type=int, default=100)
    parser.add_argument("--bootstrap-servers", help="send to Kafka there, at the rate")
    parser.add_argument("--topic", default=Settings().topic)
    args = vars(parser.parse_args(argv))
    folder, per_file, servers, topic = (args.pop(n) for n in ("folder", "per_file", "bootstrap_servers", "topic"))
    feed = Feed(Knobs(**args))
    if servers:
        kinds = to_kafka(feed, connect(servers), topic, args["rate"])
    elif folder:
        kinds = to_files(feed, folder, per_file)
    else:
        kinds = send(feed, lambda event: print(encode(event)))
    print(f"sent {sum(kinds.values())}: {dict(kinds)}", file=sys.stderr)


if __name__ == "__main__":
    main()
