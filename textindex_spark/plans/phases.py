"""Phases of a run: nested timings, memory peaks and logged values, as a tree or RESULT lines."""

from __future__ import annotations

import resource
import time
from contextlib import contextmanager


class Extension:
    """What a phase measures besides time: values at its start, end, and from phases below it."""

    def start(self) -> None: ...

    def stop(self) -> None: ...

    def pause(self) -> None: ...

    def resume(self) -> None: ...

    def propagate(self, below: Extension) -> None: ...

    def write(self) -> dict:
        return {}


class Phase:
    extensions: list[type[Extension]] = []
    current: Phase | None = None

    def __init__(self, title: str):
        self.title, self.sub, self.data, self.muted = title, [], {}, False
        self.own = [kind() for kind in Phase.extensions]

    def __enter__(self) -> Phase:
        self.above, Phase.current = Phase.current, self
        self.began, self.memory = time.perf_counter(), _peak_kb()
        for e in self.own:
            e.start()
        return self

    def __exit__(self, *_) -> None:
        self.seconds, self.peak = time.perf_counter() - self.began, _peak_kb()
        for e in self.own:
            e.stop()
        Phase.current = self.above
        if self.above is not None and not self.above.muted:
            self.above.sub.append(self)
            for a, b in zip(self.above.own, self.own):
                a.propagate(b)

    def split(self, title: str) -> Phase:
        """End this phase and begin the next beside it."""
        self.__exit__()
        return Phase(title).__enter__()

    def log(self, key: str, value) -> None:
        self.data[key] = value

    @staticmethod
    def log_current(key: str, value) -> None:
        if Phase.current is not None:
            Phase.current.log(key, value)

    @contextmanager
    def suppress(self):
        """Phases inside are run but not kept, and extensions do not count."""
        self.muted = True
        for e in self.own:
            e.pause()
        try:
            yield
        finally:
            self.muted = False
            for e in self.own:
                e.resume()

    def to_json(self) -> dict:
        out = {"title": self.title, "time": self.seconds * 1000, "memOff": self.memory, "memPeak": self.peak, **self.data}
        for e in self.own:
            out |= e.write()
        return out | {"sub": [p.to_json() for p in self.sub]}

    def to_keyval(self) -> str:
        flat = {k: v for k, v in self.to_json().items() if k != "sub"} | {p.title: p.seconds * 1000 for p in self.sub}
        return "RESULT " + " ".join(f"{k}={str(v).replace(' ', '_')}" for k, v in flat.items())


def wrap(title: str, f, *args):
    """(result, phase) of a call."""
    with Phase(title) as phase:
        result = f(*args)
    return result, phase


def _peak_kb() -> int:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


def observed(df, phase: Phase, **metrics):
    """df with metrics that Spark collects while it runs; they enter the phase once an action is over."""
    from pyspark.sql import Observation

    observation = Observation(phase.title)
    return df.observe(observation, *[c.alias(k) for k, c in metrics.items()]), lambda: phase.data.update(observation.get)
