"""Command lines, configurations and a registry of algorithms that are chosen by configuration."""

from __future__ import annotations

import itertools
import re
from abc import ABC, abstractmethod
from collections.abc import Callable

FREE = "__args"
NAME = "__name"
#: Multipliers of byte sizes.
UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "ki": 1 << 10, "mi": 1 << 20, "gi": 1 << 30, "ti": 1 << 40}


def _put(tree: dict, path: list[str], value) -> None:
    """Set a value at a dotted path; a value set again becomes a list, a value on an object becomes its name."""
    *way, leaf = path
    for part in way:
        below = tree.get(part)
        if not isinstance(below, dict):
            below = tree[part] = {} if below is None else {NAME: below}
        tree = below
    if leaf not in tree:
        tree[leaf] = value
    elif isinstance(tree[leaf], dict):
        tree[leaf][NAME] = value
    else:
        held = tree[leaf] if isinstance(tree[leaf], list) else [tree[leaf]]
        tree[leaf] = [*held, value]


def parse_command_line(argv: list[str]) -> dict:
    """-x, --name and --a.b=value as a nested configuration; what is no option is listed under FREE."""
    out: dict = {}
    free: list[str] = []
    for arg in argv:
        m = re.fullmatch(r"-{1,2}([^-=][^=]*)(?:=(.*))?", arg, re.S)
        if m is None:
            free.append(arg)
        else:
            _put(out, m[1].split("."), True if m[2] is None else m[2])
    out[FREE] = free
    return out


class Config:
    """Typed access to a configuration; a missing or unreadable value gives the default."""

    def __init__(self, values: dict):
        self.values = values

    def _read(self, name: str, default, convert: Callable):
        value = self.values.get(name)
        if value is None:
            return default
        try:
            return convert(value)
        except (TypeError, ValueError):
            return default

    def flag(self, name: str, default: bool = False) -> bool:
        """true and 1 are true; any other string is false."""
        return self._read(name, default, lambda v: v if isinstance(v, bool) else str(v) in ("1", "true"))

    def integer(self, name: str, default: int = 0) -> int:
        return self._read(name, default, lambda v: int(str(v), 10))

    def size(self, name: str, default: int = 0) -> int:
        n = self.integer(name, default)
        return n if n >= 0 else default

    def number(self, name: str, default: float = 0.0) -> float:
        return self._read(name, default, float)

    def string(self, name: str, default: str = "") -> str:
        return self._read(name, default, lambda v: v[NAME] if isinstance(v, dict) else str(v))

    def strings(self, name: str) -> list[str]:
        return self._read(name, [], lambda v: [str(x) for x in v] if isinstance(v, list) else [str(v)])

    def bytes(self, name: str, default: int = 0) -> int:
        """A number with an optional SI or IEC unit."""

        def convert(v) -> int:
            m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*?)[bB]?\s*", str(v))
            if m is None or m[2].lower() not in UNITS:
                raise ValueError(v)
            return int(m[1]) * UNITS[m[2].lower()]

        return self._read(name, default, convert)

    def sub(self, name: str) -> Config:
        value = self.values.get(name)
        return Config(value if isinstance(value, dict) else {} if value is None else {NAME: value})


class Algorithm(ABC):
    """Something with a name, parameters and, under its slots, other algorithms."""

    name: str = ""
    slots: dict[str, type[Algorithm]] = {}

    def configure(self, config: Config) -> None:
        for slot, kind in self.slots.items():
            part = kind()
            part.configure(config.sub(slot))
            setattr(self, slot, part)

    @classmethod
    def signature(cls) -> dict:
        return {NAME: cls.name, **{slot: kind.signature() for slot, kind in cls.slots.items()}}


class Executable(Algorithm):
    @abstractmethod
    def execute(self, df):
        """The result, a DataFrame, for an input DataFrame."""


def matches(signature: dict, config) -> bool:
    """Whether the configuration says all that the signature asks; a plain string names an algorithm without slots."""
    if not isinstance(config, dict):
        return set(signature) == {NAME} and config == signature[NAME]
    return all(config.get(k) == v if k == NAME else k in config and matches(v, config[k]) for k, v in signature.items())


def instances(template: Callable[..., type], *choices: list) -> list[type]:
    """The template applied to every combination of choices, the first varying slowest."""
    return [template(*c) for c in itertools.product(*choices)]


class Registry:
    """Executables in order of registration; the first whose signature matches is chosen."""

    def __init__(self):
        self.kinds: list[type[Executable]] = []
        self.defaults: dict = {}

    def default(self, kind: type[Executable]) -> None:
        """Parameters that hold where a command line says nothing."""
        self.defaults = kind.signature()

    def register(self, *kinds: type[Executable]) -> None:
        self.kinds += kinds

    def resolve(self, argv: list[str]) -> Executable:
        config = _over(self.defaults, parse_command_line(argv))
        for kind in self.kinds:
            if matches({k: v for k, v in kind.signature().items() if k != NAME}, config):
                chosen = kind()
                chosen.configure(Config(config))
                return chosen
        raise LookupError(f"no executable matches {argv}")


def _over(base: dict, more: dict) -> dict:
    out = dict(base)
    for k, v in more.items():
        out[k] = _over(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out
