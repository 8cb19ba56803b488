"""Declared parameters: types and bounds, choices, and rules between parameters, as plain predicates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Interval:
    """Numbers of a type between bounds; closed is left, right, both or neither; None is no bound."""

    type: type
    low: float | None = None
    high: float | None = None
    closed: str = "both"

    def holds(self, v: Any) -> bool:
        if isinstance(v, bool) or not isinstance(v, (int,) if self.type is int else (int, float)):
            return False
        left = self.low is None or (v >= self.low if self.closed in ("both", "left") else v > self.low)
        return left and (self.high is None or (v <= self.high if self.closed in ("both", "right") else v < self.high))

    def __str__(self) -> str:
        return f"{self.type.__name__} from {self.low} to {self.high} ({self.closed} closed)"


@dataclass(frozen=True)
class Options:
    values: tuple

    def holds(self, v: Any) -> bool:
        return any(v is x or (type(v) is type(x) and v == x) for x in self.values)

    def __str__(self) -> str:
        return " or ".join(map(repr, self.values))


@dataclass(frozen=True)
class HasType:
    types: tuple[type, ...]

    def holds(self, v: Any) -> bool:
        return isinstance(v, self.types)

    def __str__(self) -> str:
        return " or ".join(t.__name__ for t in self.types)


@dataclass(frozen=True)
class Callable_:
    def holds(self, v: Any) -> bool:
        return callable(v)

    def __str__(self) -> str:
        return "a callable"


@dataclass(frozen=True)
class Param:
    """A parameter takes what any of its constraints holds for, and None if nullable."""

    name: str
    any_of: tuple
    nullable: bool = False
    hint: str = ""

    def problem(self, v: Any) -> str | None:
        if (v is None and self.nullable) or any(c.holds(v) for c in self.any_of):
            return None
        return f"{self.name} = {v!r}: must be {' or '.join(map(str, self.any_of))}" + " or None" * self.nullable


@dataclass(frozen=True)
class Rule:
    """A condition between parameters, such as exclusion or dependence."""

    holds: Callable[[Any], bool]
    message: str

    def problem(self, owner: Any) -> str | None:
        return None if self.holds(owner) else self.message


def exclusive(*names: str) -> Rule:
    return Rule(lambda o: sum(getattr(o, n) is not None for n in names) <= 1, f"at most one of {', '.join(names)} may be given")


def required_if(condition: Callable[[Any], bool], name: str, when: str) -> Rule:
    return Rule(lambda o: not condition(o) or getattr(o, name) is not None, f"{name} is needed when {when}")


@dataclass(frozen=True)
class DataBound:
    """A bound that depends on the data, such as a width below the number of points."""

    name: str
    limit: Callable[[int, int], float]
    text: str

    def problem(self, owner: Any, n: int, d: int) -> str | None:
        v = getattr(owner, self.name)
        return None if v is None or not isinstance(v, (int, float)) or v <= self.limit(n, d) else f"{self.name} = {v!r}: must be at most {self.text}"


def check(owner: Any, n: int | None = None, d: int | None = None) -> None:
    found = []
    for p in owner.PARAMS:
        if isinstance(p, Param):
            found.append(p.problem(getattr(owner, p.name)))
        elif isinstance(p, Rule):
            found.append(p.problem(owner))
        elif n is not None:
            found.append(p.problem(owner, n, d))
    if found := [x for x in found if x]:
        raise ValueError(f"{type(owner).__name__}: " + "; ".join(found))


def hints(cls: type) -> list[dict[str, Any]]:
    """What an interface needs to ask for the parameters: name, default, allowed values, whether None is allowed."""
    fields = cls.__dataclass_fields__
    return [{"name": p.name, "default": fields[p.name].default, "allowed": [str(c) for c in p.any_of], "nullable": p.nullable, "hint": p.hint} for p in cls.PARAMS if isinstance(p, Param)]


def integer(name: str, low: int | None = 1, high: int | None = None, nullable: bool = False) -> Param:
    return Param(name, (Interval(int, low, high),), nullable)


def real(name: str, low: float | None = 0, high: float | None = None, closed: str = "both", nullable: bool = False) -> Param:
    return Param(name, (Interval(float, low, high, closed),), nullable)


def choice(name: str, *values: Any, nullable: bool = False) -> Param:
    return Param(name, (Options(values),), nullable)
