"""Typed parameters, checked before a plan is made."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

TYPES = {"string": str, "integer": int, "boolean": bool, "number": (int, float), "array": (list, tuple)}


class InvalidArgument(ValueError):
    error_type = "invalid_argument"


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    default: Any = None
    required: bool = False
    enum: tuple | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None

    def problems(self, value: Any) -> list[str]:
        if value is None:
            return [f"{self.name} is required"] if self.required else []
        wrong = not isinstance(value, TYPES[self.type]) or (isinstance(value, bool) and self.type in ("integer", "number")) or value != value
        if wrong:
            return [f"{self.name} must be of type {self.type}"]
        out = []
        if self.enum is not None and value not in self.enum:
            out.append(f"{self.name} must be one of {', '.join(map(str, self.enum))}")
        if self.minimum is not None and value < self.minimum:
            out.append(f"{self.name} must be at least {self.minimum}")
        if self.maximum is not None and value > self.maximum:
            out.append(f"{self.name} must be at most {self.maximum}")
        if self.min_length is not None and len(value) < self.min_length:
            out.append(f"{self.name} must have a length of at least {self.min_length}")
        if self.max_length is not None and len(value) > self.max_length:
            out.append(f"{self.name} must have a length of at most {self.max_length}")
        return out


def bind(params: tuple[Param, ...], given: dict[str, Any]) -> dict[str, Any]:
    """Given values over defaults. All problems are reported at once."""
    known = {p.name for p in params}
    problems = [f"unknown parameter {k}" for k in given if k not in known]
    values = {p.name: given.get(p.name, p.default) for p in params}
    for p in params:
        problems += p.problems(values[p.name])
    if problems:
        raise InvalidArgument("; ".join(problems))
    return values
