"""Budgets, window options and named profiles."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrow.functions.text import utf16_length


class BudgetError(ValueError):
    pass


def _ratio(name: str, value: float) -> None:
    if not (isinstance(value, (int, float)) and math.isfinite(value) and 0 < value <= 1):
        raise BudgetError(f"{name} must lie in (0, 1]")


@dataclass(frozen=True)
class Budget:
    max_tokens: int = 100_000
    compaction: float = 0.80
    emergency: float | None = None
    tolerance: float = 0.05

    def __post_init__(self) -> None:
        if self.max_tokens <= 0:
            raise BudgetError("max_tokens must be positive")
        _ratio("compaction", self.compaction)
        if self.emergency is not None:
            _ratio("emergency", self.emergency)
            if not self.emergency > self.compaction:
                raise BudgetError("emergency must be over compaction")
        if not (math.isfinite(self.tolerance) and 0 <= self.tolerance <= 1):
            raise BudgetError("tolerance must lie in [0, 1]")

    @property
    def compaction_trigger(self) -> int:
        return math.floor(self.max_tokens * float(self.compaction))

    @property
    def emergency_trigger(self) -> int | None:
        return None if self.emergency is None else math.floor(self.max_tokens * float(self.emergency))

    @property
    def tolerance_tokens(self) -> int:
        return math.floor(self.max_tokens * float(self.tolerance))


    def limits(self, max_tokens: Column, name: str) -> Column:
        """profile, max_tokens, trigger, emergency and tolerance for windows of other sizes under the same ratios."""
        part = lambda ratio, of: (F.floor(max_tokens * F.lit(float(ratio))) if ratio is not None else F.lit(None)).cast("long").alias(of)
        return F.struct(F.lit(name).alias("profile"), max_tokens.cast("long").alias("max_tokens"), part(self.compaction, "trigger"), part(self.emergency, "emergency"), part(self.tolerance, "tolerance"))


#: Fixed value: what a masked result says unless told otherwise.
DEFAULT_PLACEHOLDER = "[Tool result cleared — {0}, {1}]"


@dataclass(frozen=True)
class WindowOptions:
    size: int = 10
    fraction: float = 0.80
    placeholder: str = DEFAULT_PLACEHOLDER

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise BudgetError("window size must be positive")
        if not 0 < self.fraction < 1:
            raise BudgetError("fraction must lie in (0, 1)")
        if not self.placeholder or not self.placeholder.strip():
            raise BudgetError("placeholder must not be blank")
        placeholder_parts(self.placeholder)


def placeholder_parts(template: str) -> list[str | int | tuple[int, int]]:
    """The template as literal strings and argument numbers, with the width where one is given (`{0,-8}`). `{{` and `}}` stand for braces."""
    parts: list[str | int | tuple[int, int]] = []
    argument = r"\{([01])(?:, *(-?\d{1,6}) *)?\}"
    for literal, number, width in re.findall(rf"((?:\{{\{{|\}}\}}|[^{{}}])+)|{argument}", template):
        parts.append(literal.replace("{{", "{").replace("}}", "}") if literal else (int(number), int(width)) if width else int(number))
    rest = re.sub(rf"\{{\{{|\}}\}}|{argument}", "", template)
    if "{" in rest or "}" in rest:
        raise BudgetError(f"placeholder {template!r} is not a format of {{0}} and {{1}}")
    return parts


def placeholder(template: str, name: Column, call_id: Column) -> Column:
    """The template with its arguments; one shorter than its width is filled with spaces, on the left or, for a width under 0, on the right."""

    def filled(part: str | int | tuple[int, int]) -> Column:
        if isinstance(part, str):
            return F.lit(part)
        number, width = part if isinstance(part, tuple) else (part, 0)
        value = (name, call_id)[number]
        if not width:
            return value
        blank = F.repeat(F.lit(" "), F.greatest(F.lit(abs(width)) - utf16_length(value), F.lit(0)))
        return F.concat(blank, value) if width > 0 else F.concat(value, blank)

    return F.concat(*map(filled, placeholder_parts(template)))


@dataclass(frozen=True)
class Profile:
    name: str
    budget: Budget = field(default_factory=Budget)
    window: WindowOptions = field(default_factory=WindowOptions)

    def column(self) -> Column:
        b, w = self.budget, self.window
        value = lambda v, kind, name: F.lit(v).cast(kind).alias(name)
        return F.struct(
            value(self.name, "string", "profile"), value(b.max_tokens, "long", "max_tokens"), value(b.compaction_trigger, "long", "trigger"),
            value(b.emergency_trigger, "long", "emergency"), value(b.tolerance_tokens, "long", "tolerance"), value(w.size, "int", "window_size"), value(w.fraction, "double", "fraction"),
        )


class ProfileBuilder:
    """Fluent construction; the maximum has to be given."""

    def __init__(self, name: str = "default"):
        self._name, self._budget, self._window = name, {}, WindowOptions()

    @classmethod
    def default(cls, max_tokens: int = 100_000) -> ProfileBuilder:
        return cls().with_max_tokens(max_tokens)

    def _with(self, key: str, value) -> ProfileBuilder:
        if value is None:
            raise BudgetError(f"{key} must not be null")
        self._budget[key] = value
        return self

    def with_max_tokens(self, value: int) -> ProfileBuilder:
        return self._with("max_tokens", value)

    def with_compaction(self, value: float) -> ProfileBuilder:
        return self._with("compaction", value)

    def with_emergency(self, value: float) -> ProfileBuilder:
        return self._with("emergency", value)

    def with_tolerance(self, value: float) -> ProfileBuilder:
        return self._with("tolerance", value)

    def with_window(self, options: WindowOptions) -> ProfileBuilder:
        if options is None:
            raise BudgetError("window must not be null")
        self._window = options
        return self

    def build(self) -> Profile:
        if "max_tokens" not in self._budget:
            raise BudgetError("max_tokens is required")
        return Profile(self._name, Budget(**self._budget), self._window)


class ProfileRegistry:
    """Named profiles; the last registration of a name holds, and asking for an unknown name is an error."""

    def __init__(self) -> None:
        self._profiles: dict[str, Profile] = {}

    def register(self, profile: Profile, name: str | None = None) -> ProfileRegistry:
        key = name or profile.name
        if not key.strip():
            raise BudgetError("a profile needs a name")
        self._profiles[key] = replace(profile, name=key)
        return self

    def get(self, name: str = "default") -> Profile:
        if name not in self._profiles:
            raise KeyError(f"no profile named {name!r}")
        return self._profiles[name]

    def all(self) -> list[Profile]:
        return list(self._profiles.values())
