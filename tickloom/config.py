"""Column-name configuration. Driver-side only: names are read while a plan is built and never inside executors."""

from __future__ import annotations

from contextlib import ContextDecorator
from contextvars import ContextVar

_COLUMNS = ("open", "high", "low", "close", "size", "timestamp", "symbol", "price")
_overrides: ContextVar[dict[str, str]] = ContextVar("tickloom_columns", default={})  # noqa: B039 - never mutated


class Config(ContextDecorator):
    """Column names, per context: ``Config.set(price_column="px")``, ``with Config(...)`` or ``@Config(...)``."""

    def __init__(self, **options: str) -> None:
        self._options = options
        self._tokens: list = []

    def __enter__(self) -> Config:
        self._tokens.append(_overrides.set(_overrides.get() | self._options))
        return self

    def __exit__(self, *exc: object) -> None:
        _overrides.reset(self._tokens.pop())

    @classmethod
    def set(cls, **options: str) -> type[Config]:
        """Merge options into the current context; names that no operator reads are kept without complaint."""
        _overrides.set(_overrides.get() | options)
        return cls

    @classmethod
    def get(cls, option: str) -> str:
        """The configured value of ``<name>_column``, else the default. A bare ``<name>`` always gives the default."""
        default = option.removesuffix("_column")
        return _overrides.get().get(option, default if default in _COLUMNS else "")

    @classmethod
    def reset(cls) -> type[Config]:
        _overrides.set({})
        return cls


def _setter(name: str):
    def set_column(cls, value: str) -> type[Config]:
        return cls.set(**{f"{name}_column": value})

    set_column.__doc__ = f"Set the name of the {name} column."
    return classmethod(set_column)


for _name in _COLUMNS:
    setattr(Config, f"set_{_name}_column", _setter(_name))


class ColumnNames:
    """``column_names.price`` and ``column_names.price_column`` look the name up at the time of access; unknown: ``""``."""

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return Config.get(name if name.endswith("_column") else f"{name}_column")


column_names = ColumnNames()
