"""Which datasets a command is about."""

from __future__ import annotations

from collections.abc import Collection, Sequence


def resolved(asked: Sequence[str], built: Sequence[str]) -> list[str]:
    """The asked names, all that are built if none is; an unknown name is an error."""
    unknown = [n for n in asked if n not in built]
    if unknown:
        raise ValueError(f"not built: {', '.join(unknown)}")
    return list(asked) if asked else sorted(built)


def for_training(asked: Sequence[str], built: Sequence[str], benchmarks: Collection[str], with_benchmarks: bool = False) -> list[str]:
    """Names to train on: benchmarks only with ``with_benchmarks``; to name one without it is an error."""
    named = [n for n in asked if n in benchmarks]
    if named and not with_benchmarks:
        raise ValueError(f"held out as benchmarks: {', '.join(named)}")
    return [n for n in resolved(asked, built) if with_benchmarks or n not in benchmarks]
