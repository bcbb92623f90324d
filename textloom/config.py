"""Search policy as immutable values, with overrides from text (environment or files) coerced by type."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class SearchPolicy:
    size: int = 10
    start: int = 0
    expand_results: int = 0
    penalty: str = "by-query-size"
    normalize: bool = True
    separate_clauses: bool = False
    cross_links: int = 5
    max_ranked: int = 3
    prune_terms: int = 128
    widest_term: float = 0.4
    least_part: float = 0.25
    slop: int = 0
    cut_query: int = 0  # first words of a query that are searched; 0: all
    excludes: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()

    def with_text(self, values: Mapping[str, str]) -> SearchPolicy:
        """A copy with values given as text, coerced to the field's type; unknown names are refused."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        unknown = set(values) - set(kinds)
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **{k: coerce(v, kinds[k]) for k, v in values.items()})

    def excluding(self, *columns: str) -> SearchPolicy:
        """Columns left out of answers, joined with those configured, each once."""
        return replace(self, excludes=tuple(dict.fromkeys((*self.excludes, *columns))))


def coerce(text: str, kind: type):
    if kind is bool:
        return text.strip().lower() in ("true", "1", "t", "y", "yes", "on")
    if kind is tuple:
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return kind(text)


def from_environment(prefix: str = "TEXTLOOM_", environment: Mapping[str, str] | None = None) -> SearchPolicy:
    env = os.environ if environment is None else environment
    names = {f.name for f in fields(SearchPolicy)}
    return SearchPolicy().with_text({k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix) and k[len(prefix) :].lower() in names})
