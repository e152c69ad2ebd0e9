"""Functions that a mapping may execute, by IRI."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register_function(iri: str, make: Callable[..., Column]) -> None:
    """make(inputs) gives the Column from those of the parameters, by IRI; make() may take none. What depends on no row is evaluated once a query."""
    _FUNCTIONS[iri] = make


def known_function(iri: str) -> bool:
    return iri in _FUNCTIONS


def call_function(iri: str, inputs: Mapping[str, Column]) -> Column:
    make = _FUNCTIONS[iri]
    return make(dict(inputs)) if inspect.signature(make).parameters else make()


register_function("http://users.ugent.be/~bjdmeest/function/grel.ttl#date_now", lambda: F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSxxx"))
