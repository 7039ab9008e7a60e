"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst inlines a named expression at every reference, so an input used
    several times by a function (a split, an extract and a fallback of the
    same text) would repeat all the regex work feeding it. A one-element
    ``transform`` binds the value instead.
    """
    return F.transform(F.array(value), body)[0]
