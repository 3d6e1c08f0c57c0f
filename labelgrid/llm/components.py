"""Connected components of a link table; the general helper under the name that operators here use."""

from labelgrid.operators.components import components

__all__ = ["components"]
