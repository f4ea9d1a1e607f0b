"""Connected components, as the library has them."""

from wayfarer.operators.components import connected_components

__all__ = ["connected_components"]
