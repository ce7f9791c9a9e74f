"""Connected components, as the engine's graph operators have them."""

from ..operators.components import components

__all__ = ["components"]
