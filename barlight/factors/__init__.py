"""The factor catalogue; importing it registers all families."""

from . import derivatives, liquidity, momentum, volatility

__all__ = ["derivatives", "liquidity", "momentum", "volatility"]
