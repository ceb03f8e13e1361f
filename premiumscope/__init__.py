"""Pricing-portfolio analytics as Spark DataFrame operators."""

from premiumscope.spec import PortfolioSpec

__all__ = ["PortfolioSpec"]
