"""Whole requests (scan, backtest) put together from the operators."""
