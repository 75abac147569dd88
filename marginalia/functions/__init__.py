"""Column expressions and the small Python functions behind them."""
