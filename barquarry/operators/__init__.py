"""DataFrame-to-DataFrame operators: indicators, rules, scan, trades, summaries."""
