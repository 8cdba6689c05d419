"""Columns and the plain Python behind them: decoding, canonical trees, rendering, digests."""
