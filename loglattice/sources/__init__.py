"""Where lines and rows come from."""
