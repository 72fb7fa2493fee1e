"""From query text to a DataFrame."""
