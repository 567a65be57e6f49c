"""Plans of the time-series engine."""
