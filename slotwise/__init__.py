"""slotwise: industrial time series on a regular slot grid, as lazy Spark plans."""
