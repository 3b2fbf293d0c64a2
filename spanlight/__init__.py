"""Evidence analytics on Spark: segment, match, rank, tier, audit and measure, as DataFrame plans."""
