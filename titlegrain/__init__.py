"""titlegrain: title-register analytics on Spark (DataFrame in, DataFrame out)."""
