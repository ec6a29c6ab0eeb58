"""Release-resolution analytics and large-corpus preparation on Spark."""
