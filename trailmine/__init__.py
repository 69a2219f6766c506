"""trailmine: mining of event logs with Spark DataFrames."""
