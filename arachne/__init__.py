"""Web-crawl analytics and data preparation, written for Spark's DataFrame API."""
