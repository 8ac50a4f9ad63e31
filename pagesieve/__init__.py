"""Page intelligence on Spark: snapshots of web pages in, verified records out."""
